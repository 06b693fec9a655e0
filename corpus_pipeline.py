"""From raw documents to packed sequences: five stages, each written and read again.

Stages know a row by its place in the files of their input, not by its id: rows with
a null or a repeated doc_id are judged each by itself, of equal rows one stays,
and of two texts under one id only the one that fails is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm import leaks, near, packing, quality, secrets
from rolesift.llm.common import shared_dir, shipped, table, written

#: Row numbers and file names that are broadcast; more are joined by exchange.
BROADCAST_ROWS = 1_000_000
#: Rows that one file may have.
FILE_ROWS = 1 << 40


def numbered(docs: DataFrame) -> DataFrame:
    """All columns and ``_row``, a number that each row has in every reading of the same files."""
    try:
        paths = docs.select(F.col("_metadata.file_path").alias("_file"))
    except AnalysisException:  # no files of its own yet
        return numbered(written(docs))
    # A row for each file.
    first = (F.row_number().over(Window.orderBy("_file")) - 1).cast("long") * FILE_ROWS
    known = written(paths.distinct().withColumn("_first", first))
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    return placed.join(bounded(known), "_file").withColumn("_row", F.col("_first") + F.col("_index")).drop("_file", "_first", "_index")


def bounded(rows: DataFrame) -> DataFrame:
    """Written rows of a few bytes each, to be broadcast if they are ``BROADCAST_ROWS`` at most."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose number is not in ``gone``."""
    return rows.join(bounded(written(gone.select("_row"))), "_row", "left_anti").select(columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's limit."""
    rows = numbered(docs)
    judged = quality.judge(rows.select(F.col("_row").alias("doc_id"), "text", "lang", "source"))
    return without(rows, judged.where("not kept").select(F.col("doc_id").alias("_row")), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id: five-word shingles, similarity 0.8 or more."""
    shipped(spark)
    rows = numbered(docs)
    groups = near.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), width=5, percent=80)
    groups = written(groups.select(F.col("doc_id").alias("_row"), "component_id"))
    # Groups of one need no choice; null ids come last.
    shared = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = groups.join(shared, "component_id", "left_semi").join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = members.groupBy("component_id").agg(F.min(order).alias("x")).select(F.col("x._row").alias("_row"))
    return without(rows, members.select("_row").join(first, "_row", "left_anti"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return leaks.decontaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text masked."""
    shipped(spark)
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    shipped(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The stages fit models and iterate to a fixed point; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
