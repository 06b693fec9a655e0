"""S1-S4, S6-S8 and snapshots: what is read from and written to files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from . import json_lists

CONTRACT_VERSION = "1.0"
CONTRACT_FIELDS = [
    "company_name", "canonical_company_domain", "careers_url", "careers_url_status", "review_status", "ats_provider",
    "confidence_score", "last_validated_at", "confidence_reason", "is_primary_careers_url", "fortune_rank",
    "review_notes", "notes", "jobs_feed_url", "discovery_method", "source_url",
]
CASE_FIELDS = [
    "id", "expected_label", "title", "company", "location", "description_text", "target_titles", "preferred_locations",
    "remote_only", "notes",
]
CASE_SCHEMA = ", ".join(f"{f} string" for f in CASE_FIELDS)
SUMMARY_SCHEMA = """label string, created_at string, url_count long, seen_urls long, accepted_jobs long,
 skip_summary map<string,long>, drop_summary map<string,map<string,long>>"""


def read_url_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, url) of text lists; blanks and '#' lines dropped.

    pos is the line's byte-ordered place: unique and increasing per file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("pos"),
        strip(F.col("value")).alias("url"),
    )
    return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_endpoint_contract(spark: SparkSession, path: str | list[str], version: str = CONTRACT_VERSION) -> DataFrame:
    """The contracts' records, all fields as text, with their position over all files.

    Fails when the version is missing or another, or records is no list.
    """
    records, outer = json_lists.read_objects(spark, path, "records")
    for text in outer.values():
        around = json.JSONDecoder().raw_decode(text.strip())[0]
        given = str(around.get("schema_version") or "").strip()
        if not given:
            raise ValueError("Import file is missing schema_version.")
        if given != version:
            raise ValueError(f"Unsupported schema_version {given}")
        if not isinstance(around.get("records"), list):
            raise ValueError("Import file must contain a records list.")
    parsed = records.select("pos", F.from_json("text", ", ".join(f"{f} string" for f in CONTRACT_FIELDS)).alias("r"))
    return parsed.select("pos", *[F.col(f"r.{f}").alias(f) for f in CONTRACT_FIELDS])


def read_labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """S3: labelled cases of a '.json' list or of JSON lines; '#' lines and
    anything that is no object are dropped."""
    if path.endswith(".json"):
        texts = json_lists.read_objects(spark, path)[0].select(F.col("text").alias("line"))
    else:
        lines = spark.read.text(path).select(strip(F.col("value")).alias("line"))
        texts = lines.filter(F.col("line").startswith("{"))
    return texts.select(F.from_json("line", CASE_SCHEMA).alias("c")).filter("c IS NOT NULL").select("c.*")


def _folder(column: Column) -> Column:
    return F.regexp_extract(column, r"([^/]+)/[^/]+$", 1)


def read_run_reports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(one row per report folder with all its settings, its URLs as rows)."""
    path = F.col("_metadata.file_path")
    summaries = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(f"{root}/*/summary.json")
    settings = spark.read.text(f"{root}/*/effective_settings.json", wholetext=True).withColumn("settings", F.from_json("value", "map<string,string>"))
    named = [F.coalesce(F.col("settings")[c], F.lit("")).alias(c) for c in ("target_titles", "preferred_locations")]
    rows = summaries.select(_folder(path).alias("report_id"), "*").join(
        settings.select(_folder(path).alias("report_id"), *named, "settings"), "report_id", "left"
    )
    lines = spark.read.text(f"{root}/*/urls.txt").select(_folder(path).alias("report_id"), strip(F.col("value")).alias("url"))
    return rows, lines.filter("url <> ''")


def append_run_ledger(summary: DataFrame, items: DataFrame, root: str, details: Sequence[str]) -> None:
    """Run rows (details as JSON) and their item rows, each in its run's own folder.

    A run that is written again replaces its rows and no others.
    """
    counted = [c for c in summary.columns if c not in details]
    rows = summary.select(*counted, F.to_json(F.struct(*details)).alias("details_json"))
    for frame, name in ((items, "run_items"), (rows, "runs")):
        by_run = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
        by_run.parquet(f"{root}/{name}")


def merge_run_details(runs: DataFrame, extra: DataFrame) -> DataFrame:
    """Further detail keys (run_id, key, value) merged into the JSON."""
    added = extra.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_extra"))
    joined = runs.join(added, "run_id", "left")
    empty = F.create_map().cast("map<string,string>")
    old = F.coalesce(F.from_json("details_json", "map<string,string>"), empty)
    more = F.coalesce("_extra", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(more, k))
    return joined.withColumn("details_json", F.to_json(F.map_concat(kept, more))).drop("_extra")


def write_ranked_list(df: DataFrame, column: str, order: Sequence[Column], path: str) -> None:
    """One value per line; part files hold consecutive ranges."""
    df.filter(F.col(column) != "").orderBy(*order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, columns: Sequence[str], path: str, fmt: str) -> None:
    """A fixed column list as JSON lines or as CSV with a header."""
    writer = df.select(*columns).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'json', not {fmt!r}")


def publish_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a table's next version beside the ones being read."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}")
