"""The registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, leaks, lexical, near, packing, preference, quality, repeats, runs, secrets, sentencepieces, toxicity, urls
from .common import shipped, table, words


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; learned without the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with a leaked passage."""
    return leaks.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and robust outlier verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under two-word shingles at 80 in a hundred."""
    return near.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), width=2, percent=80)


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation and its resampled rival."""
    return preference.pairs(*preference.resampled(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return repeats.without_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract.extract(pages, extract.train(pages))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their text again, as digests."""
    rows = sentencepieces.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The documents; those whose crc32(doc_id) ends in 0 repeat a stretch of their words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def periodic(w):
        n, g = F.size(w), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(again, 1, n - a)), " ")).otherwise("")

    made = F.get(F.transform(F.array(words(F.col("text"))), periodic), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and what is left without them."""
    docs = with_periods(table(spark, sf_dir, "documents", "doc_id", "text"))
    return runs.digests(runs.periodic_runs(docs, texts=False))


def _on_executors(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _on_executors(op1_toxicity),
    "op2_benchmark_leaks": _on_executors(op2_benchmark_leaks),
    "op3_url_filter": _on_executors(op3_url_filter),
    "op4_quality_rules": _on_executors(op4_quality_rules),
    "op5_near_duplicates": _on_executors(op5_near_duplicates),
    "op6_preference_pairs": _on_executors(op6_preference_pairs),
    "op7_repeated_passages": _on_executors(op7_repeated_passages),
    "op8_html_extraction": _on_executors(op8_html_extraction),
    "op9_secret_scan": _on_executors(op9_secret_scan),
    "op10_best_fit_packing": _on_executors(op10_best_fit_packing),
    "op11_sentencepiece": _on_executors(op11_sentencepiece),
    "op12_lexical_search": _on_executors(op12_lexical_search),
    "op13_periodic_runs": _on_executors(op13_periodic_runs),
}

#: The same results as SQL; what SQL cannot express is tested by brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op6_preference_pairs": preference.SQL,
    "op12_lexical_search": lexical.SQL,
}
