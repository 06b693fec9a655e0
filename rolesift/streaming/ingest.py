"""Run-by-run ingest as a file stream.

Each micro-batch is one run: its duplicates go (W1), tombstoned rows are skipped (J2),
the rest is stored (M1), the sources are counted (A7) and the run gets its
ledger and item rows (S6). The store and the registry are tables in hash buckets, so a run reads
and writes what its rows touch. Run k reads version k - 1 and publishes version k,
whatever is there already: a run that is played again, after a failure in any place
or with the stream's checkpoint lost, leaves everything as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics, posting_store
from ..operators.dedupe import dedupe_batch
from ..operators.lineage import cut, spread
from ..sources import buckets
from ..sources.files import append_run_ledger

DETAILS = ["net_new_count", "rediscovered_count", "duplicate_in_run_count", "trust_promoted_count", "dropped_duplicates", "top_source", "dominant"]


def start_store(postings: DataFrame, removed: DataFrame, root: str, n: int = 256, registry: DataFrame | None = None) -> None:
    """Version 0 of the store and of the source registry."""
    posting_store.create(postings, removed, f"{root}/store", n)
    if registry is None:
        first = postings.limit(0).withColumns({"pos": F.col("posting_id"), "_at": F.col("updated_at")})
        registry = metrics.build_source_registry(first, "pos", "_at")
    buckets.create(registry, f"{root}/source_registry", "source_key", n)


def ingest_run(
    batch: DataFrame, batch_id: int, root: str, now: Column | None = None, source_name: str = "stream", source_detail: str = "", run_type: str = "ingest_jobs"
) -> None:
    """One micro-batch as run ``batch_id + 1``; ``batch`` has a unique `pos`.

    The registry and the items are published before the run's ledger row, so a run
    that is in the ledger is whole.
    """
    spark = batch.sparkSession
    run = batch_id + 1
    at = F.current_timestamp() if now is None else now
    rows = cut(dedupe_batch(spread(batch)).drop("batch_key"))
    once = rows.drop("duplicates")
    outcomes = posting_store.upsert(spark, f"{root}/store", once, run, run, at)

    fresh = cut(metrics.build_source_registry(once.withColumn("_at", at), "pos", "_at", None, source_name, source_detail))
    touched, old = buckets.part(fresh, "source_key", f"{root}/source_registry", run - 1)
    buckets.publish(metrics.merge_registry(fresh, old), f"{root}/source_registry", run, touched)

    yields = metrics.source_yield(once.withColumn("_run", F.lit(run)), "pos", "_run")
    dominance = metrics.source_dominance(yields, "_run").select("top_source", F.col("flag").alias("dominant"))
    stored = posting_store.ledger(spark, f"{root}/store").where(F.col("version") == run)
    labels = {"run_type": run_type, "source_name": source_name, "source_detail": source_detail, "status": "completed"}
    summary = stored.select("run_id", *[F.lit(v).alias(k) for k, v in labels.items()], *[c for c in stored.columns if c.endswith("_count") or c == "total_seen"])
    dropped = rows.agg(F.coalesce(F.sum("duplicates"), F.lit(0)).alias("dropped_duplicates"))
    summary = summary.withColumns({"skipped_invalid_count": F.lit(0).cast("long"), "error_count": F.lit(0).cast("long")})
    summary = summary.join(dropped, F.lit(True)).join(dominance, F.lit(True), "left")
    append_run_ledger(summary, metrics.run_items(outcomes, once), root, DETAILS)


def incremental_ingest(
    spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, handler: Callable | None = None
) -> StreamingQuery:
    """Ingest the files of a folder that have not been ingested yet, one run each."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    step = handler or (lambda df, batch_id: ingest_run(df, batch_id, root))
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
