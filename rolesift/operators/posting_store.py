"""M1-M4, M7 on a stored table: work and writes in proportion to the batch.

The store holds three tables in hash buckets, published version by version
(sources.buckets): ``postings`` by id, ``identities`` (a row for each key and URL of a
posting) by hashed value, and ``removed`` tombstones by key. A batch reads the
buckets of its own keys and URLs to find the postings it meets, then the buckets
of those postings, and writes the buckets it changed. ``runs`` gets the version's ledger row
last: a version is complete once it is there, and a run that is played again
reads the version before it and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import buckets
from . import chains, store
from .lineage import cut

LEDGER = """version long, run_id long, kind string, total_seen long, inserted_count long, updated_count long, skipped_removed_count long,
 net_new_count long, rediscovered_count long, duplicate_in_run_count long, trust_promoted_count long, greatest_id long"""
COUNTS = {
    "inserted_count": ("status", "inserted"), "updated_count": ("status", "updated"), "skipped_removed_count": ("status", "skipped_removed"),
    "net_new_count": ("discovery_state", "net_new"), "rediscovered_count": ("discovery_state", "rediscovered"),
    "duplicate_in_run_count": ("discovery_state", "duplicate_in_run"),
}


def identities(postings: DataFrame) -> DataFrame:
    """v (hashed key or URL) and the posting that has it."""
    return postings.select("posting_id", *chains.IDENTITY, F.explode(chains.identity_values()).alias("v"))


def create(postings: DataFrame, removed: DataFrame, root: str, n: int = 256) -> None:
    """Version 0; ``n`` buckets, so that one holds some hundred MB at most."""
    spark = postings.sparkSession
    buckets.create(postings, f"{root}/postings", "posting_id", n)
    buckets.create(identities(buckets.read(spark, f"{root}/postings", 0)), f"{root}/identities", "v", n)
    buckets.create(removed, f"{root}/removed", "duplicate_key", n)
    greatest = store.greatest_id(buckets.read(spark, f"{root}/postings", 0))
    _ledger(spark, root, 0, 0, "created", {}, greatest)


def _ledger(spark: SparkSession, root: str, version: int, run_id: int, kind: str, counts: dict, greatest: int) -> None:
    names = ["total_seen", *COUNTS, "trust_promoted_count"]
    row = (version, run_id, kind, *[counts.get(c, 0) for c in names], greatest)
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/version={version}")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """One row for each version."""
    return spark.read.schema(LEDGER).parquet(f"{root}/runs")


def postings(spark: SparkSession, root: str, version: int) -> DataFrame:
    return buckets.read(spark, f"{root}/postings", version)


def tombstones(spark: SparkSession, root: str, version: int) -> DataFrame:
    return buckets.read(spark, f"{root}/removed", version)


def _greatest(spark: SparkSession, root: str, version: int) -> int:
    return spark.read.schema("greatest_id long").parquet(f"{root}/runs/version={version}").first()[0]


def _reindex(spark: SparkSession, root: str, version: int, before: DataFrame, ids: DataFrame, only: list[int]) -> None:
    """Keys and URLs of the changed postings: the buckets of what they had and of what they have now."""
    after = buckets.read(spark, f"{root}/postings", version, only).join(ids, "posting_id", "left_semi")
    new = cut(identities(after))
    old = cut(identities(before.join(ids, "posting_id", "left_semi")))
    old, new = old.exceptAll(new), new.exceptAll(old)
    moved = cut(old.withColumn("gone", F.lit(True)).unionByName(new.withColumn("gone", F.lit(False))))
    touched, held = buckets.part(moved, "v", f"{root}/identities", version - 1)
    kept = held.join(moved.where("gone").drop("gone"), ["v", "posting_id", *chains.IDENTITY], "left_anti")
    buckets.publish(kept.unionByName(moved.where("not gone").drop("gone")), f"{root}/identities", version, touched)


def upsert(
    spark: SparkSession, root: str, batch: DataFrame, run_id: int, version: int, now: Column, at_once: int = chains.AT_ONCE
) -> DataFrame:
    """M1 as version ``version`` of the store; its outcomes, one row for each of the batch.

    ``batch`` has a unique `pos` of its own. The ledger row is written last.
    """
    last = version - 1
    coerced = cut(store.scored_batch(batch))
    gone = buckets.part(coerced.where("duplicate_key <> ''"), "duplicate_key", f"{root}/removed", last)[1]
    live, skipped = store.drop_tombstoned(coerced, gone)
    values = cut(live.select(F.explode(chains.identity_values()).alias("v")).distinct())
    met = buckets.part(values, "v", f"{root}/identities", last)[1].join(values, "v", "left_semi")
    known = cut(met.select("posting_id", *chains.IDENTITY).distinct())
    start = _greatest(spark, root, last)
    entities = cut(chains.assigned(live, known, start, at_once))
    ids = entities.select(F.col("entity").alias("posting_id")).distinct()
    only, part = buckets.part(ids, "posting_id", f"{root}/postings", last)
    result = store.apply_rows(part, live, entities, skipped, start, run_id, now)
    buckets.publish(result.snapshot, f"{root}/postings", version, only)
    _reindex(spark, root, version, part, ids, only)
    buckets.carry(spark, f"{root}/removed", version)
    outcomes = cut(result.outcomes)
    sums = outcomes.agg(
        F.count(F.lit(1)).alias("total_seen"),
        F.count_if("trust_promoted").alias("trust_promoted_count"),
        *[F.count_if(F.col(c) == v).alias(name) for name, (c, v) in COUNTS.items()],
    ).first()
    greatest = max(start, entities.agg(F.max("entity")).first()[0] or 0)
    _ledger(spark, root, version, run_id, "upsert", sums.asDict(), greatest)
    return outcomes


def change(
    spark: SparkSession, root: str, version: int, ids: DataFrame, job: Callable[[DataFrame], DataFrame], kind: str, run_id: int = 0
) -> None:
    """M2, M4, M7: ``job`` on the buckets that hold the given ids, as version ``version``."""
    ids = cut(ids.select("posting_id").distinct())
    only, part = buckets.part(ids, "posting_id", f"{root}/postings", version - 1)
    buckets.publish(job(part), f"{root}/postings", version, only)
    _reindex(spark, root, version, part, ids, only)
    buckets.carry(spark, f"{root}/removed", version)
    _ledger(spark, root, version, run_id, kind, {}, _greatest(spark, root, version - 1))


def mark_applied(spark: SparkSession, root: str, version: int, ids: DataFrame, today: str, now: Column) -> None:
    """M2 as a version."""
    change(spark, root, version, ids, lambda part: store.mark_applied(part, ids, today, now), "applied")


def apply_refresh(spark: SparkSession, root: str, version: int, refreshed: DataFrame, now: Column, form: str = "full") -> None:
    """M4 as a version."""
    change(spark, root, version, refreshed, lambda part: store.apply_refresh(part, refreshed, now, form), "refresh")


def remove(spark: SparkSession, root: str, version: int, ids: DataFrame, today: str, reason: str = "Removed in app") -> None:
    """M3 as a version: postings, their keys and URLs, and the tombstones."""
    last = version - 1
    ids = cut(ids.select("posting_id").distinct())
    only, part = buckets.part(ids, "posting_id", f"{root}/postings", last)
    keys = cut(part.join(ids, "posting_id", "left_semi").select("duplicate_key").distinct())
    marked, stones = buckets.part(keys, "duplicate_key", f"{root}/removed", last)
    after, tombs = store.remove_postings(part, stones, ids, today, reason)
    buckets.publish(after, f"{root}/postings", version, only)
    buckets.publish(tombs, f"{root}/removed", version, marked)
    _reindex(spark, root, version, part, ids, only)
    _ledger(spark, root, version, 0, "removed", {}, _greatest(spark, root, last))
