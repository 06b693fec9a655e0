"""Streamed runs, and runs played again."""

import json

from pyspark.sql import functions as F

from rolesift.operators import posting_store
from rolesift.sources import buckets
from rolesift.streaming.ingest import incremental_ingest, ingest_run, start_store
from tests.test_store import COLUMNS, batch_rows, by_rows, empty_snapshot

SCHEMA = COLUMNS + ", location string, ats_type string"
TIMES = ["first_seen_at", "last_seen_at", "last_page_refresh_at", "last_score_refresh_at", "updated_at"]


def batch(spark, seed):
    return spark.createDataFrame(batch_rows(seed), COLUMNS).withColumns({"location": F.lit(""), "ats_type": F.lit("Unknown")})


def runs(spark, root):
    return {r.run_id: r for r in spark.read.parquet(f"{root}/runs").collect()}


def stored(spark, root, version):
    return sorted(map(str, posting_store.postings(spark, f"{root}/store", version).drop(*TIMES).collect()))


def test_runs_and_replay(spark, tmp_path):
    root, source = str(tmp_path / "store"), str(tmp_path / "in")
    removed = spark.createDataFrame([("key|3",)], "duplicate_key string")
    stones = removed.select(F.lit("").alias("removed_date"), "duplicate_key", *[F.lit("").alias(c) for c in ("company", "title", "location", "job_posting_url", "removal_reason")])
    start_store(empty_snapshot(spark), stones, root, 8)
    for seed in (1, 2):
        batch(spark, seed).coalesce(1).write.mode("append").parquet(source)
        incremental_ingest(spark, source, SCHEMA, root, str(tmp_path / "cp")).awaitTermination()
    after = posting_store.postings(spark, f"{root}/store", 2)
    assert after.agg(F.max("last_seen_run_id")).first()[0] == 2
    assert after.filter("duplicate_key = 'key|3'").count() == 0

    # The ledger against a row-by-row store over what W1 leaves of each batch.
    state, ledger = {}, runs(spark, root)
    for run in (1, 2):
        first = {}
        for row in batch_rows(run):
            first.setdefault(row[-1], row)
        want = by_rows(state, list(first.values()), {"key|3"}, run)
        statuses = [s for s, _, _ in want.values()]
        row = ledger[run]
        assert (row.total_seen, row.inserted_count, row.updated_count, row.skipped_removed_count) == (
            len(want), statuses.count("inserted"), statuses.count("updated"), statuses.count("skipped_removed")
        )
        details = json.loads(row.details_json)
        assert details["dropped_duplicates"] == 60 - len(want) and details["net_new_count"] == statuses.count("inserted")
    items = spark.read.parquet(f"{root}/run_items")
    assert items.filter("run_id = 2 AND message = 'rediscovered'").count() > 0
    assert items.filter("item_value LIKE 'https://a.com/%'").count() == items.count()

    before = stored(spark, root, 2), sorted(map(str, items.collect())), ledger, sorted(map(str, buckets.read(spark, f"{root}/source_registry", 2).select("source_key", "seen_count").collect()))
    for batch_id in (0, 1):
        ingest_run(batch(spark, batch_id + 1), batch_id, root)
    again = spark.read.parquet(f"{root}/run_items")
    assert before == (stored(spark, root, 2), sorted(map(str, again.collect())), runs(spark, root), sorted(map(str, buckets.read(spark, f"{root}/source_registry", 2).select("source_key", "seen_count").collect())))
