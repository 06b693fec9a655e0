"""Stored tables: what a job reads and writes, and the jobs against whole snapshots."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rolesift.operators import posting_store, store
from rolesift.sources import buckets
from tests.test_store import COLUMNS, NOW, batch_rows, empty_snapshot



def at():
    return F.lit(NOW).cast("timestamp")
STONE = "removed_date string, duplicate_key string, company string, title string, location string, job_posting_url string, removal_reason string"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def written(root, table, version):
    path = f"{root}/{table}/data/v={version}"
    return sorted(x for x in os.listdir(path) if x.startswith("bucket=")) if os.path.isdir(path) else []


@pytest.fixture(scope="module")
def start(spark):
    removed = spark.createDataFrame([("2020-01-01", "key|3", "", "", "", "", "")], STONE)
    first = store.upsert_postings(empty_snapshot(spark), spark.createDataFrame(batch_rows(1), COLUMNS), removed, 1, at()).snapshot
    return spark.createDataFrame(first.collect(), first.schema), removed


@pytest.fixture()
def made(start, tmp_path):
    root = str(tmp_path / "s")
    posting_store.create(*start, root, 16)
    return root, *start


def test_tables_publish_only_what_changed(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(200).withColumn("x", F.lit("a"))
    buckets.create(df, root, "id", 8)
    some = buckets.read(spark, root, 0, [3, 5])
    assert 0 < some.count() < 200
    buckets.publish(some.withColumn("x", F.lit("b")), root, 1, [3, 5])
    buckets.publish(buckets.read(spark, root, 1, [5]).limit(0), root, 2, [5])
    buckets.carry(spark, root, 3)
    assert written(tmp_path, "t", 1) == ["bucket=3", "bucket=5"] and written(tmp_path, "t", 2) == []
    count = lambda v: buckets.read(spark, root, v).count()
    fives = buckets.read(spark, root, 0, [5]).count()
    assert (count(0), count(1), count(2), count(3)) == (200, 200, 200 - fives, 200 - fives)
    assert buckets.read(spark, root, 3).filter("x = 'b'").count() == buckets.read(spark, root, 0, [3]).count()
    assert buckets.read(spark, root, 0).filter("x = 'b'").count() == 0
    assert buckets.read(spark, root, 3, [5]).count() == 0


def test_one_row_rewrites_one_bucket(spark, made):
    root, first, removed = made
    (old,) = [r for r in first.collect() if r.duplicate_key == "key|5"]
    batch = spark.createDataFrame([(0, old.company, "new title", old.job_posting_url, "", "", "", "", "key 5")], COLUMNS)
    outcomes = posting_store.upsert(spark, root, batch, 2, 1, at())
    assert [(r.status, r.job_id) for r in outcomes.collect()] == [("updated", old.posting_id)]
    assert len(written(root, "postings", 1)) == 1 and written(root, "identities", 1) == [] and written(root, "removed", 1) == []
    assert rows_of(posting_store.postings(spark, root, 1)) == rows_of(store.upsert_postings(first, batch, removed, 2, at()).snapshot)
    # A row of its own goes to one bucket too.
    batch = spark.createDataFrame([(0, "Other", "t", "https://b.com/1", "", "", "", "", "other")], COLUMNS)
    posting_store.upsert(spark, root, batch, 3, 2, at())
    assert len(written(root, "postings", 2)) == 1 and 1 <= len(written(root, "identities", 2)) <= 3


def test_batches_match_whole_snapshots(spark, made):
    root, whole, removed = made
    rnd = random.Random(5)
    for version in (1, 2):
        rows = [(p, "A", f"t{p}", f"https://a.com/{rnd.randrange(30)}", "", "", "", "", f"key {rnd.randrange(30)}") for p in range(25)]
        batch = spark.createDataFrame(rows, COLUMNS)
        result = store.upsert_postings(whole, batch, removed, version + 1, at())
        got = posting_store.upsert(spark, root, batch, version + 1, version, at())
        assert rows_of(got) == rows_of(result.outcomes)
        whole = spark.createDataFrame(result.snapshot.collect(), result.snapshot.schema)
        stored = posting_store.postings(spark, root, version)
        assert rows_of(stored) == rows_of(whole)
        index = buckets.read(spark, f"{root}/identities", version)
        assert rows_of(index) == rows_of(posting_store.identities(stored))
    # Played again, from the version before.
    posting_store.upsert(spark, root, batch, 3, 2, at())
    assert rows_of(posting_store.postings(spark, root, 2)) == rows_of(whole)
    (row,) = posting_store.ledger(spark, root).filter("version = 2").collect()
    assert row.total_seen == 25 and row.inserted_count + row.updated_count + row.skipped_removed_count == 25


def test_changes_by_id(spark, made):
    root, first, removed = made
    some = [r.posting_id for r in first.collect()][:2]
    ids = spark.createDataFrame([(i,) for i in some], "posting_id long")
    posting_store.mark_applied(spark, root, 1, ids, "2026-01-01", at())
    whole = store.mark_applied(first, ids, "2026-01-01", at())
    assert rows_of(posting_store.postings(spark, root, 1)) == rows_of(whole)
    assert 1 <= len(written(root, "postings", 1)) <= 2
    whole = spark.createDataFrame(whole.collect(), whole.schema)

    refreshed = ids.withColumns({"job_posting_url": F.lit("https://new.com/1"), "canonical_job_posting_url": F.lit("https://new.com/1"), "scored": F.lit(True), "refresh_status": F.lit("ok")})
    posting_store.apply_refresh(spark, root, 2, refreshed, at())
    whole = store.apply_refresh(whole, refreshed, at())
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    assert rows_of(posting_store.postings(spark, root, 2)) == rows_of(whole)

    posting_store.remove(spark, root, 3, ids, "2026-01-02")
    after, stones = store.remove_postings(whole, removed, ids, "2026-01-02")
    stored = posting_store.postings(spark, root, 3)
    assert rows_of(stored) == rows_of(after) and rows_of(posting_store.tombstones(spark, root, 3)) == rows_of(stones)
    assert rows_of(buckets.read(spark, f"{root}/identities", 3)) == rows_of(posting_store.identities(stored))
    # A removed key stays out.
    gone = first.filter(F.col("posting_id") == some[0]).first()
    batch = spark.createDataFrame([(0, "A", "t", "", "", "", "", "", gone.duplicate_key)], COLUMNS)
    assert [r.status for r in posting_store.upsert(spark, root, batch, 9, 4, at()).collect()] == ["skipped_removed"]
