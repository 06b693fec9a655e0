"""Work on small files of many rows is dealt over tasks, and no expression is worked out once for each use."""

import pytest
from pyspark.sql import functions as F

from rolesift.operators import gates, pages, profiles
from rolesift.operators.lineage import spread
from rolesift.plans import derived as d
from rolesift.streaming import ingest


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_spread_deals_rows(spark):
    rows = spark.range(0, 100, 1, 1).withColumn("k", F.lit(None).cast("long"))
    dealt = spread(rows, 20)
    assert dealt.rdd.getNumPartitions() == 5
    assert max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 60
    assert sorted(dealt.collect()) == sorted(rows.collect())
    assert spread(rows, 100) is rows


@pytest.fixture
def tables(spark, tmp_path):
    orders = [(k, k % 4, "F", "5-LOW", "1996-01-02") for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string").withColumn(
        "o_orderdate", F.to_date("o_orderdate")
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"Co {k}") for k in range(4)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_large_tables_are_not_broadcast(spark, tables, monkeypatch):
    small = sorted(d.postings(spark, tables).collect())
    monkeypatch.setattr(d, "BROADCAST_ROWS", 3)
    rows = d.postings(spark, tables)
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert len(small) == 40 and sorted(rows.collect()) == small


def test_many_rows_of_one_file_are_many_tasks(spark, tmp_path):
    spark.range(0, 45_000, 1, 1).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = d.many_profiles(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3 and rows.select("profile_id").distinct().count() == 45_000


def test_url_parts_are_found_once(spark):
    rows = spark.createDataFrame([(1, "https://jobs.lever.co/org1/2"), (2, ""), (3, None)], "obs_id long, raw_url string")
    kept = gates.classify_source_url(rows).filter("keep")
    assert plan(kept).count("regexp_extract") <= 20
    assert [r.class_reason for r in kept.collect()] == ["lever_detail"]
    assert plan(gates.url_quality_gate(rows).filter("is_posting_url")).count("regexp_extract") <= 20


def test_title_groups_are_not_parsed_for_each_element(spark):
    group = '[{"main_title": "VP  of IT", "variants": [{"title": "CIO"}, {"title": "cio"}, {"title": "vp of it"}]}, {"main_title": "vp of IT"}]'
    rows = spark.createDataFrame([(1, group, "CTO"), (2, "[{", "CTO; Head"), (3, None, None)], "profile_id long, target_title_groups string, target_titles string")
    out = profiles.expand_title_groups(rows)
    # The array itself, and two tests that Spark adds before it explodes one.
    assert plan(out).count("from_json") <= 3
    got = sorted((r.profile_id, r.group_pos, r.main_title, r.pos, r.title) for r in out.collect())
    assert got == [(1, 0, "VP of IT", 0, "VP of IT"), (1, 0, "VP of IT", 1, "CIO"), (2, 0, "CTO", 0, "CTO"), (2, 1, "Head", 0, "Head")]


def test_feed_is_matched_once(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5, 0, True, True, "a"), (1, 2, 4, 0, True, True, "b"), (1, 1, 6, 0, True, True, "a"), (2, 1, 7, 0, False, True, "c"), (2, 2, 8, 0, True, True, "c")],
        "endpoint_id long, pass_no int, page_no long, pos int, title_ok boolean, place_ok boolean, detail_url string",
    )
    out = pages.flatten_feed(rows.withColumn("place_ok", F.col("place_ok") & F.col("detail_url").rlike("^[a-z]$")))
    assert "RLIKE" not in plan(out)
    assert sorted((r.endpoint_id, r.pass_no, r.page_no) for r in out.collect()) == [(1, 1, 5), (2, 2, 8)]


def test_one_file_of_a_run_is_many_tasks(spark, monkeypatch):
    class Seen(Exception):
        pass

    def dedupe(batch):
        raise Seen(batch.rdd.getNumPartitions(), batch.count())

    monkeypatch.setattr(ingest, "dedupe_batch", dedupe)
    with pytest.raises(Seen) as seen:
        ingest.ingest_run(spark.range(0, 45_000, 1, 1).withColumnRenamed("id", "pos"), 0, "/nowhere")
    assert seen.value.args == (3, 45_000)
