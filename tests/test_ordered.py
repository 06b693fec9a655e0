"""Running values and first rows against brute force, with a hot key."""

import random

from pyspark.sql import functions as F

from rolesift.operators import dedupe, ordered, ranking
from rolesift.operators.ordered import mark_first, ranked, top_n


def observations(n=400):
    rnd = random.Random(7)
    return [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}", i // 60, rnd.choice([None, 1.0])) for i in range(n)]


def test_sightings_and_states_match_a_row_by_row_pass(spark):
    rows = observations()
    df = spark.createDataFrame(rows, "pos long, entity string, run_id int, fit double").repartition(7)
    df = df.withColumn("ts", F.timestamp_seconds(F.col("pos")))
    removed = spark.createDataFrame([("k3",)], "entity string")
    seen, last, scored, want = {}, {}, {}, {}
    for pos, entity, run, fit in rows:
        state = "net_new" if entity not in last else "duplicate_in_run" if last[entity] == run else "rediscovered"
        seen[entity] = seen.get(entity, 0) + 1
        last[entity] = run
        if fit is not None:
            scored[entity] = pos
        want[pos] = ("skipped_removed" if entity == "k3" else state, seen[entity], scored.get(entity))
    for block in (1, 37, 10_000):
        states = dedupe.discovery_state(df, "entity", "run_id", "pos", removed, block_rows=block)
        stats = dedupe.sighting_stats(df, "entity", "pos", score="fit", block_rows=block)
        got = states.select("pos", "discovery_state").join(
            stats.select("pos", "seen_count", F.unix_timestamp("last_score_at").alias("s")), "pos"
        )
        assert {r.pos: (r.discovery_state, r.seen_count, r.s) for r in got.collect()} == want


def test_first_rows_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(observations(), "pos long, entity string, run_id int, fit double")
    want = {}
    for pos, entity, *_ in observations():
        want.setdefault(entity, pos)
    for n in (1, 8):
        spread = df.repartition(n)
        assert {r.entity: r.pos for r in top_n(spread, ["entity"], [F.asc("pos")]).collect()} == want
        flagged = mark_first(spread, ["entity"], "pos", "first").filter("first").collect()
        assert {r.entity: r.pos for r in flagged} == want


def test_hot_keys_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("entity"), F.col("id").alias("pos"))
    plan = top_n(df, ["entity"], [F.asc("pos")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_batch_dedup_keeps_first_or_best(spark):
    rows = [
        (1, "k", "u1", "Web Discovered", "d"),
        (2, "K", "u2", "ATS Confirmed", "d"),
        (3, "", "U9", "", ""),
        (4, "", "u9 ", "", ""),
        (5, "", "", "", ""),
        (6, "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "pos long, duplicate_key string, job_posting_url string, source_trust string, source_detail string")
    df = df.withColumns({"company": F.lit(""), "title": F.lit(""), "location": F.lit("")})
    assert sorted(r.pos for r in dedupe.dedupe_batch(df).collect()) == [1, 3, 5, 6]
    assert sorted(r.pos for r in dedupe.dedupe_batch(df, keep="best").collect()) == [2, 3, 5, 6]


def test_ranges_number_hot_keys_and_whole_tables(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "hot", None, "k"]), rnd.randrange(30)) for i in range(500)]
    df = spark.createDataFrame(rows, "pos long, k string, v int").repartition(7)
    order = [F.desc("v"), F.asc("pos")]
    want = {}
    for key in ("hot", None, "k"):
        for n, (pos, *_) in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))):
            want[pos] = n + 1
    assert {r.pos: r.n for r in ranked(df, ["k"], order, "n").collect()} == want
    assert {r.pos: r.n for r in ranked(df, ["k"], order, "n", 40, 11).collect()} == {p: n for p, n in want.items() if 11 <= n <= 40}
    whole = [p for p, *_ in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert [r.pos for r in ranked(df, [], order, "n").orderBy("n").collect()] == whole
    monkeypatch.setattr(ordered, "NARROW", 5)
    assert {r.pos for r in top_n(df, ["k"], order, 6).collect()} == {p for p, n in want.items() if n <= 6}
    last = ranking.page(df, order, 30, 99)
    assert [r.pos for r in last.orderBy("row_no").collect()] == whole[480:] and last.first().page_no == 17
    # Only the ranges of the page are numbered, and no exchange brings them into one task.
    assert "SinglePartition" not in last._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0].split("_before")[0]


def test_a_scan_ends_at_its_cap(spark):
    rnd = random.Random(8)
    rows = [(i, f"c{rnd.randrange(5)}", rnd.random() < 0.5, rnd.random() < 0.7, f"u{rnd.randrange(40)}") for i in range(120)]
    df = spark.createDataFrame(rows, "pos long, company string, t boolean, l boolean, url string")
    kept, counts = ranking.capped_scan(df, "company", 4, "pos", {"title": F.col("t"), "location": F.col("l")}, "url")
    want, urls = {}, set()
    for company in {r[1] for r in rows}:
        own, skips, scanned = [], [0, 0], 0
        for _, _, t, place, url in (r for r in rows if r[1] == company):
            scanned += 1
            if not t or not place:
                skips[t] += 1
                continue
            own.append(url)
            if len(own) == 4:
                break
        want[company] = (scanned, skips[0], skips[1], sum(r[1] == company for r in rows) - scanned, len(set(own)))
        urls |= {(company, u) for u in own}
    assert {r.company: (r.scanned, r.title_skips, r.location_skips, r.not_reached, r.kept) for r in counts.collect()} == want
    assert {(r.company, r.url) for r in kept.collect()} == urls
