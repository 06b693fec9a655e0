"""The upsert against a row-by-row reading of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from rolesift.functions.trust import SOURCE_TYPE_RANKS, UPSERT_TRUST
from rolesift.operators import chains, store

NOW = "2026-01-02 00:00:00"
COLUMNS = "pos long, company string, title string, job_posting_url string, source_trust string, source_type string, source_detail string, fit_score string, duplicate_key string"


def batch_rows(seed, n=60):
    rnd = random.Random(seed)
    trust = ["", "Web Discovered", "Third-Party Listing", "Career Site Confirmed", "ATS Confirmed"]
    rows = []
    for pos in range(n):
        k = rnd.randrange(25)
        rows.append(
            (pos, f"Co {k}", f"Title {pos}", f"https://a.com/{k}?utm_x={pos}", rnd.choice(trust), "", rnd.choice(["", f"d{pos}"]), rnd.choice(["", "70"]), f"key {k}")
        )
    return rows


def empty_snapshot(spark):
    full = store.coerce_payload(spark.createDataFrame([], COLUMNS), extra=[])
    typed = {c: F.lit(None).cast(t) for c, t in store.STORE_COLUMNS.items()}
    return full.withColumn("posting_id", F.lit(0).cast("long")).withColumns(typed)


def by_rows(state, rows, removed, run):
    """What a row-at-a-time store would hold; keys and URLs go together here."""
    outcomes = {}
    for pos, _, title, _, trust, _, detail, _, key in rows:
        name = "|".join(key.split())
        if name in removed:
            outcomes[pos] = ("skipped_removed", "skipped_removed", False)
            continue
        old = state.get(name)
        if old is None:
            state[name] = {"title": title, "trust": trust, "detail": detail, "seen": 1, "run": run, "workflow": "New"}
            outcomes[pos] = ("inserted", "net_new", False)
            continue
        up = UPSERT_TRUST.get(trust, 0) > UPSERT_TRUST.get(old["trust"], 0)
        outcomes[pos] = ("updated", "duplicate_in_run" if old["run"] == run else "rediscovered", up)
        if not old["detail"] or (up and detail):
            old["detail"] = detail
        old.update(title=title, trust=trust if up else old["trust"] or trust, seen=old["seen"] + 1, run=run)
        if old["workflow"] != "Applied":
            old["workflow"] = "New"
    return outcomes


def held(df):
    return {
        r.duplicate_key: {"title": r.title, "trust": r.source_trust, "detail": r.source_detail, "seen": r.seen_count, "run": r.last_seen_run_id, "workflow": r.workflow_status}
        for r in df.collect()
    }


def test_upserts_match_a_row_by_row_store(spark):
    assert SOURCE_TYPE_RANKS["ATS"] == 3
    removed_keys = {"key|3", "key|7"}
    removed = spark.createDataFrame([(k,) for k in removed_keys], "duplicate_key string")
    snapshot, state = empty_snapshot(spark), {}
    for run in (1, 2):
        rows = batch_rows(run)
        batch = spark.createDataFrame(rows, COLUMNS).repartition(5)
        result = store.upsert_postings(snapshot, batch, removed, run, F.lit(NOW).cast("timestamp"))
        want = by_rows(state, rows, removed_keys, run)
        got = {r.pos: (r.status, r.discovery_state, r.trust_promoted) for r in result.outcomes.collect()}
        assert got == want
        assert held(result.snapshot) == state
        snapshot = spark.createDataFrame(result.snapshot.collect(), result.snapshot.schema)
        assert snapshot.select("posting_id").distinct().count() == len(state)
        if run == 1:
            ids = snapshot.filter("posting_id % 2 = 0").select("posting_id")
            snapshot = store.mark_applied(snapshot, ids, "2026-01-01", F.lit(NOW).cast("timestamp"))
            for r in snapshot.filter("workflow_status = 'Applied'").collect():
                state[r.duplicate_key]["workflow"] = "Applied"


def one_by_one(stored, rows):
    """pos -> posting id, where an update gives the posting the row's key and URLs."""
    held, start, out = dict(stored), max(stored, default=0), {}
    for pos, *identity in rows:
        for k, value in enumerate(identity):
            found = [i for i, x in held.items() if value and x[k] == value]
            if found:
                break
        entity = min(found) if found else start + pos + 1
        held[entity] = identity
        out[pos] = entity
    return out


def mixed(seed, n=120):
    rnd = random.Random(seed)
    few = rnd.choice([6, 25, 80])
    draw = lambda p: rnd.choice(["", *[f"{p}{rnd.randrange(few)}"] * 9])
    stored = {i: [f"k{i}" if rnd.random() < 0.5 else f"own{i}", draw("c"), draw("u")] for i in range(1, 20)}
    rows = []
    for pos in range(n):
        key, url = draw("k"), draw("u")
        rows.append((pos, key, draw("c") if url else "", url))
    return stored, rows


def frames(spark, stored, rows):
    identity = ", ".join(f"{c} string" for c in chains.IDENTITY)
    known = spark.createDataFrame([(i, *x) for i, x in stored.items()], f"posting_id long, {identity}")
    return known, spark.createDataFrame(rows, f"pos long, {identity}").repartition(5)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("at_once", [chains.AT_ONCE, 0])
def test_rows_go_where_a_row_by_row_store_puts_them(spark, seed, at_once):
    stored, rows = mixed(seed)
    known, live = frames(spark, stored, rows)
    found = chains.assigned(live, chains.candidates(live, known), max(stored), at_once)
    assert {r.pos: r.entity for r in found.collect()} == one_by_one(stored, rows)


def test_a_hot_key_is_not_replayed(spark):
    rows = [(k, "hot", f"c{k % 7}", f"u{k}") for k in range(300)] + [(300, "a", "c", "u1x"), (301, "b", "c", "u2x"), (302, "a", "", "")]
    known, live = frames(spark, {}, rows)
    assert sorted(r.duplicate_key for r in chains.tangled_keys(live, known).collect()) == ["a", "b"]
    found = {r.pos: r.entity for r in chains.assigned(live, known, 0).collect()}
    assert found == one_by_one({}, rows)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for r in chains.components(spark.createDataFrame(edges, "a long, b long")).collect():
        groups.setdefault(r.component, set()).add(r.node)
    want = {}
    for x in {x for e in edges for x in e if e[0] != e[1]}:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_rounds_do_not_multiply_the_estimated_size(spark):
    found = chains.components(spark.range(400).selectExpr("id AS a", "id + 1 AS b"))
    assert (found.count(), found.select("component").distinct().count()) == (401, 1)
    # Joins of what was joined before gave it hundreds of digits, three times as many in each round.
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**12


def test_url_match_within_the_batch(spark):
    rows = [(1, "A", "t", "https://a.com/1", "", "", "", "", "k1"), (2, "B", "u", "https://a.com/1/", "", "", "", "", "k2")]
    removed = spark.createDataFrame([], "duplicate_key string")
    result = store.upsert_postings(
        empty_snapshot(spark), spark.createDataFrame(rows, COLUMNS), removed, 1, F.lit(NOW).cast("timestamp")
    )
    (row,) = result.snapshot.collect()
    assert (row.title, row.duplicate_key, row.seen_count) == ("u", "k2", 2)


def test_a_key_goes_where_its_first_row_goes(spark):
    removed = spark.createDataFrame([], "duplicate_key string")
    now = F.lit(NOW).cast("timestamp")
    start = store.upsert_postings(
        empty_snapshot(spark), spark.createDataFrame([(0, "A", "t0", "https://a.com/u", "", "", "", "", "k0")], COLUMNS), removed, 1, now
    ).snapshot
    start = spark.createDataFrame(start.collect(), start.schema)
    moved = [(1, "A", "t1", "https://a.com/u", "", "", "", "", "k1"), (2, "A", "t2", "https://a.com/v", "", "", "", "", "k1")]
    result = store.upsert_postings(start, spark.createDataFrame(moved, COLUMNS), removed, 2, now)
    (row,) = result.snapshot.collect()
    assert (row.title, row.duplicate_key, row.seen_count) == ("t2", "k1", 3)
    # The key comes before the URL: a new key's second row leaves the row that has its URL alone.
    new_first = [(1, "A", "t1", "https://a.com/x", "", "", "", "", "k2"), (2, "A", "t2", "https://a.com/u", "", "", "", "", "k2")]
    result = store.upsert_postings(start, spark.createDataFrame(new_first, COLUMNS), removed, 2, now)
    assert sorted((r.duplicate_key, r.title, r.seen_count) for r in result.snapshot.collect()) == [("k0", "t0", 1), ("k2", "t2", 2)]


def test_mixed_runs_match_a_row_by_row_store(spark):
    removed = spark.createDataFrame([], "duplicate_key string")
    snapshot, stored = empty_snapshot(spark), {}
    for run in (1, 2, 3):
        rnd = random.Random(run)
        rows = [(p, "A", f"t{p}", f"https://a.com/{rnd.randrange(12)}", "", "", "", "", f"k{rnd.randrange(12)}") for p in range(40)]
        result = store.upsert_postings(snapshot, spark.createDataFrame(rows, COLUMNS), removed, run, F.lit(NOW).cast("timestamp"))
        snapshot = spark.createDataFrame(result.snapshot.collect(), result.snapshot.schema)
        want = one_by_one(stored, [(p, key, url, url) for p, _, _, url, *_, key in rows])
        assert {r.pos: r.job_id for r in result.outcomes.collect()} == want
        for p, _, _, url, *_, key in rows:
            stored[want[p]] = [key, url, url]
        assert {r.posting_id: [r.duplicate_key, r.canonical_job_posting_url, r.job_posting_url] for r in snapshot.collect()} == stored
        last = {e: p for p, e in want.items()}
        assert {r.posting_id: r.title for r in snapshot.collect() if r.posting_id in last} == {e: f"t{p}" for e, p in last.items()}


def test_removed_rows_become_tombstones(spark):
    snapshot = spark.createDataFrame(
        [(1, "k1", "a", "t", "l", "u"), (2, "k2", "b", "t", "l", "u")],
        "posting_id long, duplicate_key string, company string, title string, location string, job_posting_url string",
    )
    old = spark.createDataFrame(
        [("2020-01-01", "k1", "", "", "", "", "old")],
        "removed_date string, duplicate_key string, company string, title string, location string, job_posting_url string, removal_reason string",
    )
    after, gone = store.remove_postings(snapshot, old, spark.createDataFrame([(1,)], "posting_id long"), "2026-01-01")
    assert [r.posting_id for r in after.collect()] == [2]
    assert [(r.duplicate_key, r.removed_date) for r in gone.collect()] == [("k1", "2026-01-01")]
