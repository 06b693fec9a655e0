import collections
import random

from rolesift.llm import leaks

from .conftest import SCHEMA, WORD, prose


def expected(rows, bench):
    found = {}
    for k, text, *_ in rows:
        w = WORD.findall((text or "").lower())
        for item, passage in bench:
            x = WORD.findall((passage or "").lower())
            if len(x) < 5:
                continue
            a = collections.Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
            for s in range(len(w)):
                y = w[s : s + len(x)]
                b = collections.Counter(tuple(y[i : i + 5]) for i in range(max(1, len(y) - 4)))
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8:
                    found[k, item] = max(sim, found.get((k, item), 0))
    return found


def test_leaks_match_brute_force_over_all_windows(spark):
    rng = random.Random(3)
    bench = [(k, prose(rng, rng.randint(6, 50), 5000)) for k in range(12)] + [(50, None), (51, ""), (52, "too short"), (53, "the " * 30)]
    rows = []
    for k in range(80):
        item = bench[k % 12][1].split()
        if k % 5 == 1 and len(item) > 30:
            item[len(item) // 2] = "changed"
        if k % 5 == 2:
            item = item[: len(item) // 2]
        middle = " ".join(item).upper() if k % 7 == 0 else " ".join(item)
        text = middle if k % 3 == 0 else f"{prose(rng, 30)} {middle} {prose(rng, 30)}"
        rows.append((k, text if k % 4 else prose(rng, 60), None, None, 0, "", "", 0, 0, 0.0))
    rows += [(200, None, None, None, 0, "", "", 0, 0, 0.0), (201, "", None, None, 0, "", "", 0, 0, 0.0), (202, "the " * 90, None, None, 0, "", "", 0, 0, 0.0)]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA)
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = expected(rows, bench)
    assert len(want) > 30
    for broadcast_rows in (2_000_000, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in leaks.leaks(docs, items, broadcast_rows=broadcast_rows).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r.doc_id for r in leaks.decontaminated(docs, items).collect()}
    assert kept == {r[0] for r in rows} - {k for k, _ in want}


def test_swapped_and_moved_parts_match_brute_force(spark):
    rng = random.Random(8)
    bench = [(k, prose(rng, rng.randint(40, 70), 5000)) for k in range(6)] + [(50, "the of " * 20)]
    rows = []
    for k in range(36):
        item = bench[k % 6][1].split()
        half, third = len(item) // 2, len(item) // 3
        item = [item[half:] + item[:half], item[third:] + item[:third], item[:third] + item[2 * third :] + item[third : 2 * third]][k % 3]
        text = " ".join(item) if k % 4 == 0 else f"{prose(rng, 30)} {' '.join(item)} {prose(rng, k % 7)}"
        rows.append((k, text, None, None, 0, "", "", 0, 0, 0.0))
    rows += [(k, prose(rng, 90), *rows[0][2:]) for k in (3, 70)] + [(80, "of the " * 50, *rows[0][2:])]
    want = {}
    for r in rows:
        want |= {k: max(v, want.get(k, 0)) for k, v in expected([r], bench).items()}
    assert len(want) > 20
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.leaks(spark.createDataFrame(rows, SCHEMA), items).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_repeated_ids_and_null_ids(spark):
    rng = random.Random(11)
    one, two, other = (prose(rng, 30, 5000) for _ in range(3))
    items = spark.createDataFrame([(1, one, "x"), (1, two, "y"), (1, two, "z"), (2, one, "x"), (None, other, "x")], "item_id long, text string, t string")
    rows = [(1, f"{prose(rng, 9)} {one}"), (2, f"{two} {prose(rng, 9)}"), (2, other), (2, prose(rng, 40)), (None, one), (None, prose(rng, 40)), (3, other), (4, None)]
    docs = spark.createDataFrame([(k, t, "a", "b") for k, t in rows + rows[:1]], "doc_id long, text string, t string, size string")
    got = sorted(((r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, 1), (1, 2), (2, 1), (None, 1), (None, 2)], key=str)
    kept = leaks.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[k] for k in (2, 3, 5, 6, 7)], key=str)


def test_fingerprints_of_many_words(spark):
    words = [f"w{k % 701}" for k in range(40_000)]
    rows = spark.createDataFrame([(1, 1, words), (2, 1, words * 3)], "id int, size int, w array<string>")
    assert len({r.fp for r in leaks.fingerprints(rows, "id").collect()}) == 1


def test_nearly_all_near_the_threshold_come_within_the_radius(spark):
    rng = random.Random(12)
    bench, rows = [], []
    for k in range(120):
        item = prose(rng, rng.randint(35, 60), 5000).split()
        most = (len(item) - 4) // 9  # shingles that differ: a similarity of 0.8 or little more
        bench.append((k, " ".join(item)))
        rows.append((k, " ".join(item[: len(item) - most] + [f"other{j}" for j in range(most)])))
    want = {x for k in range(120) for x in expected([rows[k]], [bench[k]])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(want) == 120 and len(got & want) >= 0.95 * len(want)


def test_plan_has_no_python_and_no_pairing(docs, spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = leaks.leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_empty_tables(no_docs, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(no_docs, none).count() == leaks.leaks(docs, none).count() == 0
