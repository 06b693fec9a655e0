import random

from pyspark.sql import functions as F

from rolesift.llm import toxicity

from .conftest import SCHEMA, prose


def brute_segments(scores):
    """Ruzzo and Tompa's definition: take the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for s in range(len(scores)):
        total = 0.0
        for e in range(s, len(scores)):
            total += scores[e]
            if total > best + 1e-9:
                best, at = total, (s, e + 1)
    if at is None:
        return []
    left = brute_segments(scores[: at[0]])
    right = [(v, s + at[1], e + at[1]) for v, s, e in brute_segments(scores[at[1] :])]
    return [*left, (best, *at), *right]


def test_segments_are_all_maximal_ones():
    rng = random.Random(0)
    for _ in range(200):
        scores = [rng.choice([-0.5, -0.5, -0.5, round(rng.uniform(0.1, 3), 3)]) for _ in range(rng.randint(0, 25))]
        got = toxicity.segments([(k, s) for k, s in enumerate(scores) if s > 0], neutral=-0.5)
        want = brute_segments(scores)
        assert [(s, e) for _, s, e in got] == [(s, e) for _, s, e in want]
        assert all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_distant_passages_stay_apart():
    weights = toxicity.Weights({"vile": 3.0, "meh": 1.6, "kind": -1.0}, {})
    far = " ".join(["vile"] * 5 + ["plain"] * 595 + ["vile"] * 5)
    assert [(s, e) for _, s, e in toxicity.evidence(far, weights)[1]] == [(0, 5), (600, 605)]
    lone = " ".join(["meh", *["plain"] * 69] * 40)
    assert [(s, e) for _, s, e in toxicity.evidence(lone, weights)[1]] == [(70 * k, 70 * k + 1) for k in range(40)]
    near = "vile plain vile kind kind kind kind vile"
    assert [(s, e) for _, s, e in toxicity.evidence(near, weights)[1]] == [(0, 3), (7, 8)]


def test_clean_tokens_score_negative_on_average(spark):
    rng = random.Random(6)
    texts = [(" ".join([prose(rng, 40), "kind" if k % 5 else "vile"]), int(k % 5 == 0)) for k in range(300)]
    weights, lam, _ = toxicity.token_table(spark.createDataFrame(texts, "text string, toxic int"))
    scores = [weights[w] for t, toxic in texts if not toxic for w in toxicity.TOKEN.findall(t.lower())]
    assert weights["vile"] > 1 and weights.neutral < 0 and sum(scores) < 0 and weights["kind"] < 0 and lam > 0


def test_held_out_accuracy_with_copies(spark):
    rng = random.Random(5)
    rows, labels = [], []
    copy = prose(rng, 60)
    for k in range(900):
        toxic = rng.random() < 0.2
        words = (copy if k % 9 == 0 else prose(rng, rng.randint(20, 200))).split()
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilea", "vileb", "vilec", "Nasty", "foul"]))
        rows.append((k, " ".join(words), None, None, 0, "", "", 0, 0, 0.0))
        labels.append((k, int(toxic)))
    rows += [(2000, None, *rows[0][2:]), (2001, "", *rows[0][2:]), (2002, "quiet " * 30_000, *rows[0][2:])]
    docs = spark.createDataFrame(rows + rows[-3:], SCHEMA)
    table = spark.createDataFrame(labels + [(3000, None), (0, labels[0][1])], "doc_id long, toxic int")
    model = toxicity.train(docs, table.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    assert sum((got[k].score >= 0.3) == bool(truth[k]) for k in truth) >= 0.98 * len(truth)
    assert all(got[k].score < 0.3 for k in (2000, 2001, 2002))
    assert all(got[k].passages for k in truth if truth[k] and got[k].score > 0.9)
    assert toxicity.score(docs, model).count() == len(rows) + 3


def test_no_labels(no_docs, docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.score(no_docs, toxicity.train(no_docs, none)).count() == 0
