import collections
import random

import pytest

import corpus_pipeline
from rolesift.llm import quality, secrets

from .conftest import SCHEMA, prose
from .test_leaks import expected as leaked
from .test_near import expected as components

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_shrink(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            sizes.append(docs.count())
    assert n > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > n / 2
    assert docs.select("doc_id").distinct().count() == sizes[3]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows with null and repeated ids, equal rows, copies, leaks and secrets, in several files."""
    rng = random.Random(9)
    item = prose(rng, 30, 5000)
    texts = [prose(rng, rng.randint(12, 90)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " more", f"{prose(rng, 9)} {item}", f"{item} {prose(rng, 30)}", None, "", "a b", "x y " * 30, None]
    texts += [f"{prose(rng, 20)} password=hunter2hunter2 {prose(rng, 9)}", f"{prose(rng, 20)} {item} {prose(rng, 4)}"]
    ids = [rng.choice([None, 3, 3, 7, 100 + k]) for k in range(len(texts))]
    rows = [(i, t, ["en", None][k % 2], "s", len(t or ""), "w", "d", k, 2, 3.0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[2], rows[2], rows[44]]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (1, "other words of another item here"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    return at, docs, [tuple(r) for r in docs.collect()], item


def left(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_rows_are_numbered_alike_in_every_reading(odd, spark):
    _, docs, rows, _ = odd
    numbers = {tuple(r)[:-1] + (r["_row"],) for r in corpus_pipeline.numbered(docs).collect()}
    again = {(r.text, r["_row"]) for r in corpus_pipeline.numbered(docs.select("text")).collect()}
    assert len(numbers) == len(rows) and {(r[1], r[-1]) for r in numbers} == again
    assert corpus_pipeline.numbered(spark.createDataFrame(rows, SCHEMA)).select("_row").distinct().count() == len(rows)


def test_quality_rules_judge_every_row_by_itself(odd, spark):
    at, docs, rows, _ = odd
    alone = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], SCHEMA)
    kept = {r.doc_id for r in quality.judge(alone).collect() if r.kept}
    assert left(corpus_pipeline.quality_rules(spark, docs, at)) == collections.Counter(r for k, r in enumerate(rows) if k in kept)
    assert 20 < len(kept) < len(rows)


def test_one_row_of_each_group_stays(odd, spark):
    at, docs, rows, _ = odd
    groups = collections.defaultdict(list)
    for k, (_, component, _) in components([(k, *r[1:]) for k, r in enumerate(rows)], 5).items():
        groups[component].append(rows[k])
    got = left(corpus_pipeline.near_dedup(spark, docs, at))
    # Of rows with the same least id any one may stay.
    best = lambda g: min((r[0] is None, r[0] or 0) for r in g)
    assert sum(got.values()) == len(groups) < len(rows)
    for g in groups.values():
        assert sum(got[r] for r in set(g) if (r[0] is None, r[0] or 0) == best(g)) >= 1


def test_rows_with_passages_go_and_others_under_their_id_stay(odd, spark):
    at, docs, rows, item = odd
    held = {k for k, _ in leaked([(k, *r[1:]) for k, r in enumerate(rows)], [(1, item), (2, "other words of another item here")])}
    assert left(corpus_pipeline.decontamination(spark, docs, at)) == collections.Counter(r for k, r in enumerate(rows) if k not in held)
    assert len(held) >= 4


def test_secrets_are_masked_and_every_row_is_packed(odd, spark):
    at, docs, rows, _ = odd
    path = secrets.default_vocabulary()
    mask = lambda t: secrets.masked(t, secrets.all_spans(t, path)[1], "[secret]") if t else t
    want = collections.Counter((r[0], mask(r[1]), *r[2:4], None if r[1] is None else len(mask(r[1])), *r[5:]) for r in rows)
    got = left(corpus_pipeline.secret_scan(spark, docs, at))
    assert {k[:4] for k in got} == {k[:4] for k in want} and sum(got.values()) == len(rows)
    packed = corpus_pipeline.best_fit_packing(spark, docs, at)
    assert packed.where("piece = 0").count() == len(rows)
