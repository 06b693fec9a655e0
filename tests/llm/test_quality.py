import collections
import random

import numpy as np
import pytest

from rolesift.llm import quality

from .conftest import SCHEMA, WORD, prose


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    where = collections.defaultdict(list)
    for k in range(len(words) - 4):
        where[tuple(words[k : k + 5])].append(k)
    repeated = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


def test_counts_and_base_rules(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs, steps=1).collect()}
    assert len(got) == len(rows)
    for k, text, *_ in rows:
        r, e = got[k], expected(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, k
        assert r.base_failed == (e[0] < 10 or 100 * e[4] > 20 * e[0])
        assert not (r.kept and r.base_failed)


def test_outliers_go_and_plain_texts_stay(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randint(30, 300)), "en", "s", 0, "", "", 0, 0, 0.0) for k in range(400)]
    rows += [(1000 + k, " ".join(w + "%%%" for w in prose(rng, 50).split()), "en", "s", 0, "", "", 0, 0, 0.0) for k in range(60)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


@pytest.mark.parametrize("part", [0.3, 0.38, 0.45])
def test_many_outliers_do_not_hide_each_other(spark, part):
    rng = np.random.default_rng(2)
    n = 4000
    x = rng.normal(0, 1, (n, 5)) * [0.7, 0.08, 0.01, 0.05, 0.02] + [5, 1.8, 0.02, 0.05, 0.02]
    bad = int(part * n)
    x[:bad, 2] += np.log(4)  # three symbols a word
    x[:bad, 1] += 0.4
    rows = [("a", "s", *map(float, v)) for v in x]
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{s} double" for s in quality.STATS))
    r = quality.estimates(frame).first()
    y = np.linalg.solve(np.array(r.c).reshape(5, 5), (x - r.m).T)
    out = (y**2).sum(axis=0) > quality.chi2_quantile(1 - 1e-9, 5)
    assert out[:bad].all() and not out[bad:].any()


def test_estimate_is_the_one_of_the_clean_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3000, 5)) @ np.diag([1, 2, 1, 3, 1])
    x[2400:] += 50
    rows = [("a", None, *map(float, v)) for v in x]
    frame = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{s} double" for s in quality.STATS))
    r = quality.estimates(frame).first()
    factor = np.array(r.c).reshape(5, 5)
    assert np.abs(np.array(r.m)).max() < 0.25
    assert np.abs(np.diag(factor @ factor.T) / (np.array([1, 4, 1, 9, 1]) + np.array(list(quality.TOLERANCE.values())) ** 2) - 1).max() < 0.35


def test_empty_table(no_docs):
    assert quality.judge(no_docs, steps=1).count() == 0


def test_quantile():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
