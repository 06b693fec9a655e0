import itertools
import random

import numpy as np
import pytest

from rolesift.llm import near

from .conftest import SCHEMA, WORD, lower, prose


def sets(rows, width):
    out = {}
    for k, text, *_ in rows:
        w = WORD.findall(lower(text or ""))
        n = min(width, len(w))
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


def expected(rows, width, percent=80):
    own = sets(rows, width)
    parent = {k: k for k in own}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(own, 2):
        x, y = own[a], own[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(own[k]), find(k), find(k) == k) for k in own}


@pytest.mark.parametrize("width,block", [(2, 3), (5, 2000)])
def test_components_match_brute_force(docs, rows, width, block):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs, width, block=block).collect()}
    assert got == expected(rows, width)


@pytest.mark.parametrize("block", [2000, 4])
def test_pivot_far_from_a_group_does_not_hide_its_links(spark, block):
    rng = random.Random(2)
    words = prose(rng, 200, 5000).split()
    rows = []
    for k in range(40):  # pairs near each other, all of them just too far from the first
        w = list(words)
        for j in range(11 if k else 0):
            w[(k // 2 * 13 + j * 17) % 200] = f"p{k // 2}x{j}"
        rows.append((k, " ".join(w), None, None, 0, "", "", 0, 0, 0.0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2, block=block).collect()}
    assert got == expected(rows, 2)


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = (np.frombuffer(near.registers(np.unique(x)), np.uint16) for x in (pool[:2400], pool[600:]))
    assert abs((a == b).mean() - 0.6) < 0.12


def test_empty_table(no_docs):
    assert near.near_duplicates(no_docs).count() == 0
