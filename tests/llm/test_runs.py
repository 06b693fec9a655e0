import hashlib
import random
import zlib

import pytest

import __spark_entry__ as entry
from rolesift.llm import runs

from .conftest import SCHEMA


def expected(words, least=6, times=4):
    """All runs by trying every period."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def left(words, found):
    drop = {i for s, q, n in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def periodic(rng, letters):
    out = []
    for _ in range(rng.randint(1, 5)):
        out += [rng.choice(letters) for _ in range(rng.randint(0, 12))]
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 17]))]
        n = rng.randint(0, 9 * len(unit))
        out += (unit * 9)[:n]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_solved_parts_match_every_period(seed):
    rng = random.Random(seed)
    parts = [[w.encode() for w in periodic(rng, "ab" if k % 2 else "abcdefgh")] for k in range(300)] + [[], [b"a"], [b"a"] * 500, [b"a", b"b"] * 300]
    for part, found in zip(parts, runs.solve(parts, 1, 1 << 20), strict=True):
        assert sorted((x, q, y - x + q) for q, x, y in found) == expected(part)


def test_pieces_cover_and_overlap():
    for n in (9000, 70_000):
        for low, high, first, last in runs.pieces(n, 1024, 4):
            assert first < last <= n and last - first <= max(1024, 32 * high) + 24 * high
        tops = {high for _, high, _, _ in runs.pieces(n, 1024, 4)}
        assert max(tops) * 8 > n


@pytest.mark.parametrize("tile_words", [8192, 64, 32])
def test_documents(spark, docs, rows, tile_words):
    rng = random.Random(tile_words)
    more = [(1000 + k, " ".join(periodic(rng, "abcd") + periodic(rng, "ab") * rng.choice([1, 5])), *rows[0][2:]) for k in range(60)]
    more += [(2000, "\n ".join(["same"] * 3000), *rows[0][2:]), (2001, " ".join(str(k % 411) for k in range(2500)), *rows[0][2:]), (2000, "same", *rows[0][2:]), (None, "a " * 9, *rows[0][2:]), (None, None, *rows[0][2:])]
    table = spark.createDataFrame(rows + more, SCHEMA).repartition(4)
    found = runs.periodic_runs(table, tile_words=tile_words)
    got = sorted((str(r.doc_id), r.collapsed, [tuple(x) for x in r.runs], r.collapsed_sha256) for r in found.collect())
    want = []
    for doc, text, *_ in rows + more:
        words = [w.decode() for w in (text or "").encode().split()]
        e = expected(words)
        want.append((str(doc), left(words, e), e, hashlib.sha256(left(words, e).encode()).hexdigest()))
    assert got == sorted(want)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in entry.queries()["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    periodic_docs = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        e = expected(words)
        periodic_docs += bool(e)
        best = min(((-n, s, q) for s, q, n in e), default=None)
        want = (len(e), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4))
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in e).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left(words, e).encode()).hexdigest()
    assert periodic_docs > 5


def test_empty_table(no_docs):
    assert runs.periodic_runs(no_docs).count() == 0
