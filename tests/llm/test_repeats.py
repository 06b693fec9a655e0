import collections
import hashlib

import pyarrow as pa
import pytest

from rolesift.llm import repeats


def expected(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("block", [30_000, 1])
def test_removal_matches_brute_force(docs, rows, block):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.without_repeats(docs, block=block).collect()}
    want = expected([r[1] for r in rows], 200)
    assert sum(w[1] > 0 for w in want) > 8
    for (k, *_), w in zip(rows, want, strict=True):
        assert tuple(got[k][:4]) == w[:4] and bytes(got[k][4]) == w[4], k


def test_repeated_rows_are_documents(spark):
    docs = spark.createDataFrame([(1, "abc " * 5 + "".join(map(chr, range(300, 700)))), (1, "abc " * 5 + "".join(map(chr, range(300, 700)))), (None, "z" * 150)], "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in repeats.without_repeats(docs).collect() if r.doc_id)
    assert got == [(1, 820, 820, 1)] * 2


def test_cover_is_the_same_in_equal_windows():
    cover = repeats.Cover(200, 48)
    data = bytes((k * k * 31 + k // 7) % 251 for k in range(3000))
    other = b"q" * 777 + data[500:1500] + b"r" * 300
    a, b = cover.find(data), cover.find(other)
    places = lambda f, lo, hi: {int(s + o) - lo for s, o, c in zip(f[2], f[4], f[3], strict=True) if lo <= s and s + c + 199 <= hi}
    assert places(a, 500, 1500) and places(a, 500, 1500) == places(b, 777, 1777)


def test_empty_table(no_docs):
    assert repeats.without_repeats(no_docs).count() == 0


def test_results_of_few_texts_are_held_at_once(spark):
    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, each, schema):
            return each

    def ones(keys, data, found):
        return [pa.array(keys), pa.array([len(data)])]

    count = 2 * repeats.ROWS + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(count)), pa.array([b"x" * 300] * count)], names=["doc_id", "data"])
    made = list(repeats._positions(Docs(), "doc_id long, n long", ones, 200, 48, "doc_id")(iter([batch])))
    assert [b.num_rows for b in made] == [repeats.ROWS, repeats.ROWS, 1]
    assert [x for b in made for x in b.column(0).to_pylist()] == list(range(count))
