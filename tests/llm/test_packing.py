import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rolesift.llm import packing

from .conftest import SCHEMA


def ids_of(text):
    return np.array(Tokenizer.from_file(packing.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_pieces_are_the_tokenizers(docs, rows, spark):
    more = ["a<|endoftext|>b <|ENDOFTEXT|> it's, d'd. ÉÀß ÷ 12,3", "\x1c\x00 a\u00a0b Σας ǅ ﬁ", "word. " * 9000]
    rows = rows + [(900 + k, t, *rows[0][2:]) for k, t in enumerate(more)]
    got = collections.defaultdict(dict)
    for r in packing.pieces(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    for k, text, *_ in rows:
        ids = ids_of(text)
        assert got[k] == {j: (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for j, s in enumerate(range(0, len(ids), 2048))}


@pytest.mark.parametrize("capacity,block", [(2048, 1_000_000), (64, 3)])
def test_places(docs, rows, capacity, block):
    found = packing.packed(docs.union(docs.limit(5)), capacity, block=block).collect()
    assert len(found) == packing.pieces(docs.union(docs.limit(5)), capacity).count()
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1 + 1.15 * sum(r.length for r in found) / capacity


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_close_to_the_bound(seed):
    rng = random.Random(seed)
    capacity = 2048
    lengths = [min(capacity, int(rng.lognormvariate(6, 1 + seed / 5)) + 1) for _ in range(rng.choice([1, 50, 5000]))]
    lengths += [capacity // 3 + 1] * (500 if seed == 3 else 0)
    histogram = collections.Counter(lengths)
    slots = packing.plan(dict(histogram), capacity)
    fill, taken = collections.Counter(), collections.defaultdict(int)
    for n, first, count, seq, per, offset in slots:
        assert first == taken[n]
        taken[n] += count
        for r in range(count):
            fill[seq + r // per] += n
    assert taken == histogram and max(fill.values()) <= capacity
    bound = max(-(-sum(lengths) // capacity), sum(n > capacity // 2 for n in lengths))
    if seed != 3:
        assert len(fill) <= 1.03 * bound + 2


def test_empty_table(no_docs):
    assert packing.packed(no_docs).count() == 0
