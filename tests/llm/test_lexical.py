import collections
import math
import random
import re

import pytest

import __spark_entry__ as entry
from rolesift.llm import lexical
from tools.check import compare, oracle

from .conftest import SCHEMA, lower, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(lower(text or ""))


def expected(rows, items, top):
    docs = [(doc, collections.Counter(terms(text))) for doc, text in rows]
    docs = [(doc, c) for doc, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scores = []
        for doc, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = 0
            for t in terms(text):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            scores += [(-s, doc is None, doc)] if s else []
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("top,block_terms,broadcast_pairs", [(20, 16_384, 1_000_000), (3, 30, 0), (1000, 16_384, 1_000_000)])
def test_ranks_match_brute_force(spark, rows, top, block_terms, broadcast_pairs):
    rng = random.Random(top)
    more = [(300 + k, prose(rng, rng.randint(1, 300), 60) + " the" * rng.choice([0, 1, 7, 90])) for k in range(150)]
    more += [(300, "the b9w3 again"), (None, "the Ünï x1"), (None, None), (7, more[3][1]), (8, more[3][1])]
    table = spark.createDataFrame(rows + [(k, t, *rows[0][2:]) for k, t in more], SCHEMA).repartition(4)
    items = [(k, prose(rng, rng.randint(1, 30), 60) + " THE the") for k in range(8)] + [(50, None), (51, ""), (52, "..."), (53, "nowhere"), (1, "one"), (1, "one"), (None, "漢字 ünï"), (54, "x" * 5000)]
    questions = spark.createDataFrame([(*i, "extra") for i in items], "item_id long, text string, score string")
    found = lexical.search(table, questions, top, block_terms, broadcast_pairs).collect()
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found), key=str)
    assert got == expected([r[:2] for r in rows] + more, items, top)


def test_bounds_hold_for_every_document():
    rng = random.Random(3)
    counts = [collections.Counter(f"t{rng.randrange(rng.choice([5, 80]))}".encode() for _ in range(rng.choice([1, 30, 900]))) for _ in range(300)]
    asked = lexical.Questions([(k, {f"t{rng.randrange(90)}".encode(): rng.randint(1, 3) for _ in range(12)}) for k in range(9)])
    asked.counted(300, sum(sum(c.values()) for c in counts), collections.Counter(t for c in counts for t in c))
    flat = [x for c in counts for x in c.items()]
    blocks = lexical._blocks(list(range(300)), [sum(c.values()) for c in counts], [len(c) for c in counts], [lexical.zlib.crc32(t) for t, _ in flat], [n for _, n in flat])
    near = seen = 0
    for ids, sizes, bits, slices in blocks:
        bounds = asked.bounds(sizes, bits, slices)
        for k, doc in enumerate(ids):
            seen += 1
            for q in range(9):
                s = asked.score(q, counts[doc], lexical.length_part(int(sizes[k]), asked.n, asked.total))
                assert bounds[q, k] >= s
                near += bounds[q, k] <= 1.3 * s + 1
    assert seen == 300 and near > 0.8 * 9 * 300


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op12_lexical_search"](spark, sf).toPandas()
    assert compare(got, oracle(sf).execute(entry.oracle_sql()["op12_lexical_search"]).fetchdf()) == "" and len(got) > 100


def test_empty_tables(no_docs, docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(no_docs, one).count() == lexical.search(docs, none).count() == 0
