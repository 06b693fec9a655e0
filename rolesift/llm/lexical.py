"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a Bloom signature of its (term, level) entries: a term that
occurs tf times is entered for every step of ``LEVELS`` up to tf. Documents with
about as many entries form blocks, and a block is stored by bits: slice b is a
bitmap with a bit for each document. Slices of a term's positions together overestimate
which documents hold it at a level, and so bound its part of the score; the
weighted sums of these bitmaps are upper bounds of all scores of a block at once.

1. ``build`` reads the documents once and writes the signatures.
2. The documents that hold each asked term are counted exactly, in one scan.
3. The ``top`` documents by upper bound are scored exactly; the least of their
   scores is a score that ``top`` documents reach.
4. All documents whose upper bound is above it, or equal with no later id, are scored
   exactly. No other document can be among the first.

The questions are taken in blocks of about ``block_terms`` terms, so what is
broadcast (their terms, and weights of items times terms) has a bound. Candidates
go to the documents by a broadcast of their ids if they are ``broadcast_pairs``
at most, else by a join on the id; a document is scored for all its items in one row.

Terms are maximal runs of ASCII letters, digits and all characters from U+0080 on;
A-Z are lower-cased. Scores are whole numbers: see ``weight``, ``length_part`` and ``gain``.

Defined results: null and empty texts, and items without terms, give no rows;
repeated rows are documents of their own and repeated (item_id, text) one item;
two texts under one item_id are ranked each; equal scores are ordered by doc_id, null last;
other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, written

#: A-Z to a-z; other ASCII characters but letters and digits to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Occurrences from which a term has a further entry: 1, 2, 3, then 4, 6, 8, 12, 16, 24 and so on.
LEVELS = [1, 2, 3, *sorted([4 << k for k in range(20)] + [6 << k for k in range(20)])]
#: Signature bits for each entry and bits set by an entry; bits of a block; words read at once.
ROOM, HASHES, BLOCK_BITS, AT_ONCE = 12, 4, 1 << 22, 1 << 21
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_part(size, n: int, total: int):
    """A document's length against the mean, in hundredths, a quarter of it counted."""
    return 100 - 25 + (25 * size * n) // total


def gain(tf, m):
    """Part of a term's weight that ``tf`` occurrences are worth."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def positions(hashes: np.ndarray, levels: np.ndarray | int, bits: int) -> np.ndarray:
    """Signature bits of entries, a row for each."""
    x = hashes * ODD[0] + (np.atleast_1d(levels).astype(np.uint64) + np.uint64(1)) * ODD[1]
    x ^= x >> np.uint64(29)
    y = (x[:, None] * ODD[None, :HASHES]) >> np.uint64(32)
    return ((y * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def _blocks(ids: list, sizes: list, counts: list[int], crcs: list[int], tfs: list[int]) -> Iterator[tuple[list, np.ndarray, int, bytes]]:
    """Ids, sizes, bits and slices of the blocks of some documents."""
    sizes, tf = np.array(sizes, np.int32), np.array(tfs, np.int64)
    steps = np.searchsorted(LEVELS, tf, "right")
    doc = np.repeat(np.repeat(np.arange(len(ids)), counts), steps)
    level = np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)
    hashes = np.repeat(np.array(crcs, np.uint64), steps)
    entries = np.bincount(doc, minlength=len(ids))
    kinds = np.maximum(4, np.ceil(np.log2(np.maximum(entries, 1)))).astype(int)
    order = np.argsort(doc, kind="stable")
    doc, level, hashes = doc[order], level[order], hashes[order]
    begins = np.concatenate([[0], np.cumsum(entries)])
    for kind in np.unique(kinds).tolist():
        bits = ROOM << kind
        own = np.flatnonzero(kinds == kind)
        for k in range(0, len(own), max(8, BLOCK_BITS // bits)):
            part = own[k : k + max(8, BLOCK_BITS // bits)]
            at = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in part])
            spots = positions(hashes[at], level[at], bits)
            cells = np.zeros((bits, -(-len(part) // 8) * 8), bool)
            cells[spots, np.repeat(np.arange(len(part)), entries[part])[:, None]] = True
            yield [ids[d] for d in part], sizes[part], bits, np.packbits(cells, axis=1, bitorder="little").tobytes()


def build(docs: DataFrame) -> DataFrame:
    """The signatures as a written table: ids and sizes (terms with repeats) of a block's documents, bits, slices."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("bits", T.LongType()), T.StructField("slices", T.BinaryType())]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])

        def flush(id_type):
            for ids, sizes, bits, slices in _blocks(*held):
                lists = pa.array([ids], pa.list_(id_type)), pa.array([sizes.tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*lists, pa.array([bits], pa.int64()), pa.array([slices], pa.binary())], names=schema.names)
            for x in held:
                x.clear()

        id_type, words = pa.int64(), 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py() or b"")
                if not found:
                    continue
                count = Counter(found)
                for x, value in zip(held[:3], (doc, len(found), len(count)), strict=True):
                    x.append(value)
                held[3].extend(map(zlib.crc32, count))
                held[4].extend(count.values())
                words += len(found)
                if words > AT_ONCE:
                    yield from flush(id_type)
                    words = 0
        if held[0]:
            yield from flush(id_type)

    made = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(sign, schema)
    at = f"{shared_dir(docs.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    # Row groups are read whole, so they are small, and measured at each of the large rows.
    made.write.option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 1).option("parquet.block.size.row.check.max", 4).option("compression", "uncompressed").parquet(at)
    return docs.sparkSession.read.schema(schema).parquet(at)


class Questions:
    """The terms of a block of items, and their weights once the documents are counted."""

    def __init__(self, items: list[tuple[object, dict[bytes, int]]]):
        self.ids = [i for i, _ in items]
        self.counts = [c for _, c in items]
        self.terms = sorted(set().union(*self.counts)) if items else []
        self.hashes = np.array([zlib.crc32(t) for t in self.terms], np.uint64)

    def counted(self, n: int, total: int, df: dict[bytes, int]) -> None:
        self.n, self.total = n, total
        self.weight = {t: weight(n, df.get(t, 0)) for t in self.terms}
        at = {t: k for k, t in enumerate(self.terms)}
        every = np.zeros((len(self.ids), len(self.terms)))
        for q, count in enumerate(self.counts):
            for t, c in count.items():
                every[q, at[t]] = c * self.weight[t]
        self.matrix = every.astype(np.float32) if every.sum(axis=1).max(initial=0) < 1 << 24 else every  # whole numbers either way

    def bounds(self, sizes: np.ndarray, bits: int, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores: a row for each item, a column for each document of the block."""
        width = len(sizes)
        rows = np.frombuffer(slices, np.uint8).reshape(bits, -1)
        m = length_part(sizes.astype(np.int64), self.n, self.total)
        out, before = np.zeros((len(self.ids), width)), np.zeros(width)
        active, above = np.arange(len(self.terms)), None
        for k, _ in enumerate(LEVELS):
            packed = np.bitwise_and.reduce(rows[positions(self.hashes[active], k, bits)], axis=1)
            if above is not None:
                packed &= above
            some = packed.any(axis=1)
            active, above = active[some], packed[some]
            if not len(active):
                break
            held = np.unpackbits(above, axis=1, count=width, bitorder="little").astype(self.matrix.dtype)
            most = gain(LEVELS[k + 1] - 1, m) if k + 1 < len(LEVELS) else np.full(width, 1_000_000)
            out += (self.matrix[:, active] @ held) * (most - before)
            before = most
        return out

    def score(self, q: int, found: Counter, m: int) -> int:
        return sum(self.weight[t] * c * gain(found[t], m) for t, c in self.counts[q].items() if t in found)


def _sums(docs: DataFrame, asked: Broadcast) -> dict[bytes, int]:
    """How many documents hold each asked term; one row for each asked term comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = frozenset(asked.value.terms), Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(wanted.intersection(terms(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.collect()}


def _place(bound: float, doc: object) -> tuple:
    """Order of the results: the highest first, equal ones by id, null last."""
    return -bound, doc is None, 0 if doc is None else doc


def _highest(index: DataFrame, asked: Broadcast, top: int) -> DataFrame:
    """q and doc_id of the ``top`` upper bounds of each item, equal ones by id."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("bound", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(asked.value.ids)
        kept: list[list] = [[] for _ in range(items)]
        least, id_type = np.ones(items), pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type.value_type
            for own, sizes, bits, slices in zip(*batch.columns, strict=True):
                bounds = asked.value.bounds(np.array(sizes.as_py()), bits.as_py(), slices.as_py())
                hits = bounds >= least[:, None]
                own = own.as_py()
                for q in np.flatnonzero(hits.any(axis=1)).tolist():
                    more = [(bounds[q, d], own[d]) for d in np.flatnonzero(hits[q]).tolist()]
                    kept[q] = heapq.nsmallest(top, kept[q] + more, key=lambda x: _place(*x))
                    if len(kept[q]) == top:
                        least[q] = kept[q][-1][0]
        flat = [(q, doc, bound) for q, found in enumerate(kept) for bound, doc in found]
        columns = zip(*flat, strict=True) if flat else ([], [], [])
        kinds = pa.int32(), id_type, pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    by = Window.partitionBy("q").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    found = index.mapInArrow(best, schema)
    return found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= top).select("q", "doc_id")


def _reaching(index: DataFrame, asked: Broadcast, least: np.ndarray, last: list) -> DataFrame:
    """q and doc_id of all upper bounds above an item's least score, or equal to it with an id up to ``last``."""
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc_id", kind)])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sizes, bits, slices in zip(*batch.columns, strict=True):
                bounds = asked.value.bounds(np.array(sizes.as_py()), bits.as_py(), slices.as_py())
                names = own.as_py()
                item, place = np.nonzero(bounds > least[:, None])
                tied = [(q, d) for q, d in zip(*np.nonzero(bounds == least[:, None]), strict=True) if _place(0, names[d]) <= _place(0, last[q])]
                item, place = np.append(item, [q for q, _ in tied]), np.append(place, [d for _, d in tied])
                yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), own.values.take(pa.array(place.astype(np.int64)))], names=["q", "doc_id"])

    return index.mapInArrow(reach, schema)


def _scored(docs: DataFrame, pairs: DataFrame, asked: Broadcast, broadcast_pairs: int) -> DataFrame:
    """q, doc_id and score of every row of ``docs`` under the id of a pair."""
    lists = written(pairs.groupBy("doc_id").agg(F.collect_set("q").alias("qs")))
    if (lists.agg(F.sum(F.size("qs")).alias("n")).first().n or 0) <= broadcast_pairs:
        lists = F.broadcast(lists)
    schema = T.StructType([T.StructField("q", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for doc, text, qs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = terms(text.as_py() or b"")
                if found:
                    count, m = Counter(found), length_part(len(found), a.n, a.total)
                    for q in qs.as_py():
                        for x, value in zip(out, (q, doc, a.score(q, count, m)), strict=True):
                            x.append(value)
            kinds = pa.int32(), batch.schema.field(0).type, pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=schema.names)

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    met = texts.join(lists.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return met.select("doc_id", "text", "qs").mapInArrow(score, schema).where("score > 0")


def _items(questions: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """item_id, its terms with their counts, and the number of its block."""
    rows = questions.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(Counter(terms(t.as_py())).items()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.binary())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64()))],
                names=["item_id", "terms", "counts"],
            )

    schema = T.StructType([questions.schema["item_id"], T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    made = written(rows.mapInArrow(count, schema).where(F.size("terms") > 0))
    blocks = -(-(made.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) // block_terms)
    return made.withColumn("block", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(blocks, 1)))), blocks


def search(docs: DataFrame, questions: DataFrame, top: int = 20, block_terms: int = 16_384, broadcast_pairs: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = build(docs)
    sums = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    items, blocks = _items(questions, block_terms)
    found = None
    for block in range(blocks if sums.n else 0):
        rows = items.where(F.col("block") == block).orderBy("item_id", "terms").collect()  # about block_terms terms
        asked = Questions([(r.item_id, dict(zip(map(bytes, r.terms), r.counts, strict=True))) for r in rows])
        if not rows:
            continue
        asked.counted(sums.n, sums.total, _sums(docs, spark.sparkContext.broadcast(asked)))
        shared = spark.sparkContext.broadcast(asked)
        by = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        first = _scored(docs, _highest(index, shared, top), shared, broadcast_pairs)
        first = first.withColumn("r", F.row_number().over(by)).where(F.col("r") == top).select("q", "score", "doc_id")
        least, last = np.full(len(rows), 0.5), [None] * len(rows)
        for r in first.collect():  # a row for each item of the block at most
            least[r.q], last[r.q] = r.score, r.doc_id
        score = _scored(docs, _reaching(index, shared, least, last), shared, broadcast_pairs)
        ranked = score.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        names = items.where(F.col("block") == block).select("item_id", "terms")
        numbered = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], T.StructType([T.StructField("q", T.IntegerType()), names.schema["item_id"]]))
        part = ranked.join(F.broadcast(numbered), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([questions.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return found


#: The same ranking as SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM size),
m AS (SELECT doc_id, 100 - 25 + (25 * size.n * total.n) // total.l AS m FROM size, total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, total),
q AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""
