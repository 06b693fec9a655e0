"""Removal of long repeated byte strings by blockwise suffix sorting.

A byte goes if some ``length``-byte string over it also starts anywhere else.
Only comparisons to that depth matter, so suffixes are sorted to it, one bucket
after the other, and long ties are resolved by ranks of a sparse cover of the
text, as in difference-cover construction:

* The cover is content-defined: in every ``length``-byte window the position of
  the least hash of its ``gram``-byte strings. Like the residues of a difference
  cover it has one position at the same offset in any two equal windows, but it
  holds 1.3 % of the positions where residues hold over 10 %.
* A cover position whose gram occurs once proves its windows unique. The others
  make the suffix buckets: one gram, one bucket. Inside, occurrences with the
  same bytes around them (``ctx``) are settled by counting.
* What is left, the edges of repeated passages, is sorted: the bytes after the
  cover position, and those before it read backwards. Common-prefix lengths of
  neighbours give each occurrence a rank at every depth, and two windows at the
  same offset are equal when both ranks are. A task holds one bucket block
  of at most ``block`` occurrences; the windows of a bucket over that size are
  counted by digests, spread over all tasks.

Texts are read again for each step rather than shuffled: a bitmap of fixed
bound, made of the keys that are still open, says which cover positions a step
has to send. A task makes results of ``ROWS`` texts at a time, however many a
batch holds. Grams and contexts are 64-bit hashes each, seen together.

Defined results: null and empty texts keep their bytes; shorter texts than
``length`` have no string to repeat; of repeated rows each is a document of its
own, so all of a long text repeated as a row goes; rows are told apart by doc_id
and text, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import bitmap, hit, signed, sliced, written

LENGTH, GRAM = 200, 48
#: Texts whose results a task holds at once.
ROWS = 250
#: Bytes that are hashed at once, and occurrences that are sorted at once.
CHUNK, BLOCK = 1 << 17, 30_000
_M = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a random value for each byte."""
    base = 0x5851F42D4C957F2D
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1], np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


class Cover:
    """Cover positions of texts, found a chunk at a time."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.pow, self.inv, self.byte = _powers(CHUNK + 2 * length + 1)

    def find(self, data: bytes) -> tuple[np.ndarray, ...]:
        """gram, ctx, first window, number of windows, and offset of the position in the first one."""
        parts = []
        for at in range(0, max(0, len(data) - self.length + 1), CHUNK):
            piece = data[at : at + CHUNK + self.length - 1]
            parts.append(self._piece(np.frombuffer(piece, np.uint8), at))
        if not parts:
            return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _piece(self, b: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n, w = len(b), self.width
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[b] * self.pow[:n], out=sums[1:])
        grams = _mix((sums[self.gram :] - sums[: n + 1 - self.gram]) * self.inv[: n + 1 - self.gram])
        # Least hash first, then the leftmost place: sliding minimum by blocks.
        key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        pad = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        pad[: len(key)] = key
        blocks = pad.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        windows = n - self.length + 1
        place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFF)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[lo, windows])
        pos, end = place[lo], lo + count - 1 + self.length
        ctx = _mix((sums[end] - sums[lo]) * self.inv[lo] ^ _mix(((pos - lo) << 20 | count).astype(np.uint64)))
        return grams[pos], ctx, lo + at, count, pos - lo


def _both(gram: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return _mix(gram * np.uint64(3) + ctx)


def _data() -> Column:
    return F.col("text").cast("binary").alias("data")


def _positions(docs: DataFrame, schema: str, row, length: int, gram: int, *key: str | Column) -> DataFrame:
    """Rows that ``row`` makes of each text's cover: a list of arrays for (values of key, data, cover)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(length, gram)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in sliced(batches, ROWS):
            parts = []
            for *keys, data in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1], strict=True):
                data = data.as_py() or b""
                if len(data) >= length:
                    parts.append(row(keys, data, cover.find(data)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], names=names)

    return docs.select(*key, _data()).mapInArrow(each, schema)


def _depths(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte rows inside their groups, and the common prefix with the row before (-1: another group)."""
    width = rows.shape[1]
    order = np.lexsort((np.ascontiguousarray(rows).view(f"S{width}").reshape(-1), group))
    r, g = rows[order], group[order]
    differ = r[1:] != r[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.r_[-1, np.where(g[1:] == g[:-1], lcp, -1)]


def sorted_block(group: np.ndarray, single: np.ndarray, count: np.ndarray, offset: np.ndarray, data: list[bytes], length: int) -> list[np.ndarray]:
    """Start and end windows of the repeated runs of each single context, by sorting the block's suffixes.

    ``group``: bucket of each context; ``count`` windows start at its first byte
    and after; the cover position is ``offset`` bytes from there.
    """
    m, left = len(data), int(offset.max(initial=0))
    after, before = np.zeros((m, length), np.uint8), np.zeros((m, max(left, 1)), np.uint8)
    for k, d in enumerate(data):
        b = np.frombuffer(d, np.uint8)
        right = b[offset[k] : offset[k] + length]
        after[k, : len(right)] = right
        before[k, : offset[k]] = b[: offset[k]][::-1]
    (order_a, lcp_a), (order_b, lcp_b) = _depths(after, group), _depths(before, group)
    flags = np.zeros((m, int(count.max(initial=0))), bool)
    rank_a, rank_b = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(left + 1):
        own = np.flatnonzero((offset >= o) & (offset - o < count))
        if not len(own):
            continue
        rank_a[order_a] = np.cumsum(lcp_a < length - o)
        rank_b[order_b] = np.cumsum(lcp_b < o)
        key = rank_a[own] * (m + 1) + rank_b[own]
        by = np.argsort(key, kind="stable")
        same = np.r_[False, key[by][1:] == key[by][:-1]]
        twice = same | np.r_[same[1:], False]
        hit = own[by[twice]]
        flags[hit, offset[hit] - o] = True
    out = []
    for k in range(m):
        edge = np.flatnonzero(np.diff(np.r_[0, flags[k].astype(np.int8), 0])) if single[k] else np.empty(0, np.int64)
        out.append(edge.reshape(-1, 2).astype(np.int32))
    return out


def _sorted_spans(rows: DataFrame, length: int, block: int) -> DataFrame:
    """gram, ctx, spans of single contexts; rows of one gram lie together, sorted."""
    columns = ["gram", "ctx", "n", "count", "offset", "data"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(part: pa.Table) -> pa.RecordBatch:
            gram, ctx, n, count, offset = (part.column(k).to_numpy() for k in range(5))
            spans = sorted_block(gram, n == 1, count, offset, part.column(5).to_pylist(), length)
            some = np.array([len(s) > 0 for s in spans], bool)
            data = [s.tobytes() for s, keep in zip(spans, some, strict=True) if keep]
            return pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(ctx[some]), pa.array(data, pa.binary())], names=["gram", "ctx", "spans"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < block:
                continue
            part = pa.Table.from_batches(held)
            gram = part.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last bucket may go on
            if cut:
                yield flush(part.slice(0, cut))
                held = part.slice(cut).to_batches()
                size = sum(b.num_rows for b in held)
        if size:
            yield flush(pa.Table.from_batches(held))

    return rows.select(*columns).mapInArrow(work, "gram long, ctx long, spans binary")


def _counted_spans(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets over the block size: a digest of each window, counted over all tasks."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                gram, ctx, n, count, offset, data = (batch.column(j)[k].as_py() for j in range(6))
                keys = [xxh3_128_digest(data[j : j + length] + (offset - j).to_bytes(4, "little")) for j in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * count, t) for x, t in ((gram, pa.int64()), (ctx, pa.int64()), (n, pa.int64()))]
                    + [pa.array(range(count), pa.int32()), pa.array(keys, pa.binary())],
                    names=["gram", "ctx", "n", "j", "key"],
                )

    each = rows.select("gram", "ctx", "n", "count", "offset", "data").mapInArrow(digests, "gram long, ctx long, n long, j int, key binary")
    twice = each.groupBy("gram", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram", "key")
    hits = each.where("n = 1").join(twice, ["gram", "key"]).groupBy("gram", "ctx").agg(F.sort_array(F.collect_list("j")).alias("j"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for j in batch.column(2).to_pylist():
                j = np.array(j)
                cut = np.flatnonzero(np.diff(j) > 1)
                out.append(np.column_stack([np.r_[j[0], j[cut + 1]], np.r_[j[cut], j[-1]] + 1]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["gram", "ctx", "spans"])

    return hits.mapInArrow(runs, "gram long, ctx long, spans binary")


def _spans(docs: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """gram, ctx and the repeated windows of the context: null for all of them."""

    def grams(keys, data, found):
        return [signed(found[0])]

    repeated = _positions(docs, "gram long", grams, length, gram).groupBy("gram").count().where("count > 1").select("gram")
    some = bitmap(written(repeated))

    def contexts(keys, data, found):
        keep = hit(some, found[0])
        return [signed(found[0][keep]), signed(found[1][keep])]

    classes = written(_positions(docs, "gram long, ctx long", contexts, length, gram).groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n")))
    buckets = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("gram", "m")
    open_ = written(classes.join(buckets, "gram"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, c = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([signed(_both(g, c))], names=["key"])

    wanted = bitmap(open_.select("gram", "ctx").mapInArrow(both, "key long"))

    def bytes_(keys, data, found):
        keep = hit(wanted, _both(found[0], found[1]))
        g, c, lo, count, offset = (x[keep] for x in found)
        around = [data[a : a + k - 1 + length] for a, k in zip(lo.tolist(), count.tolist(), strict=True)]
        return [signed(g), signed(c), pa.array(count), pa.array(offset), pa.array(around, pa.binary())]

    sent = _positions(docs, "gram long, ctx long, count long, offset long, data binary", bytes_, length, gram)
    sent = sent.groupBy("gram", "ctx").agg(F.first("count").alias("count"), F.first("offset").alias("offset"), F.first("data").alias("data"))
    rows = written(sent.join(open_, ["gram", "ctx"]))
    small = rows.where(F.col("m") <= block).repartition("gram").sortWithinPartitions("gram")
    found = _sorted_spans(small, length, block).union(_counted_spans(rows.where(F.col("m") > block), length))
    whole = classes.where("n > 1").select("gram", "ctx", F.lit(None).cast("binary").alias("spans"))
    return written(whole.union(found)), both


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    spans, both = _spans(docs, length, gram, block)
    open_ = bitmap(spans.select("gram", "ctx").mapInArrow(both, "key long"))

    def places(keys, data, found):
        keep = hit(open_, _both(found[0], found[1]))
        g, c, lo, count, _ = (x[keep] for x in found)
        return [*(pa.array([k] * len(g), pa.int64()) for k in keys), signed(g), signed(c), pa.array(lo), pa.array(count)]

    t = F.xxhash64(_data()).alias("t")
    at = _positions(docs, "doc_id long, t long, gram long, ctx long, lo long, count long", places, length, gram, "doc_id", t)
    at = at.join(spans, ["gram", "ctx"]).select("doc_id", "t", "lo", "count", "spans")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            out = []
            for a, n, s in zip(lo.tolist(), count.tolist(), batch.column(4).to_pylist(), strict=True):
                w = np.array([[0, n]]) if s is None else np.frombuffer(s, np.int32).reshape(-1, 2)
                out.append((w.astype(np.int64) + a + [0, length - 1]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "t", "runs"])

    cut = at.mapInArrow(runs, "doc_id long, t long, runs binary")
    cut = cut.groupBy("doc_id", "t").agg(F.collect_list("runs").alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            out: tuple[list, ...] = ([], [], [], [], [])
            for data, found in zip(batch.column(1), batch.column(2), strict=True):
                data, found = data.as_py() or b"", found.as_py() or []
                kept, at, gone, spans_ = [], 0, 0, 0
                r = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                for s, e in r[np.argsort(r[:, 0], kind="stable")].tolist():
                    if s > at or not spans_:
                        kept.append(data[at:s])
                        spans_ += 1
                        gone -= s
                        gone += e
                        at = e
                    elif e > at:
                        gone += e - at
                        at = e
                rest = b"".join([*kept, data[at:]])
                for column, x in zip(out, (len(data), gone, spans_, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    texts = docs.select("doc_id", _data(), t)
    joined = texts.join(cut.withColumnsRenamed({"doc_id": "_d", "t": "_t"}), (F.col("doc_id").eqNullSafe(F.col("_d"))) & (F.col("t") == F.col("_t")), "left")
    return joined.select("doc_id", "data", "runs").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
