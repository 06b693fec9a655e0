"""Near-duplicate groups by HyperMinHash registers, banding and exact confirmation.

1. Every text becomes a set of word shingles and, from it, ``registers``
   HyperMinHash registers: leading-zero count and ten mantissa bits of the least
   hash in each bucket (each bucket has a hash function of its own).
2. Texts with the same set are one class; its least doc_id stands for it.
3. Bands of registers are hashed to buckets. In each bucket all members are
   compared with two pivots, the least id and one that differs from bucket to
   bucket: stars, never all pairs. Registers give a collision-corrected Jaccard
   estimate; what may reach the threshold is confirmed on the full sets.
4. Members of a bucket that the stars have not joined into one component are
   compared among themselves, in bounded blocks; only links leave a block.
   Jaccard distance is a metric, so a member joined to the pivot needs no
   comparison with one over two thresholds away from it.
5. Components of the confirmed links, by alternating large and small stars.

At a similarity of 0.8, forty bands of six registers miss a pair once in 200,000
and the estimate's margin of six standard deviations misses none that count.
Every step is a keyed exchange; groups are summed before it, and hot keys meet
only in joins that AQE can split.

Defined results: null, empty and white texts have an empty set, are linked with
nothing and stand for themselves; shorter texts than a shingle have their whole
word sequence as the one shingle; a row without doc_id is left out; of repeated
rows of one doc_id the first set in digest order counts. Other columns are not
read, and their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import bitmap, hit, signed, written

REGISTERS, ROWS = 240, 6
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: Standard deviations of the estimate below the threshold from which pairs are confirmed.
MARGIN = 6.0


def shingles(data: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased."""
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(acc)]
    acc ^= acc >> np.uint64(32)
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the buckets' hash functions."""
    rng = np.random.default_rng(20240917)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def registers(values: np.ndarray) -> bytes:
    """HyperMinHash registers of a non-empty set: 6 bits of leading zeros, 10 of mantissa."""
    mult, add = _family(REGISTERS)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        part = values[None, at : at + 512] + add[:, None]
        part *= mult[:, None]
        part ^= part >> np.uint64(31)
        part *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, part.min(axis=1), out=least)
    zeros = 64 - np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(zeros, 0, 63).astype(np.uint64)
    bits = (least << (zeros + np.uint64(1)) % np.uint64(64)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | bits).astype(np.uint16).tobytes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and registers (null without a set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, digests, regs = batch.column(0), [], [], []
            for data in batch.column(1):
                s = shingles(data.as_py(), width)
                sizes.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "registers"],
            )

    rows = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, registers binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """rid, bucket and band, one row for each band."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
            for k in range(ROWS):
                acc = (acc ^ r[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                acc ^= acc >> np.uint64(29)
            rid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int16), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(acc.reshape(-1).view(np.int64)), pa.array(band)], names=["rid", "bucket", "band"])

    return classes.select("rid", "registers").mapInArrow(cut, "rid long, bucket long, band short")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b and the corrected estimate of their Jaccard similarity."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
            # Different least hashes agree in the kept bits this often.
            chance = 0.72 * n * m / (n + m) ** 2 / 2**MANTISSA
            est = ((x == y).mean(axis=1) - chance) / (1 - chance)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(est)], names=["a", "b", "est"])

    one = classes.select(F.col("rid").alias("a"), F.col("n_shingles").alias("n"), F.col("registers").alias("x"))
    two = classes.select(F.col("rid").alias("b"), F.col("n_shingles").alias("m"), F.col("registers").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(estimate, "a long, b long, est double")


def _sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rid and its set, for the documents of ``ids``; the texts are read again, not shuffled."""
    some = bitmap(ids.mapInArrow(_mixed, "key long"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = hit(some, _mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            batch = batch.filter(pa.array(keep))
            out = [shingles(x.as_py(), width).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rid", "s"])

    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    # One text for each id, should rows be repeated.
    found = texts.mapInArrow(sets, "rid long, s binary").join(ids, "rid", "left_semi")
    return written(found.groupBy("rid").agg(F.min("s").alias("s")))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([signed(_mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))], names=["key"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.withColumnsRenamed({"rid": "a", "s": "x"}), "a").join(sets.withColumnsRenamed({"rid": "b", "s": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of the graph with edges a, b; nodes with no edge are absent."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum("b")).first())
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = now
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        e = written(small.select("x.a", F.col("x.m").alias("b")).where("a > b").distinct())


def _rest(
    own: DataFrame, near: DataFrame, far: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, least: float, block: int
) -> DataFrame:
    """Links between members of one bucket in different components, neither of them its first pivot.

    A bucket is cut into blocks of about ``block`` members and each pair of
    blocks is one group, so none is larger than two blocks. Inside, a pair is
    looked at in the first band that it shares, estimated by the registers and
    confirmed by counting shared shingles; only links leave the group.
    """
    own = written(own.where("rid <> first"))
    split = own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
    split = split.where("lo <> hi").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = own.join(split, "bucket").join(near, ["rid", "first"], "left").join(far, ["rid", "first"], "left")
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    rows = written(
        rows.select("bucket", "band", "rid", "c", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("far", F.lit(False)).alias("far"), "blocks", mine.alias("mine"))
    )
    loose = rows.where("not core").select("bucket").distinct()
    rows = rows.join(loose, "bucket", "left_semi").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("mine", "x").alias("lo"), F.greatest("mine", "x").alias("hi"), "band", "rid", "c", "core", "far", "mine")
    rows = rows.join(classes.select("rid", "registers"), "rid").join(sets, "rid")

    def compare(part: pa.Table) -> pa.Table:
        lo, hi, band = (part.column(k)[0].as_py() for k in ("lo", "hi", "band"))
        rid, c, core, far, mine = (part.column(k).to_numpy() for k in ("rid", "c", "core", "far", "mine"))
        regs = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(len(rid), -1)
        own = [np.frombuffer(s, np.uint64) for s in part.column("s").to_pylist()]
        size = np.array([len(s) for s in own])
        every, start = np.concatenate(own), np.r_[0, np.cumsum(size)[:-1]]
        out = []
        for k in np.flatnonzero(~core).tolist():
            other = (c != c[k]) & ~(core & far[k]) & (core | (rid < rid[k]))
            if lo != hi:
                other &= mine != mine[k]
            at = np.flatnonzero(other)
            same = regs[at] == regs[k]
            first = same.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1)
            at = at[(same.mean(axis=1) >= least) & (first == band)]
            if not len(at):
                continue
            if len(at) * 8 > len(rid):
                found = np.searchsorted(own[k], every)
                equal = own[k][np.minimum(found, size[k] - 1)] == every
                both = np.add.reduceat(equal, start, dtype=np.int64)[at]
            else:
                both = np.array([len(np.intersect1d(own[k], own[x], assume_unique=True)) for x in at])
            out += [(rid[k], rid[x]) for x in at[100 * both >= percent * (size[k] + size[at] - both)]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = 2000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    ``width``-word shingle sets; a component is named by its least doc_id.
    """
    t = percent / 100
    slack = MARGIN * (t * (1 - t) / REGISTERS) ** 0.5
    signed = written(signatures(docs, width))
    sets = signed.where("digest is not null")
    classes = written(
        sets.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("x")).select(
            "digest", F.col("x.doc_id").alias("rid"), "x.n_shingles", "x.registers"
        )
    )
    buckets = written(_buckets(classes))
    pivots = buckets.groupBy("bucket").agg(
        F.min("rid").alias("first"), F.min_by("rid", F.xxhash64("bucket", "rid")).alias("other"), F.count(F.lit(1)).alias("n")
    )
    shared = written(buckets.join(pivots.where("n > 1").drop("n"), "bucket"))
    sets = _sets(shared.select("rid").distinct(), docs, width)
    star = shared.select(F.col("rid").alias("a"), F.explode(F.array(F.struct(F.col("first").alias("b"), F.lit(1).alias("f")), F.struct(F.col("other").alias("b"), F.lit(0).alias("f")))).alias("x"))
    star = star.select("a", "x.b", "x.f").where("a <> b").groupBy("a", "b").agg(F.max("f").alias("f"))
    star = written(_estimated(star.select("a", "b"), classes).join(star, ["a", "b"]))
    # Any spanning set of links will do: those to the first pivots, and the likeliest two others of each member.
    likely = Window.partitionBy("a").orderBy(F.desc("est"), "b")
    tried = star.where(F.col("est") >= t - slack).withColumn("k", F.row_number().over(likely)).where("f = 1 or k <= 2").select("a", "b")
    links = written(_confirmed(tried, sets, percent))

    # What the stars left apart: members of one bucket in different components.
    comp = components(links)
    near = links.select(F.col("a").alias("rid"), F.col("b").alias("first"), F.lit(True).alias("core"))
    far = star.where(F.col("est") < 1 - 2 * (1 - t) - slack).select(F.col("a").alias("rid"), F.col("b").alias("first"), F.lit(True).alias("far"))
    own = shared.join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("bucket", "band", "rid", "first", F.coalesce("component", "rid").alias("c"))
    final = components(links.union(_rest(own, near, far, classes, sets, percent, t - slack, block)))

    named = classes.select("digest", "rid").join(final.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.select("digest", F.coalesce("component", "rid").alias("component_id"))
    return signed.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"),
    )
