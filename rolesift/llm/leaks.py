"""Benchmark decontamination: SimHash windows, multi-index blocks, exact check.

For every benchmark item of L words the L-word windows of a document are
compared with it. The similarity is at most the part of the item's shingles that
the window shares, so all windows are cut, at any start and in any order of their
words, that hold so many places with a shingle of items of that size as the
threshold asks; all others stay under it. Each window and each item gets a 64-bit SimHash of its
words. The fingerprints are cut into eight blocks: two that differ in at most 15
bits differ in at most one bit in some block, so items are listed under each
block value and its one-bit neighbours, and every pair within the radius meets.
Pairs within it are confirmed by the weighted Jaccard similarity of their
shingles, weighted by how often each occurs.

Only column expressions, joins and grouped sums are used. Shingles of documents
are hashed inside generated code and never shuffled: the benchmark's shingle
table is broadcast when its summed lists hold at most ``broadcast_rows`` entries, as are the
starts that were found; beyond that Spark joins by exchange. Equal windows are
compared once, whatever the number of documents that hold them; texts are known by
their 128-bit digest, and a pair is compared inside its row. Where an item of L words stands
in a document, up to 0.4 L windows of L words are cut: very long items are dear.

Defined results: null and empty texts hold nothing; case is ignored; items with
fewer words than a shingle match nothing; two texts under one item_id are both
looked for, and two under one doc_id are two documents of which ``decontaminated``
drops only those that hold an item; a null doc_id is an id like another; of a document
shorter than the item its whole text is the window; repeated rows and items give one
row for each pair of ids; other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

WIDTH = 5
RADIUS = 15
BLOCKS = 8
BITS = 64 // BLOCKS


def _shingle(w: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(w, at + k) for k in range(width)])


def _lanes() -> list[Column]:
    """Thirty-two sums of two 32-bit lanes each: how many words have each bit of their hash set."""
    out = []
    for k in range(32):
        n = F.shiftrightunsigned("_h", 2 * k)
        lanes = n.bitwiseAND(F.lit(1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(n, 1).bitwiseAND(F.lit(1)), 32))
        out.append(F.sum(lanes).alias(f"_l{k}"))
    return out


def _fingerprint() -> Column:
    """The bits that over half of the words have."""
    out = F.lit(0).cast("long")
    for k in range(64):
        set_ = F.shiftrightunsigned(f"_l{k // 2}", 32 * (k % 2)).bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("_n")
        out = out.bitwiseOR(F.when(set_, F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """key, size and fp: the SimHash of the words of the array ``w``; keys are distinct."""
    each = rows.select(key, "size", F.explode("w").alias("_word")).select(key, "size", F.xxhash64("_word").alias("_h"))
    return each.groupBy(key, "size").agg(F.count(F.lit(1)).alias("_n"), *_lanes()).select(key, "size", _fingerprint().alias("fp"))


def _block(fp: str, k: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))


def _probes(near: bool) -> Column:
    """Block number and value, with the one-bit neighbours if ``near``."""
    flips = [0, *([1 << b for b in range(BITS)] if near else [])]
    return F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), _block("fp", k).bitwiseXOR(F.lit(x).cast("long")).alias("v")) for k in range(BLOCKS) for x in flips])
    )


def _starts(at: str, most: Column, percent: int) -> Column:
    """Starts of all windows of ``most`` shingles that hold at least ``percent`` in a hundred as many places of the sorted array ``at``.

    The window has k places if it holds some i-th to (i + k - 1)-th; those that
    held the (i - 1)-th to (i + k - 2)-th too are listed there.
    """
    k = F.ceil(most * percent / 100).cast("int")

    def new(i: Column) -> Column:
        low = F.greatest(F.get(at, i + k - 1) - most + 1, F.coalesce(F.get(at, i - 1), F.lit(-1)) + 1)
        return F.when(low <= F.get(at, i), F.sequence(low, F.get(at, i))).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(at) >= k, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - k), new))).otherwise(F.array().cast("array<int>"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _numbered(sorted_: Column) -> Column:
    """A sorted array with each element's number among its equals: as a set, what the array is as a multiset."""
    first = F.transform(sorted_, lambda h: F.xxhash64(h, F.lit(0)))
    every = F.transform(sorted_, lambda h, i: F.xxhash64(h, (i + 1 - F.array_position(sorted_, h)).cast("int")))
    return F.when(F.size(F.array_distinct(sorted_)) == F.size(sorted_), first).otherwise(every)


def _multiset(rows: DataFrame, w: str, width: int, name: str) -> DataFrame:
    """The weighted shingles of the word array ``w`` as a set."""
    spots = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
    made = rows.withColumn("_s", F.array_sort(F.transform(spots, lambda o: _shingle(w, o, width))))
    return made.withColumn(name, _numbered(F.col("_s"))).drop("_s", w)


def _bounded(rows: DataFrame, lists: str, most: int) -> DataFrame:
    """The rows, to be broadcast if their lists hold at most ``most`` entries in all."""
    return F.broadcast(rows) if (rows.agg(F.sum(F.size(lists)).alias("n")).first().n or 0) <= most else rows


def places(docs: DataFrame, bench: DataFrame, percent: int, width: int, radius: int, broadcast_rows: int) -> DataFrame:
    """doc_id, t (hash of the text), item_id, similarity and start of every window that holds an item."""
    if radius >= 2 * BLOCKS:
        raise ValueError("blocks guarantee a radius under twice their number")
    members = bench.where("item_id is not null").select("item_id", F.array_join(words(F.lower("text")), " ").alias("text"))
    members = written(members.withColumn("item", _digest(F.col("text"))).distinct())
    items = members.select("item", F.split("text", " ").alias("w")).withColumn("size", F.size("w")).where(F.col("size") >= width)
    items = written(_multiset(items.distinct().withColumn("v", F.col("w")), "v", width, "b"))
    spots = items.select("size", "w", F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("o"))
    spots = spots.select(_shingle("w", F.col("o"), width).alias("h"), "size").groupBy("h").agg(F.collect_set("size").alias("sizes"))
    spots = _bounded(written(spots), "sizes", broadcast_rows)

    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), F.lower("text").alias("text"))
    hits = texts.select("doc_id", "t", words(F.col("text")).alias("w"))
    hits = hits.select("doc_id", "t", "w", F.posexplode("w").alias("p", "_x")).where(F.col("p") <= F.size("w") - width)
    hits = hits.select("doc_id", "t", "p", _shingle("w", F.col("p"), width).alias("h")).join(spots, "h")
    hits = hits.select("doc_id", "t", "p", F.explode("sizes").alias("size"))
    found = hits.groupBy("doc_id", "t", "size").agg(F.sort_array(F.collect_set("p")).alias("at"))
    found = found.withColumn("starts", _starts("at", F.col("size") - width + 1, percent)).where(F.size("starts") > 0)
    found = _bounded(written(found.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "size", "starts")), "starts", broadcast_rows)
    cut = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    cut = cut.select("doc_id", "t", "size", words(F.col("text")).alias("w"), F.explode("starts").alias("start"))
    windows = cut.select("doc_id", "t", "size", "start", F.array_join(F.slice("w", F.col("start") + 1, F.col("size")), " ").alias("text"))
    windows = written(windows.withColumn("window", _digest(F.col("text"))))

    # Equal windows once.
    once = written(windows.groupBy("window", "size").agg(F.first("text").alias("text")))
    fps = fingerprints(once.withColumn("w", F.split("text", " ")), "window")
    probes = fingerprints(items, "item").select("item", "size", F.col("fp").alias("item_fp"), _probes(True).alias("x")).select("item", "size", "item_fp", "x.k", "x.v")
    met = fps.select("window", "size", "fp", _probes(False).alias("x")).select("window", "size", "fp", "x.k", "x.v").join(probes, ["size", "k", "v"])
    met = written(met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("window", "size", "item").distinct())
    both = met.join(_multiset(once.select("window", "size", F.split("text", " ").alias("w")), "w", width, "a"), ["window", "size"]).join(items.select("item", "b"), "item")
    shared = both.withColumn("x", F.size(F.array_intersect("a", "b"))).withColumn("y", F.size("a") + F.size("b") - F.col("x"))
    sure = shared.where(F.col("x") * 100 >= F.col("y") * percent).select("window", "size", "item", (F.col("x") / F.col("y")).alias("similarity"))
    return windows.drop("text").join(written(sure), ["window", "size"]).join(members.select("item", "item_id"), "item").select("doc_id", "t", "item_id", "similarity", "start")


def leaks(
    docs: DataFrame, bench: DataFrame, percent: int = 80, width: int = WIDTH, radius: int = RADIUS, broadcast_rows: int = 2_000_000
) -> DataFrame:
    """doc_id, item_id, similarity and start (word number of the best window) of every leak."""
    best = places(docs, bench, percent, width, radius, broadcast_rows).groupBy("doc_id", "item_id")
    return best.agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x")).select(
        "doc_id", "item_id", F.col("x.similarity").alias("similarity"), (-F.col("x.s")).cast("long").alias("start")
    )


def decontaminated(
    docs: DataFrame, bench: DataFrame, percent: int = 80, width: int = WIDTH, radius: int = RADIUS, broadcast_rows: int = 2_000_000
) -> DataFrame:
    """The documents that hold no item, all columns as they were."""
    gone = places(docs, bench, percent, width, radius, broadcast_rows).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__t")), "left_anti")
