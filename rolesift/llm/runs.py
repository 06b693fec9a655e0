"""Periodic runs of words: tiles for each octave of periods, stitched by document and period.

A run is a stretch of words with smallest period q and at least ``times`` periods
(``least`` words) that no neighbouring word extends. Word i and word i + q are
equal over an unbroken interval of at least need(q) = max(least, times * q) - q
words i; finding these intervals finds the runs.

Periods q from P to 2P - 1, P a power of two, are one octave. Its anchors stand 2P
words apart. A tile is an anchor c with need(2P - 1) words and more on either side,
and is solved alone: the Z-function of the words from c gives for every q
how far equality goes on to the right, that of the reversed words before c how far
it goes to the left. What is longer than the tile leaves it as a fragment, and the
fragments of a (document, period) are stitched where they meet. Each interval
holds an anchor whose next P words stand q words on once more, so only anchors
with such an equal hash are solved; the Z-functions then compare the words
themselves. A stretch whose first q words are a power of a shorter word has a
smaller period and is left to that one's octave, so nothing is found twice.

Short documents are solved where they are read, many at once. A longer one is
cut into pieces of ``tile_words`` words (32 P for the octaves that need more) with
12 P words more on either side; the pieces are dealt to all tasks and their
fragments meet by (document, period). Texts are shuffled only of documents that
have runs or more than ``tile_words`` words.

Defined results: null and empty texts have no words and no run; repeated rows are
documents of their own, whatever their ids; a document of one word throughout has
one run; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

LEAST, TIMES = 6, 4
TILE_WORDS = 8192
#: Words that are solved at once, and words beyond a piece in parts of the octave.
AT_ONCE, MARGIN = 1 << 20, 12
#: Odd multipliers of the hash of neighbouring words.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

FOUND = T.ArrayType(T.StructType([T.StructField("period", T.LongType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def z_function(s: list) -> list[int]:
    """For each place, how many elements from there on are those from the start on."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def need(q: int, least: int, times: int) -> int:
    """Places i with word i equal to word i + q that a run has at least."""
    return max(least, times * q) - q


def tile(words: list, c: int, p: int, periods: list[int], least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(q, x, y) of the intervals around anchor c that are long enough, as far as the tile reaches."""
    reach = need(2 * p - 1, least, times)
    ahead = z_function(words[c : c + reach + 2 * p])
    periods = [q for q in periods if q < len(ahead) and ahead[q] >= p]  # the hashes may deceive
    if not periods:
        return
    low, high = max(0, c - reach), min(len(words), c + 2 * p)
    before = words[low:c][::-1]
    behind = z_function([*before, None, *words[low:high][::-1]])
    for q in periods:
        f, b = min(ahead[q], reach), min(behind[len(before) + 1 + high - c - q], reach)
        if f + b >= need(q, least, times) and not any(q % d == 0 and ahead[d] >= q - d for d in range(1, q // 2 + 1)):
            yield q, c - b, c + f


def met(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals of equal q that overlap or touch as one."""
    out: list[tuple[int, int, int]] = []
    for q, x, y in sorted(found):
        if out and out[-1][0] == q and x <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(y, out[-1][2]))
        else:
            out.append((q, x, y))
    return out


def solve(parts: list[list], low: int, high: int, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Intervals (q, x, y) of each part, for the octaves from ``low`` to ``high``."""
    flat: list = []
    starts = []
    for k, part in enumerate(parts):
        starts.append(len(flat))
        flat += part
        flat.append(~k)  # equals no word and no other end
    n = len(flat)
    found: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    longest = max(map(len, parts), default=0)
    grams = np.fromiter(map(hash, flat), np.int64, n).view(np.uint64)
    at = np.array(starts)
    p = 1
    while p <= high and times * p <= longest:
        if p >= low:
            rows = np.zeros(-(-n // (2 * p)) * 2 * p, np.uint64)
            rows[: len(grams)] = grams
            rows = rows.reshape(-1, 2 * p)
            equal = rows[:, p:] == rows[:, :1]
            for r in np.flatnonzero(equal.any(axis=1)).tolist():
                c = 2 * p * r
                if c >= len(grams):
                    break
                own = int(np.searchsorted(at, c, "right")) - 1
                for q, x, y in tile(flat, c, p, (np.flatnonzero(equal[r]) + p).tolist(), least, times):
                    found[own].append((q, x - starts[own], y - starts[own]))
        if len(grams) <= p:
            break
        grams = grams[:-p] * MIX[0] + (grams[p:] ^ (grams[p:] >> np.uint64(29))) * MIX[1]
        p *= 2
    return [met(f) for f in found]


def pieces(n: int, tile_words: int, times: int) -> Iterator[tuple[int, int, int, int]]:
    """Octaves from and to, first and last word of the overlapping pieces of a document of n words."""
    shared = 1
    while 32 * shared * 2 <= tile_words:
        shared *= 2
    low, high, p = 1, shared, shared
    while times * low <= n:
        core = max(tile_words, 32 * p)
        for s in range(0, n, core):
            yield low, high, max(0, s - MARGIN * p), min(n, s + core + MARGIN * p)
        low = high = p = 2 * p


def collapsed(words: list[bytes], runs: list) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, period, length in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return list(itertools.compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def _solved(docs: DataFrame, tile_words: int, least: int, times: int, texts: bool) -> DataFrame:
    """A row for each document, and one for each piece of a long one (``low`` is set).

    Documents without runs are done; of the others the words are kept.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()), T.StructField("doc_id", kind), T.StructField("done", T.BooleanType()), T.StructField("words", T.BinaryType()),
            T.StructField("sha", T.StringType()), T.StructField("collapsed", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
            T.StructField("first", T.LongType()), T.StructField("found", FOUND),
        ]
    )
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(1).type
            types = [pa.int64(), id_type, pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _FOUND]
            waiting, size, done = [], 0, []

            def flush(types=types):
                out = list(done)
                solved = solve([w for _, _, w in waiting], 1, AT_ONCE, least, times)
                for (key, doc, words), found in zip(waiting, solved, strict=True):
                    joined = b" ".join(words)
                    if found:
                        out.append((key, doc, False, joined, None, None, None, None, None, _records(found)))
                    else:
                        out.append((key, doc, True, None, hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None, None, None, None, None))
                waiting.clear()
                done.clear()
                columns = zip(*out, strict=True) if out else [[]] * len(types)
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                size += len(words)
                if len(words) <= tile_words:
                    waiting.append((key, doc, words))
                else:
                    done.append((key, doc, False, b" ".join(words), None, None, None, None, None, None))
                    for low, high, first, last in pieces(len(words), tile_words, times):
                        done.append((key, doc, False, b" ".join(words[first:last]), None, None, low, high, first, None))
                        size += last - first
                if size > AT_ONCE:
                    yield flush()
                    size = 0
            yield flush()

    return docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("binary")).mapInArrow(cut, schema)


_FOUND = pa.list_(pa.struct([("period", pa.int64()), ("x", pa.int64()), ("y", pa.int64())]))


def _records(found: list[tuple[int, int, int]], first: int = 0) -> list[dict]:
    return [{"period": q, "x": x + first, "y": y + first} for q, x, y in found]


def _of_pieces(rows: DataFrame, least: int, times: int) -> DataFrame:
    """key and found of every piece."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, low, high, first, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(key)
                found.append(_records(solve([words.split()], low, high, least, times)[0], first))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, _FOUND)], names=["key", "found"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("found", FOUND)])
    return rows.select("key", "low", "high", "first", "words").mapInArrow(each, schema)


def stitched(fragments: DataFrame) -> DataFrame:
    """key and runs: intervals (key, period, x, y) that overlap or touch become one run each, sorted by start, then period."""
    by = Window.partitionBy("key", "period").orderBy("x", "y")
    reach = F.max("y").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = fragments.withColumn("new", F.when(F.col("x") <= reach, 0).otherwise(1))
    chains = new.withColumn("chain", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = chains.groupBy("key", "period", "chain").agg(F.min("x").alias("start"), F.max("y").alias("y"))
    run = F.struct("start", "period", (F.col("y") - F.col("start") + F.col("period")).alias("length"))
    return whole.groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _finished(rows: DataFrame, texts: bool) -> DataFrame:
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, hashes = [], []
            for words, runs in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = b" ".join(collapsed(words.split(), [(r["start"], r["period"], r["length"]) for r in runs]))
                kept.append(text.decode() if texts else None)
                hashes.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.string()), pa.array(hashes, pa.string())], names=schema.names)

    return rows.select("doc_id", "runs", "words").mapInArrow(each, schema)


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, tile_words: int = TILE_WORDS, texts: bool = True) -> DataFrame:
    """doc_id, runs, collapsed and collapsed_sha256 of every row.

    ``runs`` holds start, period and length of each by start, then period; ``collapsed``
    the words that no run holds after its first period, joined by one space, or null
    where ``texts`` is false: then no text is carried but those with runs.
    """
    if least <= times or times < 4:
        raise ValueError("runs have at least four periods, and more words than that")
    rows = written(_solved(docs, tile_words, least, times, texts))
    cut = rows.where("low is not null").repartition(F.col("key"), F.col("low"), F.col("first"))
    found = rows.where("low is null").select("key", "found").unionByName(_of_pieces(cut, least, times))
    fragments = found.select("key", F.explode("found").alias("f")).select("key", "f.period", "f.x", "f.y")
    none = F.array().cast(RUNS)
    open_ = rows.where("low is null and not done").select("key", "doc_id", "words").join(stitched(fragments), "key", "left")
    open_ = _finished(open_.withColumn("runs", F.coalesce("runs", none)), texts)
    clear = rows.where("low is null and done").select("doc_id", none.alias("runs"), "collapsed", F.col("sha").alias("collapsed_sha256"))
    return clear.unionByName(open_)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and the digest of all runs, beside ``collapsed_sha256``."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    first = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = found.withColumn("_best", F.array_min(F.transform("runs", first)))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.expr("(-1000 * _best.l) div _best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
