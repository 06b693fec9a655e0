"""Best-fit packing by linear grouping.

1. Documents are tokenized whole and cut into pieces of at most ``capacity``
   tokens; only the lengths are needed to plan.
2. The histogram of piece lengths has at most ``capacity`` entries whatever the
   corpus size. The driver plans on it alone: large lengths are put in
   ``groups`` groups of equal cardinality, each rounded up to its longest; the
   mix of sequence configurations of these few sizes is optimised by column
   generation; the real lengths take the slots, longest first; what is left and
   the small lengths are placed best-fit. All of this works on runs of equal
   sequences, never on single documents.
3. The plan is a bounded list of slots for each length. Every piece has a rank
   among the pieces of its length, and rank and slot list give its sequence and
   place: one shuffle of (length, id) for the ranks, none of the tokens.

Ranks are counted in salted blocks, so a length that a third of all pieces have
is not one task's work. Defined results: null and empty texts are one piece,
the closing id alone; repeated rows are packed each; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

CAPACITY = 2048
#: Groups of the large lengths, and the part of the capacity from which a length is large.
GROUPS, LARGE = 24, 0.125
#: Words whose ids a worker keeps; when full it starts anew.
KEPT = 600_000
#: Lower-case Latin letters alone: one piece for the merges, needing no normalizer or splitter.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The printable letters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = _byte_letters()


class Words(dict):
    """Little-endian 32-bit ids of lower-case words; kept from the second time a word is seen."""

    def __init__(self, tok):
        super().__init__()
        self.tok, self.model = tok, tok.model
        self.seen = bytearray(1 << 22)
        self.ends = {b",": self.encoded(b","), b".": self.encoded(b".")}

    def encoded(self, word: bytes) -> bytes:
        return array("I", self.tok.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        # A comma or full stop after a word of letters is a token of its own.
        end = self.ends.get(word[-1:])
        if end is not None and PLAIN.fullmatch(word, 0, len(word) - 1):
            return self[word[:-1]] + end
        if PLAIN.fullmatch(word):
            ids = array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(LETTERS))]).tobytes()
        else:
            ids = self.encoded(word)
        at, bit = (hash(word) & 0x1FFFFFF) >> 3, 1 << (hash(word) & 7)
        if self.seen[at] & bit:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        self.seen[at] |= bit
        return ids


@functools.lru_cache(2)
def _words(path: str) -> Words:
    return Words(_tokenizer(path))


def token_ids(texts: Iterable[bytes], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text.

    The vocabulary lower-cases and its splitter drops white space, so a text's
    ids are those of its words in a row; frequent words are encoded once.
    """
    known = _words(path)
    for data in texts:
        # Special strings are found before lower-casing.
        words = map(known.encoded, data.split()) if b"<|" in data else map(known.__getitem__, data.lower().split())
        yield b"".join(words)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; each document ends with id 0."""
    path = path or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            ids = batch.column(0).to_pylist()
            texts = (x.as_py() or b"" for x in batch.column(1))
            for doc, data in zip(ids, token_ids(texts, path), strict=True):
                data += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[float, np.ndarray]]:
    """Amounts of the configurations that fill the demand with the least sequences, by column generation.

    The master problem min sum(x), A x >= demand, x >= 0 is solved by revised
    simplex steps on a basis of as many configurations as sizes; the knapsack
    over the dual values finds the next configuration.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = np.linalg.solve(basis, demand.astype(float))
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i in range(k):
            if dual[i] > 1e-12:
                s = int(sizes[i])
                for c in range(s, capacity + 1):
                    if best[c - s] + dual[i] > best[c] + 1e-12:
                        best[c], pick[c] = best[c - s] + dual[i], i
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0 and best[c] > 0:
            if pick[c] < 0:
                c -= 1
                continue
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(x, 0) / step, np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = column
    return [(float(v), basis[:, i].astype(int)) for i, v in enumerate(x) if v > 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, per sequence, offset) for every piece of the histogram.

    Ranks from ``first`` on take ``per`` places in each sequence, from
    ``offset`` on, sequence after sequence.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    # Runs of equal sequences: lengths in order -> how many; full ones need no plan.
    runs: list[tuple[int, list[int]]] = []
    if capacity in left:
        runs.append((left.pop(capacity), [capacity]))
    big = sorted((n for n in left if n >= large * capacity), reverse=True)
    total = sum(left[n] for n in big)
    if big:
        # Equal cardinality: a group ends at the first length that fills its share.
        groups_of, seen, rounded = {}, 0, {}
        for n in big:
            g = min(groups - 1, seen * groups // total)
            groups_of[n] = g
            rounded.setdefault(g, n)
            seen += left[n]
        order = sorted(rounded)
        sizes = np.array([rounded[g] for g in order])
        demand = np.array([sum(left[n] for n in big if groups_of[n] == g) for g in order])
        # The group's real lengths as queues, longest first.
        queues = [[[n, left[n]] for n in big if groups_of[n] == g] for g in order]
        for amount, column in sorted(configurations(sizes, demand, capacity), key=lambda v: -v[0]):
            n_seq = int(amount)
            while n_seq > 0:
                # As many equal sequences as the heads of the queues allow.
                take, content, ok = n_seq, [], True
                for i, a in enumerate(column):
                    if not a:
                        continue
                    if not queues[i] or sum(c for _, c in queues[i]) < a:
                        ok = False
                        break
                    head, count = queues[i][0]
                    if count >= a:
                        take = min(take, count // a)
                        content += [(i, 0, a)]
                    else:
                        take, need, k = 1, a, 0
                        while need:
                            used = min(need, queues[i][k][1])
                            content.append((i, k, used))
                            need -= used
                            k += 1
                if not ok:
                    break
                lengths = [queues[i][k][0] for i, k, a in content for _ in range(a)]
                for i, k, a in content:
                    queues[i][k][1] -= a * take
                for q in queues:
                    q[:] = [x for x in q if x[1]]
                runs.append((take, lengths))
                n_seq -= take
        for n in big:
            del left[n]
        for q in queues:
            for n, c in q:
                left[n] = left.get(n, 0) + c
    # The rest, longest first, each into the fullest sequences that still take it.
    free: dict[int, list[tuple[int, list[int]]]] = {}

    def put(count: int, lengths: list[int]) -> None:
        space = capacity - sum(lengths)
        if space not in free:
            free[space] = []
        free[space].append((count, lengths))

    for count, lengths in runs:
        put(count, lengths)
    for n in sorted(left, reverse=True):
        need = left[n]
        while need:
            space = min((s for s, v in free.items() if s >= n and v), default=None)
            if space is None:
                per = min(capacity // n, need)
                count = need // per
                put(count, [n] * per)
                need -= count * per
                continue
            count, lengths = free[space].pop()
            per = min(space // n, need)
            used = min(count, need // per)
            if used < count:
                free[space].append((count - used, lengths))
            put(used, lengths + [n] * per)
            need -= used * per
    slots, ranks, seq = [], {}, 0
    for space in sorted(free):
        for count, lengths in free[space]:
            at = 0
            while at < len(lengths):
                n = lengths[at]
                per = 1
                while at + per < len(lengths) and lengths[at + per] == n:
                    per += 1
                first = ranks.get(n, 0)
                slots.append((n, first, per * count, seq, per, sum(lengths[:at])))
                ranks[n] = first + per * count
                at += per
            seq += count
    return slots


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, block: int = 1_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, path))
    per_length = cut.groupBy("length").count()
    histogram = {r.length: r["count"] for r in per_length.collect()}  # at most ``capacity`` rows
    slots = plan(histogram, capacity)
    # Salted blocks of about ``block`` pieces of one length, counted and then ranked each.
    salts = max(histogram.values(), default=0) // block + 16
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(inside) - 1).join(sums, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r")).alias("rank"))

    lists: dict[int, list[tuple[int, ...]]] = {}
    for n, *slot in slots:
        lists.setdefault(n, []).append(tuple(slot))
    tables = spark.sparkContext.broadcast({n: np.array(v, np.int64) for n, v in lists.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                t = tables.value[int(n)]
                s = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                nth = rank[own] - s[:, 0]
                seq[own] = s[:, 2] + nth // s[:, 3]
                off[own] = s[:, 4] + nth % s[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
