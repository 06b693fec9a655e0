"""The objects of large JSON lists, read by many tasks.

A JSON list has no line to split at. Spark's text reader splits files of any store by
bytes at a closing brace instead, and two passes make records of the parts. The
first counts, for every byte range, quotes and brackets, once as if the range began
inside a string and once as if it did not; one short row for each range then
tells how each of them really begins. The second cuts the records
out; one that reaches over ranges is put together from its pieces. Positions
count the records over all files, in the order of their paths.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut


def _parts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _summaries(parts: DataFrame, key: str | None) -> list:
    """Per byte range the parity of quotes, bracket sums and the depths at which the list's key stands, by either beginning."""

    def scan(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        token = re.compile(r'\\.|["{}\[\]]', re.S)
        marker = re.compile(rf'"{re.escape(key)}"\s*:\s*\Z') if key else None
        names = ["file", "start", "odd", "sum0", "sum1", "keys0", "keys1"]
        now, odd, sums, keys = None, 0, [0, 0], [[], []]

        def row():
            values = [*now, odd, *sums, *keys]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != now:
                    if now:
                        yield row()
                    now, odd, sums, keys = (file, start), 0, [0, 0], [[], []]
                for m in token.finditer(value):
                    t = m[0]
                    if t == '"':
                        odd ^= 1
                    elif t in "{[":
                        if marker and t == "[" and marker.search(value, max(0, m.start() - len(key) - 40), m.start()):
                            keys[odd].append(sums[odd])
                        sums[odd] += 1
                    elif t in "}]":
                        sums[odd] -= 1
                sums[odd] -= 1  # the brace that ends the part
        if now:
            yield row()

    schema = "file string, start long, odd int, sum0 long, sum1 long, keys0 array<long>, keys1 array<long>"
    return sorted(parts.mapInArrow(scan, schema).collect(), key=lambda r: (r.file, r.start))


def _begins(ranges: list, key: str | None) -> dict[tuple[str, int], tuple[bool, int, bool]]:
    """How each byte range begins: inside a string, at which depth, inside the list."""
    out, file, quoted, depth, listed = {}, None, False, 0, False
    base = 2 if key else 1
    for r in ranges:
        if r.file != file:
            file, quoted, depth, listed = r.file, False, 0, False
        out[r.file, r.start] = (quoted, depth, listed and depth >= base)
        found = r.keys1 if quoted else r.keys0
        listed = listed or (depth == 0 if key is None else any(depth + k == 1 for k in found))
        depth += r.sum1 if quoted else r.sum0
        quoted ^= bool(r.odd)
    return out


def _cut_out(parts: DataFrame, begins: dict, key: str | None) -> DataFrame:
    """Rows of records ('whole'), their pieces ('tail' begins one, 'through' and 'head' go on) and what stands around the list ('outer')."""

    def each(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa

        token = re.compile(r'\\.|["{}\[\]]', re.S)
        marker = re.compile(rf'"{re.escape(key)}"\s*:\s*\Z') if key else None
        base = 2 if key else 1
        now = None
        quoted = listed = carried = False
        depth = count = 0
        held: list | None = None  # the open record's text so far
        outer: list = []
        rows: list = []

        def ended():
            if held is not None:
                rows.append((*now, -1 if carried else count, "through" if carried else "tail", "".join(held)))
            if outer:
                rows.append((*now, 0, "outer", "".join(outer)))

        def flushed():
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["file", "start", "n", "kind", "text"])
            rows.clear()
            return out

        for batch in batches:
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != now:
                    if now:
                        ended()
                    now = (file, start)
                    quoted, depth, listed = begins[now]
                    carried = listed and depth > base
                    held, outer, count = [] if carried else None, [], 0
                value += "}"
                at = 0  # where the open record, or what is around the list, goes on
                for m in token.finditer(value):
                    t = m[0]
                    if t == '"':
                        quoted = not quoted
                    elif quoted or t[0] == "\\":
                        continue
                    elif t in "{[":
                        if listed and depth == base and t == "{":
                            held, at = [], m.start()
                        elif not listed and t == "[" and depth == base - 1 and (marker is None or marker.search(value, 0, m.start())):
                            listed = True
                            outer.append(value[at : m.end()])
                        depth += 1
                    else:
                        depth -= 1
                        if listed and depth == base and held is not None:
                            held.append(value[at : m.end()])
                            rows.append((*now, -1 if carried else count, "head" if carried else "whole", "".join(held)))
                            count += not carried
                            held, carried, at = None, False, m.end()
                        elif listed and depth < base:
                            listed, at = False, m.start()
                if held is not None:
                    held.append(value[at:])
                elif not listed:
                    outer.append(value[at:])
            yield flushed()
        if now:
            ended()
            yield flushed()

    return parts.mapInArrow(each, "file string, start long, n long, kind string, text string")


def read_objects(spark: SparkSession, path: str | list[str], key: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(pos, text) of the objects of each file's list, and by file what stands around it.

    The list is the whole file, or the value of ``key`` in the file's object.
    Elements that are no objects are dropped.
    """
    parts = _parts(spark, path)
    begins = _begins(_summaries(parts, key), key)
    rows = cut(_cut_out(parts, begins, key))
    outer: dict[str, str] = {}
    for r in sorted(rows.where("kind = 'outer'").collect(), key=lambda r: (r.file, r.start)):  # the text around each file's list
        outer[r.file] = outer.get(r.file, "") + r.text
    counts = {(r.file, r.start): r.n for r in rows.where("kind IN ('whole', 'tail')").groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for file, start in sorted(begins):
        offsets.append((file, start, total))
        total += counts.get((file, start), 0)
    places = spark.createDataFrame(offsets, "file string, start long, first long")
    # At most two pieces of each byte range lie in an open record.
    pieces = rows.where("kind IN ('tail', 'through', 'head')")
    begun = F.when(F.col("kind") == "tail", 1).otherwise(0)
    opened = F.sum(begun).over(Window.partitionBy("file").orderBy("start", begun).rowsBetween(Window.unboundedPreceding, 0))
    chains = pieces.withColumn("chain", opened).groupBy("file", "chain").agg(
        F.max_by(F.struct("start", "n"), F.when(F.col("kind") == "tail", F.col("start"))).alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    joined = chains.where("h IS NOT NULL").select("file", "h.start", "h.n", "text")
    every = rows.where("kind = 'whole'").select("file", "start", "n", "text").unionByName(joined)
    return every.join(F.broadcast(places), ["file", "start"]).select((F.col("first") + F.col("n")).alias("pos"), "text"), outer
