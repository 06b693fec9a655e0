"""Which stored posting each row of a batch goes to, exactly as if rows came one by one.

A row goes to the posting that has its key at that moment, else to the one of
least id with its canonical URL, else with its URL, else it starts a posting. An update
gives the posting the row's key and URLs, so a later row may no longer find it: what
a row meets depends on the rows before it.

Most keys meet nobody else's URLs. All their rows go where the first of them goes, by
joins and partial aggregates, however many rows a key has. Rows whose keys and URLs
are tangled are replayed in order. Up to ``at_once`` of them are one short
sequence; more are first divided into the connected components of the graph of keys
and URLs, and each component is replayed by itself. A replay reads its rows in a
sorted stream and holds the keys and URLs of one component, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, written

IDENTITY = ["duplicate_key", "canonical_job_posting_url", "job_posting_url"]
#: Tangled rows that one task replays without dividing them.
AT_ONCE = 500_000


def identity_values() -> Column:
    """Array of the hashed non-blank key, canonical URL and URL; equal ones of different kinds differ."""
    return F.array_compact(F.array(*[F.when(F.col(c) != "", F.xxhash64(F.lit(k), c)) for k, c in enumerate(IDENTITY)]))


def components(edges: DataFrame) -> DataFrame:
    """node and component (one of its nodes) of the graph with edges a, b; nodes without an edge are absent.

    In each round every node joins its neighbour of least hash, or stays if its
    own is less, and what has joined is one node of the next. Hashes are
    new in each round, so the nodes shrink by a constant part whatever the shape. Nodes
    get their names from the last round backwards, each round's once.
    """
    edges, rounds = written(edges.where("a <> b").distinct()), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        draw = lambda c: F.xxhash64(F.lit(len(rounds)), c)
        joins = both.groupBy("a").agg(F.min(F.struct(draw("b").alias("h"), F.col("b").alias("n"))).alias("least"))
        joins = written(joins.select(F.col("a").alias("node"), F.when(F.col("least.h") < draw("a"), F.col("least.n")).otherwise(F.col("a")).alias("to")))
        left = joins.withColumnsRenamed({"node": "a", "to": "_a"})
        right = joins.withColumnsRenamed({"node": "b", "to": "_b"})
        moved = edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = written(moved.where("a <> b").distinct())
        rounds.append(joins)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = rounds.pop().withColumnRenamed("to", "component")
    for joins in reversed(rounds):
        later = names.withColumnsRenamed({"node": "to", "component": "_to"})
        names = written(joins.join(later, "to", "left").select("node", F.coalesce("_to", "to").alias("component")))
    return names


def candidates(live: DataFrame, snapshot: DataFrame) -> DataFrame:
    """posting_id, key and URLs of the postings that share one with some row."""
    asked = live.select(*IDENTITY).distinct().select(F.explode(identity_values()).alias("v")).distinct()
    held = snapshot.select("posting_id", *IDENTITY, F.explode(identity_values()).alias("v"))
    return held.join(asked, "v", "left_semi").select("posting_id", *IDENTITY).distinct()


def tangled_keys(live: DataFrame, known: DataFrame) -> DataFrame:
    """Keys that meet, over shared URLs or stored postings, rows of another key."""
    rows = live.select(*IDENTITY).distinct().select("duplicate_key", F.explode(identity_values()).alias("v")).distinct()
    span = [F.min("duplicate_key").alias("lo"), F.max("duplicate_key").alias("hi")]
    spans = rows.groupBy("v").agg(*span)
    # A stored posting ties together what its values meet.
    ties = known.select("posting_id", F.explode(identity_values()).alias("v")).join(spans, "v")
    ends = ties.groupBy("posting_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    tied = ties.select("posting_id", "v").join(ends, "posting_id").select("v", "lo", "hi")
    spans = spans.unionByName(tied).groupBy("v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return rows.join(spans.where("lo <> hi"), "v", "left_semi").select("duplicate_key").distinct()


def _of_first_rows(live: DataFrame, known: DataFrame, start: Column) -> DataFrame:
    """pos and entity of rows whose key meets no other: all go where the first does."""
    first = F.min_by(F.struct("canonical_job_posting_url", "job_posting_url"), "pos")
    heads = live.groupBy("duplicate_key").agg(F.min("pos").alias("_first"), first.alias("_h")).select("duplicate_key", "_first", "_h.*")
    for name in IDENTITY:
        side = known.where(F.col(name) != "").groupBy(name).agg(F.min("posting_id").alias(f"_{name}"))
        heads = heads.join(side, name, "left")
    found = F.coalesce(*[F.col(f"_{name}") for name in IDENTITY], start + F.col("_first") + 1)
    return live.select("pos", "duplicate_key").join(heads.select("duplicate_key", found.alias("entity")), "duplicate_key").select("pos", "entity")


def _replayed(rows: DataFrame, start: int) -> DataFrame:
    """pos and entity of sorted rows (component, pos, posting_id, key, URLs); those without pos are stored postings."""

    def replay(batches: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa

        now: object = None
        keys: dict = {}
        held: dict = {}
        by_url: tuple[dict, dict] = ({}, {})

        def least(kind: int, value: str):
            """The least posting that holds the URL now; those that gave it up leave the heap when they come to its top."""
            heap = by_url[kind].get(value, [])
            while heap and held[heap[0]][kind + 1] != value:
                heapq.heappop(heap)
            return heap[0] if heap else None

        for batch in batches:
            out: tuple[list, list] = ([], [])
            for component, pos, known, key, canonical, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != now:
                    now = component
                    for state in (keys, held, *by_url):
                        state.clear()
                entity = known
                if pos is not None:
                    entity = keys.get(key) if key else None
                    if entity is None and url:
                        entity = least(0, canonical) if canonical else None
                        entity = least(1, url) if entity is None else entity
                    entity = start + pos + 1 if entity is None else entity
                    out[0].append(pos)
                    out[1].append(entity)
                before = held.get(entity, (None, None, None))
                held[entity] = (key, canonical, url)
                if before[0] != key:
                    if before[0] and keys.get(before[0]) == entity:
                        del keys[before[0]]
                    if key:
                        keys.setdefault(key, entity)
                for kind, value in enumerate((canonical, url)):
                    if value and before[kind + 1] != value:
                        heapq.heappush(by_url[kind].setdefault(value, []), entity)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["pos", "entity"])

    return rows.select("component", "pos", "posting_id", *IDENTITY).mapInArrow(replay, "pos long, entity long")


def assigned(live: DataFrame, known: DataFrame, start: int, at_once: int = AT_ONCE) -> DataFrame:
    """pos and entity (a posting's id) of every row of a batch.

    ``known`` are the candidates, ``start`` the greatest stored id: a row that starts a
    posting gives it the id start + pos + 1.
    """
    none = (F.col("duplicate_key") == "") & (F.col("job_posting_url") == "")
    alone = live.where(none).select("pos", (F.lit(start) + F.col("pos") + 1).alias("entity"))
    live = live.where(~none).select("pos", *IDENTITY)
    knots = cut(tangled_keys(live, known).where("duplicate_key <> ''"))
    plain = live.where("duplicate_key <> ''").join(knots, "duplicate_key", "left_anti")
    knotted = live.where("duplicate_key <> ''").join(knots, "duplicate_key", "left_semi").unionByName(live.where("duplicate_key = ''"))
    knotted = cut(knotted)
    found = _of_first_rows(plain, known, F.lit(start)).unionByName(alone)
    n = knotted.count()
    if not n:
        return found
    values = knotted.select(F.explode(identity_values()).alias("v")).distinct()
    stored = known.select("posting_id", *IDENTITY, F.explode(identity_values()).alias("v")).join(values, "v", "left_semi")
    stored = stored.groupBy("posting_id", *IDENTITY).agg(F.array_sort(F.collect_set("v")).alias("vs")).withColumn("pos", F.lit(None).cast("long"))
    rows = knotted.withColumns({"vs": identity_values(), "posting_id": F.lit(None).cast("long")}).unionByName(stored)
    if n <= at_once:
        rows = rows.withColumn("component", F.lit(0).cast("long")).repartition(1)
    else:
        rows = cut(rows)
        spokes = rows.select(F.get("vs", F.lit(0)).alias("a"), F.explode(F.slice("vs", 2, 2)).alias("b"))
        named = components(spokes)
        rows = rows.withColumn("node", F.get("vs", F.lit(0))).join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = rows.repartition("component")
    replayed = _replayed(rows.sortWithinPartitions("component", F.asc_nulls_first("pos"), "posting_id"), start)
    return found.unionByName(replayed)
