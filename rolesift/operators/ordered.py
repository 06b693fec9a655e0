"""First-row, top-n and running-state jobs that hold when one key is hot.

`pos` is a unique, increasing long: the order every "first wins" rule refers
to. Nothing here relies on physical row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BLOCK_ROWS = 1_000_000


#: Rows per key up to which every map task may keep its own first n.
NARROW = 1000


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of every key.

    Spark limits each map task to n rows per key before the shuffle, so a key
    holding a third of the table reaches its task as n rows per map task. Beyond
    ``NARROW`` rows that is a table of its own, and `ranked` takes over.
    """
    if n > NARROW:
        kept = ranked(df, keys, order, "_rank", n)
    else:
        numbered = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        kept = numbered.filter(F.col("_rank") <= n)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank", n: int | None = None, first: int = 1) -> DataFrame:
    """Each row's number in its key's order, for a key (or a whole table, without keys) of any size.

    Rows are dealt by ranges of (keys, order) and counted for each key and
    range; the counts before a range are its offset, so no task numbers more than a
    range. Only ranges that hold a number from ``first`` to ``n`` are numbered at all.
    """
    ranged = df.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    wanted = F.col("_before") + F.col("_size") >= first
    offsets = offsets.filter(wanted if n is None else wanted & (F.col("_before") < n)).drop("_size")
    same = F.col("_range") == F.col("_of")
    for k, key in enumerate(keys):
        offsets = offsets.withColumnRenamed(key, f"_key{k}")
        same &= F.col(key).eqNullSafe(F.col(f"_key{k}"))
    placed = ranged.join(offsets.withColumnRenamed("_range", "_of"), same)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = placed.withColumn(rank, (F.col("_before") + F.row_number().over(inside)).cast("long"))
    kept = numbered.filter((F.col(rank) >= first) if n is None else F.col(rank).between(first, n))
    return kept.select(*df.columns, rank)


def mark_first(df: DataFrame, keys: Sequence[str], pos: str, flag: str, among: Column | None = None) -> DataFrame:
    """Flag the first row (by pos) of every key, all rows kept.

    The first positions come from a partially aggregated min; they are joined
    back on `pos`, which is unique, so no key gathers in one task.
    """
    # A condition inside the min, not a filter before it: a filter on computed
    # columns would be pushed down with all their expressions written out.
    candidate = F.col(pos) if among is None else F.when(among, F.col(pos))
    firsts = df.groupBy(*keys).agg(F.min(candidate).alias(pos)).select(pos, F.lit(True).alias(flag))
    return df.join(firsts, pos, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def running(
    df: DataFrame,
    entity: str,
    pos: str,
    counts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    extra: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running values per entity in `pos` order, two-level.

    counts: rows so far (this one included) for which the condition holds;
    lags: the previous row's value; firsts: the entity's first value;
    lasts: the latest non-NULL value so far. `extra` is joined per entity
    (unique there).

    A block is a run of `block_rows` positions, so no (entity, block) group
    can exceed that many rows however hot the entity is. Block totals are
    carried forward over the small table of blocks and joined back.
    """
    counts, lags, firsts, lasts = counts or {}, lags or {}, firsts or {}, lasts or {}
    values = {f"_l_{k}": c for k, c in lags.items()} | {f"_f_{k}": c for k, c in firsts.items()}
    values |= {f"_n_{k}": c for k, c in lasts.items()}
    values |= {f"_c_{k}": F.when(c, 1).otherwise(0).cast("long") for k, c in counts.items()}
    rows = df.withColumns({**values, "_block": F.floor(F.col(pos) / F.lit(block_rows)).cast("long")})

    totals = [F.sum(f"_c_{k}").alias(f"_tc_{k}") for k in counts]
    totals += [F.max_by(f"_l_{k}", pos).alias(f"_tl_{k}") for k in lags]
    totals += [F.min_by(f"_f_{k}", pos).alias(f"_tf_{k}") for k in firsts]
    # The last non-NULL value: its own position decides.
    totals += [F.max_by(f"_n_{k}", F.when(F.col(f"_n_{k}").isNotNull(), F.col(pos))).alias(f"_tn_{k}") for k in lasts]
    blocks = rows.groupBy(entity, "_block").agg(*totals)
    before = Window.partitionBy(entity).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(entity).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.coalesce(F.sum(f"_tc_{k}").over(before), F.lit(0)).alias(f"_bc_{k}") for k in counts]
    carried += [F.last(f"_tl_{k}").over(before).alias(f"_bl_{k}") for k in lags]
    carried += [F.first(f"_tf_{k}").over(whole).alias(f"_bf_{k}") for k in firsts]
    carried += [F.last(f"_tn_{k}", ignorenulls=True).over(before).alias(f"_bn_{k}") for k in lasts]
    carry = blocks.select(entity, "_block", *carried)
    if extra is not None:
        carry = carry.join(extra, entity, "left")

    inside = Window.partitionBy(entity, "_block").orderBy(pos)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_sc_{k}": F.sum(f"_c_{k}").over(so_far) for k in counts}
    local |= {f"_sl_{k}": F.lag(f"_l_{k}").over(inside) for k in lags}
    local |= {f"_sn_{k}": F.last(f"_n_{k}", ignorenulls=True).over(so_far) for k in lasts}
    if lags:
        local["_head"] = F.row_number().over(inside) == 1
    joined = rows.withColumns(local).join(carry, [entity, "_block"])
    out = {k: F.col(f"_sc_{k}") + F.col(f"_bc_{k}") for k in counts}
    out |= {k: F.when(F.col("_head"), F.col(f"_bl_{k}")).otherwise(F.col(f"_sl_{k}")) for k in lags}
    out |= {k: F.col(f"_bf_{k}") for k in firsts}
    out |= {k: F.coalesce(f"_sn_{k}", f"_bn_{k}") for k in lasts}
    extras = [c for c in extra.columns if c != entity] if extra is not None else []
    return joined.withColumns(out).select(*df.columns, *out, *extras)
