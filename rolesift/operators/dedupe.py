"""Duplicates, first sightings and known keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trust, urls
from ..functions.text import clean, let, norm_plain, or_default
from .ordered import BLOCK_ROWS, running, top_n


def batch_key() -> Column:
    """Normal duplicate key, else lower URL, else company/title/location."""
    named = F.concat_ws(
        "|", *[F.nullif(norm_plain(F.col(c)), F.lit("")) for c in ("company", "title", "location")]
    )
    parts = F.struct(
        norm_plain(F.col("duplicate_key")).alias("dup"), F.lower(clean(F.col("job_posting_url"))).alias("url"), named.alias("named")
    )
    return let(
        parts,
        lambda p: F.when(p["dup"] != "", F.concat(F.lit("dup:"), p["dup"]))
        .when(p["url"] != "", F.concat(F.lit("url:"), p["url"]))
        .when(p["named"] != "", F.concat(F.lit("fallback:"), p["named"]))
        .otherwise(F.lit("")),
    )


def quality_order() -> list[Column]:
    """Numbers of a payload's worth, the weightier first: trust, detail, URL and title length."""
    length = lambda c: F.length(clean(F.col(c)))
    return [trust.rank(F.col("source_trust"), trust.REVIEW_TRUST), length("source_detail"), length("job_posting_url"), length("title")]


def _worth(c: Column) -> Column:
    return -F.coalesce(c, F.lit(-1)).cast("long")


def dedupe_batch(df: DataFrame, keep: str = "first", pos: str = "pos", within: Sequence[str] = ()) -> DataFrame:
    """One row per batch key with the number of duplicates dropped.

    keep='first' is what the reference stores, keep='best' what it computes;
    ties keep the first. Rows without a key are never duplicates.
    """
    if keep not in ("first", "best"):
        raise ValueError(f"keep must be 'first' or 'best', not {keep!r}")
    key = batch_key()
    order = F.struct(*[_worth(c) for c in quality_order()], F.col(pos).alias("pos")) if keep == "best" else F.col(pos)
    keyed = df.select(*within, pos, key.alias("_key"), order.alias("_order"))
    # One narrow row each: rows without a key are keys of their own.
    keyed = keyed.withColumn("_key", F.when(F.col("_key") == "", F.concat(F.lit("row:"), F.col(pos))).otherwise(F.col("_key")))
    kept = keyed.groupBy(*within, "_key").agg(F.min("_order").alias("_first"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    own = F.when(F.col("_key").startswith("row:"), F.lit("")).otherwise(F.col("_key"))
    first = F.col("_first.pos") if keep == "best" else F.col("_first")
    return df.join(kept.select(first.alias(pos), own.alias("batch_key"), "duplicates"), pos)


def distinct_in_order(df: DataFrame, key: str | Column, pos: str, within: Sequence[str] = ()) -> DataFrame:
    """The first row of every non-blank key."""
    column = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_key", column).filter(F.col("_key") != "")
    return top_n(keyed, [*within, "_key"], [F.col(pos).asc()]).drop("_key")


def discovery_state(
    observations: DataFrame,
    entity: str,
    run: str,
    pos: str,
    removed: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Net new, seen again in the run, seen in an earlier run, or removed."""
    gone = None
    if removed is not None:
        gone = removed.select(entity).distinct().withColumn("_gone", F.lit(True))
    lagged = running(observations, entity, pos, lags={"_prev": F.col(run)}, extra=gone, block_rows=block_rows)
    state = (
        F.when(F.col("_prev").isNull(), F.lit("net_new"))
        .when(F.col("_prev") == F.col(run), F.lit("duplicate_in_run"))
        .otherwise(F.lit("rediscovered"))
    )
    if gone is not None:
        state = F.when(F.coalesce(F.col("_gone"), F.lit(False)), F.lit("skipped_removed")).otherwise(state)
    return lagged.withColumn("discovery_state", state).drop("_prev", "_gone")


def sighting_stats(
    observations: DataFrame,
    entity: str,
    pos: str,
    ts: str = "ts",
    run: str = "run_id",
    score: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Seen count, first and last time and run, last scored time."""
    scored = F.when(F.col(score).isNotNull(), F.col(ts)) if score else F.lit(None).cast("timestamp")
    out = running(
        observations,
        entity,
        pos,
        counts={"seen_count": F.lit(True)},
        firsts={"first_seen_at": F.col(ts)},
        lasts={"last_score_at": scored},
        block_rows=block_rows,
    )
    return out.withColumns({"last_seen_at": F.col(ts), "last_seen_run_id": F.col(run)})


def skip_known(batch: DataFrame, known: Sequence[DataFrame], key: str) -> DataFrame:
    """Batch rows whose key is in none of the known key sets."""
    keys = None
    for side in known:
        side = side.select(key).filter(F.col(key) != "")
        keys = side if keys is None else keys.union(side)
    keyed = F.coalesce(F.col(key) != "", F.lit(False))
    # Blank keys are known to nobody and would meet in one task of the join.
    return batch.filter(keyed).join(keys.distinct(), key, "left_anti").unionByName(batch.filter(~keyed))


def merge_providers(
    frames: Sequence[DataFrame], url: str, pos: str, normal: Column | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """Union in provider order; the first provider's URL wins."""
    merged = None
    for order, frame in enumerate(frames):
        frame = frame.withColumn("provider_order", F.lit(order))
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    key = urls.vendor_form(F.col(url)) if normal is None else normal
    keyed = merged.withColumn("url_key", key).filter(F.col("url_key") != "")
    return top_n(keyed, [*within, "url_key"], [F.col("provider_order").asc(), F.col(pos).asc()])


def seed_attribution(accepted: DataFrame, seeds: DataFrame, url: str = "job_posting_url") -> DataFrame:
    """Accepted rows with a flag for those that came from seeded URLs."""
    key = lambda c: F.lower(clean(urls.vendor_form(F.col(c))))
    seeded = (
        seeds.select(key(url).alias("_seed")).filter(F.col("_seed") != "").distinct().withColumn("_s", F.lit(True))
    )
    own = accepted.withColumn("_seed", F.lower(clean(F.col(url))))
    joined = own.filter("_seed <> ''").join(seeded, "_seed", "left").withColumn("seeded", F.coalesce(F.col("_s"), F.lit(False))).drop("_s")
    return joined.unionByName(own.filter("_seed = ''").withColumn("seeded", F.lit(False))).drop("_seed")


def seed_totals(attributed: DataFrame, by: str, pos: str, k: int = 5) -> DataFrame:
    """Seeded and other accepted rows, and the first k companies that seeds led to."""
    counts = attributed.groupBy(by).agg(F.count_if("seeded").alias("seeded_jobs"), F.count_if(~F.col("seeded")).alias("legacy_jobs"))
    named = attributed.filter("seeded").withColumn("_company", or_default(F.col("company"), "(unknown company)"))
    first = top_n(named.groupBy(by, "_company").agg(F.min(pos).alias("_p")), [by], [F.asc("_p")], k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_company"))), lambda x: x["_company"])
    firms = first.groupBy(by).agg(F.array_join(ordered, ", ").alias("seeded_companies"))
    return counts.join(firms, by, "left").fillna("", ["seeded_companies"])
