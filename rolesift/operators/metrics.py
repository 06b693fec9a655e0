"""Summaries, yields, registries and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import notes, trust, urls
from ..functions.text import clean, first_number, or_default
from .ordered import top_n

PRE_PARSE = ["non_job_url", "weak_url_title_match"]
POST_PARSE = [
    "parse_failed",
    "processing_error",
    "title_mismatch",
    "location_mismatch",
    "excluded_keyword",
    "below_threshold",
]
DUPLICATE = "duplicate_in_batch"
#: Reasons that a run's summary shows, and those that name its limiter, the first that is there.
SHOWN_REASONS = 8
LIMITERS = {"location_mismatch": "location_strictness", "title_mismatch": "title_drift", "weak_url_title_match": "url_title_prefilter"}


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """part of whole in %, 0 where the whole is not positive."""
    share = F.try_divide(part.cast("double") * 100, whole)
    return F.when(whole > 0, F.round(share, places)).otherwise(F.lit(0.0))


def reason_summary(gated: DataFrame, pos: str, detail: str, reason: str = "reason", top: int = 8) -> DataFrame:
    """A1: the commonest reasons with counts and the first non-blank example."""
    shown = F.when(F.col(detail) != "", F.col(pos))
    counts = (
        gated.filter(F.col(reason) != "")
        .groupBy(reason)
        .agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"), F.min_by(detail, shown).alias("example"))
    )
    # One row per reason: the total over them is a small window.
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    ranked = counts.orderBy(F.desc("n"), F.asc("first_pos")).limit(top)
    return ranked.withColumn("example", F.coalesce("example", F.lit("")))


def tier_samples(rejected: DataFrame, tier: str, reason: str, pos: str, samples: int = 5) -> DataFrame:
    """A1, per tier: count per reason; the tier's first `samples` rows."""
    counts = rejected.groupBy(tier, reason).agg(F.count(F.lit(1)).alias("n"))
    shown = top_n(rejected, [tier], [F.col(pos).asc()], samples).groupBy(tier).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(pos, reason))), lambda s: s[reason]), " | "
        ).alias("samples")
    )
    return counts.join(shown, tier)


def flatten_drop_counts(reports: DataFrame, column: str = "drop_summary", keys: Sequence[str] = ()) -> DataFrame:
    """A2: source -> reason -> count maps summed per reason."""
    per_source = reports.select(*keys, F.explode(column).alias("source", "bucket"))
    per_reason = per_source.select(*keys, F.explode("bucket").alias("reason", "n"))
    return per_reason.groupBy(*keys, F.trim("reason").alias("reason")).agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("dropped")
    )


def run_quality(gated: DataFrame, pos: str, run: str = "run_id", reason: str = "reason", drops: DataFrame | None = None) -> DataFrame:
    """A3: shares and verdicts per run from rows with '' for accepted.

    `verdict` compares the stages; `limiter` says which of the eight commonest
    reasons a run's reader should look at. drops: (run, drop_reason) of URLs that
    were dropped before the run.
    """
    r = F.col(reason)
    per_reason = gated.groupBy(run, reason).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("p"))
    sums = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    limiting = (r != "") & (r != DUPLICATE)
    # most_common keeps first-seen order on ties, so the earlier reason wins.
    order = F.when(limiting, F.struct(F.col("n"), -F.col("p")))
    totals = per_reason.groupBy(run).agg(
        F.sum("n").alias("seen"),
        sums(r == "").alias("accepted"),
        sums(r.isin(*PRE_PARSE)).alias("pre_parse"),
        sums(r.isin(*POST_PARSE)).alias("post_parse"),
        sums(r == DUPLICATE).alias("duplicates"),
        sums(r != "").alias("skipped"),
        F.coalesce(F.max_by(reason, order), F.lit("")).alias("dominant_reason"),
        F.coalesce(F.max(F.when(limiting, F.col("n"))), F.lit(0)).alias("dominant_count"),
    )
    share = {f"{c}_pct": percent(F.col(c), F.col("seen")) for c in ("accepted", "pre_parse", "post_parse", "duplicates")}
    verdict = (
        F.when((F.col("accepted") == 0) & (F.col("pre_parse") > F.col("post_parse")), F.lit("weak_discovery"))
        .when(F.col("accepted") == 0, F.lit("poor_fit"))
        .when(F.col("dominant_reason") != "", F.concat(F.lit("limited_by_"), F.col("dominant_reason")))
        .otherwise(F.lit("clean"))
    )
    judged = totals.withColumns(
        {
            **share,
            "dominant_pct": percent(F.col("dominant_count"), F.greatest(F.col("skipped"), F.lit(1))),
            "verdict": verdict,
        }
    )
    # A run has a handful of reasons.
    shown = top_n(per_reason.filter(r != ""), [run], [F.desc("n"), F.asc("p")], SHOWN_REASONS)
    said = lambda value: F.max(r == value)
    shown = shown.groupBy(run).agg(*[said(v).alias(f"_{v}") for v in LIMITERS], F.lit(True).alias("_some"))
    judged = judged.join(shown, run, "left")
    if drops is None:
        judged = judged.withColumns({"_blocked": F.lit(False), "_dropped": F.lit(False)})
    else:
        dropped = drops.groupBy(run).agg(F.max(F.col("drop_reason") == "blocked_domain").alias("_blocked"), F.lit(True).alias("_dropped"))
        judged = judged.join(dropped, run, "left")
    limiter = F.coalesce(
        *[F.when(F.col(f"_{v}"), F.lit(label)) for v, label in LIMITERS.items()],
        F.when(F.col("_blocked"), F.lit("noisy_sources")),
        F.when(F.coalesce("_some", "_dropped", F.lit(False)), F.lit("hidden_in_mix")),
        F.lit(""),
    )
    return judged.withColumn("limiter", limiter).drop("_some", "_blocked", "_dropped", *[f"_{v}" for v in LIMITERS])


# --- ingest and sources --------------------------------------------------------


def ingest_summary(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """A4: per run, totals by status and by discovery state."""
    is_ = lambda column, value: F.count_if(F.col(column) == value)
    return outcomes.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_seen"),
        is_("status", "inserted").alias("inserted_count"),
        is_("status", "updated").alias("updated_count"),
        is_("status", "skipped_removed").alias("skipped_removed_count"),
        F.count_if(~F.col("status").isin("inserted", "updated", "skipped_removed")).alias("skipped_invalid_count"),
        is_("discovery_state", "net_new").alias("net_new_count"),
        is_("discovery_state", "rediscovered").alias("rediscovered_count"),
        is_("discovery_state", "duplicate_in_run").alias("duplicate_in_run_count"),
    )


def ingest_label_counts(outcomes: DataFrame, labels: Sequence[str], run: str = "run_id") -> DataFrame:
    """A4: per run and label column, rows per value, blank as 'Unknown'."""
    named = outcomes.select(
        run,
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("label"), or_default(F.col(c), "Unknown").alias("value")) for c in labels]
            )
        ),
    )
    return named.groupBy(run, "label", "value").agg(F.count(F.lit(1)).alias("n"))


def run_items(outcomes: DataFrame, batch: DataFrame, run: str = "run_id") -> DataFrame:
    """An item for each row of a run: what it was, what became of it, and the state as message."""
    text = lambda c: F.nullif(clean(F.col(c), False), F.lit(""))
    named = batch.select("pos", text("job_posting_url").alias("_url"), text("title").alias("_title"))
    value = F.coalesce("_url", "_title", F.nullif("duplicate_key", F.lit("")), F.lit(""))
    return outcomes.join(named, "pos").select(
        run, "pos", value.alias("item_value"), "status", "duplicate_key", "job_id", F.col("discovery_state").alias("message")
    )


def ingest_ids(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """A4: ids per run and state as rows; a list would grow without bound."""
    return outcomes.filter(F.col("job_id").isNotNull()).select(run, "discovery_state", "job_id")


SLUG_HOSTS = ["job-boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "jobs.smartrecruiters.com"]


def yield_root(detail: Column, url: Column, ignored_detail: str = "in_memory_discovery_result") -> Column:
    """The source a posting counts for: its detail, else host and slug."""
    text, link = clean(detail), clean(url)
    where = urls.host(link)
    slug = F.get(urls.segments(urls.path(link)), F.lit(0))
    by_url = F.when(urls.on_any_host(where, SLUG_HOSTS) & slug.isNotNull(), F.concat(where, F.lit("/"), slug)).otherwise(
        where
    )
    return F.when((text != "") & (text != ignored_detail), text).otherwise(
        F.coalesce(F.nullif(by_url, F.lit("")), F.lit("unknown"))
    )


def source_yield(postings: DataFrame, pos: str, run: str | None = None) -> DataFrame:
    """A5: postings per vendor::root with the first-seen trust and type."""
    keys = ([run] if run else []) + ["ats_type", "source_root"]
    named = postings.select(
        *([run] if run else []),
        pos,
        or_default(F.col("ats_type"), "Unknown").alias("ats_type"),
        yield_root(F.col("source_detail"), F.col("job_posting_url")).alias("source_root"),
        or_default(F.col("source_trust"), "Unknown").alias("source_trust"),
        or_default(F.col("source_type"), "Unknown").alias("source_type"),
    )
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("job_count"),
        F.min_by("source_trust", pos).alias("source_trust"),
        F.min_by("source_type", pos).alias("source_type"),
        F.min(pos).alias("first_pos"),
    ).withColumn("source_key", F.concat_ws("::", "ats_type", "source_root"))


def top_yield(yields: DataFrame, run: str | None = None, k: int = 8) -> DataFrame:
    """A5: the k best sources (per run)."""
    order = [F.desc("job_count"), F.desc("ats_type"), F.desc("source_root")]
    return top_n(yields, [run], order, k) if run else yields.orderBy(*order).limit(k)


def source_dominance(yields: DataFrame, run: str, min_jobs: int = 10, min_share: float = 0.35) -> DataFrame:
    """Does one source give a run at least 10 postings and 35 %?"""
    order = F.struct(F.col("job_count"), -F.col("first_pos"))
    top = yields.groupBy(run).agg(
        F.sum("job_count").alias("total_seen"),
        F.max("job_count").alias("top_count"),
        F.max_by("source_key", order).alias("top_source"),
    )
    share = F.col("top_count") / F.col("total_seen")
    return top.withColumns(
        {"share": F.round(share, 4), "flag": (F.col("top_count") >= min_jobs) & (share >= min_share)}
    )


def build_source_registry(
    batch: DataFrame, pos: str, seen_at: str, registry: DataFrame | None = None, source_name: str | Column = "", source_detail: str | Column = ""
) -> DataFrame:
    """Per source key the latest attributes, counts and times.

    `source_name` and `source_detail` say where the batch came from. The batch
    is folded to one row per key before it meets the old registry.
    """
    url, vendor = F.col("job_posting_url"), F.col("ats_type")
    attributes = {
        "source_root": trust.source_root(url, vendor),
        "hostname": urls.host(clean(url)),
        "ats_type": clean(vendor),
        "source_type": or_default(F.col("source_type"), trust.source_type(url, vendor)),
        "source_trust": or_default(F.col("source_trust"), trust.source_trust(url, vendor)),
        "source_name": source_name if isinstance(source_name, Column) else F.lit(source_name),
        "source_detail": source_detail if isinstance(source_detail, Column) else F.lit(source_detail),
        "example_job_url": clean(url),
    }
    rows = batch.select(
        trust.source_key(url, vendor).alias("source_key"),
        F.col(pos).alias("_pos"),
        F.col(seen_at).alias("_at"),
        *[c.alias(n) for n, c in attributes.items()],
    ).filter(F.col("source_key") != "")
    fresh = rows.groupBy("source_key").agg(
        *[F.max_by(n, "_pos").alias(n) for n in attributes],
        F.count(F.lit(1)).alias("seen_count"),
        F.count(F.lit(1)).alias("matching_job_count"),
        F.min("_at").alias("first_seen_at"),
        F.max("_at").alias("last_seen_at"),
        F.max("_at").alias("last_success_at"),
        F.lit("active").alias("status"),
    )
    return fresh if registry is None else merge_registry(fresh, registry)


def merge_registry(fresh: DataFrame, registry: DataFrame) -> DataFrame:
    """A registry with the sources of a batch (`build_source_registry`) brought in."""
    old = registry.select("source_key", *[F.col(c).alias(f"old_{c}") for c in fresh.columns if c != "source_key"])
    merged = fresh.join(old, "source_key", "full_outer")
    counted = ["seen_count", "matching_job_count"]
    latest = [c for c in fresh.columns if c not in ("source_key", "first_seen_at", *counted)]
    return merged.select(
        "source_key",
        *[F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in latest],
        *[(F.coalesce(F.col(f"old_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counted],
        F.coalesce("old_first_seen_at", "first_seen_at").alias("first_seen_at"),
    )


def registry_totals(registry: DataFrame) -> DataFrame:
    """One row of counts per trust, of active sources, and sums."""
    labelled = {
        "ats_confirmed_sources": "ATS Confirmed",
        "career_site_sources": "Career Site Confirmed",
        "web_discovered_sources": "Web Discovered",
    }
    return registry.agg(
        F.count(F.lit(1)).alias("total_sources"),
        *[F.count_if(F.col("source_trust") == v).alias(k) for k, v in labelled.items()],
        F.count_if(~F.col("source_trust").isin(*labelled.values())).alias("other_sources"),
        F.count_if(F.col("status") == "active").alias("active_sources"),
        F.coalesce(F.sum("seen_count"), F.lit(0)).alias("total_seen_count"),
        F.coalesce(F.sum("matching_job_count"), F.lit(0)).alias("total_matching_job_count"),
    )


def recent_sources(registry: DataFrame, k: int = 8) -> DataFrame:
    """The k sources that succeeded last."""
    return (
        registry.select("source_key", "hostname", "source_trust", "source_type", "matching_job_count", "last_success_at")
        .orderBy(F.desc("last_success_at"), F.desc("source_key"))
        .limit(k)
    )


def registry_mix(registry: DataFrame, dims: Sequence[str], top: int) -> DataFrame:
    """The commonest values of each dimension, one pass over the table."""
    named = registry.select(
        *[F.coalesce(F.nullif(F.trim(F.coalesce(F.col(d), F.lit(""))), F.lit("")), F.lit("<<blank>>")).alias(d) for d in dims]
    )
    exploded = named.select(
        F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    )
    counts = exploded.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, ["dimension"], [F.desc("n"), F.asc("value")], top)


def root_rollup(registry: DataFrame) -> DataFrame:
    """Root x host x vendor sums and mean priority."""
    return registry.groupBy("source_root", "hostname", "ats_type").agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("seen_count").alias("seen"),
        F.sum("matching_job_count").alias("matched"),
        F.round(F.avg("priority_score"), 2).alias("avg_priority"),
    )


# --- reports -----------------------------------------------------------------


def case_metrics(reports: DataFrame, case_urls: DataFrame, key: str = "report_id") -> DataFrame:
    """Per report, rates and broken, blocked and weak counts.

    reports carry skip_summary (reason -> count) and drop_summary (source ->
    reason -> count); their URLs come as rows of (key, url).
    """
    skip = lambda k: F.coalesce(F.try_element_at("skip_summary", F.lit(k)), F.lit(0))
    blocked = F.aggregate(
        F.map_values("drop_summary"),
        F.lit(0).cast("long"),
        lambda a, b: a + F.coalesce(F.try_element_at(b, F.lit("blocked_domain")), F.lit(0)),
    )
    hosts = (
        case_urls.select(key, urls.host(F.col("url")).alias("_host"))
        .groupBy(key, "_host")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(key)
        .agg(F.sum("_n").alias("url_count"), F.count_if(F.col("_host") != "").alias("domain_count"))
    )
    return (
        reports.withColumns(
            {
                "acceptance_pct": percent(F.col("accepted_jobs"), F.col("seen_urls")),
                "broken_url_count": skip("stale_ats_posting") + skip("parse_failed"),
                "blocked_domain_drop_count": blocked,
                "weak_title_match_count": skip("weak_url_title_match"),
                "duplicate_count": skip("duplicate_in_batch"),
            }
        )
        .join(hosts, key, "left")
        .fillna(0, ["url_count", "domain_count"])
    )


def variant_overlap(cases: DataFrame, case_urls: DataFrame) -> DataFrame:
    """A10: per group of variants the shared and joint URLs and the gaps.

    cases: (group, variant, accepted_jobs, broken_url_count); case_urls:
    (group, variant, url), one row per URL so no list has to fit a row.
    """
    sizes = cases.groupBy("group").agg(
        F.count_distinct("variant").alias("variants"),
        (F.max("accepted_jobs") - F.min("accepted_jobs")).alias("accepted_gap"),
        (F.max("broken_url_count") - F.min("broken_url_count")).alias("broken_gap"),
    )
    per_url = case_urls.filter(F.col("url") != "").select("group", "url", "variant").distinct()
    per_url = per_url.groupBy("group", "url").agg(F.count(F.lit(1)).alias("in_variants"))
    spread = per_url.groupBy("group", "in_variants").agg(F.count(F.lit(1)).alias("n"))
    joined = sizes.join(spread, "group", "left")
    return (
        joined.groupBy("group", "variants", "accepted_gap", "broken_gap")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("union_urls"),
            F.coalesce(F.sum(F.when(F.col("in_variants") == F.col("variants"), F.col("n"))), F.lit(0)).alias("shared_urls"),
        )
        .withColumn("overlap_pct", percent(F.col("shared_urls"), F.col("union_urls")))
    )


def benchmark_overall(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals and the groups that fail a threshold."""
    flagged = (F.col("overlap_pct") < 50) | (F.col("accepted_gap") > 2) | (F.col("broken_gap") > 1)
    totals = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("seen_urls").alias("seen_urls"),
        F.sum("accepted_jobs").alias("accepted_jobs"),
        F.sum("broken_url_count").alias("broken_urls"),
    ).withColumn("acceptance_pct", percent(F.col("accepted_jobs"), F.col("seen_urls"), 2))
    flags = groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(flagged).alias("flagged_groups"))
    return totals.join(flags, F.lit(True))


def profile_scoreboard(scored: DataFrame) -> DataFrame:
    """Per profile the mean fit and how often each action came up."""
    action = lambda a: F.count_if(F.col("recommended_action") == a)
    return scored.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("scored"),
        F.round(F.avg("fit_score"), 1).alias("avg_fit_score"),
        action("Apply").alias("apply_count"),
        action("Apply with Caution").alias("apply_caution_count"),
        action("Hold").alias("hold_count"),
        action("Skip").alias("skip_count"),
    )


LABEL_RANKS = {"no": 0, "maybe": 1, "yes": 2}


def calibration_rows(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Expected against predicted label per case and scorer."""
    rank = lambda c: trust.rank(F.lower(c), {"maybe": 1, "yes": 2})
    known = F.lower("predicted_label").isin(*LABEL_RANKS)
    gap = F.abs(rank(F.col("expected_label")) - rank(F.col("predicted_label")))
    rows = cases.filter(F.lower("expected_label").isin(*LABEL_RANKS)).join(predictions, "case_id")
    return rows.withColumn(
        "outcome",
        F.when(~F.coalesce(known, F.lit(False)), F.lit("skipped"))
        .when(gap == 0, F.lit("exact"))
        .when(gap == 1, F.lit("adjacent"))
        .otherwise(F.lit("far_miss")),
    )


def calibration_report(rows: DataFrame, keys: Sequence[str] = ("scorer",)) -> DataFrame:
    """Outcome counts and the exact share per scorer (and profile)."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        is_("exact").alias("exact"),
        is_("adjacent").alias("adjacent"),
        is_("far_miss").alias("far_misses"),
        is_("skipped").alias("skipped"),
    )
    return out.withColumn("exact_pct", percent(F.col("exact"), F.col("cases") - F.col("skipped")))


def calibration_cross(rows: DataFrame) -> DataFrame:
    """Expected x predicted counts per scorer."""
    return (
        rows.groupBy("scorer", "expected_label")
        .pivot("predicted_label", list(LABEL_RANKS))
        .agg(F.count(F.lit(1)))
        .fillna(0, list(LABEL_RANKS))
    )


def review_kpis(postings: DataFrame, today: Column) -> DataFrame:
    """New rows, rows applied for in the last week, rounded mean fit."""
    listed = (F.col("workflow_status") == "New") & (F.coalesce("active_status", F.lit("Active")) == "Active")
    applied = F.col("workflow_status") == "Applied"
    day = notes.iso_day(F.col("applied_date"))
    fit = F.coalesce(first_number(F.col("fit_score").cast("string")), F.lit(-1.0))
    return postings.agg(
        F.count_if(listed).alias("new_roles"),
        F.count_if(applied & (F.date_diff(today, day) <= 7)).alias("applied_this_week"),
        F.bround(F.avg(F.when(listed & (fit >= 0), fit))).alias("avg_fit"),
    )


def status_counts(postings: DataFrame, removed: DataFrame, endpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """(metric, value) rows over all tables, one pass each."""

    def tall(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
        one = df.agg(*[c.cast("long").alias(k) for k, c in measures.items()])
        return one.select(
            F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in measures]))
        )

    blank = lambda c: clean(F.col(c)) == ""
    parts = [
        tall(
            postings,
            {
                "postings": F.count(F.lit(1)),
                "new_postings": F.count_if(F.col("workflow_status") == "New"),
                "applied_postings": F.count_if(F.col("workflow_status") == "Applied"),
                "with_duplicate_key": F.count_if(~blank("duplicate_key")),
                "missing_company": F.count_if(blank("company")),
                "missing_title": F.count_if(blank("title")),
            },
        ),
        tall(removed, {"removed_postings": F.count(F.lit(1))}),
        tall(
            endpoints,
            {
                "endpoints": F.count(F.lit(1)),
                "active_endpoints": F.count_if(F.col("active") == 1),
                "approved_endpoints": F.count_if(F.col("review_status") == "approved"),
            },
        ),
        tall(runs, {"latest_run_id": F.coalesce(F.max("run_id"), F.lit(0))}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vendor_mix(active: DataFrame, preferred: Column, top: int = 5) -> DataFrame:
    """The commonest vendors with review, status and pool counts."""
    per_vendor = active.groupBy(or_default(F.lower("ats_vendor"), "unknown").alias("vendor")).agg(
        F.count(F.lit(1)).alias("endpoints"),
        F.count_if(F.lower("review_status") == "approved").alias("approved"),
        F.count_if(F.lower("careers_url_status") == "candidate").alias("candidates"),
        F.count_if(F.col("is_primary") == 1).alias("primary_endpoints"),
        F.count_if(preferred).alias("preferred_pool"),
    )
    return per_vendor.orderBy(F.desc("endpoints"), F.asc("vendor")).limit(top)


def selection_mix(selected: DataFrame, by: str = "profile_id", k: int = 5) -> DataFrame:
    """Per selection its k commonest vendors, as 'vendor n', and its companies in order.

    selected: vendor, company_name and position of at most a selection's cap of
    endpoints; vendors of one count stand in the order they came.
    """
    counts = selected.groupBy(by, "vendor").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("p"))
    top = top_n(counts, [by], [F.desc("n"), F.asc("p")], k, rank="r")
    shown = lambda rows, value: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), value), ", ")
    vendors = top.groupBy(by).agg(shown(F.struct("r", F.concat_ws(" ", "vendor", F.col("n").cast("string")).alias("v")), lambda x: x["v"]).alias("top_vendors"))
    firms = selected.groupBy(by, "company_name").agg(F.min("position").alias("p"))
    firms = firms.groupBy(by).agg(shown(F.struct("p", "company_name"), lambda x: x["company_name"]).alias("companies"))
    return vendors.join(firms, by)


def provider_mix(observations: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run how many distinct URLs each provider brought."""
    each = observations.select(run, "provider", "url").filter("url <> ''").distinct()
    return each.groupBy(run, "provider").agg(F.count(F.lit(1)).alias("urls"))


def seed_scan_summary(selection: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """Per selected endpoint, found, kept and skipped feed rows.

    feed_rows: (endpoint_id, title_ok, place_ok) per posting found. They are
    counted before they meet the endpoints, so a feed's size does not matter.
    """
    counts = feed_rows.groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col("title_ok") & F.col("place_ok")).alias("kept"),
        F.count_if(~F.col("title_ok")).alias("title_skipped"),
        F.count_if(F.col("title_ok") & ~F.col("place_ok")).alias("place_skipped"),
    )
    zero = ["found", "kept", "title_skipped", "place_skipped"]
    return selection.join(counts, "endpoint_id", "left").fillna(0, zero)


def seed_run_totals(scan: DataFrame, run: str = "profile_id") -> DataFrame:
    """The run's totals over its endpoints."""
    return scan.groupBy(run).agg(
        F.count_if("supported").alias("scanned"),
        F.count_if(~F.col("supported")).alias("unsupported"),
        F.sum("found").alias("found"),
        F.sum("kept").alias("seeded"),
        F.sum("title_skipped").alias("title_skipped"),
        F.sum("place_skipped").alias("place_skipped"),
    )
