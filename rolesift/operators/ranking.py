"""Ranking and review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import notes, pay, titles, trust, urls
from ..functions.text import clean, contains_any, first_number, norm_plain, split_csv, split_places
from .lineage import cut
from .ordered import ranked, top_n

# Vendors whose endpoints can be scanned, and their quotas.
SEED_VENDORS = ["greenhouse", "lever", "workday", "sap successfactors", "icims", "taleo / oracle recruiting"]
VENDOR_SHARES = [
    ("workday", 0.40),
    ("icims", 0.28),
    ("sap successfactors", 0.16),
    ("taleo / oracle recruiting", 0.08),
    ("greenhouse", 0.04),
    ("lever", 0.04),
]
SENIOR_WORDS = [
    "chief",
    "ceo",
    "cto",
    "cio",
    "cfo",
    "coo",
    "vice",
    "president",
    "vp",
    "svp",
    "evp",
    "avp",
    "head",
    "director",
]
TECHNOLOGY_WORDS = [
    "technology",
    "information",
    "it",
    "engineering",
    "infrastructure",
    "platform",
    "systems",
    "applications",
    "application",
    "software",
    "security",
    "cybersecurity",
    "cyber",
    "data",
    "analytics",
    "digital",
    "cloud",
    "network",
]
ENDPOINT_CAP = 25
DIRECT_CAP = 12


def active_endpoints(endpoints: DataFrame, companies: DataFrame) -> DataFrame:
    """Active endpoints with their company's columns."""
    firms = companies.select("company_id", F.col("name").alias("company_name"), "canonical_domain", "hq")
    return endpoints.filter(F.col("active") == 1).join(firms, "company_id")


def vendor_quotas(cap: int) -> list[tuple[str, int]]:
    """Quotas for a cap: shares rounded half to even, at least one, then
    trimmed from the last vendor above one, or topped up on the first."""
    quotas = {vendor: max(1, round(cap * share)) for vendor, share in VENDOR_SHARES}
    over = sum(quotas.values()) - cap
    if over < 0:
        quotas[VENDOR_SHARES[0][0]] -= over
    while over > 0 and max(quotas.values()) > 1:
        for vendor in reversed([v for v, n in quotas.items() if n > 1]):
            if over > 0:
                quotas[vendor] -= 1
                over -= 1
    return list(quotas.items())


def _seedable(vendor: Column, u: Column) -> Column:
    host, path = u["host"], F.lower(u["path"])
    return (u["value"] != "") & (
        F.when(vendor == "greenhouse", contains_any(host, ["job-boards.greenhouse.io", "boards.greenhouse.io"]))
        .when(vendor == "lever", host.contains("jobs.lever.co"))
        .when(vendor == "workday", host.contains("myworkdayjobs.com"))
        .when(vendor == "sap successfactors", ~contains_any(host, ["successfactors.com", "sapsf.com", "ondemand.com"]))
        .when(vendor == "icims", F.lit(True))
        .when(
            vendor == "taleo / oracle recruiting",
            host.contains("taleo.net")
            & path.contains("/careersection/")
            & (path.endswith("/jobsearch.ftl") | path.endswith("/mysearches.ftl")),
        )
        .otherwise(F.lit(False))
    )


def _shape_priority(vendor: Column, u: Column) -> Column:
    """How much an endpoint URL looks like a board that can be scanned."""
    path = F.regexp_replace(F.lower(u["path"]), "/+$", "")
    steps = urls.segments(path)
    last = F.coalesce(F.try_element_at(steps, F.lit(-1)), F.lit(""))
    locales = F.array(*[F.lit(x) for x in ("en-us", "en-ca", "fr-fr")])
    workday = (
        F.when(~u["host"].contains("myworkdayjobs.com") | (last == "login"), 0)
        .when(last == "search", 1)
        .when(F.arrays_overlap(steps, locales), 4)
        .when(last.isin("careers", "external", "external_careers", "externalcareers_globalsite", "assurant_careers"), 3)
        .otherwise(2)
    )
    icims = (
        F.when(
            contains_any(path, ["job-scams", "job-scam", "resources", "resource", "career-areas", "locations", "categories"]), 0
        )
        .when(last.isin("jobs", "results.html", "careers", "careers-home"), 3)
        .otherwise(2)
    )
    sap = (
        F.when(contains_any(path, ["reasonable-accommodations", "accommodations", "benefits", "faq", "content/"]), 0)
        .when(path.contains("/search") | last.isin("careers", "jobs", "viewalljobs"), 3)
        .when(path.contains("/go"), 2)
        .otherwise(1)
    )
    return (
        F.when(u["value"] == "", 0)
        .when(vendor == "workday", workday)
        .when(vendor == "icims", icims)
        .when(vendor == "sap successfactors", sap)
        .when(vendor == "taleo / oracle recruiting", F.when(path.endswith("/jobsearch.ftl"), 3).otherwise(2))
        .when(vendor.isin("greenhouse", "lever"), 3)
        .otherwise(1)
    )


def _vendor_priority(vendor: Column) -> Column:
    return (
        F.when(vendor == "workday", 5)
        .when(vendor == "icims", 4)
        .when(vendor.isin("greenhouse", "lever"), 3)
        .when(vendor == "taleo / oracle recruiting", 2)
        .when(vendor == "sap successfactors", 1)
        .otherwise(0)
    )


def endpoint_profiles(profiles: DataFrame) -> DataFrame:
    """The columns endpoint scoring needs of a profile; titles split on commas."""
    tokens = lambda items: F.array_distinct(
        F.filter(F.flatten(F.transform(items, lambda v: F.split(norm_plain(v), " "))), lambda t: F.length(t) >= 3)
    )
    titled = split_csv(F.col("target_titles"))
    said = F.split(F.array_join(F.transform(titled, norm_plain), " "), " ")
    has = lambda names: F.arrays_overlap(said, F.array(*[F.lit(w) for w in names]))
    return profiles.select(
        "profile_id",
        tokens(titled).alias("title_tokens"),
        tokens(split_places(F.col("preferred_locations"))).alias("place_tokens"),
        (F.lower(clean(F.col("remote_only"), False)) == "true").alias("wants_remote_only"),
        (F.size(titled).between(1, 3) & has(SENIOR_WORDS) & has(TECHNOLOGY_WORDS)).alias("senior_tech"),
    )


def score_endpoints(rows: DataFrame) -> DataFrame:
    """Score and priorities of (endpoint, profile) rows.

    rows: active endpoints with a profile_id and endpoint_profiles' columns.
    """
    vendor = F.coalesce(F.nullif(F.lower(clean(F.col("ats_vendor"))), F.lit("")), F.lit("unknown"))
    staged = rows.withColumns(
        {
            "vendor": vendor,
            "_u": urls.parts(F.col("endpoint_url")),
            "_review": F.lower(clean(F.col("review_status"))),
            "_status": F.lower(clean(F.col("careers_url_status"))),
            "_text": norm_plain(
                F.concat_ws(" ", "company_name", "canonical_domain", "hq", "notes", "endpoint_url", vendor)
            ),
        }
    )
    hits = lambda c: F.least(F.size(F.filter(c, lambda t: F.col("_text").contains(t))), F.lit(3))
    tenth = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double") * 10
    score = (
        F.when(F.col("_review") == "approved", 80)
        .when(F.col("_review") == "unreviewed", 55)
        .when(F.col("_review") == "needs_review", 45)
        .otherwise(0)
        + F.when(F.col("_status") == "validated", 15).when(F.col("_status") == "candidate", 5).otherwise(0)
        + F.when(F.col("is_primary") == 1, 15).otherwise(0)
        + tenth("confidence_score").cast("int")
        + tenth("health_score").cast("int")
        + F.when(F.col("vendor") != "unknown", 5).otherwise(0)
        + hits("title_tokens") * 8
        + hits("place_tokens") * 4
        + F.when(F.col("wants_remote_only") & F.col("_text").contains("remote"), 6).otherwise(0)
    )
    seedable = _seedable(F.col("vendor"), F.col("_u"))
    return staged.withColumns(
        {
            "score": score,
            "seedable": seedable,
            "supported": F.col("vendor").isin(*SEED_VENDORS),
            "shape_priority": _shape_priority(F.col("vendor"), F.col("_u")),
            "vendor_priority": F.when(F.col("senior_tech"), _vendor_priority(F.col("vendor"))).otherwise(0),
            "preferred": seedable
            & (F.col("_status") == "validated")
            & (F.col("_review") != "rejected")
            & (F.coalesce(F.col("confidence_score"), F.lit(0.0)) >= 0.80)
            & (F.col("is_primary") == 1),
        }
    ).drop("_u", "_review", "_status", "_text")


def _rank_order(mode: str) -> list[Column]:
    name = F.lower(F.col("company_name")).asc()
    tail = [F.desc("score"), name, F.lower(F.col("endpoint_url")).asc(), F.asc("endpoint_id")]
    if mode != "next_gen":
        return tail
    return [F.desc(F.col("seedable").cast("int")), F.desc("shape_priority"), F.desc("vendor_priority"),
            F.desc(F.col("supported").cast("int")), *tail]


def select_endpoints(
    scored: DataFrame, cap: int = 0, mode: str = "next_gen", offset: int = 0, exclude: Sequence[str] = ()
) -> DataFrame:
    """Each profile's endpoints to scan, with pass number and position.

    next_gen mode: pass 1 takes the preferred pool (everything, where there
    is none), by vendor quota for a senior technology search and else by
    rank. What is left of the cap is filled from other URLs: fresh quotas for
    the smaller cap (2), any scannable endpoint (3), any endpoint (4).

    Every step is a top-n per profile or per vendor, so no step holds more
    than `cap` rows of a group.
    """
    cap = cap or (DIRECT_CAP if mode == "next_gen" else ENDPOINT_CAP)
    order, profile = _rank_order(mode), ["profile_id"]
    rows = scored.filter(~F.col("endpoint_url").isin(*exclude)) if exclude else scored
    if offset:
        skipped = top_n(rows, profile, order, offset).select("profile_id", "endpoint_id")
        rows = rows.join(skipped, ["profile_id", "endpoint_id"], "left_anti")
    if mode != "next_gen":
        return top_n(rows, profile, order, cap, rank="position").withColumn("pass_no", F.lit(1))

    # The passes below read the scored rows several times.
    rows = cut(rows)
    pool = rows.filter("preferred").select("profile_id", "endpoint_url").distinct().withColumn("_pool", F.lit(True))
    pooled = pool.select("profile_id").distinct().withColumn("_pooled", F.lit(True))
    rows = rows.join(pool, ["profile_id", "endpoint_url"], "left").join(pooled, "profile_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("_pool", "_pooled")})
    eligible = rows.filter(F.col("_pool") | ~F.col("_pooled"))

    by_rank = top_n(eligible.filter(~F.col("senior_tech")), profile, order, cap)
    scannable = top_n(eligible.filter(F.col("senior_tech") & F.col("seedable")), ["profile_id", "endpoint_url"], order)
    in_quota = top_n(scannable, ["profile_id", "vendor"], order, cap, rank="_in_vendor")
    by_quota = in_quota.filter(F.col("_in_vendor") <= _quota_column(dict(vendor_quotas(cap)))).drop("_in_vendor")
    turn = F.when(F.col("senior_tech"), _vendor_turn()).otherwise(0)
    first = top_n(by_rank.unionByName(by_quota).withColumn("_turn", turn), profile, [F.asc("_turn"), *order], cap)
    first = cut(first.withColumn("pass_no", F.lit(1)))

    taken = first.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_taken"))
    rest = rows.join(first.select("profile_id", "endpoint_url").distinct(), ["profile_id", "endpoint_url"], "left_anti")
    rest = top_n(rest, ["profile_id", "endpoint_url"], order)
    rest = top_n(rest, ["profile_id", "vendor", "seedable"], order, cap, rank="_in_vendor").join(taken, "profile_id", "left")
    left = F.lit(cap) - F.coalesce("_taken", F.lit(0)).cast("int")
    tables = F.array(*[F.create_map(*[F.lit(x) for v, n in vendor_quotas(c) for x in (v, n)]) for c in range(1, cap + 1)])
    quota = F.coalesce(F.try_element_at(F.get(tables, left - 1), F.col("vendor")), F.lit(0))
    renewed = F.col("_pooled") | ~F.col("senior_tech")
    pass_no = (
        F.when(F.col("seedable") & renewed & (F.col("_in_vendor") <= quota), 2).when(F.col("seedable"), 3).otherwise(4)
    )
    more = rest.withColumn("pass_no", pass_no).withColumn(
        "_turn", F.when(F.col("pass_no") == 2, _vendor_turn()).otherwise(0)
    )
    both = first.unionByName(more.drop("_in_vendor", "_taken"))
    picked = top_n(both, profile, [F.asc("pass_no"), F.asc("_turn"), *order], cap, rank="position")
    return picked.drop("_pool", "_pooled", "_turn")


def _quota_column(quotas: dict[str, int]) -> Column:
    out = None
    for vendor, n in quotas.items():
        out = F.when(F.col("vendor") == vendor, n) if out is None else out.when(F.col("vendor") == vendor, n)
    return out.otherwise(0)


def _vendor_turn() -> Column:
    out = None
    for i, (vendor, _) in enumerate(VENDOR_SHARES):
        out = F.when(F.col("vendor") == vendor, i) if out is None else out.when(F.col("vendor") == vendor, i)
    return out.otherwise(len(VENDOR_SHARES))


def next_batch(scored: DataFrame, used: DataFrame, kept: DataFrame, cap: int = 0) -> DataFrame:
    """For profiles whose first batch kept nothing, the next selection.

    used: (profile_id, endpoint_url) rows scanned so far; kept: (profile_id)
    rows that found something.
    """
    remaining = scored.join(kept.select("profile_id").distinct(), "profile_id", "left_anti").join(
        used.select("profile_id", "endpoint_url").distinct(), ["profile_id", "endpoint_url"], "left_anti"
    )
    return select_endpoints(remaining, cap)


# --- registry ranking -----------------------------------------------------------


def source_priority(registry: DataFrame, accept_both_names: bool = False) -> DataFrame:
    """Priority score and note per source.

    The type bonus is written for 'Company Career Site' while sources carry
    'Company Careers'; accept_both_names gives it to either.
    """
    site = ["Company Career Site", *(["Company Careers"] if accept_both_names else [])]
    seen, matched = F.coalesce("seen_count", F.lit(0)), F.coalesce("matching_job_count", F.lit(0))
    ratio = F.when(seen > 0, matched.cast("double") / F.greatest(seen, F.lit(1))).otherwise(0.0)
    score = (
        F.when(F.col("source_trust") == "ATS Confirmed", 50.0)
        .when(F.col("source_trust") == "Career Site Confirmed", 35.0)
        .when(F.col("source_trust") == "Web Discovered", 20.0)
        .otherwise(0.0)
        + F.when(F.col("source_type") == "ATS", 20.0).when(F.col("source_type").isin(*site), 10.0).otherwise(0.0)
        + F.least(seen, F.lit(50)) * 0.5
        + F.least(matched, F.lit(50)) * 1.5
        + ratio * 30
        + F.when(F.col("status") == "active", 10.0).otherwise(-10.0)
    )
    yields = F.when(ratio >= 0.75, F.lit("high yield")).when((ratio <= 0.15) & (seen >= 5), F.lit("low yield"))
    volume = F.when(seen >= 25, F.lit("high volume")).when(seen <= 2, F.lit("low history"))
    return registry.withColumns(
        {"priority_score": F.bround(score, 2), "notes": F.concat_ws(", ", yields, volume)}
    )


def top_bottom_sources(registry: DataFrame, k: int = 15) -> DataFrame:
    """O3: the k best and the k worst sources."""
    best = [F.desc("priority_score"), F.desc("matching_job_count"), F.desc("seen_count"), F.asc("source_key")]
    worst = [F.asc("priority_score"), F.asc("matching_job_count"), F.asc("seen_count"), F.asc("source_key")]
    return (
        registry.orderBy(*best)
        .limit(k)
        .withColumn("side", F.lit("top"))
        .unionByName(registry.orderBy(*worst).limit(k).withColumn("side", F.lit("bottom")))
    )


def low_yield(registry: DataFrame, k: int) -> DataFrame:
    """Often seen, hardly ever matching, worst first."""
    return (
        registry.filter((F.col("seen_count") >= 3) & (F.col("matching_job_count") <= 1))
        .orderBy(F.asc("priority_score"), F.desc("seen_count"), F.asc("source_key"))
        .limit(k)
    )


def split_and_cap_sources(registry: DataFrame, caps: dict[str, tuple[int, int]]) -> DataFrame:
    """Per vendor the strong roots, then the others, up to two caps.

    caps: vendor -> (strong, other). Returns all distinct roots with `kept`
    and the board-list position.
    """
    order = [F.desc("priority_score"), F.desc("matching_job_count"), F.desc("seen_count"), F.asc("source_root"), F.asc("source_key")]
    strong = (F.coalesce("priority_score", F.lit(0.0)) >= 60) | (F.coalesce("matching_job_count", F.lit(0)) >= 3)
    rows = registry.filter(F.col("ats_type").isin(*caps) & (F.col("source_root") != "") & (F.col("status") == "active"))
    distinct = top_n(rows, ["ats_type", "source_root"], order).withColumn("strong", strong)
    limits = F.create_map(*[F.lit(x) for v, (a, b) in caps.items() for x in (v, F.array(F.lit(a), F.lit(b)))])
    widest = max(max(pair) for pair in caps.values())
    cap = F.get(F.element_at(limits, F.col("ats_type")), F.when(F.col("strong"), 0).otherwise(1))
    taken = top_n(distinct, ["ats_type", "strong"], order, widest, rank="rank_in_class").filter(
        F.col("rank_in_class") <= cap
    )
    return distinct.join(
        taken.select("ats_type", "source_root", "rank_in_class", F.lit(True).alias("_k")),
        ["ats_type", "source_root"],
        "left",
    ).withColumns({"kept": F.coalesce("_k", F.lit(False)), "rank_in_class": F.coalesce("rank_in_class", F.lit(0))}).drop("_k")


def cap_per_group(df: DataFrame, group: str | Sequence[str], n: int, order: Sequence[Column]) -> DataFrame:
    """At most n rows per group, in an explicit order."""
    return top_n(df, [group] if isinstance(group, str) else list(group), order, n)


def capped_scan(df: DataFrame, group: str, n: int, pos: str, gates: dict[str, Column], url: str) -> tuple[DataFrame, DataFrame]:
    """(the rows kept per group, per group what was kept and skipped).

    A group is scanned by `pos` (unique) until n rows have passed all gates; a row is
    skipped by its first failing gate. Rows after the scan's end are neither
    kept nor skipped, and a URL that is kept twice is one of the kept.
    """
    reason = F.lit(None).cast("string")
    for name, passes in reversed(gates.items()):
        reason = F.when(F.coalesce(passes, F.lit(False)), reason).otherwise(F.lit(name))
    judged = df.withColumn("_skip", reason)
    kept = top_n(judged.filter(F.col("_skip").isNull()), [group], [F.asc(pos)], n, rank="_nth")
    ends = kept.filter(F.col("_nth") == n).select(F.col(group).alias("_group"), F.col(pos).alias("_end"))
    seen = judged.join(ends, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn(
        "_in", F.col("_end").isNull() | (F.col(pos) <= F.col("_end"))
    )
    counts = [F.count_if(F.col("_in") & (F.col("_skip") == name)).alias(f"{name}_skips") for name in gates]
    summary = seen.groupBy(group).agg(F.count_if("_in").alias("scanned"), *counts, F.count_if(~F.col("_in")).alias("not_reached"))
    once = top_n(kept.drop("_skip", "_nth"), [group, url], [F.asc(pos)])
    found = once.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("kept"))
    summary = summary.join(found, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group").fillna(0, ["kept"])
    return once, summary


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The newest (n) rows per key."""
    return top_n(df, [key] if isinstance(key, str) else list(key), order, n)


def label_latest_run(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """W10: 'Net New' or 'Rediscovered' for rows of the newest run."""
    newest = F.broadcast(runs.agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("_newest")))
    here = F.coalesce(F.col("last_seen_run_id"), F.lit(0)) == F.col("_newest")
    seen = F.coalesce(F.col("seen_count"), F.lit(0))
    label = F.when(here & (seen <= 1), F.lit("Net New")).when(here, F.lit("Rediscovered")).otherwise(F.lit(""))
    return postings.join(newest, F.lit(True)).withColumn("discovery_state", label).drop("_newest")


def new_per_tier(observations: DataFrame, tier: str, url: str) -> DataFrame:
    """Results per tier and URLs no earlier tier had returned."""
    per_url = observations.groupBy(url).agg(F.min(tier).alias(tier))
    fresh = per_url.groupBy(tier).agg(F.count(F.lit(1)).alias("new_urls"))
    counts = observations.groupBy(tier).agg(F.count(F.lit(1)).alias("results"))
    return counts.join(fresh, tier, "left").fillna(0, ["new_urls"])


# --- review lists ------------------------------------------------------------------

SORT_MODES = ["Newest First", "Highest Fit Score", "Highest Compensation", "Highest Source Trust", "Company A-Z"]


def review_order(mode: str, prior: Sequence[Column]) -> list[Column]:
    """O1: the order of a review mode; ties keep the prior order."""
    keys = {
        "Highest Fit Score": F.coalesce(first_number(F.col("fit_score").cast("string")), F.lit(-1.0)).desc(),
        "Highest Compensation": pay.largest_number(F.col("compensation_raw")).desc(),
        "Highest Source Trust": trust.rank(F.col("source_trust"), trust.REVIEW_TRUST).desc(),
        "Company A-Z": F.lower(clean(F.col("company"), False)).asc(),
    }
    return [keys.get(mode, notes.to_timestamp(F.col("date_found")).desc_nulls_last()), *prior]


def open_order() -> list[Column]:
    return [F.col("fit_score").desc_nulls_last(), F.asc("company"), F.asc("title"), F.asc("posting_id")]


def review_sort(df: DataFrame, mode: str) -> DataFrame:
    """O1: the review list in one of five modes."""
    return df.orderBy(*review_order(mode, open_order()))


def open_list(postings: DataFrame) -> DataFrame:
    """O2: new and active postings, best fit first, with a display title."""
    rows = postings.filter(
        (F.col("workflow_status") == "New") & (F.coalesce("active_status", F.lit("Active")) == "Active")
    )
    shown = rows.withColumn("display_title", titles.display_title(F.col("company"), F.col("title")))
    return shown.orderBy(*open_order())


def applied_list(postings: DataFrame, today: Column) -> DataFrame:
    """O2: applied postings by applied date, with days since."""
    rows = postings.filter(F.col("workflow_status") == "Applied")
    dated = rows.withColumn("applied_on", notes.to_day(F.col("applied_date")))
    return dated.withColumn("days_ago", F.date_diff(today, F.col("applied_on"))).orderBy(
        F.col("applied_on").desc_nulls_last(), F.asc("company"), F.asc("title"), F.asc("posting_id")
    )


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """One page with the totals; the number is clamped to the range.

    The table is dealt by ranges of the order, and only the ranges that the page
    lies in are numbered: the last page costs what the first does.
    """
    total = df.count()
    pages = max(1, -(-total // size))
    number = max(1, min(number, pages))
    rows = ranked(df, [], order, "row_no", number * size, (number - 1) * size + 1)
    totals = {"total_rows": total, "total_pages": pages, "page_no": number}
    return rows.withColumn("row_no", F.col("row_no").cast("int")).withColumns({c: F.lit(v).cast("long") for c, v in totals.items()})


# --- sets and comparisons --------------------------------------------------------------


def url_set_algebra(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """Every URL of two sets once, with the side(s) it is on."""
    left = a.select(key).filter(F.col(key) != "").withColumn("_side", F.lit(1))
    right = b.select(key).filter(F.col(key) != "").withColumn("_side", F.lit(2))
    sides = left.unionByName(right).groupBy(key).agg(F.min("_side").alias("_a"), F.max("_side").alias("_b"))
    return sides.select(
        key,
        F.when(F.col("_a") != F.col("_b"), F.lit("shared"))
        .when(F.col("_a") == 1, F.lit("first_only"))
        .otherwise(F.lit("second_only"))
        .alias("side"),
    )


def registry_delta(export: DataFrame, registry: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Export rows the registry lacks, and the floored count difference."""
    missing = export.join(registry.select(*key).distinct(), list(key), "left_anti")
    counts = export.agg(F.count(F.lit(1)).alias("export_rows")).join(
        registry.agg(F.count(F.lit(1)).alias("registry_rows")), F.lit(True)
    )
    return missing, counts.withColumn("delta", F.greatest(F.col("export_rows") - F.col("registry_rows"), F.lit(0)))


def compare_reports(baseline: DataFrame, current: DataFrame, key: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per key of the current report the change of every measure."""
    old = baseline.select(*key, *[F.col(m).alias(f"_b_{m}") for m in measures])
    change = lambda m: F.coalesce(F.col(m), F.lit(0)) - F.coalesce(F.col(f"_b_{m}"), F.lit(0))
    return current.join(old, list(key), "left").select(
        *key, *[F.col(m) for m in measures], *[F.round(change(m), 4).alias(f"{m}_delta") for m in measures]
    )


def pair_modes(reports: DataFrame, modes: Sequence[str], measures: Sequence[str], order: str) -> DataFrame:
    """The modes of a title side by side; the last report of each counts."""
    values = [F.max_by(m, order).alias(m) for m in measures]
    return reports.groupBy("title").pivot("mode", list(modes)).agg(*values)
