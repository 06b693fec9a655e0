"""URL, text and selection gates with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pay, urls
from ..functions.text import clean, contains_any, first_marker, first_number, let
from .ordered import top_n

# Markers of pages that are not postings.
BLOCKED_SUBSTRINGS = [
    "?error=",
    "?keyword=",
    "/search",
    "/jobs/search",
    "/about-us/",
    "/about/",
    "/leadership",
    "/executive-team",
    "/executive_team",
    "/team/",
    "/our-team",
    "/people/",
    "/our-people",
    "/company/",
    "/companies/",
]
BLOCKED_PATHS = [
    "/leadership",
    "/team",
    "/people",
    "/about-us",
    "/about",
    "/company",
    "/companies",
    "/executives",
    "/our-team",
    "/our-people",
]
LISTING_QUERY_KEYS = ["keyword=", "location=", "search=", "query="]
GENERIC_HOSTS = [
    "linkedin.com",
    "facebook.com",
    "instagram.com",
    "x.com",
    "twitter.com",
    "youtube.com",
    "wikipedia.org",
]
POSTING_PATHS = [
    "/job/",
    "/jobs/",
    "/careers/job",
    "/open-positions/",
    "/positions/",
    "/vacancies/",
    "/opportunities/",
    "/role/",
    "/roles/",
]
DETAIL_REASONS = [
    "lever_detail",
    "greenhouse_detail",
    "ashby_detail",
    "smartrecruiters_detail",
    "workday_detail",
    "generic_jobish_path",
]
# The narrower allow-list classifier.
CLASSIFIER_BLOCKED = ["?error=", "?keyword=", "/search", "/jobs/search"]
ALLOWED_DOMAINS = ["greenhouse.io", "lever.co", "myworkdayjobs.com", "ashbyhq.com", "smartrecruiters.com"]
# Hosts to prefer, hosts that only lead on, and their paths.
PREFERRED_HOSTS = [
    "greenhouse.io",
    "lever.co",
    "myworkdayjobs.com",
    "ashbyhq.com",
    "smartrecruiters.com",
    "recruiting.paylocity.com",
    "jobs.jobvite.com",
    "jobs.icims.com",
    "taleo.net",
    "careers.bamboohr.com",
    "paycomonline.net",
    "adp.com",
]
GATEWAY_HOSTS = [
    "linkedin.com",
    "indeed.com",
    "glassdoor.com",
    "ziprecruiter.com",
    "trueup.io",
    "otta.com",
    "wellfound.com",
    "arcussearch.com",
]
GATEWAY_BLOCKED_PATHS = [
    "/jobs/search",
    "/jobs-",
    "/q-",
    "/cmp/",
    "/companies/",
    "/company/",
    "/salaries",
    "/salary",
    "/career-advice",
    "/career",
    "/community",
    "/communities",
    "/overview",
    "/reviews",
    "/interviews",
    "/profile/",
    "/profiles/",
    "/hiring/page/",
    "/hiring/companies/",
    "/job-alert",
    "/job-alerts",
]
GREENHOUSE_HOSTS = ["job-boards.greenhouse.io", "boards.greenhouse.io"]


def _detail_or_root(enough: Column, detail: str, root: str) -> Column:
    return F.when(enough, F.lit(detail)).otherwise(F.lit(root))


def _vendor_reason(u: Column) -> Column:
    """Detail or board root for the five vendors, NULL elsewhere."""
    two = F.size(u["segments"]) >= 2
    on = lambda *hosts: urls.on_any_host(u["host"], hosts)
    return (
        F.when(on("jobs.lever.co"), _detail_or_root(two, "lever_detail", "lever_board_root"))
        .when(
            on(*GREENHOUSE_HOSTS),
            _detail_or_root(
                two & F.array_contains(u["segments"], "jobs"), "greenhouse_detail", "greenhouse_board_root"
            ),
        )
        .when(on("jobs.ashbyhq.com"), _detail_or_root(two, "ashby_detail", "ashby_board_root"))
        .when(on("jobs.smartrecruiters.com"), _detail_or_root(two, "smartrecruiters_detail", "smartrecruiters_root"))
        .when(
            on("myworkdayjobs.com"),
            _detail_or_root(F.lower(u["path"]).contains("/job/"), "workday_detail", "workday_root"),
        )
    )


def url_gate_reason(u: Column) -> Column:
    """The gate's reason for URL parts; DETAIL_REASONS pass."""
    low_path, low_query = F.lower(u["path"]), F.lower(u["query"])
    by_path = F.coalesce(
        *[
            F.when((low_path == m) | low_path.startswith(m + "/"), F.lit(f"blocked_path:{m}"))
            for m in BLOCKED_PATHS
        ]
    )
    return F.coalesce(
        F.when(u["value"] == "", F.lit("blank_url")),
        first_marker(u["lowered"], BLOCKED_SUBSTRINGS, lambda m: f"blocked_pattern:{m}"),
        by_path,
        F.when(contains_any(low_query, LISTING_QUERY_KEYS), F.lit("blocked_query_listing")),
        F.when(
            u["host"].contains("jobs.lever.co") & u["lowered"].contains("jobgether"),
            F.lit("blocked_jobgether_wrapper"),
        ),
        _vendor_reason(u),
        F.when(u["lowered"].contains("/careers/"), F.lit("blocked_pattern:/careers/")),
        F.when(contains_any(u["host"], GENERIC_HOSTS), F.lit("blocked_generic_host")),
        F.when(contains_any(low_path, POSTING_PATHS), F.lit("generic_jobish_path")),
        F.lit("unclassified_non_job"),
    )


def url_quality_gate(df: DataFrame, url: str = "raw_url") -> DataFrame:
    """is the URL a posting page, and why (not)."""
    reason = let(urls.parts(F.col(url)), url_gate_reason)
    return df.withColumn("gate_reason", reason).withColumn("is_posting_url", F.col("gate_reason").isin(*DETAIL_REASONS))


def _class_reason(u: Column) -> Column:
    return F.coalesce(
        F.when(u["value"] == "", F.lit("blank_url")),
        first_marker(u["lowered"], CLASSIFIER_BLOCKED, lambda m: f"blocked_pattern:{m}"),
        F.when(~contains_any(u["lowered"], ALLOWED_DOMAINS), F.lit("blocked_domain")),
        _vendor_reason(u),
        F.lit("unclassified"),
    )


def classify_source_url(df: DataFrame, url: str = "raw_url") -> DataFrame:
    """the allow-list classifier as (keep, class_reason)."""
    # Bound: a filter on `keep` would write the parts out for every rule.
    reason = let(urls.parts(F.col(url)), _class_reason)
    return df.withColumn("class_reason", reason).withColumn("keep", F.col("class_reason").isin(*DETAIL_REASONS, "unclassified"))


def drop_counts(classified: DataFrame, source: str = "provider") -> DataFrame:
    """dropped rows per source and reason."""
    return (
        classified.filter(~F.col("keep"))
        .groupBy(source, "class_reason")
        .agg(F.count(F.lit(1)).alias("dropped"))
    )


def kept_urls(classified: DataFrame, url: str = "raw_url", pos: str = "obs_id") -> DataFrame:
    """the kept URLs, distinct, first seen first."""
    return classified.filter("keep").groupBy(url).agg(F.min(pos).alias("first_pos"))


def is_preferred_host(u: Column) -> Column:
    return contains_any(u["host"], PREFERRED_HOSTS)


def is_gateway_host(u: Column) -> Column:
    return contains_any(u["host"], GATEWAY_HOSTS)


def is_detail_url(u: Column) -> Column:
    """a posting page by host rules; u are parts of a light-form URL."""
    path = F.lower(u["path"])
    has = path.contains
    two = F.size(u["segments"]) >= 2
    numbered = F.exists(u["segments"], lambda s: F.length(F.regexp_replace(s, r"\D", "")) >= 5)
    at = u["host"].contains
    by_host = (
        F.when(at("linkedin.com"), has("/jobs/view/") & numbered)
        .when(at("indeed.com"), has("/viewjob") | u["value"].contains("jk="))
        .when(at("glassdoor.com"), has("/job-listing/"))
        .when(at("ziprecruiter.com"), has("/jobs/") & two)
        .when(at("trueup.io"), has("/job/") | has("/jobs/"))
        .when(at("otta.com"), has("/jobs/") & two)
        .when(at("wellfound.com"), has("/jobs/"))
        .when(at("arcussearch.com"), has("/job/"))
        .otherwise(F.lit(False))
    )
    return (u["value"] != "") & (
        is_preferred_host(u) | (is_gateway_host(u) & ~contains_any(path, GATEWAY_BLOCKED_PATHS) & by_host)
    )


def pick_best_url(df: DataFrame, key: str, url: str, pos: str) -> DataFrame:
    """one candidate per key: first preferred host, else first detail page.

    Keys without either keep a row with a blank URL and the reason.
    """
    light = df.withColumn("_url", urls.light(F.col(url))).withColumn("_u", urls.parts(F.col("_url")))
    ranked = light.withColumn(
        "_class",
        F.when(F.col("_url") == "", 3)
        .when(is_preferred_host(F.col("_u")), 0)
        .when(is_detail_url(F.col("_u")), 1)
        .otherwise(2),
    )
    best = top_n(ranked, [key], [F.col("_class"), F.col(pos)])
    found = F.col("_class") <= 1
    return best.select(
        key,
        F.when(found, F.col("_url")).otherwise(F.lit("")).alias("best_url"),
        F.when(F.col("_class") == 0, F.lit("preferred_host"))
        .when(F.col("_class") == 1, F.lit("detail_like_discovery_url"))
        .when(F.col("_class") == 2, F.lit("no_preferred_or_detail_candidate"))
        .otherwise(F.lit("no_candidate_url"))
        .alias("pick_reason"),
    )


def gate_cascade(df: DataFrame, gates: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """ordered gates (stage, fails, reason); the first failure counts.

    A NULL test counts as passed, so try_* results need no special care.
    """
    stage = F.coalesce(*[F.when(fails, F.lit(name)) for name, fails, _ in gates], F.lit("accepted"))
    reason = F.coalesce(*[F.when(fails, why) for _, fails, why in gates], F.lit(""))
    return df.withColumns({"stage": stage, "reason": reason}).withColumn("passed", F.col("stage") == "accepted")


# --- text and selection gates ----------------------------------------------

# The strict title gate.
REJECTED_TITLE_PARTS = [
    "director",
    "senior director",
    "manager",
    "principal",
    "lead",
    "staff ",
    "counsel",
    "recruiting",
    "sales",
    "tax",
    "design",
    "safety",
]
SENIOR_TITLE_PARTS = ["vp", "vice president", "svp", "senior vice president", "head of", "chief", "cto", "cio", "coo"]
DOMAIN_TITLE_PARTS = [
    "technology",
    "it",
    "information",
    "digital",
    "platform",
    "ai",
    "artificial intelligence",
    "product technology",
    "enterprise systems",
    "enterprise applications",
    "business technology",
    "business systems",
    "information security",
    "cybersecurity",
    "security",
    "data",
    "machine learning",
    "ml",
    "applications",
    "infrastructure",
    "engineering platform",
]
MIN_GATE_SCORE = 65


def strict_title_gate(title: Column) -> Column:
    """no rejected word, a senior word and a domain word."""
    low = F.lower(title)
    return (
        ~contains_any(low, REJECTED_TITLE_PARTS)
        & contains_any(low, SENIOR_TITLE_PARTS)
        & contains_any(low, DOMAIN_TITLE_PARTS)
    )


def settings_gates(df: DataFrame) -> DataFrame:
    """the profile's own title, place and keyword gates, one flag each.

    Rows carry the prepared profile columns (see profiles.prepare).
    """
    title, place = F.lower("title"), F.lower("location")
    everything = F.lower(F.concat_ws(" ", "title", "company", "location", "compensation_raw"))
    remote = place.contains("remote")
    unknown = F.col("location") == "Unknown"
    has_wishes = F.size("wishes") > 0
    wished = F.exists("wishes", lambda w: place.contains(F.lower(w["raw"])))
    return df.withColumns(
        {
            "strict_title_ok": strict_title_gate(F.col("title")),
            "title_ok": (F.size("targets") == 0) | F.exists("targets", lambda t: title.contains(F.lower(t))),
            "place_ok": F.when(F.col("remote_only"), remote | unknown)
            .when(F.col("include_remote") & remote, F.lit(True))
            .when(has_wishes, wished)
            .otherwise(~remote | F.col("include_remote")),
            "keywords_ok": ~F.exists("exclude_list", lambda k: everything.contains(F.lower(k))),
        }
    )


def record_gate(df: DataFrame) -> DataFrame:
    """validation, pay and score thresholds as one flag."""
    return df.withColumn(
        "record_ok",
        (F.col("validation_status") != "Rejected")
        & (F.col("compensation_status") != "Below Target")
        & (F.coalesce(F.col("fit_score"), F.lit(0.0)) >= MIN_GATE_SCORE),
    )


def review_filters(
    df: DataFrame,
    min_fit: float | None = None,
    discovery_state: str | None = None,
    remote_only: bool = False,
    paid_only: bool = False,
    trust_label: str | None = None,
) -> DataFrame:
    """the review list's filters; None or False switches one off."""
    if min_fit is not None:
        df = df.filter(F.coalesce(first_number(F.col("fit_score").cast("string")), F.lit(-1.0)) >= min_fit)
    if discovery_state is not None:
        df = df.filter(clean(F.col("discovery_state"), False) == discovery_state)
    if remote_only:
        df = df.filter(F.lower("location").contains("remote"))
    if paid_only:
        df = df.filter(pay.is_given(F.col("compensation_raw")))
    if trust_label is not None:
        label = clean(F.col("source_trust"), False)
        df = df.filter(label.isin("", "Unknown") if trust_label == "Unknown" else label == trust_label)
    return df


def _workflow_order() -> Column:
    return F.when(F.col("workflow_status") == "New", 0).when(F.col("workflow_status") == "Applied", 1).otherwise(2)


def select_for_rescore(df: DataFrame, as_of: Column, stale_days: int = 0, limit: int = 0) -> DataFrame:
    """not removed, stale if asked; a blank update time is not stale."""
    out = df.filter(F.col("active_status") != "Removed")
    if stale_days > 0:
        out = out.filter(F.coalesce(F.col("updated_at"), as_of) <= as_of - F.expr(f"INTERVAL {stale_days} DAYS"))
    out = out.orderBy(_workflow_order(), F.desc("updated_at"), F.desc("posting_id"))
    return out.limit(limit) if limit > 0 else out


def select_for_maintenance(
    df: DataFrame, as_of: Column, stale_days: int = 7, exclude_run: int = 0, limit: int = 0
) -> DataFrame:
    """incomplete or stale pages; a blank refresh time is stale."""
    blank = lambda c: clean(F.col(c), False) == ""
    never = F.col("last_page_refresh_at").isNull()
    stale = F.col("last_page_refresh_at") <= as_of - F.expr(f"INTERVAL {max(stale_days, 1)} DAYS")
    no_name = blank("company") | blank("title")
    no_pay = blank("compensation_raw")
    out = df.filter(F.col("active_status") != "Removed").filter(
        no_name | no_pay | blank("validation_status") | never | stale
    )
    if exclude_run > 0:
        out = out.filter(F.coalesce(F.col("last_seen_run_id"), F.lit(0)) != exclude_run)
    urgency = F.when(no_name, 0).when(no_pay, 1).when(never, 2).otherwise(3)
    out = out.orderBy(
        urgency, _workflow_order(), F.desc_nulls_last("fit_score"), F.desc("updated_at"), F.desc("posting_id")
    )
    return out.limit(limit) if limit > 0 else out
