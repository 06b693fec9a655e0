"""F1, whole: every observed URL through all stages of a run, up to the batch's duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trust, urls
from ..functions.text import contains_any
from . import gates, matching
from .dedupe import batch_key
from .lineage import cut
from .ordered import mark_first

# Hosts whose missing pages are expired postings.
STALE_HOSTS = [
    "jobs.lever.co",
    "job-boards.greenhouse.io",
    "boards.greenhouse.io",
    "myworkdayjobs.com",
    "jobs.smartrecruiters.com",
    "jobs.ashbyhq.com",
]


def parse_failure(url: Column, status: Column) -> Column:
    """The reason why a page gave no record, NULL if it gave one; `status` is 'ok', 'expired', an HTTP code or NULL."""
    gone = (status == "expired") | ((status == "404") & contains_any(F.lower(urls.authority(url)), STALE_HOSTS))
    return F.when(status == "ok", F.lit(None).cast("string")).otherwise(F.when(gone, F.lit("stale_ats_posting")).otherwise(F.lit("parse_failed")))


def run_cascade(seen: DataFrame, profiles: DataFrame, records: DataFrame) -> DataFrame:
    """F1: stage, reason and score of every observation.

    seen: obs_id (unique, in order), run_id, profile_id, provider, url; records:
    what parsing a page gave per obs_id: page_status, title, company, location,
    compensation_raw, ats_type. Only rows that pass the URL gates meet their page, only
    parsed ones are scored, and only accepted ones are looked at for duplicates
    within their run, where the first stays.
    """
    keep = ["obs_id", "run_id", "profile_id", "provider", "url"]
    checked = matching.title_prefilter(gates.url_quality_gate(matching.with_profile(seen, profiles), "url"))
    checked = cut(checked.select(*keep, "is_posting_url", "title_pass"))
    early = gates.gate_cascade(
        checked.filter(~(F.col("is_posting_url") & F.col("title_pass"))),
        [
            ("url_gate", ~F.col("is_posting_url"), F.lit("non_job_url")),
            ("url_title_prefilter", ~F.col("title_pass"), F.lit("weak_url_title_match")),
        ],
    )
    fetched = checked.filter("is_posting_url AND title_pass").select(*keep).join(records, "obs_id", "left")
    fetched = cut(fetched.withColumn("parse_reason", parse_failure(F.col("url"), F.col("page_status"))))
    unparsed = gates.gate_cascade(fetched.filter("parse_reason IS NOT NULL"), [("page_parse", F.lit(True), F.col("parse_reason"))])

    parsed = matching.with_profile(fetched.filter("parse_reason IS NULL"), profiles)
    scored = matching.qualify(parsed.withColumn("job_posting_url", F.col("url")))
    key = trust.stored_key(trust.record_key(F.col("company"), F.col("title"), F.col("location")))
    scored = scored.withColumn("duplicate_key", key)
    scored = cut(scored.select(*keep, batch_key().alias("batch_key"), "accepted", "forced", "match_skip", "match_score", "reason_text"))
    among = F.col("accepted") & (F.col("batch_key") != "")
    marked = mark_first(scored, ["run_id", "batch_key"], "obs_id", "first_in_run", among=among)
    late = gates.gate_cascade(
        marked,
        [
            ("match_score", ~F.col("accepted"), F.col("match_skip")),
            ("batch_dedup", among & ~F.col("first_in_run"), F.lit("duplicate_in_batch")),
        ],
    )
    every = early.unionByName(unparsed, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)
    return every.select(
        *keep, "stage", "reason", "passed", F.coalesce("match_score", F.lit(0)).alias("match_score"),
        F.coalesce("forced", F.lit(False)).alias("forced"), F.coalesce("reason_text", F.lit("")).alias("reason_text"),
    )
