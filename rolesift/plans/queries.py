"""One query per operator over the derived posting tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notes, pay, titles, trust, urls
from ..functions.text import split_titles
from ..operators import cascade, dedupe, gates, inverted, matching, metrics, ordered, pages, planning, profiles, ranking, results, store
from ..operators.lineage import cut, scratch
from ..sources import files
from ..streaming import ingest
from . import derived as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with their source facts and duplicate key."""
    url, vendor = F.col("job_posting_url"), F.col("ats_type")
    key = trust.record_key(F.col("company"), F.col("title"), F.col("location"))
    return d.postings(spark, sf_dir).withColumns(
        {
            "source_type": trust.source_type(url, vendor),
            "source_trust": trust.source_trust(url, vendor),
            "source_detail": trust.source_detail(url, vendor, F.lit("feed")),
            "duplicate_key": trust.stored_key(key),
            "pos": F.col("posting_id"),
        }
    )


def gated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations through the URL gate, the title gate and the batch dedup."""
    seen = d.url_observations(spark, sf_dir).withColumn("url", urls.vendor_form(F.col("raw_url")))
    checked = matching.title_prefilter(
        gates.url_quality_gate(matching.with_profile(seen, d.profiles(spark, sf_dir)), "url")
    )
    # Narrow, then computed once: the first-of-run join reads it twice.
    checked = cut(checked.select("obs_id", "run_id", "profile_id", "provider", "url", "is_posting_url", "title_pass"))
    ready = F.col("is_posting_url") & F.col("title_pass")
    marked = ordered.mark_first(checked, ["run_id", "url"], "obs_id", "first_in_run", among=ready)
    return gates.gate_cascade(
        marked,
        [
            ("url_gate", ~F.col("is_posting_url"), F.lit("non_job_url")),
            ("url_title_prefilter", ~F.col("title_pass"), F.lit("weak_url_title_match")),
            ("batch_dedup", ~F.col("first_in_run"), F.lit("duplicate_in_batch")),
        ],
    ).select("obs_id", "run_id", "profile_id", "provider", "url", "stage", "reason", "passed")


# --- gates ---------------------------------------------------------------------


@query("F1_gate_cascade")
def _(spark, sf):
    return gated_observations(spark, sf)


def full_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations through all stages, with a page record for those that an order stands for."""
    seen = d.url_observations(spark, sf_dir).withColumn("url", urls.vendor_form(F.col("raw_url")))
    seen = seen.select("obs_id", "run_id", "profile_id", "provider", "url")
    return cascade.run_cascade(seen, d.profiles(spark, sf_dir), d.page_records(spark, sf_dir))


@query("F1_full_cascade")
def _(spark, sf):
    return full_cascade(spark, sf)


@query("A3_full_run_quality")
def _(spark, sf):
    return metrics.run_quality(full_cascade(spark, sf), "obs_id", drops=gates.classify_source_url(d.url_observations(spark, sf)).filter("NOT keep").select("run_id", F.col("class_reason").alias("drop_reason")))


@query("F2_url_quality_gate")
def _(spark, sf):
    out = gates.url_quality_gate(d.url_observations(spark, sf))
    return out.select("obs_id", "raw_url", "is_posting_url", "gate_reason")


@query("F3_classify_source_url")
def _(spark, sf):
    return gates.drop_counts(gates.classify_source_url(d.url_observations(spark, sf)))


@query("F3_kept_urls")
def _(spark, sf):
    return gates.kept_urls(gates.classify_source_url(d.url_observations(spark, sf)))


@query("F4_pick_best_url")
def _(spark, sf):
    seen = d.url_observations(spark, sf).withColumn("result_id", F.floor(F.col("obs_id") / 4).cast("long"))
    return gates.pick_best_url(seen, "result_id", "raw_url", "obs_id")


@query("F5_title_prefilter")
def _(spark, sf):
    seen = matching.with_profile(d.url_observations(spark, sf), d.profiles(spark, sf))
    return matching.title_prefilter(seen, "raw_url").select(
        "obs_id", "profile_id", "title_hint", "title_pass", "title_reason"
    )


@query("F6_seed_title_prefilter")
def _(spark, sf):
    seen = matching.with_profile(d.url_observations(spark, sf), d.profiles(spark, sf))
    return matching.seed_title_prefilter(seen, "raw_url").select(
        "obs_id", "profile_id", "seed_title_pass", "seed_title_reason"
    )


@query("F7_seed_location_prefilter")
def _(spark, sf):
    seen = matching.with_profile(d.url_observations(spark, sf), d.profiles(spark, sf))
    return matching.seed_location_prefilter(seen, "raw_url").select(
        "obs_id", "profile_id", "seed_place_pass", "seed_place_reason"
    )


@query("F8_location_filter")
def _(spark, sf):
    rows = matching.with_profile(d.postings(spark, sf), d.profiles(spark, sf))
    return matching.location_filter(rows).select("posting_id", "profile_id", "place_pass", "place_reason")


@query("F9_settings_gates")
def _(spark, sf):
    rows = matching.with_profile(d.postings(spark, sf), d.profiles(spark, sf))
    return gates.settings_gates(rows).select(
        "posting_id", "strict_title_ok", "title_ok", "place_ok", "keywords_ok"
    )


@query("F11_review_filters")
def _(spark, sf):
    out = gates.review_filters(enriched(spark, sf), min_fit=50, remote_only=True, paid_only=True, trust_label="ATS Confirmed")
    return out.select("posting_id", "fit_score", "location", "compensation_raw", "source_trust")


AS_OF = "TIMESTAMP '1998-06-01 00:00:00'"


@query("F12_select_for_rescore")
def _(spark, sf):
    rows = d.postings(spark, sf).withColumn("updated_at", F.col("first_seen_at"))
    out = gates.select_for_rescore(rows, F.expr(AS_OF), stale_days=30, limit=200)
    return out.select("posting_id", "workflow_status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


@query("F13_select_for_maintenance")
def _(spark, sf):
    rows = d.postings(spark, sf).withColumns(
        {
            "updated_at": F.col("first_seen_at"),
            "validation_status": F.lit("Validated"),
            "last_page_refresh_at": F.when(F.col("posting_id") % 3 > 0, F.col("first_seen_at")),
        }
    )
    out = gates.select_for_maintenance(rows, F.expr(AS_OF), stale_days=7, exclude_run=199803, limit=500)
    return out.select("posting_id", "title", "compensation_raw", "workflow_status")


# --- matching --------------------------------------------------------------------


@query("J5_match_location")
def _(spark, sf):
    rows = matching.with_profile(d.postings(spark, sf), d.profiles(spark, sf))
    return matching.match_location(rows).select("posting_id", "profile_id", "place_match", "place_match_reason")


@query("J5_match_locations_keyed")
def _(spark, sf):
    return inverted.match_locations(d.postings(spark, sf), d.profiles(spark, sf))


@query("J14_top_profiles")
def _(spark, sf):
    return inverted.top_profiles(d.postings(spark, sf), d.many_profiles(spark, sf), 3)


@query("J6_match_titles")
def _(spark, sf):
    rows = matching.with_profile(d.postings(spark, sf), d.profiles(spark, sf))
    return matching.match_titles(rows).select("posting_id", "profile_id", "title_score", "title_score_reason")


@query("J7_expand_terms")
def _(spark, sf):
    return profiles.expand_terms(d.many_profiles(spark, sf))


@query("C1_qualify")
def _(spark, sf):
    rows = matching.with_profile(d.postings(spark, sf), d.profiles(spark, sf))
    return matching.qualify(rows).select(
        "posting_id", "profile_id", "score", "fit_tier", "accepted", "forced", "reject_reason", "rationale", "match_skip",
        "match_score", "reason_text", "place_pass", "place_reason",
    )


# --- duplicates and sightings -------------------------------------------------------


@query("W1_dedupe_batch")
def _(spark, sf):
    rows = enriched(spark, sf).withColumn("duplicate_key", F.when(F.col("posting_id") % 3 == 0, "").otherwise(F.col("duplicate_key")))
    return dedupe.dedupe_batch(rows).select("posting_id", "batch_key", "duplicates")


@query("W1_dedupe_batch_best")
def _(spark, sf):
    rows = enriched(spark, sf).withColumn("duplicate_key", F.when(F.col("posting_id") % 3 == 0, "").otherwise(F.col("duplicate_key")))
    return dedupe.dedupe_batch(rows, keep="best").select("posting_id", "batch_key", "duplicates")


@query("W2_distinct_in_order")
def _(spark, sf):
    seen = d.url_observations(spark, sf).withColumn("url", urls.vendor_form(F.col("raw_url")))
    return dedupe.distinct_in_order(seen, "url", "obs_id").select("obs_id", "url")


def _entity_observations(spark, sf):
    return d.url_observations(spark, sf).withColumn("entity", urls.canonical(F.col("raw_url")))


@query("W3_discovery_state")
def _(spark, sf):
    seen = _entity_observations(spark, sf)
    removed = seen.filter("obs_id % 17 = 0 AND entity LIKE '%lever.co%'").select("entity")
    out = dedupe.discovery_state(seen, "entity", "run_id", "obs_id", removed, block_rows=1000)
    return out.select("obs_id", "entity", "run_id", "discovery_state")


@query("W4_sighting_stats")
def _(spark, sf):
    seen = _entity_observations(spark, sf).withColumn("fit", F.when(F.col("obs_id") % 4 == 1, F.col("obs_id")))
    out = dedupe.sighting_stats(seen, "entity", "obs_id", score="fit", block_rows=1000)
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return out.select("obs_id", "seen_count", text("first_seen_at"), text("last_seen_at"), text("last_score_at"))


@query("J8_skip_known")
def _(spark, sf):
    rows = enriched(spark, sf)
    known = rows.filter("posting_id % 5 = 0")
    removed = rows.filter("posting_id % 17 = 0")
    return dedupe.skip_known(rows, [known, removed], "duplicate_key").select("posting_id", "duplicate_key")


@query("J11_seed_attribution")
def _(spark, sf):
    rows = enriched(spark, sf)
    seeds = rows.filter("posting_id % 6 = 0").select("job_posting_url")
    out = dedupe.seed_attribution(rows, seeds)
    return out.groupBy("profile_id").agg(
        F.count_if("seeded").alias("seeded_jobs"), F.count_if(~F.col("seeded")).alias("legacy_jobs")
    )


@query("U1_merge_providers")
def _(spark, sf):
    seen = d.url_observations(spark, sf)
    parts = [seen.filter(F.col("provider") == p) for p in ("search", "board_a", "board_b")]
    merged = dedupe.merge_providers(parts, "raw_url", "obs_id")
    return merged.groupBy("provider").agg(F.count(F.lit(1)).alias("urls"), F.sum("obs_id").alias("obs_sum"))


# --- metrics ---------------------------------------------------------------------


@query("A1_reason_summary")
def _(spark, sf):
    return metrics.reason_summary(gated_observations(spark, sf), "obs_id", "url")


@query("A1_tier_samples")
def _(spark, sf):
    rejected = gates.classify_source_url(d.url_observations(spark, sf)).filter("NOT keep")
    return metrics.tier_samples(rejected, "provider", "class_reason", "obs_id")


@query("A3_run_quality")
def _(spark, sf):
    return metrics.run_quality(gated_observations(spark, sf), "obs_id")


@query("A3_full_skip_reasons")
def _(spark, sf):
    return full_cascade(spark, sf).groupBy("run_id", "stage", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("A4_ingest_ids")
def _(spark, sf):
    return metrics.ingest_ids(_outcome_rows(spark, sf))


@query("A18_selection_mix")
def _(spark, sf):
    chosen = ranking.select_endpoints(scored_endpoints(spark, sf)).select("profile_id", "vendor", "company_name", "position")
    return metrics.selection_mix(chosen)


@query("A18_provider_mix")
def _(spark, sf):
    return metrics.provider_mix(d.url_observations(spark, sf).withColumn("url", F.col("raw_url")))


@query("J11_seed_totals")
def _(spark, sf):
    rows = enriched(spark, sf).withColumn("company", F.when(F.col("posting_id") % 97 == 0, F.lit(" ")).otherwise(F.col("company")))
    seeds = rows.filter("posting_id % 6 = 0").select("job_posting_url")
    return dedupe.seed_totals(dedupe.seed_attribution(rows, seeds), "profile_id", "posting_id")


@query("T18_run_durations")
def _(spark, sf):
    n = F.col("event_id")
    rows = d.table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("a"))
    rows = rows.withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + n % 9000 - 100))
    text = lambda c: (
        F.when(n % 5 == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).when(n % 5 == 1, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n % 5 == 2, F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(".250000"))).when(n % 5 == 3, F.lit(" ")).otherwise(F.lit("soon"))
    )
    own = F.when(n % 7 == 0, F.concat((n % 11).cast("string"), F.lit(".50"))).when(n % 7 == 1, F.lit("x")).otherwise(F.lit(""))
    return rows.select("event_id", notes.run_duration(text("a"), text("b"), own).alias("duration"))


@query("T19_note_fields")
def _(spark, sf):
    n = F.col("p_partkey")
    said = F.concat(F.lit("Selected endpoints: "), n % 50, F.lit(". Old picks: "), F.col("p_size"), F.lit(". Mode: next gen. More: "), F.col("p_name"))
    output = F.concat(F.lit("start\n"), F.when(n % 3 > 0, F.lit("Skip summary:\n")).otherwise(F.lit("")), F.lit("- size: "), F.col("p_size"), F.lit("\n  - name: "), F.col("p_name"), F.lit("\n\n- later"))
    return d.table(spark, sf, "part").select(
        "p_partkey", notes.number_after(said, "Selected endpoints", "Old picks").alias("picked"), notes.number_after(said, "selected endpoints").alias("none"),
        notes.phrase_after(said, "Way", "Mode").alias("mode"), notes.phrase_after(said, "More").alias("more"),
        F.array_join(notes.line_items(output, "Skip summary:"), "; ").alias("items"),
    )


@query("T21_profile_text")
def _(spark, sf):
    n = F.col("c_custkey")
    blank = lambda k, c: F.when(n % k == 0, F.lit(" ")).otherwise(c)
    text = notes.profile_text(blank(2, F.col("c_name")), blank(3, F.concat(F.lit("segment "), "c_mktsegment")), blank(5, F.col("c_name")))
    return d.table(spark, sf, "customer").select("c_custkey", text.alias("profile_text"), notes.truncated(text, 60).alias("short"))


@query("F9_record_gate")
def _(spark, sf):
    n = F.col("posting_id")
    rows = d.postings(spark, sf).withColumns(
        {"validation_status": F.when(n % 4 == 0, F.lit("Rejected")).otherwise(F.lit("Validated")), "compensation_status": F.when(n % 6 == 0, F.lit("Below Target")).otherwise(F.lit("Meets Target"))}
    )
    return gates.record_gate(rows).select("posting_id", "record_ok")


@query("M7_artifact_records")
def _(spark, sf):
    base = snapshot(spark, sf).withColumn("company", F.concat(F.lit(" "), "company"))
    letters = table_rows(spark, sf).select(F.col("l_orderkey").alias("posting_id"), "artifact_id", F.concat(F.lit("/out/"), "artifact_id", F.lit(".txt")).alias("path"))
    records, strays = store.artifact_records(base, letters)
    unknown = strays.select("artifact_id", *[F.lit(None).cast("string").alias(c) for c in ("duplicate_key", "company", "title")], F.col("path").alias("output_path"))
    return records.unionByName(unknown).fillna("?", ["duplicate_key", "company", "title"])


@query("F4_resolve_redirects")
def _(spark, sf):
    n, raw = F.col("obs_id"), F.col("raw_url")
    coded = raw
    for char, code in ((":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("=", "%3D"), ("&", "%26")):
        coded = F.replace(coded, F.lit(char), F.lit(code))
    wrapped = F.when(n % 4 == 0, F.concat(F.lit("https://go.example.com/r?x=1&target="), coded)).when(n % 4 == 1, F.lit("https://go.example.com/r?target=soon")).otherwise(raw)
    seen = d.url_observations(spark, sf).select("obs_id", urls.resolve(wrapped).alias("r"))
    return seen.select("obs_id", F.col("r.url").alias("url"), F.col("r.reason").alias("reason"))


@query("C4_score_lists")
def _(spark, sf):
    listed = lambda name, *items: F.concat(F.lit(f'"{name}": ["'), *items, F.lit('", " "], '))
    body = F.concat(
        F.lit('```json\n{'), *[listed(c, F.lit(f"{k} "), F.col("lang")) for k, c in enumerate(results.SCORE_LISTS)], F.lit('"fit_score": 70}\n```')
    )
    rows = d.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("no")).otherwise(body).alias("raw_text"), F.lit("").alias("title"), F.array().cast("array<string>").alias("levels"),
    )
    return results.normalise_scores(rows).select("doc_id", *[F.array_join(c, "; ").alias(c) for c in results.SCORE_LISTS])


@query("A5_source_yield")
def _(spark, sf):
    rows = enriched(spark, sf).withColumn("source_detail", F.when(F.col("posting_id") % 3 == 0, F.col("source_detail")).otherwise(F.lit("in_memory_discovery_result")))
    top = metrics.top_yield(metrics.source_yield(rows, "pos", "last_seen_run_id"), "last_seen_run_id")
    return top.select("last_seen_run_id", "source_key", "job_count", "source_trust", "source_type")


@query("A6_source_dominance")
def _(spark, sf):
    yields = metrics.source_yield(enriched(spark, sf), "pos", "last_seen_run_id")
    return metrics.source_dominance(yields, "last_seen_run_id").select(
        "last_seen_run_id", "total_seen", "top_count", "share", "flag"
    )


def registry(spark, sf):
    """Old registry rows (early runs) brought forward with later ones."""
    rows = enriched(spark, sf)
    run = F.concat(F.lit("run "), "last_seen_run_id")
    old = metrics.build_source_registry(rows.filter("last_seen_run_id < 199500"), "pos", "first_seen_at", None, "early", run)
    return metrics.build_source_registry(rows.filter("last_seen_run_id >= 199500"), "pos", "first_seen_at", old, "late", run)


@query("A7_build_source_registry")
def _(spark, sf):
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return registry(spark, sf).select(
        "source_key", "source_root", "hostname", "ats_type", "source_type", "source_trust", "source_name", "source_detail", "example_job_url",
        "status", "seen_count", "matching_job_count", text("first_seen_at"), text("last_seen_at"),
    )


@query("A8_registry_totals")
def _(spark, sf):
    return metrics.registry_totals(registry(spark, sf))


@query("A8_recent_sources")
def _(spark, sf):
    return metrics.recent_sources(registry(spark, sf)).select("source_key", "source_trust", "matching_job_count")


@query("A15_review_kpis")
def _(spark, sf):
    day = F.date_format("first_seen_at", "yyyy-MM-dd")
    rows = d.postings(spark, sf).withColumn(
        "applied_date", F.when(F.col("posting_id") % 9 == 0, F.date_format("first_seen_at", "MM/dd/yyyy")).otherwise(day)
    )
    return metrics.review_kpis(rows, F.lit("1998-07-01").cast("date"))


@query("A16_status_counts")
def _(spark, sf):
    rows = enriched(spark, sf)
    runs = d.url_observations(spark, sf).select("run_id")
    return metrics.status_counts(rows, rows.filter("posting_id % 17 = 0"), d.endpoints(spark, sf), runs)


# --- store ------------------------------------------------------------------------


RUN = 199901


def now():
    return F.lit("1999-01-01 00:00:00").cast("timestamp")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting store: even postings, one per duplicate key."""
    rows = enriched(spark, sf_dir).filter("posting_id % 2 = 0 AND active_status = 'Active'")
    first = ordered.top_n(rows, ["duplicate_key"], [F.asc("posting_id")])
    blank = F.lit("")
    full = store.coerce_payload(
        first,
        extra=["posting_id", "workflow_status", "first_seen_at", "last_seen_run_id"],
    )
    return full.withColumns(
        {
            "applied_date": F.when(F.col("workflow_status") == "Applied", F.date_format("first_seen_at", "yyyy-MM-dd")).otherwise(blank),
            "source_trust": F.when(F.col("posting_id") % 6 == 0, F.lit("Web Discovered")).otherwise(F.col("source_trust")),
            "last_seen_at": F.col("first_seen_at"),
            "seen_count": F.lit(1).cast("long"),
            "last_page_refresh_at": F.col("first_seen_at"),
            "last_score_refresh_at": F.lit(None).cast("timestamp"),
            "last_refresh_status": F.lit("discovered"),
            "updated_at": F.col("first_seen_at"),
        }
    )


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enriched(spark, sf_dir).filter("posting_id % 17 = 0")
    return rows.select(
        F.lit("1998-12-31").alias("removed_date"), "duplicate_key", "company", "title", "location", "job_posting_url",
        F.lit("Removed in app").alias("removal_reason"),
    ).dropDuplicates(["duplicate_key"])


def upserted(spark: SparkSession, sf_dir: str) -> store.Upsert:
    batch = enriched(spark, sf_dir).filter("posting_id % 3 = 0")
    return store.upsert_postings(cut(snapshot(spark, sf_dir)), batch, tombstones(spark, sf_dir), RUN, now())


@query("J2_drop_tombstoned")
def _(spark, sf):
    live, gone = store.drop_tombstoned(enriched(spark, sf), tombstones(spark, sf))
    count = lambda df, label: df.groupBy("profile_id").agg(F.count(F.lit(1)).alias(label))
    return count(live, "live").join(count(gone, "skipped"), "profile_id", "full_outer").fillna(0)


@query("J3_resolve_existing")
def _(spark, sf):
    batch = cut(store.coerce_payload(enriched(spark, sf).filter("posting_id % 3 = 0")))
    found = store.resolve_existing(batch, cut(snapshot(spark, sf)))
    return batch.join(found, ["duplicate_key", "canonical_job_posting_url", "job_posting_url"]).select(
        "pos", F.coalesce("existing_id", F.lit(-1)).alias("existing_id")
    )


@query("M1_upsert_postings")
def _(spark, sf):
    out = upserted(spark, sf).snapshot
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    return out.select(
        "posting_id", "company", "title", "job_posting_url", "canonical_job_posting_url", "source_trust", "source_type",
        "source_detail", "workflow_status", "applied_date", "duplicate_key", "seen_count", "last_seen_run_id",
        text("first_seen_at"), text("last_seen_at"), text("last_score_refresh_at"),
    )


@query("M1_upsert_outcomes")
def _(spark, sf):
    return upserted(spark, sf).outcomes.select(
        "pos", F.coalesce("job_id", F.lit(-1)).alias("job_id"), "status", "discovery_state", "trust_promoted"
    )


@query("M1_upsert_matches")
def _(spark, sf):
    return upserted(spark, sf).matches.select("pos", "posting_id")


def _outcome_rows(spark, sf):
    """Every posting as one run item: upsert outcomes by its own run."""
    seen = enriched(spark, sf).withColumn("entity", F.concat_ws("|", "company", "title"))
    state = dedupe.discovery_state(seen, "entity", "last_seen_run_id", "pos", block_rows=5000)
    status = F.when(F.col("discovery_state") == "net_new", F.lit("inserted")).otherwise(F.lit("updated"))
    return state.withColumns({"status": status, "run_id": F.col("last_seen_run_id"), "job_id": F.col("posting_id")})


@query("A4_ingest_summary")
def _(spark, sf):
    return metrics.ingest_summary(_outcome_rows(spark, sf))


@query("A4_ingest_label_counts")
def _(spark, sf):
    return metrics.ingest_label_counts(_outcome_rows(spark, sf), ["source_trust", "source_type"])


@query("M2_mark_applied")
def _(spark, sf):
    base = snapshot(spark, sf)
    ids = base.filter("posting_id % 10 = 0").select("posting_id")
    return store.mark_applied(base, ids, "1999-01-02", now()).select("posting_id", "workflow_status", "status", "applied_date")


@query("M3_remove_postings")
def _(spark, sf):
    base = snapshot(spark, sf)
    ids = base.filter("posting_id % 10 = 0").select("posting_id")
    after, gone = store.remove_postings(base, tombstones(spark, sf), ids, "1999-01-02")
    left = after.select(F.lit("kept").alias("side"), "duplicate_key", F.lit("").alias("removed_date"))
    return left.unionByName(gone.select(F.lit("tombstone").alias("side"), "duplicate_key", "removed_date"))


@query("M4_apply_refresh")
def _(spark, sf):
    base = snapshot(spark, sf)
    refreshed = base.filter("posting_id % 8 = 0").select(
        "posting_id", F.upper("title").alias("title"), "company", "location", F.lit("$300,000 - $310,000").alias("compensation_raw"),
        (F.col("posting_id") % 100).cast("double").alias("fit_score"), (F.col("posting_id") % 16 == 0).alias("scored"),
        F.lit("refreshed").alias("refresh_status"),
    )
    out = store.apply_refresh(base, refreshed, now())
    return out.select(
        "posting_id", "title", "compensation_raw", "last_refresh_status",
        F.coalesce("fit_score", F.lit(-1.0)).alias("fit_score"),
        F.coalesce(F.date_format("last_score_refresh_at", "yyyy-MM-dd"), F.lit("")).alias("scored_on"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"),
    )


@query("M6_upsert_settings")
def _(spark, sf):
    stored = settings_kv(spark, sf)
    updates = stored.filter("profile_id % 2 = 0").select(
        "profile_id", F.when(F.col("key") == "remote_only", F.lit("executive_summary")).otherwise(F.col("key")).alias("key"),
        F.concat(F.lit(" new "), "value").alias("value"), F.monotonically_increasing_id().alias("pos"),
    )
    return profiles.upsert_settings(stored, updates)


def settings_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as stored (profile_id, key, value) rows."""
    keys = ["target_titles", "preferred_locations", "include_keywords", "remote_only", "include_remote"]
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys]
    retired = F.struct(F.lit("require_mark_as_applied").alias("key"), F.lit("x").alias("value"))
    alias = F.struct(F.lit("default_minimum_fit_score").alias("key"), F.lit(" nan ").alias("value"))
    return d.many_profiles(spark, sf_dir).select("profile_id", F.inline(F.array(*pairs, retired, alias)))


@query("S5_load_settings")
def _(spark, sf):
    wide = profiles.load_settings(settings_kv(spark, sf))
    return wide.select(
        "profile_id", "target_titles", "include_remote", "remote_only", "search_strategy", "default_min_fit_score",
        "default_jobs_per_page",
    )


@query("M7_append_artifact")
def _(spark, sf):
    base = snapshot(spark, sf)
    letters = table_rows(spark, sf).select(
        (F.col("l_orderkey")).alias("posting_id"), F.col("artifact_id"), F.concat(F.lit("/out/"), "artifact_id", F.lit(".txt")).alias("path")
    )
    return store.append_artifact(base, letters).select("posting_id", "artifact_path")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output records: one per (order, line) pair of lineitem."""
    lines = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.withColumn("artifact_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("S9_align_schema")
def _(spark, sf):
    rows = d.postings(spark, sf).withColumn("status", F.when(F.col("posting_id") % 2 == 0, F.lit("  ")).otherwise(F.col("workflow_status")))
    out = store.coerce_payload(rows, extra=["posting_id"])
    return out.select(
        "posting_id", "status", "source", "active_status", "parser_version", "source_type", "risk_flags", "duplicate_key",
        "canonical_job_posting_url", F.coalesce("fit_score", F.lit(-1.0)).alias("fit_score"),
    )


# --- endpoints -----------------------------------------------------------------------


def scored_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = ranking.active_endpoints(d.endpoints(spark, sf_dir), d.companies(spark, sf_dir))
    owned = active.withColumn("profile_id", (F.col("endpoint_id") % 5).cast("int"))
    return ranking.score_endpoints(owned.join(ranking.endpoint_profiles(d.profiles(spark, sf_dir)), "profile_id"))


@query("J1_active_endpoints")
def _(spark, sf):
    out = ranking.active_endpoints(d.endpoints(spark, sf), d.companies(spark, sf))
    return out.select("endpoint_id", "company_id", "company_name", "canonical_domain", "hq", "endpoint_url")


@query("C3_score_endpoints")
def _(spark, sf):
    return scored_endpoints(spark, sf).select(
        "endpoint_id", "profile_id", "vendor", "score", "seedable", "shape_priority", "vendor_priority", "preferred"
    )


@query("W5_select_endpoints")
def _(spark, sf):
    return ranking.select_endpoints(scored_endpoints(spark, sf)).select(
        "profile_id", "endpoint_id", "vendor", "score", "pass_no", "position"
    )


@query("W5_select_endpoints_by_score")
def _(spark, sf):
    return ranking.select_endpoints(scored_endpoints(spark, sf), mode="legacy", offset=5).select(
        "profile_id", "endpoint_id", "vendor", "score", "position"
    )


@query("W6_next_batch")
def _(spark, sf):
    scored = scored_endpoints(spark, sf)
    used = ranking.select_endpoints(scored, 5)
    kept = used.filter("profile_id = 1")
    return ranking.next_batch(scored, used, kept, 5).select("profile_id", "endpoint_id", "pass_no", "position")


@query("A17_vendor_mix")
def _(spark, sf):
    return metrics.vendor_mix(scored_endpoints(spark, sf), F.col("preferred"))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract records from the endpoints of all parts, with bad rows."""
    rows = d.endpoints(spark, sf_dir).join(d.companies(spark, sf_dir), "company_id")
    n = F.col("endpoint_id")
    return rows.select(
        n.alias("pos"),
        F.when(n % 13 == 0, F.lit(" ")).when(n % 4 == 0, F.concat(F.lit("New Co "), n % 50)).otherwise(F.col("name")).alias("company_name"),
        F.when(n % 4 == 0, F.concat(F.lit("NEW"), n % 50, F.lit(".com"))).otherwise(F.concat(F.lower(F.replace("name", F.lit("#"))), F.lit(".com"))).alias("canonical_company_domain"),
        F.col("endpoint_url").alias("careers_url"),
        F.when(n % 29 == 0, F.lit("weird")).otherwise(F.col("careers_url_status")).alias("careers_url_status"),
        F.col("review_status"),
        F.col("ats_vendor").alias("ats_provider"),
        F.when(n % 31 == 0, F.lit("high")).otherwise(F.col("confidence_score").cast("string")).alias("confidence_score"),
        F.lit("2026-01-01").alias("last_validated_at"),
        F.col("is_primary").cast("string").alias("is_primary_careers_url"),
        F.col("notes"),
    )


@query("F10_validate_contract_records")
def _(spark, sf):
    out = store.validate_contract_records(contract(spark, sf))
    return out.select("pos", "verdict", F.array_join("errors", "; ").alias("errors"))


@query("J4_resolve_company")
def _(spark, sf):
    out = store.resolve_company(contract(spark, sf), d.companies(spark, sf))
    return out.select("pos", F.coalesce("company_id", F.lit(-1)).alias("company_id"))


@query("M5_import_endpoints")
def _(spark, sf):
    known = d.endpoints(spark, sf).filter("endpoint_id % 3 = 0").drop("active").withColumn("active", F.lit(1))
    return store.import_endpoints(d.companies(spark, sf), known, contract(spark, sf)).summary


@query("M5_imported_endpoints")
def _(spark, sf):
    known = d.endpoints(spark, sf).filter("endpoint_id % 3 = 0")
    out = store.import_endpoints(d.companies(spark, sf), known, contract(spark, sf)).endpoints
    return out.select(
        "company_id", "endpoint_url", "endpoint_id", "ats_vendor", F.coalesce("extraction_method", F.lit("")).alias("extraction_method"),
        "review_status", "active", "confidence_score",
    )


@query("M5_imported_companies")
def _(spark, sf):
    known = d.endpoints(spark, sf).filter("endpoint_id % 3 = 0")
    out = store.import_endpoints(d.companies(spark, sf), known, contract(spark, sf)).companies
    return out.select("company_id", "name", "canonical_domain", F.coalesce("hq", F.lit("")).alias("hq"), F.coalesce("company_active", F.lit(-1)).alias("company_active"))


@query("U3_registry_delta")
def _(spark, sf):
    endpoints = d.endpoints(spark, sf)
    missing, _ = ranking.registry_delta(contract(spark, sf).withColumnRenamed("careers_url", "endpoint_url"), endpoints.filter("endpoint_id % 7 = 0"), ["endpoint_url"])
    return missing.select("pos", "endpoint_url")


@query("U3_registry_delta_count")
def _(spark, sf):
    return ranking.registry_delta(contract(spark, sf).withColumnRenamed("careers_url", "endpoint_url"), d.endpoints(spark, sf).filter("endpoint_id % 7 = 0"), ["endpoint_url"])[1]


# --- registry ranking and review -------------------------------------------------------


def ranked_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources per host, plus one per customer so that there are many."""
    return ranking.source_priority(registry(spark, sf_dir))


@query("C2_source_priority")
def _(spark, sf):
    return ranked_registry(spark, sf).select("source_key", "priority_score", "notes")


@query("A9_registry_mix")
def _(spark, sf):
    return metrics.registry_mix(registry(spark, sf), ["source_trust", "source_type", "ats_type", "hostname"], 5)


@query("A9_root_rollup")
def _(spark, sf):
    return metrics.root_rollup(ranked_registry(spark, sf))


@query("O3_top_bottom_sources")
def _(spark, sf):
    return ranking.top_bottom_sources(ranked_registry(spark, sf)).select("side", "source_key", "priority_score")


@query("O4_low_yield")
def _(spark, sf):
    weak = ranked_registry(spark, sf).withColumn("matching_job_count", F.col("matching_job_count") % 4)
    return ranking.low_yield(weak, 10).select("source_key", "seen_count", "matching_job_count")


@query("W8_split_and_cap_sources")
def _(spark, sf):
    out = ranking.split_and_cap_sources(ranked_registry(spark, sf), {"Lever": (10, 5), "Unknown": (25, 15)})
    return out.select("ats_type", "source_root", "strong", "kept", "rank_in_class")


@query("W7_capped_scan")
def _(spark, sf):
    rows = d.postings(spark, sf)
    words = F.lower("title")
    gates_ = {"title": words.contains("vice") | words.contains("director") | words.contains("head"), "location": ~F.lower("location").contains("canada")}
    return ranking.capped_scan(rows, "company", 2, "posting_id", gates_, "job_posting_url")[1]


@query("W7_capped_scan_kept")
def _(spark, sf):
    words = F.lower("title")
    gates_ = {"title": words.contains("vice") | words.contains("director") | words.contains("head"), "location": ~F.lower("location").contains("canada")}
    return ranking.capped_scan(d.postings(spark, sf), "company", 2, "posting_id", gates_, "job_posting_url")[0].select("company", "posting_id", "job_posting_url")


@query("W7_wide_cap")
def _(spark, sf):
    """A cap of 3,000 rows a group, in groups of a fifth of the table each."""
    rows = d.postings(spark, sf)
    return ordered.top_n(rows, ["profile_id"], [F.desc_nulls_last("fit_score"), F.asc("posting_id")], 3000, rank="place").select("profile_id", "posting_id", F.col("place").cast("long").alias("place"))


@query("W7_cap_per_group")
def _(spark, sf):
    out = ranking.cap_per_group(d.postings(spark, sf), "company", 2, [F.asc("posting_id")])
    return out.select("posting_id", "company")


@query("W9_latest_per_key")
def _(spark, sf):
    out = ranking.latest_per_key(d.url_observations(spark, sf), ["profile_id", "provider"], [F.desc("run_id"), F.desc("obs_id")], 3)
    return out.select("profile_id", "provider", "run_id", "obs_id")


@query("W10_label_latest_run")
def _(spark, sf):
    rows = d.postings(spark, sf).withColumn("seen_count", F.col("posting_id") % 3)
    runs = rows.select(F.col("last_seen_run_id").alias("run_id"))
    return ranking.label_latest_run(rows, runs).select("posting_id", "discovery_state")


@query("W12_page")
def _(spark, sf):
    rows = ranking.open_list(d.postings(spark, sf))
    return ranking.page(rows, ranking.open_order(), 25, 3).select("posting_id", "row_no", "page_no", "total_rows", "total_pages")


@query("W12_last_page")
def _(spark, sf):
    rows = ranking.open_list(d.postings(spark, sf))
    return ranking.page(rows, ranking.open_order(), 25, 1_000_000_000).select("posting_id", "row_no", "page_no", "total_rows", "total_pages")


@query("W13_new_per_tier")
def _(spark, sf):
    seen = d.url_observations(spark, sf).withColumn("tier", (F.col("obs_id") % 6).cast("int"))
    found = seen.withColumn("url", urls.canonical(F.col("raw_url")))
    return ranking.new_per_tier(found, "tier", "url")


def _sorted_top(spark, sf, mode):
    rows = enriched(spark, sf).withColumn("date_found", F.date_format("first_seen_at", "yyyy-MM-dd"))
    open_rows = ranking.open_list(rows)
    return open_rows.orderBy(*ranking.review_order(mode, ranking.open_order())).limit(100).select("posting_id", "company", "title")


for _mode in ["Newest First", "Highest Compensation", "Highest Source Trust", "Company A-Z", "Highest Fit Score"]:
    QUERIES["O1_review_sort_" + _mode.lower().replace(" ", "_").replace("-", "_")] = (
        lambda spark, sf, m=_mode: _sorted_top(spark, sf, m)
    )


@query("O2_open_list")
def _(spark, sf):
    return ranking.open_list(d.postings(spark, sf)).select("posting_id", "display_title", F.coalesce("fit_score", F.lit(-1.0)).alias("fit_score"))


@query("O2_applied_list")
def _(spark, sf):
    n = F.col("posting_id") % 4
    rows = d.postings(spark, sf).withColumn(
        "applied_date",
        F.when(n == 0, F.date_format("first_seen_at", "yyyy-MM-dd")).when(n == 1, F.date_format("first_seen_at", "MM/dd/yyyy"))
        .when(n == 2, F.date_format("first_seen_at", "yyyy/MM/dd")).otherwise(F.lit("soon")),
    )
    out = ranking.applied_list(rows, F.lit("1999-01-01").cast("date"))
    return out.select("posting_id", "applied_date", F.coalesce("days_ago", F.lit(-1)).alias("days_ago"))


# --- profiles and planned queries ----------------------------------------------------


@query("W11_plan_queries")
def _(spark, sf):
    return planning.plan_queries(d.many_profiles(spark, sf))


def grouped_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with title-group JSON: good, broken, or none."""
    good = F.concat(
        F.lit('[{"main_title": "VP  of IT", "variants": [{"title": "Head of IT"}, {"title": "vp of it"}, {"title": "CIO", "selected": false},'
              ' {"title": "head of it"}]}, {"main_title": ""}, {"main_title": "vp of IT"}, {"main_title": "Kind '),
        (F.col("profile_id") % 7).cast("string"), F.lit('"}]'),
    )
    kind = F.col("profile_id") % 3
    return d.many_profiles(spark, sf_dir).withColumn(
        "target_title_groups", F.when(kind == 0, good).when(kind == 1, F.lit('[{"main_title": ')).otherwise(F.lit(""))
    )


@query("J15_expand_title_groups")
def _(spark, sf):
    return profiles.expand_title_groups(grouped_profiles(spark, sf))


@query("J15_effective_titles")
def _(spark, sf):
    out = profiles.effective_titles(grouped_profiles(spark, sf))
    return out.select("profile_id", F.array_join("effective", "; ").alias("effective"), F.array_join("search", "; ").alias("search"))


def _suggested(spark, sf, heads):
    mains = d.many_profiles(spark, sf).select("profile_id", F.explode(split_titles(F.col("target_titles"))).alias("main_title"))
    named = F.array(*[F.concat(F.lit(h), "main_title") for h in heads])
    return mains.select("profile_id", "main_title", F.posexplode(named).alias("pos", "title"))


@query("J13_merge_variants")
def _(spark, sf):
    wanted = _suggested(spark, sf, ["Senior ", "Lead ", "", "senior  ", "Interim ", "Acting "])
    old = wanted.filter("pos IN (0, 4)").select(
        "profile_id", "main_title", "title", ((F.col("pos") == 4) | (F.col("profile_id") % 2 == 0)).alias("selected")
    )
    return profiles.merge_variants(old, wanted).select("profile_id", "main_title", "title", "selected")


@query("C7_close_variants")
def _(spark, sf):
    heads = ["Director, ", "Vice Pres ", "", "Senior ", "senior  ", "Head of ", "Acting "]
    return profiles.close_variants(_suggested(spark, sf, heads)).select("profile_id", "main_title", "title")


# --- pages ---------------------------------------------------------------------------


@query("X1_extract_links")
def _(spark, sf):
    return pages.extract_links(d.table(spark, sf, "pages")).select("page_id", "pos", "href", "url")


def board_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages as company boards with posting links on top."""
    n = F.col("page_id")
    link = lambda href, text: F.concat(F.lit('<a class="x" href="'), href, F.lit('">'), text, F.lit("</a>"))
    head = F.concat(
        link(F.concat(F.lit("/org"), n % 40, F.lit("/"), n), F.lit("VP of <b>IT</b>")),
        link(F.concat(F.lit("https://boards.greenhouse.io/org/jobs/"), n), F.lit("Data Analyst &amp; more")),
        link(F.concat(F.lit("https://boards.greenhouse.io/org/jobs/"), n), F.lit("Data Analyst again")),
        link(F.lit("../about"), F.lit("VP of IT")),
    )
    board = F.concat(F.lit("https://jobs.lever.co/org"), n % 40)
    return d.table(spark, sf_dir, "pages").select(
        "page_id", (n % 5).cast("int").alias("profile_id"), board.alias("url"), F.concat(head, "html").alias("html")
    )


@query("X1_posting_links")
def _(spark, sf):
    rows = matching.with_profile(board_pages(spark, sf), d.profiles(spark, sf))
    return pages.posting_links(rows)


@query("X2_extract_page_fields")
def _(spark, sf):
    out = pages.extract_page_fields(d.table(spark, sf, "pages"))
    return out.select("page_id", "title", F.length("text").alias("text_length"))


def formed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages that say title, place and firm in five ways: labels, meta tags, the URL, a title and a line, JSON-LD."""
    n, c = F.col("page_id"), F.concat
    forms = [
        c(F.lit("<title>Job Application for Data Head "), n % 7, F.lit(" at Blue Labs</title><h1>Data Head "), n % 7, F.lit('</h1><span class="job-location">Denver, CO</span>')),
        c(F.lit('<meta property="og:site_name" content="Site Nine"><meta name="keywords" content="jobs in Boston, MA now"><h1></h1><title></title><meta content="Og Title '), n % 5, F.lit('" property="og:title">')),
        F.lit("<title></title><h1> </h1>"),
        c(F.lit("<h1>Chief &amp; Data "), n % 3, F.lit("</h1><title>Chief | Green Farm</title><p>Primary Location: Chicago, IL | x</p>")),
        c(
            F.lit('<h1></h1><title></title><script type="application/ld+json">{"title": "Ld Title '), n % 9,
            F.lit('", "hiringOrganization": {"name": "Ld Works"}, "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}}}</script>'),
        ),
    ]
    head = F.get(F.array(*forms), (n % 5).cast("int"))
    where = F.when(n % 5 == 2, F.lit("https://acme.wd5.myworkdayjobs.com/en-US/External/job/Dallas-TX/VP-of-Data_R5")).otherwise(F.lit("https://pages.example.org/a"))
    return d.table(spark, sf_dir, "pages").select("page_id", where.alias("url"), F.concat(head, "html").alias("html"))


@query("X2_page_fields_by_form")
def _(spark, sf):
    return pages.extract_page_fields(formed_pages(spark, sf)).select("page_id", "title", "page_location", "page_company")


@query("X3_build_postings")
def _(spark, sf):
    return parsed_pages(spark, sf).select(
        "page_id", "company", "ats_type", "role_family", "compensation_raw", "compensation_status", "status"
    )


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages with a title, pay line and place of their own."""
    n = F.col("page_id")
    head = F.concat(
        F.lit("<title>Careers</title><h1>VP &amp; Head "), n % 9, F.lit("</h1><div class='job-location'>Location: Plano, TX | x</div><p>Salary Range: $"),
        (n % 7 + 1) * 50000, F.lit(" - $"), (n % 7 + 2) * 50000, F.lit("</p>"),
        F.when(n % 10 == 0, F.lit("<p>This job is no longer available.</p><p>Search for jobs</p>")).otherwise(F.lit("")),
    )
    where = F.when(n % 3 == 0, F.concat(F.lit("https://jobs.lever.co/acme-labs-"), n % 40, F.lit("/x"))).when(
        n % 3 == 1, F.concat(F.lit("https://brightsystems.wd5.myworkdayjobs.com/en-US/External/job/Dallas-TX/VP_R"), n)
    ).otherwise(F.col("url"))
    rows = d.table(spark, sf_dir, "pages").select("page_id", where.alias("url"), F.concat(head, "html").alias("html"))
    return pages.build_postings(rows)


@query("C6_rough_fit")
def _(spark, sf):
    rows = d.postings(spark, sf).select(
        "posting_id", "title", "location", "job_posting_url", "ats_type", titles.role_family(F.col("title")).alias("role_family"),
        F.concat_ws(" ", "title", "location", "company", "compensation_raw").alias("text"),
    )
    return pages.rough_fit(rows).select("posting_id", "fit_score", "fit_tier", "match_rationale")


@query("F14_expired_pages")
def _(spark, sf):
    n = F.col("page_id")
    tail = F.when(n % 3 == 0, F.lit("<p>The page you are looking for doesn&#39;t exist.</p>")).otherwise(F.lit(""))
    more = F.when(n % 6 == 0, F.lit("<a href='/'>Search for <b>Jobs</b></a>")).otherwise(F.lit(""))
    rows = d.table(spark, sf, "pages").select(
        "page_id", "url", F.concat("html", tail, more).alias("html"), F.when(n % 11 == 0, 404).otherwise(200).alias("status")
    )
    rows = rows.withColumn("url", F.when(n % 2 == 0, F.lit("https://jobs.lever.co/a/b")).otherwise(F.col("url")))
    return pages.expired_pages(rows).select("page_id", "expired", "expired_reason")


@query("J12_resolve_gateways")
def _(spark, sf):
    n = F.col("page_id")
    link = F.concat(F.lit('<a href="https://jobs.lever.co/org'), n % 40, F.lit("/"), n, F.lit('/apply/">x</a>'))
    crawled = d.table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("https://www.linkedin.com/jobs/view/"), F.lit(100000) + n, F.lit("/")).alias("url"),
        F.when(n % 3 > 0, F.concat("html", link)).otherwise(F.col("html")).alias("html"),
    )
    out = pages.resolve_gateways(d.url_observations(spark, sf), crawled)
    return out.select("obs_id", "resolved_url", "resolve_reason")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON feed pages of twenty postings each, one profile per endpoint."""
    page = F.floor(F.col("posting_id") / 20).cast("long")
    entry = F.struct(
        F.col("title"), F.col("location").alias("locationsText"), F.concat(F.lit("/job/"), F.col("posting_id") % 10).alias("externalPath"),
        F.col("posting_id").alias("n"),
    )
    body = d.postings(spark, sf_dir).groupBy(page.alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("posting_id", entry.alias("e")))).alias("s"))
    rows = body.select(
        (F.col("page_no") % 50).alias("endpoint_id"), (F.col("page_no") % 50 % 5).cast("int").alias("profile_id"),
        F.concat(F.lit("https://org"), F.col("page_no") % 50, F.lit(".wd1.myworkdayjobs.com/External/login")).alias("endpoint_url"),
        (F.col("page_no") % 2 + 1).alias("pass_no"), "page_no",
        F.to_json(F.struct(F.lit(20).alias("total"), F.transform("s", lambda x: x["e"]).alias("jobPostings"))).alias("body"),
    )
    return matching.with_profile(rows, d.profiles(spark, sf_dir))


@query("X4_flatten_feed")
def _(spark, sf):
    rows = pages.feed_rows(feed(spark, sf)).select("endpoint_id", "pass_no", "page_no", "pos", "title_ok", "place_ok", "detail_url")
    return pages.flatten_feed(rows).select("endpoint_id", "pass_no", "page_no", "pos", "detail_url")


@query("A18_seed_scan_summary")
def _(spark, sf):
    rows = pages.feed_rows(feed(spark, sf)).select("endpoint_id", "title_ok", "place_ok")
    selection = ranking.select_endpoints(scored_endpoints(spark, sf)).select("profile_id", "endpoint_id", F.col("seedable").alias("supported"))
    return metrics.seed_scan_summary(selection, rows).select(
        "profile_id", "endpoint_id", "supported", "found", "kept", "title_skipped", "place_skipped"
    )


@query("A18_seed_run_totals")
def _(spark, sf):
    rows = pages.feed_rows(feed(spark, sf)).select("endpoint_id", "title_ok", "place_ok")
    selection = ranking.select_endpoints(scored_endpoints(spark, sf)).select("profile_id", "endpoint_id", F.col("seedable").alias("supported"))
    return metrics.seed_run_totals(metrics.seed_scan_summary(selection, rows))


@query("X5_parse_delimited_feed")
def _(spark, sf):
    n, sep = (F.col("posting_id") + 10000).cast("string"), "!|!"
    title = F.when(F.col("title") == "", F.lit("None given")).otherwise(F.replace("title", F.lit("&"), F.lit("&amp;")))
    place = F.when(F.col("location") == "", F.lit("-")).otherwise(F.col("location"))
    group = F.concat_ws(sep, n, title, n, title, n, n, n, n, n, place, F.lit("false"), F.lit(""), F.lit(""), F.lit(""), F.lit(""),
                        F.lit("a"), F.lit("b"), F.lit("1"), F.lit("Apply"), F.lit(""))
    page = F.floor(F.col("posting_id") / 20).cast("long")
    body = d.postings(spark, sf).groupBy(page.alias("endpoint_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posting_id", group.alias("g")))), lambda x: x["g"]), "~").alias("body")
    )
    rows = body.withColumns(
        {
            "profile_id": (F.col("endpoint_id") % 5).cast("int"),
            "endpoint_url": F.lit("https://a.taleo.net/careersection/2/jobsearch.ftl?lang=en"),
        }
    )
    out = pages.parse_delimited_feed(matching.with_profile(rows, d.profiles(spark, sf)))
    return out.select("endpoint_id", "job_id", "title", "location", "detail_url")


@query("X6_refresh_diff")
def _(spark, sf):
    return _diff(spark, sf).select("posting_id", F.array_join("notes", "; ").alias("notes"), "changed")


@query("X6_refresh_counts")
def _(spark, sf):
    return pages.refresh_counts(_diff(spark, sf))


def _diff(spark, sf):
    old = d.postings(spark, sf).withColumn("compensation_status", pay.status_of_raw(F.col("compensation_raw")))
    n = F.col("posting_id")
    new = old.withColumns(
        {
            "title": F.when(n % 3 == 0, F.lit("")).when(n % 5 == 0, F.upper("title")).otherwise(F.col("title")),
            "compensation_raw": F.when(n % 4 == 0, F.lit("$1 - $2")).otherwise(F.col("compensation_raw")),
        }
    )
    return pages.refresh_diff(old, new, ["company", "title", "location", "compensation_raw", "compensation_status"])


# --- model results and reports ----------------------------------------------------------


def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers for postings, with their profile's levels."""
    rows = d.model_results(spark, sf_dir).withColumn("posting_id", F.col("result_id"))
    named = rows.join(d.postings(spark, sf_dir).select("posting_id", "title"), "posting_id")
    return results.normalise_scores(matching.with_profile(named.withColumn("profile_id", (F.col("posting_id") % 5).cast("int")), d.profiles(spark, sf_dir)))


@query("C4_normalise_scores")
def _(spark, sf):
    return scored_results(spark, sf).select(
        "posting_id", "status", "fit_score", "fit_label", "recommended_action", "confidence", "match_rationale", "risk_flags", "application_angle"
    )


@query("C5_apply_corrections")
def _(spark, sf):
    rows = enriched(spark, sf).withColumns(
        {
            "description_text": F.when(F.col("posting_id") % 7 == 0, F.lit("")).otherwise(F.lit("days per week")),
            "normalized_title": F.lower("title"), "remote_type": F.lit("Other"), "dallas_dfw_match": F.lit("No"),
            "risk_flags": F.lit("one; two"), "ai_priority": F.when(F.col("posting_id") % 2 == 0, "Apply").otherwise("Hold"),
        }
    )
    n = F.col("posting_id")
    fixes = rows.select(
        "posting_id", F.when(n % 3 == 0, "clean").when(n % 3 == 1, "Reject").otherwise("odd").alias("scrub_status"),
        F.array(F.lit("two"), F.lit(" three ")).alias("scrub_flags"), F.when(n % 4 == 0, F.lit("Fixed Title")).otherwise(F.lit("")).alias("corrected_title"),
        F.lit("").alias("corrected_company"), F.when(n % 6 == 0, F.lit("Plano, TX")).otherwise(F.lit("")).alias("corrected_location"),
        F.lit("").alias("corrected_compensation_raw"), F.when(n % 5 == 0, "low").otherwise("HIGH").alias("correction_confidence"),
        F.array().cast("array<string>").alias("correction_notes"),
    )
    return results.apply_corrections(rows, fixes).select(
        "posting_id", "title", "location", "duplicate_key", "normalized_title", "remote_type", "dallas_dfw_match", "risk_flags", "ai_priority"
    )


@query("A12_profile_scoreboard")
def _(spark, sf):
    return metrics.profile_scoreboard(scored_results(spark, sf).withColumn("profile_id", (F.col("posting_id") % 5).cast("int")))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = d.table(spark, sf_dir, "labels")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    cases = labels.select(
        F.col("doc_id").alias("case_id"), F.when(good & toxic, "maybe").when(good, "yes").otherwise("no").alias("expected_label")
    )
    said = F.when(F.col("doc_id") % 3 == 0, "no").when(F.col("doc_id") % 3 == 1, "maybe").otherwise("yes")
    other = F.when(F.col("doc_id") % 13 == 0, F.lit("skipped")).when(F.col("doc_id") % 2 == 0, "yes").otherwise("no")
    votes = labels.select(
        F.col("doc_id").alias("case_id"),
        F.inline(F.array(F.struct(F.lit("qualifier").alias("scorer"), said.alias("predicted_label")), F.struct(F.lit("model").alias("scorer"), other.alias("predicted_label")))),
    )
    return metrics.calibration_rows(cases, votes)


@query("A13_calibration_report")
def _(spark, sf):
    return metrics.calibration_report(calibration(spark, sf))


@query("A13_calibration_cross")
def _(spark, sf):
    return metrics.calibration_cross(calibration(spark, sf))


def reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reports per profile, provider and mode, and their URLs as rows."""
    seen = gates.classify_source_url(gates.url_quality_gate(d.url_observations(spark, sf_dir)))
    skip = (
        F.when(F.col("gate_reason") == "greenhouse_detail", F.lit("stale_ats_posting"))
        .when(F.col("gate_reason") == "workday_detail", F.lit("parse_failed"))
        .when(F.col("gate_reason") == "blocked_generic_host", F.lit("weak_url_title_match"))
        .when(~F.col("is_posting_url"), F.lit("non_job_url"))
    )
    mode = F.when(F.col("obs_id") % 2 == 0, F.lit("legacy")).otherwise(F.lit("next_gen"))
    rows = seen.select(
        F.concat_ws("-", "profile_id", "provider", mode).alias("report_id"), F.concat(F.lit("g"), "profile_id").alias("group"),
        F.col("provider").alias("variant"), mode.alias("mode"), skip.alias("skip"), "keep", "class_reason", "raw_url", "obs_id",
    )
    rows = cut(rows)
    id_columns = ["report_id", "group", "variant", "mode"]
    base = rows.groupBy(*id_columns).agg(F.count(F.lit(1)).alias("seen_urls"), F.count_if(F.col("skip").isNull()).alias("accepted_jobs"), F.max("obs_id").alias("created"))
    counts = lambda df, column: df.groupBy("report_id", column).agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda df, column, name: df.groupBy("report_id").agg(
        F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(name)
    )
    skips = as_map(counts(rows.filter("skip IS NOT NULL"), "skip"), "skip", "skip_summary")
    drops = as_map(counts(rows.filter("NOT keep"), "class_reason"), "class_reason", "dropped")
    full = base.join(skips, "report_id", "left").join(drops, "report_id", "left")
    full = full.withColumn("drop_summary", F.create_map(F.col("variant"), "dropped")).drop("dropped")
    return full, rows.filter("raw_url <> ''").select("report_id", "group", "variant", "mode", F.lower("raw_url").alias("url"))


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    full, links = reports(spark, sf_dir)
    return cut(metrics.case_metrics(full, links)), links


@query("A2_flatten_drop_counts")
def _(spark, sf):
    return metrics.flatten_drop_counts(reports(spark, sf)[0])


@query("A14_case_metrics")
def _(spark, sf):
    return cases(spark, sf)[0].select(
        "report_id", "seen_urls", "accepted_jobs", "acceptance_pct", "broken_url_count", "blocked_domain_drop_count",
        "weak_title_match_count", "duplicate_count", "url_count", "domain_count",
    )


@query("A10_variant_overlap")
def _(spark, sf):
    rows, links = cases(spark, sf)
    return metrics.variant_overlap(_by_mode(rows), _by_mode(links))


def _by_mode(rows: DataFrame) -> DataFrame:
    """Groups of one mode each: the variants of a group are compared within a mode."""
    return rows.withColumn("group", F.concat_ws("/", "group", "mode"))


@query("A11_benchmark_overall")
def _(spark, sf):
    rows, links = cases(spark, sf)
    return metrics.benchmark_overall(rows, metrics.variant_overlap(_by_mode(rows), _by_mode(links)))


@query("J9_compare_reports")
def _(spark, sf):
    rows = cases(spark, sf)[0]
    key = ["group", "variant"]
    old = rows.filter("mode = 'legacy' AND variant <> 'search'")
    return ranking.compare_reports(old, rows.filter("mode = 'next_gen'"), key, ["url_count", "accepted_jobs", "broken_url_count"])


@query("J10_pair_modes")
def _(spark, sf):
    rows = cases(spark, sf)[0].withColumn("title", F.concat_ws("/", "group", "variant"))
    return ranking.pair_modes(rows, ["legacy", "next_gen"], ["url_count", "accepted_jobs"], "created")


@query("U2_url_set_algebra")
def _(spark, sf):
    links = reports(spark, sf)[1]
    return ranking.url_set_algebra(links.filter("mode = 'legacy'"), links.filter("mode = 'next_gen'"))


# --- files ---------------------------------------------------------------------------


@query("S1_S7_url_list_round_trip")
def _(spark, sf):
    path = scratch(spark)
    files.write_ranked_list(d.table(spark, sf, "pages"), "url", [F.asc("page_id")], path)
    return files.read_url_list(spark, path).select("url")


@query("S6_append_run_ledger")
def _(spark, sf):
    seen, root = d.url_observations(spark, sf), scratch(spark)
    summary = seen.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_seen"), F.count_if(F.col("provider") == "search").cast("string").alias("search")
    )
    files.append_run_ledger(summary, seen.select("run_id", "obs_id", "raw_url"), root, ["search"])
    runs = spark.read.parquet(f"{root}/runs")
    extra = summary.select("run_id", F.lit("mode").alias("key"), F.lit("legacy").alias("value"))
    merged = files.merge_run_details(runs, extra)
    items = spark.read.parquet(f"{root}/run_items").groupBy("run_id").agg(F.count(F.lit(1)).alias("items"))
    field = lambda k: F.get_json_object("details_json", f"$.{k}").alias(k)
    return merged.join(items, "run_id").select("run_id", "total_seen", "items", field("search"), field("mode"))


@query("S8_write_report")
def _(spark, sf):
    path = scratch(spark)
    report = metrics.run_quality(gated_observations(spark, sf), "obs_id")
    files.write_report(report, ["run_id", "seen", "accepted", "dominant_reason"], path, "csv")
    return spark.read.schema("run_id int, seen long, accepted long, dominant_reason string").option("header", True).csv(path)


def _json_file(rows: DataFrame, head: str, tail: str, path: str) -> None:
    """One JSON text: the objects (`pos` in order) between a head and a tail."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(-1, head), (1 << 62, tail)], "pos long, value string")
    last = rows.agg(F.max("pos").alias("_last"))
    lines = rows.join(F.broadcast(last), F.lit(True)).select("pos", F.concat("value", F.when(F.col("pos") < F.col("_last"), F.lit(",")).otherwise(F.lit(""))).alias("value"))
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


@query("S2_endpoint_contract")
def _(spark, sf):
    root = scratch(spark)
    rows = contract(spark, sf)
    fields = [c for c in rows.columns if c != "pos"]
    for part, test in (("a", "pos % 2 = 0"), ("b", "pos % 2 = 1")):
        _json_file(rows.filter(test).select("pos", F.to_json(F.struct(*fields)).alias("value")), '{"schema_version": "1.0", "records": [', "]}", f"{root}/{part}")
    read = files.read_endpoint_contract(spark, [f"{root}/a", f"{root}/b"])
    return read.select("pos", "company_name", "careers_url", "confidence_score", "notes")


@query("S3_labelled_cases")
def _(spark, sf):
    root = scratch(spark)
    label = F.when(F.col("quality") == 1, F.lit("yes")).otherwise(F.lit("no"))
    rows = d.table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.to_json(F.struct(F.col("doc_id").alias("id"), label.alias("expected_label"), F.lit('a "}{" title').alias("title"))).alias("value"))
    _json_file(rows.unionByName(spark.createDataFrame([(-1, "7,")], "pos long, value string")).withColumn("value", F.when(F.col("pos") < 0, F.lit("7")).otherwise(F.col("value"))), "[", "]", f"{root}/cases.json")
    return files.read_labelled_cases(spark, f"{root}/cases.json").select("id", "expected_label", "title")


STREAMED = "pos long, company string, title string, location string, job_posting_url string, ats_type string, source_trust string, source_type string, source_detail string, fit_score string, duplicate_key string"


@query("Z1_ingest_runs")
def _(spark, sf):
    """Events as two files of postings, streamed as two runs into an empty store; the ledger they leave."""
    root = scratch(spark)
    seen = d.table(spark, sf, "events")
    who = F.concat(F.lit("u"), "user_id", F.lit(" "), "event_type")
    blank = F.lit("")
    rows = seen.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("Co "), F.col("user_id") % 40).alias("company"), F.col("event_type").alias("title"), blank.alias("location"),
        F.concat(F.lit("https://jobs.lever.co/org"), F.col("user_id") % 40, F.lit("/"), F.col("user_id"), F.lit("-"), "event_type").alias("job_posting_url"),
        F.lit("Lever").alias("ats_type"), blank.alias("source_trust"), blank.alias("source_type"), blank.alias("source_detail"), F.lit("70").alias("fit_score"), who.alias("duplicate_key"), F.floor((F.dayofmonth("ts") - 1) / 16).alias("run"),
    )
    rows = cut(rows)
    gone = rows.filter("title = 'purchase' OR pos % 1000 = 7").select(trust.stored_key(F.col("duplicate_key")).alias("duplicate_key")).distinct()
    stones = gone.select(blank.alias("removed_date"), "duplicate_key", *[blank.alias(c) for c in ("company", "title", "location", "job_posting_url", "removal_reason")])
    empty = snapshot(spark, sf).limit(0)
    ingest.start_store(empty, stones, f"{root}/store", 16)
    for run in range(2):
        rows.filter(F.col("run") == run).drop("run").coalesce(1).write.mode("append").parquet(f"{root}/in")
    ingest.incremental_ingest(spark, f"{root}/in", STREAMED, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    field = lambda k: F.get_json_object("details_json", f"$.{k}").cast("long").alias(k)
    ledger = spark.read.parquet(f"{root}/store/runs").select(
        "run_id", "status", "total_seen", "inserted_count", "updated_count", "skipped_removed_count", field("net_new_count"), field("rediscovered_count"), field("dropped_duplicates")
    )
    items = spark.read.parquet(f"{root}/store/run_items").groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("job_id").alias("postings"))
    return ledger.join(items, "run_id")
