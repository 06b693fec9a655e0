"""The posting store as snapshot jobs.

A table is never changed in place: each job reads a snapshot and returns the
next one, which sources.snapshots publishes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import trust, urls
from ..functions.text import clean, or_default, to_float
from . import chains
from .lineage import cut
from .ordered import top_n

# The ingest columns, and defaults for blank ones.
PAYLOAD_COLUMNS = [
    "date_found",
    "date_last_validated",
    "company",
    "title",
    "role_family",
    "normalized_title",
    "location",
    "remote_type",
    "dallas_dfw_match",
    "company_careers_url",
    "job_posting_url",
    "ats_type",
    "requisition_id",
    "source",
    "source_type",
    "source_trust",
    "source_detail",
    "parser_version",
    "compensation_raw",
    "compensation_status",
    "validation_status",
    "validation_confidence",
    "fit_score",
    "fit_tier",
    "ai_priority",
    "match_rationale",
    "risk_flags",
    "application_angle",
    "cover_letter_starter",
    "status",
    "duplicate_key",
    "active_status",
]
PAYLOAD_DEFAULTS = {
    "status": "New",
    "active_status": "Active",
    "source": "Local Pipeline",
    "parser_version": "rolesift_v1",
}
SOURCE_COLUMNS = ["source_type", "source_trust", "source_detail"]
# Overwritten on update: everything but the first date and source standing.
UPDATED_COLUMNS = [c for c in PAYLOAD_COLUMNS if c not in ("date_found", *SOURCE_COLUMNS)] + ["canonical_job_posting_url"]
STORE_COLUMNS = {
    "workflow_status": "string",
    "applied_date": "string",
    "first_seen_at": "timestamp",
    "last_seen_at": "timestamp",
    "last_seen_run_id": "long",
    "seen_count": "long",
    "last_page_refresh_at": "timestamp",
    "last_score_refresh_at": "timestamp",
    "last_refresh_status": "string",
    "updated_at": "timestamp",
}


def align_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, str] | None = None) -> DataFrame:
    """Exactly the schema's columns; missing or blank ones get defaults.

    Text is trimmed with '' for missing; other types are cast, NULL if not
    castable. Unknown input columns are dropped.
    """
    defaults = defaults or {}

    def value(field: T.StructField) -> Column:
        default = defaults.get(field.name, "")
        if isinstance(field.dataType, T.StringType):
            return or_default(F.col(field.name), default) if field.name in df.columns else F.lit(default)
        if field.name not in df.columns:
            return F.lit(defaults.get(field.name)).cast(field.dataType)
        return F.col(field.name).try_cast(field.dataType)

    return df.select(*[value(f).alias(f.name) for f in schema.fields])


def coerce_payload(batch: DataFrame, extra: Sequence[str] = ("pos",)) -> DataFrame:
    """The 32 ingest columns with defaults, canonical URL and final key."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in PAYLOAD_COLUMNS if c != "fit_score"])
    base = batch if "fit_score" in batch.columns else batch.withColumn("fit_score", F.lit(None).cast("double"))
    kept = {c: F.col(c) for c in extra}
    text = {
        f.name: (or_default(F.col(f.name), PAYLOAD_DEFAULTS.get(f.name, "")) if f.name in base.columns
                 else F.lit(PAYLOAD_DEFAULTS.get(f.name, "")))
        for f in schema.fields
    }
    out = base.select(
        *[c.alias(k) for k, c in kept.items()],
        *[c.alias(k) for k, c in text.items()],
        to_float(F.col("fit_score")).alias("fit_score"),
    )
    own = trust.stored_key(F.col("duplicate_key"))
    named = [F.col(c) for c in ("company", "title", "location", "ats_type", "requisition_id", "job_posting_url")]
    return out.withColumns(
        {
            "canonical_job_posting_url": urls.canonical(F.col("job_posting_url")),
            "duplicate_key": F.coalesce(F.nullif(own, F.lit("")), trust.fallback_key(*named)),
        }
    )


def drop_tombstoned(rows: DataFrame, removed: DataFrame, key: str = "duplicate_key") -> tuple[DataFrame, DataFrame]:
    """(rows to go on with, rows whose key is tombstoned)."""
    gone = removed.select(key).filter(F.col(key) != "").distinct()
    keyed = F.coalesce(F.col(key) != "", F.lit(False))
    # Rows without a key go round the join, where they would meet in one task.
    live = rows.filter(keyed).join(gone, key, "left_anti").unionByName(rows.filter(~keyed))
    return live, rows.filter(keyed).join(gone, key, "left_semi")


def resolve_existing(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot id each row matches, by key, canonical, then raw URL.

    Rows are resolved per distinct identity, so a hot key is looked up once.
    """
    identity = ["duplicate_key", "canonical_job_posting_url", "job_posting_url"]
    ids = batch.select(*identity).distinct()
    for column in identity:
        side = snapshot.filter(F.col(column) != "").groupBy(column).agg(F.min("posting_id").alias(f"_by_{column}"))
        ids = ids.join(side, column, "left")
    return ids.select(*identity, F.coalesce(*[f"_by_{c}" for c in identity]).alias("existing_id"))


class Upsert(NamedTuple):
    snapshot: DataFrame
    outcomes: DataFrame
    #: pos, posting_id, key and URLs of every row that was stored.
    matches: DataFrame


def _fold(rows: DataFrame) -> DataFrame:
    """One row per entity: payload position, counts and source standing."""
    rank = trust.rank(F.col("source_trust"), trust.UPSERT_TRUST)
    type_rank = trust.rank(F.col("source_type"), trust.SOURCE_TYPE_RANKS)
    at_rank = lambda v: F.when(F.col("_rank") == v, F.col("pos"))
    earliest_best = lambda r: F.struct(F.col(r), -F.col("pos"))
    said = F.when(F.col("source_detail") != "", F.col("pos"))
    levels = [a for v in (1, 2, 3) for a in (F.min(at_rank(v)).alias(f"p{v}"), F.min_by("source_detail", at_rank(v)).alias(f"d{v}"))]
    return (
        rows.withColumns({"_rank": rank, "_type_rank": type_rank})
        .groupBy("entity")
        .agg(
            F.first("existing_id").alias("existing_id"),
            F.min("pos").alias("first_pos"),
            F.max("pos").alias("last_pos"),
            F.count(F.lit(1)).alias("sightings"),
            F.max_by("source_trust", earliest_best("_rank")).alias("new_trust"),
            F.max_by("source_type", earliest_best("_type_rank")).alias("new_type"),
            F.min_by("source_detail", said).alias("new_detail"),
            F.max(F.when(F.col("_scored"), 1).otherwise(0)).alias("any_scored"),
            *levels,
        )
    )


def _raises(v: int, base_rank: Column) -> Column:
    """Did the first row of trust rank v raise the entity's trust?"""
    higher = [F.col(f"p{w}") for w in range(v + 1, 4)]
    before = F.lit(True)
    for p in higher:
        before = before & (p.isNull() | (F.col(f"p{v}") < p))
    return F.col(f"p{v}").isNotNull() & (F.lit(v) > base_rank) & before


def scored_batch(batch: DataFrame) -> DataFrame:
    """A batch in the store's columns, with a flag for rows that bring a score."""
    scored = F.col("fit_score").isNotNull() | (clean(F.col("fit_tier"), False) != "") | (clean(F.col("ai_priority"), False) != "")
    return coerce_payload(batch).withColumn("_scored", scored)


def greatest_id(snapshot: DataFrame) -> int:
    return snapshot.agg(F.max("posting_id")).first()[0] or 0


def upsert_postings(
    snapshot: DataFrame, batch: DataFrame, removed: DataFrame, run_id: int, now: Column, at_once: int = chains.AT_ONCE
) -> Upsert:
    """M1: insert or update a batch, exactly as if its rows came one by one in `pos`.

    A row goes to the posting that has its key, else its canonical URL, else its
    URL at that moment (`chains.assigned`); an update changes all three.
    """
    live, skipped = drop_tombstoned(cut(scored_batch(batch)), removed)
    start = greatest_id(snapshot)
    known = cut(chains.candidates(live, snapshot))
    rows = chains.assigned(live, known, start, at_once)
    return apply_rows(snapshot, live, rows, skipped, start, run_id, now)


def apply_rows(
    snapshot: DataFrame, live: DataFrame, entities: DataFrame, skipped: DataFrame, start: int, run_id: int, now: Column
) -> Upsert:
    """M1, second half: rows, each with its posting's id (`entities`), into the part of a store that holds those postings."""
    rows = live.join(entities, "pos")
    rows = cut(rows.withColumn("existing_id", F.when(F.col("entity") <= start, F.col("entity"))))

    folded = _fold(rows)
    payload = rows.drop("entity", "existing_id", "_scored", *SOURCE_COLUMNS).withColumnRenamed("pos", "last_pos")
    latest = folded.join(payload, "last_pos")
    new_columns = [c for c in latest.columns if c not in ("entity", "existing_id")]
    fresh = latest.select(
        "entity", "existing_id", *[F.col(c).alias(f"n_{c}") for c in new_columns if c[0] not in "pd" or not c[1:].isdigit()],
        *[f"{a}{v}" for a in "pd" for v in (1, 2, 3)],
    )
    old = snapshot.withColumn("_old", F.lit(True))
    joined = old.join(fresh, old["posting_id"] == fresh["existing_id"], "full_outer")

    is_old, hit = F.col("_old").isNotNull(), F.col("entity").isNotNull()
    base_rank = F.when(is_old, trust.rank(F.col("source_trust"), trust.UPSERT_TRUST)).otherwise(F.lit(-1))
    text = lambda c: clean(F.col(c))
    better = lambda c, order: F.when(
        is_old
        & (trust.rank(F.col(c), order) >= trust.rank(F.col(f"n_new_{c.split('_')[1]}"), order))
        & (text(c) != ""),
        text(c),
    ).otherwise(F.col(f"n_new_{c.split('_')[1]}"))
    raised = [F.when(_raises(v, base_rank) & (F.col(f"d{v}") != ""), F.col(f"d{v}")) for v in (3, 2, 1)]
    detail = F.coalesce(
        F.when(is_old & (text("source_detail") == ""), F.coalesce(*raised, "n_new_detail", F.lit(""))),
        *raised,
        F.when(is_old, text("source_detail")),
        F.col("n_new_detail"),
        F.lit(""),
    )
    applied = is_old & (F.col("workflow_status") == "Applied")
    scored_at = F.when(F.col("n_any_scored") == 1, now)
    changed = {
        **{c: F.col(f"n_{c}") for c in UPDATED_COLUMNS},
        "date_found": F.when(is_old, F.col("date_found")).otherwise(F.col("n_date_found")),
        "source_trust": better("source_trust", trust.UPSERT_TRUST),
        "source_type": better("source_type", trust.SOURCE_TYPE_RANKS),
        "source_detail": detail,
        "workflow_status": F.when(applied, F.lit("Applied")).otherwise(F.lit("New")),
        "applied_date": F.when(applied, F.col("applied_date")).otherwise(F.lit("")),
        "first_seen_at": F.when(is_old, F.col("first_seen_at")).otherwise(now),
        "last_seen_at": now,
        "last_seen_run_id": F.lit(run_id).cast("long"),
        "seen_count": F.coalesce(F.col("seen_count"), F.lit(0)) + F.col("n_sightings"),
        "last_page_refresh_at": now,
        "last_score_refresh_at": F.coalesce(scored_at, F.col("last_score_refresh_at")),
        "last_refresh_status": F.lit("discovered"),
        "updated_at": now,
    }
    # Ids of new rows follow their first position: unique without a global sort.
    new_id = F.col("entity")
    known = [c for c in snapshot.columns if c != "posting_id"]
    after = joined.select(
        F.when(is_old, F.col("posting_id")).otherwise(new_id).alias("posting_id"),
        *[(F.when(hit, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in known],
    )
    matches = rows.select("pos", F.col("entity").alias("posting_id"), *chains.IDENTITY)
    return Upsert(after, _outcomes(rows, skipped, joined, run_id, new_id, is_old, base_rank), matches)


def _outcomes(rows, skipped, joined, run_id, new_id, is_old, base_rank) -> DataFrame:
    """One row per batch row: status, state, id and trust promotion."""
    raising = F.array_compact(F.array(*[F.when(_raises(v, base_rank), F.col(f"p{v}")) for v in (1, 2, 3)]))
    per_entity = joined.filter(F.col("entity").isNotNull()).select(
        "entity",
        F.when(is_old, F.col("posting_id")).otherwise(new_id).alias("job_id"),
        is_old.alias("known"),
        (is_old & (F.coalesce(F.col("last_seen_run_id"), F.lit(0)) == run_id)).alias("seen_this_run"),
        F.col("n_first_pos").alias("first_pos"),
        raising.alias("raising"),
    )
    first = F.col("pos") == F.col("first_pos")
    kept = rows.select("pos", "entity", "duplicate_key", "job_posting_url").join(per_entity, "entity")
    kept = kept.select(
        "pos",
        "job_id",
        "duplicate_key",
        F.when(first & ~F.col("known"), F.lit("inserted")).otherwise(F.lit("updated")).alias("status"),
        F.when(first & ~F.col("known"), F.lit("net_new"))
        .when(first & ~F.col("seen_this_run"), F.lit("rediscovered"))
        .otherwise(F.lit("duplicate_in_run"))
        .alias("discovery_state"),
        (F.array_contains("raising", F.col("pos")) & (F.col("known") | ~first)).alias("trust_promoted"),
    )
    gone = skipped.select(
        "pos",
        F.lit(None).cast("long").alias("job_id"),
        "duplicate_key",
        F.lit("skipped_removed").alias("status"),
        F.lit("skipped_removed").alias("discovery_state"),
        F.lit(False).alias("trust_promoted"),
    )
    return kept.unionByName(gone).withColumn("run_id", F.lit(run_id))


def mark_applied(snapshot: DataFrame, ids: DataFrame, today: str, now: Column) -> DataFrame:
    """M2: status change for the given ids; a first applied date stays."""
    picked = ids.select("posting_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull()
    day = F.when(clean(F.col("applied_date"), False) == "", F.lit(today)).otherwise(F.col("applied_date"))
    changed = {"workflow_status": F.lit("Applied"), "status": F.lit("Applied"), "applied_date": day, "updated_at": now}
    joined = snapshot.join(picked, "posting_id", "left")
    return joined.select(
        *[(F.when(hit, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in snapshot.columns]
    )


def remove_postings(
    snapshot: DataFrame, removed: DataFrame, ids: DataFrame, today: str, reason: str = "Removed in app"
) -> tuple[DataFrame, DataFrame]:
    """M3: (next snapshot, next tombstones); a key's newest tombstone stays."""
    picked = ids.select("posting_id").distinct()
    columns = ["duplicate_key", "company", "title", "location", "job_posting_url"]
    fresh = snapshot.join(picked, "posting_id", "left_semi").select(
        F.lit(today).alias("removed_date"),
        *[clean(F.col(c), False).alias(c) for c in columns],
        F.lit(reason).alias("removal_reason"),
        F.col("posting_id").alias("_order"),
    )
    both = removed.withColumn("_order", F.lit(-1).cast("long")).unionByName(fresh)
    keyed = top_n(both.filter("duplicate_key <> ''"), ["duplicate_key"], [F.desc("_order")])
    tombstones = keyed.unionByName(both.filter("duplicate_key = ''")).drop("_order")
    return snapshot.join(picked, "posting_id", "left_anti"), tombstones


REFRESHED_COLUMNS = [
    "company", "title", "role_family", "normalized_title", "location", "remote_type", "dallas_dfw_match",
    "job_posting_url", "canonical_job_posting_url", "compensation_raw", "compensation_status", "validation_status",
    "validation_confidence", "fit_score", "fit_tier", "ai_priority", "match_rationale", "risk_flags",
    "application_angle", "parser_version",
]
SCORE_COLUMNS = ["fit_score", "fit_tier", "ai_priority", "match_rationale", "risk_flags", "application_angle"]


def apply_refresh(snapshot: DataFrame, refreshed: DataFrame, now: Column, form: str = "full") -> DataFrame:
    """M4: overwrite columns by id.

    refreshed: posting_id plus, by form, the parsed and score columns with
    `scored` and `refresh_status` (full), the score columns (score), the
    score columns with company, title, location and pay (score_core), or
    `refresh_status` alone (status). Unique per id.
    """
    columns = {
        "full": REFRESHED_COLUMNS,
        "score": SCORE_COLUMNS,
        "score_core": ["company", "title", "location", "compensation_raw", *SCORE_COLUMNS],
        "status": [],
    }[form]
    given = [c for c in columns if c in refreshed.columns]
    extra = [c for c in ("scored", "refresh_status") if c in refreshed.columns]
    side = refreshed.select("posting_id", *[F.col(c).alias(f"_n_{c}") for c in [*given, *extra]], F.lit(True).alias("_hit"))
    changed = {c: F.col(f"_n_{c}") for c in given} | {"updated_at": now}
    if "refresh_status" in extra:
        changed["last_refresh_status"] = clean(F.col("_n_refresh_status"))
    if form == "full":
        changed["last_page_refresh_at"] = now
        changed["last_score_refresh_at"] = F.when(F.col("_n_scored"), now).otherwise(F.col("last_score_refresh_at"))
    joined = snapshot.join(side, "posting_id", "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        *[(F.when(hit, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in snapshot.columns]
    )


def append_artifact(snapshot: DataFrame, artifacts: DataFrame) -> DataFrame:
    """M7: set each posting's path to its newest artifact's."""
    newest = artifacts.groupBy("posting_id").agg(F.max_by("path", "artifact_id").alias("_path"))
    joined = snapshot.join(newest, "posting_id", "left")
    old = F.col("artifact_path") if "artifact_path" in snapshot.columns else F.lit("")
    keep = [c for c in snapshot.columns if c != "artifact_path"]
    return joined.select(*keep, F.coalesce("_path", old).alias("artifact_path"))


def artifact_records(snapshot: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: (a record for each artifact of a known posting, artifacts of none)."""
    text = lambda c: clean(F.col(c), False).alias(c)
    known = snapshot.select("posting_id", text("duplicate_key"), text("company"), text("title"))
    records = artifacts.join(known, "posting_id").select("artifact_id", "duplicate_key", "company", "title", F.col("path").alias("output_path"))
    return records, artifacts.join(known, "posting_id", "left_anti")


# --- endpoint contract ---------------------------------------------------------

# The contract's required fields (in the order its error text names missing ones, by letter) and allowed statuses.
REQUIRED_FIELDS = [
    "ats_provider", "canonical_company_domain", "careers_url", "careers_url_status",
    "company_name", "confidence_score", "last_validated_at", "review_status",
]
CAREERS_STATUSES = ["validated", "candidate", "blocked", "not_found", "unresolved"]
REVIEW_STATUSES = ["approved", "needs_review", "rejected", "unreviewed"]
IMPORTABLE_STATUSES = ["validated", "candidate"]
NAMED_METHODS = ["greenhouse", "ashby", "lever", "workday", "smartrecruiters", "icims"]


def validate_contract_records(records: DataFrame) -> DataFrame:
    """error texts per record and what becomes of it."""
    text = lambda c: clean(F.col(c), False)
    missing = F.filter(
        F.array(*[F.when(text(c) == "", F.lit(c)) for c in REQUIRED_FIELDS]), lambda m: m.isNotNull()
    )
    status, review = F.lower(text("careers_url_status")), F.lower(text("review_status"))
    shape = F.array_compact(
        F.array(
            F.when(~status.isin(*CAREERS_STATUSES), F.concat(F.lit("invalid careers_url_status: "), status)),
            F.when(~review.isin(*REVIEW_STATUSES), F.concat(F.lit("invalid review_status: "), review)),
            F.when(text("confidence_score").try_cast("double").isNull(), F.lit("confidence_score must be numeric")),
        )
    )
    errors = F.when(
        F.size("_missing") > 0,
        F.array(F.concat(F.lit("missing required field(s): "), F.array_join("_missing", ", "))),
    ).otherwise(shape)
    checked = records.withColumn("_missing", missing).withColumn("errors", errors).drop("_missing")
    return checked.withColumn(
        "verdict",
        F.when(F.size("errors") > 0, F.lit("invalid"))
        .when(~status.isin(*IMPORTABLE_STATUSES), F.lit("skipped"))
        .otherwise(F.lit("kept")),
    )


def resolve_company(records: DataFrame, companies: DataFrame) -> DataFrame:
    """Company id by canonical domain, else by exact name."""
    by_domain = (
        companies.filter("canonical_domain <> ''").groupBy("canonical_domain").agg(F.min("company_id").alias("_by_domain"))
    )
    by_name = companies.groupBy("name").agg(F.min("company_id").alias("_by_name"))
    domain = F.lower(clean(F.col("canonical_company_domain"), False))
    return (
        records.withColumns({"canonical_domain": domain, "name": clean(F.col("company_name"), False)})
        .join(by_domain, "canonical_domain", "left")
        .join(by_name, "name", "left")
        .withColumn("company_id", F.coalesce("_by_domain", "_by_name"))
        .drop("_by_domain", "_by_name")
    )


class EndpointImport(NamedTuple):
    companies: DataFrame
    endpoints: DataFrame
    summary: DataFrame


def import_endpoints(companies: DataFrame, endpoints: DataFrame, records: DataFrame) -> EndpointImport:
    """M5: contract records (with `pos`) into companies and endpoints.

    A record without a company in the tables starts one under its domain,
    else its name; ids of new rows follow the record's position.
    """
    checked = validate_contract_records(records)
    kept = resolve_company(checked.filter("verdict = 'kept'"), companies)
    group = F.when(F.col("canonical_domain") != "", F.concat(F.lit("d:"), "canonical_domain")).otherwise(
        F.concat(F.lit("n:"), "name")
    )
    entity = F.when(F.col("company_id").isNotNull(), F.concat(F.lit("id:"), "company_id")).otherwise(group)
    rows = kept.withColumn("_entity", entity)
    start = F.broadcast(companies.agg(F.coalesce(F.max("company_id"), F.lit(0)).alias("_start")))
    folded = (
        rows.groupBy("_entity")
        .agg(
            F.first("company_id").alias("_known_id"),
            F.min("pos").alias("_first"),
            F.max_by("name", "pos").alias("_name"),
            F.min_by("canonical_domain", F.when(F.col("canonical_domain") != "", F.col("pos"))).alias("_domain"),
            F.count(F.lit(1)).alias("_n"),
        )
        .join(start, F.lit(True))
        .withColumn("_id", F.coalesce("_known_id", F.col("_start") + F.col("_first") + 1))
    )
    after = companies.join(folded.withColumn("company_id", F.col("_id")), "company_id", "full_outer").select(
        "company_id",
        F.coalesce("_name", "name").alias("name"),
        F.coalesce(F.nullif("canonical_domain", F.lit("")), "_domain", F.lit("")).alias("canonical_domain"),
        *[F.col(c) for c in companies.columns if c not in ("company_id", "name", "canonical_domain")],
    )

    vendor = F.lower(clean(F.col("ats_provider"), False))
    note = F.concat_ws(
        " | ",
        *[F.nullif(clean(F.col(c), False), F.lit("")) for c in ("confidence_reason", "review_notes", "notes") if c in records.columns],
    )
    primary = F.lower(clean(F.col("is_primary_careers_url"), False)).isin("1", "true", "yes", "y")
    review = F.lower(clean(F.col("review_status"), False))
    fresh = rows.join(folded.select("_entity", "_id"), "_entity").select(
        F.col("_id").alias("company_id"),
        clean(F.col("careers_url"), False).alias("endpoint_url"),
        vendor.alias("ats_vendor"),
        F.when(vendor.isin("custom", "unknown", ""), F.lit("careers_page")).otherwise(vendor).alias("extraction_method"),
        F.col("confidence_score").try_cast("double").alias("confidence_score"),
        F.col("confidence_score").try_cast("double").alias("health_score"),
        review.alias("review_status"),
        F.lower(clean(F.col("careers_url_status"), False)).alias("careers_url_status"),
        primary.cast("int").alias("is_primary"),
        F.when(review == "rejected", 0).otherwise(1).alias("active"),
        note.alias("notes"),
        "pos",
    )
    fields = [c for c in fresh.columns if c not in ("company_id", "endpoint_url", "pos")]
    key = ["company_id", "endpoint_url"]
    latest = top_n(fresh, key, [F.desc("pos")])
    known = endpoints.groupBy(*key).agg(F.min("endpoint_id").alias("_eid"))
    new = latest.join(known, key, "left")
    old = endpoints.select(*key, "endpoint_id", *[F.col(c).alias(f"_o_{c}") if c in endpoints.columns else F.lit(None).alias(f"_o_{c}") for c in fields])
    # Ids of new endpoints follow their last record's position, like those of companies.
    last = F.broadcast(endpoints.agg(F.coalesce(F.max("endpoint_id"), F.lit(0)).alias("_last")))
    merged = old.join(new.drop("_eid").withColumn("_hit", F.lit(True)), key, "full_outer").join(last, F.lit(True)).select(
        *key, F.coalesce("endpoint_id", F.col("_last") + F.col("pos") + 1).alias("endpoint_id"), *[F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in fields]
    )
    sums = checked.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col("verdict") == "invalid").alias("invalid"),
        F.count_if(F.col("verdict") == "skipped").alias("skipped"),
    )
    firms = folded.agg(
        F.count_if(F.col("_known_id").isNull()).alias("company_inserted"),
        F.coalesce(F.sum(F.col("_n") - F.when(F.col("_known_id").isNull(), 1).otherwise(0)), F.lit(0)).alias("company_updated"),
    )
    per_pair = fresh.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).join(known, key, "left")
    pairs = per_pair.agg(
        F.count_if(F.col("_eid").isNull()).alias("endpoint_inserted"),
        F.coalesce(F.sum(F.col("_n") - F.when(F.col("_eid").isNull(), 1).otherwise(0)), F.lit(0)).alias("endpoint_updated"),
    )
    summary = sums.join(F.broadcast(firms), F.lit(True)).join(F.broadcast(pairs), F.lit(True))
    return EndpointImport(after, merged, summary)
