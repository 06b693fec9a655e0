"""Model results and corrections applied to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, titles
from ..functions.text import clean

# The lists of a model's answer.
SCORE_LISTS = [
    "match_reasons", "gaps_or_risks", "resume_signals_used", "must_have_requirements", "preferred_requirements",
    "matched_must_haves", "missing_must_haves", "matched_preferred", "missing_preferred",
]
SCORE_SCHEMA = "struct<fit_score:string,confidence:string,match_summary:string," + ",".join(f"{c}:array<string>" for c in SCORE_LISTS) + ">"


def json_text(raw: Column) -> Column:
    """The object in a model's answer: fenced, else the outer braces."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    braced = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braced, F.lit("")), F.trim(raw))


def clean_list(values: Column) -> Column:
    return F.filter(
        F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: clean(v, False)), lambda v: v != ""
    )


def fit_label(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("Strong"))
        .when(score >= 60, F.lit("Moderate"))
        .when(score >= 40, F.lit("Weak"))
        .otherwise(F.lit("Not Recommended"))
    )


def action(score: Column) -> Column:
    return (
        F.when(score >= 80, F.lit("Apply"))
        .when(score >= 60, F.lit("Apply with Caution"))
        .when(score >= 40, F.lit("Hold"))
        .otherwise(F.lit("Skip"))
    )


def confidence(c: Column) -> Column:
    low = F.lower(clean(c, False))
    return F.when(low == "high", F.lit("High")).when(low == "medium", F.lit("Medium")).otherwise(F.lit("Low"))


def normalise_scores(results: DataFrame) -> DataFrame:
    """C4: raw model answers into bounded scores, their nine lists and write-back columns.

    results: raw_text (NULL or blank: not asked), title and, prepared, the
    profile's `levels`. A title outside the preferred levels costs points.
    """
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    staged = results.withColumn("_asked", clean(raw, False) != "").withColumn("_json", json_text(raw))
    staged = staged.withColumns(
        {
            # A strict reader rejects trailing text; so does try_parse_json.
            "_ok": F.col("_asked") & F.try_parse_json("_json").isNotNull() & F.col("_json").startswith("{"),
            "_r": F.from_json("_json", SCORE_SCHEMA),
            "_level": titles.level_penalty(F.col("title"), F.col("levels")),
        }
    )
    number = F.coalesce(F.col("_r.fit_score").try_cast("double"), F.lit(0.0))
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(number).cast("int")))
    base = F.when(F.col("_ok"), bounded).otherwise(0)
    penalised = F.col("_ok") & (F.col("_level.penalty") > 0)
    staged = staged.withColumn(
        "fit_score", F.when(penalised, F.greatest(F.lit(0), base - F.col("_level.penalty"))).otherwise(base)
    )
    summary = clean(F.coalesce(F.col("_r.match_summary"), F.lit("")), False)
    level_note = F.concat(F.lit("Detected title level: "), "_level.detected", F.lit("."))
    noted = F.when(summary.contains(level_note), summary).otherwise(
        F.trim(F.concat_ws(" ", F.nullif(summary, F.lit("")), level_note))
    )
    gaps = clean_list(F.col("_r.gaps_or_risks"))
    gaps = F.when(penalised, F.array_append(gaps, F.col("_level.reason"))).otherwise(gaps)
    failed = F.array(F.lit("Could not parse model response as JSON"))
    lists = {c: F.when(F.col("_ok"), clean_list(F.col(f"_r.{c}"))).otherwise(F.array().cast("array<string>")) for c in SCORE_LISTS[2:]}
    lists["match_reasons"] = F.when(F.col("_ok"), clean_list(F.col("_r.match_reasons"))).otherwise(F.array().cast("array<string>"))
    lists["gaps_or_risks"] = F.when(F.col("_asked") & ~F.col("_ok"), failed).otherwise(gaps)
    staged = staged.withColumns(lists)
    return staged.withColumns(
        {
            "status": F.when(~F.col("_asked"), F.lit("skipped")).when(F.col("_ok"), F.lit("scored")).otherwise(F.lit("error")),
            "fit_label": fit_label(F.col("fit_score")),
            "recommended_action": action(F.col("fit_score")),
            "confidence": F.when(F.col("_ok"), confidence(F.col("_r.confidence"))).otherwise(F.lit("Low")),
            "match_rationale": F.when(
                F.col("_asked") & ~F.col("_ok"), F.lit("AI job scoring returned a non-JSON response.")
            )
            .when(penalised & (F.col("_level.detected") != ""), noted)
            .otherwise(summary),
            "risk_flags": F.array_join(F.when(F.col("_asked") & ~F.col("_ok"), failed).otherwise(gaps), "; "),
            "application_angle": F.array_join(
                F.transform(clean_list(F.col("_r.match_reasons")), lambda m: F.concat(F.lit("- "), m)), "\n"
            ),
        }
    ).drop("_asked", "_json", "_ok", "_r", "_level")


CORRECTED = [("title", "Title"), ("company", "Company"), ("location", "Location"), ("compensation_raw", "Compensation")]


def apply_corrections(postings: DataFrame, results: DataFrame) -> DataFrame:
    """High-confidence corrections with notes, risks and action.

    results: posting_id, scrub_status, scrub_flags, corrected_<field>,
    correction_confidence, correction_notes (unique per id).
    """
    joined = postings.join(results, "posting_id")
    sure = (F.lower(clean(F.col("correction_confidence"), False)) == "high") & (clean(F.col("description_text"), False) != "")
    was = {f: clean(F.col(f), False) for f, _ in CORRECTED}
    new = {f: clean(F.col(f"corrected_{f}"), False) for f, _ in CORRECTED}
    takes = {f: sure & (new[f] != "") & (new[f] != was[f]) for f, _ in CORRECTED}
    identity = takes["title"] | takes["company"] | takes["location"]
    arrow = lambda f, label: F.when(
        takes[f],
        F.concat(
            F.lit(f"AI scrub updated {label}: "), F.coalesce(F.nullif(was[f], F.lit("")), F.lit("blank")), F.lit(" -> "), new[f]
        ),
    )
    own = clean_list(F.split(F.coalesce("risk_flags", F.lit("")), ";"))
    changes = F.array_compact(F.array(*[arrow(f, n) for f, n in CORRECTED]))
    risks = F.array_distinct(F.concat(own, clean_list(F.col("scrub_flags")), clean_list(F.col("correction_notes")), changes))
    status = F.lower(clean(F.col("scrub_status"), False))
    status = F.when(status.isin("clean", "reject"), status).otherwise(F.lit("review"))
    place = F.when(takes["location"], new["location"]).otherwise(F.col("location"))
    moved = identity & (new["location"] != "")
    out = {f: F.when(takes[f], new[f]).otherwise(F.col(f)) for f, _ in CORRECTED}
    out |= {
        "duplicate_key": F.when(identity, F.lit("")).otherwise(F.col("duplicate_key")),
        "normalized_title": F.when(identity & (new["title"] != ""), F.lit("")).otherwise(F.col("normalized_title")),
        "remote_type": F.when(moved, places.remote_type(place, F.col("description_text"))).otherwise(F.col("remote_type")),
        "dallas_dfw_match": F.when(moved, places.metro_match(place)).otherwise(F.col("dallas_dfw_match")),
        "risk_flags": F.array_join(risks, "; "),
        "ai_priority": F.when(status == "reject", F.lit("Skip"))
        .when((status == "review") & (clean(F.col("ai_priority"), False) == "Apply"), F.lit("Hold"))
        .otherwise(F.col("ai_priority")),
    }
    return joined.select(*[(out[c].alias(c) if c in out else F.col(c)) for c in postings.columns])
