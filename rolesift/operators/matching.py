"""Postings and URLs against profiles.

A posting or URL belongs to one profile (the run that found it); profiles are
joined on profile_id and every test is then a column expression on the row.
Nothing is paired up, so nothing grows but the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, titles, urls
from ..functions.text import clean, contains_any, let, norm_match, norm_plain, words
from .profiles import TECH_TERMS, prepare

# Neighbours of the technology lane, and other functions.
ADJACENT_TERMS = [
    "technology and data",
    "technology and engineering",
    "technology and architecture",
    "enterprise technology",
    "business technology",
    "platform engineering",
]
OTHER_FUNCTION_TERMS = [
    "sales",
    "marketing",
    "revenue",
    "customer success",
    "finance",
    "financial",
    "legal",
    "hr",
    "human resources",
    "people",
    "talent",
    "operations",
    "clinical",
    "medicare",
    "aca marketplace",
    "commercial",
    "partnerships",
    "growth",
]
FOREIGN_MARKERS = [
    "argentina",
    "australia",
    "brazil",
    "canada",
    "colombia",
    "europe",
    "france",
    "germany",
    "india",
    "ireland",
    "italy",
    "japan",
    "latam",
    "latin america",
    "mexico",
    "netherlands",
    "philippines",
    "poland",
    "portugal",
    "spain",
    "united kingdom",
    "uk",
]
PLACE_NOISE_TOKENS = ["metro", "area", "city", "state", "county", "region", "office", "location"]
AUTO_ACCEPT_SCORE = 45
FORCED_NOTE = "blank-location title override"
MIN_SEED_OVERLAP = 0.34


def with_profile(rows: DataFrame, profiles: DataFrame, resolver=None) -> DataFrame:
    """Rows joined with their prepared profile.

    No broadcast hint: Spark broadcasts the profiles while they are under its
    threshold and otherwise shuffles, splitting a hot profile (AQE skew join).
    """
    return rows.join(prepare(profiles, resolver), "profile_id")


def _hint_signature_ok(hint: Column) -> Column:
    return titles.signature_fits(
        titles.leadership(hint), titles.lanes(hint), F.col("hint_levels"), F.col("hint_lanes")
    )


def title_prefilter(df: DataFrame, url: str = "url") -> DataFrame:
    """the URL's title words against the profile's expanded titles."""
    hint = F.col("title_hint")
    said, shared, fits = F.col("_said"), F.col("_shared"), F.col("_fits")
    staged = df.withColumn("title_hint", titles.url_hint(F.col(url))).withColumns(
        {
            "_said": F.get(
                F.filter("hint_terms", lambda t: (t["plain"] != "") & hint.contains(t["plain"])), F.lit(0)
            )["term"],
            "_shared": F.array_sort(F.array_intersect(F.split(hint, " "), F.col("hint_tokens"))),
            "_fits": _hint_signature_ok(hint),
        }
    )
    passed = (
        F.when((F.size("targets") == 0) | (hint == "") | said.isNotNull(), F.lit(True))
        .otherwise((F.size(shared) > 0) & fits)
    )
    reason = (
        F.when(F.size("targets") == 0, F.lit("no target titles configured"))
        .when(hint == "", F.lit("no reliable url title hint"))
        .when(said.isNotNull(), F.concat(F.lit("url title hint matched '"), said, F.lit("'")))
        .when(~fits, F.concat(F.lit("url title signature mismatch: "), hint))
        .when(
            F.size(shared) > 0,
            F.concat(F.lit("url title hint token overlap: "), F.array_join(F.slice(shared, 1, 3), ", ")),
        )
        .otherwise(F.concat(F.lit("url title prefilter mismatch: "), hint))
    )
    return staged.withColumns({"title_pass": passed, "title_reason": reason}).drop("_said", "_shared", "_fits")


def best_title(hint: Column) -> Column:
    """J6, second form: the target with a phrase hit, else the best overlap."""
    tokens = words(hint)
    scored = F.transform(
        "scoring_terms",
        lambda t, i: F.struct(
            hint.contains(t["plain"]).cast("int").alias("phrase"),
            (F.size(F.array_intersect(t["plain_tokens"], tokens)) / F.size(t["plain_tokens"])).alias("overlap"),
            (-i).alias("order"),
            t["title"].alias("title"),
        ),
    )
    return F.array_max(scored)


def match_seed_title(df: DataFrame, hint_column: str) -> DataFrame:
    """F6 over any title text (a URL's hint or a feed title)."""
    hint, plain = F.col(hint_column), F.col("_plain")
    staged = df.withColumn("_plain", norm_plain(hint)).withColumns(
        {
            "_best": best_title(plain),
            "_levels": titles.leadership(plain),
            "_lanes": titles.lanes(plain),
            "_sparse": ~F.exists(F.split(plain, " "), lambda t: F.length(t) >= 3),
        }
    )
    best = F.col("_best")
    fits = titles.signature_fits(F.col("_levels"), F.col("_lanes"), F.col("scoring_levels"), F.col("scoring_lanes"))
    both = F.arrays_overlap("scoring_levels", "_levels") & F.arrays_overlap("scoring_lanes", "_lanes")
    free = (F.size("scoring_titles") == 0) | (hint == "") | F.col("_sparse")
    passed = free | (fits & ((best["phrase"] == 1) | (best["overlap"] >= MIN_SEED_OVERLAP) | both))
    reason = (
        F.when(F.size("scoring_titles") == 0, F.lit("no target titles configured"))
        .when(hint == "", F.lit("no reliable url title hint"))
        .when(F.col("_sparse"), F.lit("url title hint too sparse for seed filtering"))
        .when(~fits, F.concat(F.lit("seed title signature mismatch: "), hint))
        .when(best["phrase"] == 1, F.concat(F.lit("seed title phrase matched '"), best["title"], F.lit("'")))
        .when(
            best["overlap"] >= MIN_SEED_OVERLAP,
            F.concat(
                F.lit("seed title overlap matched '"),
                best["title"],
                F.lit("' ("),
                F.format_string("%.2f", best["overlap"]),
                F.lit(")"),
            ),
        )
        .when(both, F.concat(F.lit("seed leadership/function lane matched: "), hint))
        .otherwise(F.concat(F.lit("seed title prefilter mismatch: "), hint))
    )
    return staged.withColumns({"seed_title_pass": passed, "seed_title_reason": reason}).drop(
        "_plain", "_best", "_levels", "_lanes", "_sparse"
    )


def seed_title_prefilter(df: DataFrame, url: str = "url") -> DataFrame:
    """stricter; the signature must fit and a phrase, overlap or lane hit."""
    return match_seed_title(df.withColumn("title_hint", titles.url_hint(F.col(url))), "title_hint")


def match_seed_place(df: DataFrame, hint_column: str) -> DataFrame:
    """F7 over any place text (a URL's path and query, or a feed's place)."""
    hint, plain, hit = F.col(hint_column), F.col("_plain"), F.col("_hit")
    remote = plain.contains("remote")
    wants_remote = F.col("remote_only") | F.col("include_remote")
    foreign = wants_remote & remote & contains_any(plain, FOREIGN_MARKERS)

    def wish_reason(wish: Column) -> Column:
        text = norm_plain(wish["raw"])
        tokens = F.filter(words(text, 4), lambda t: ~t.isin(*PLACE_NOISE_TOKENS))
        return F.when(
            (text != "") & plain.contains(text), F.concat(F.lit("url location hint matched '"), wish["raw"], F.lit("'"))
        ).when(
            (F.size(tokens) > 0) & F.arrays_overlap(tokens, F.split(plain, " ")),
            F.concat(
                F.lit("url location hint token overlap: "), F.array_join(F.slice(F.array_sort(tokens), 1, 2), ", ")
            ),
        )

    staged = df.withColumn("_plain", norm_plain(hint)).withColumn(
        "_hit", F.get(F.filter(F.transform("wishes", wish_reason), lambda r: r.isNotNull()), F.lit(0))
    )
    open_profile = (F.size("wishes") == 0) & ~wants_remote
    passed = (
        F.when(open_profile | (plain == ""), F.lit(True))
        .when(foreign, F.lit(False))
        .when(remote, wants_remote)
        .when(F.col("remote_only"), F.lit(False))
        .otherwise(hit.isNotNull())
    )
    reason = (
        F.when(open_profile, F.lit("no preferred locations configured"))
        .when(plain == "", F.lit("no reliable url location hint"))
        .when(foreign, F.concat(F.lit("url location prefilter foreign remote mismatch: "), hint))
        .when(remote & wants_remote, F.lit("url location hint matched remote"))
        .when(remote, F.lit("url location prefilter mismatch: remote disabled"))
        .when(F.col("remote_only"), F.lit("url location prefilter mismatch: remote_only"))
        .otherwise(F.coalesce(hit, F.concat(F.lit("url location prefilter mismatch: "), hint)))
    )
    return staged.withColumns({"seed_place_pass": passed, "seed_place_reason": reason}).drop("_plain", "_hit")


def seed_location_prefilter(df: DataFrame, url: str = "url") -> DataFrame:
    """the URL's path and query against the profile's places."""
    text = clean(F.col(url))
    source = F.concat_ws(
        " ", F.nullif(urls.path(text), F.lit("")), F.nullif(urls.query(text), F.lit(""))
    )
    return match_seed_place(df.withColumn("place_hint", source), "place_hint")


# --- posting matchers ----------------------------------------------------------


def location_filter(df: DataFrame) -> DataFrame:
    """F8: the hard location filter as (place_pass, place_reason)."""
    parsed = df.withColumn("place", places.parse(F.col("location")))
    parsed = parsed.withColumn("_hit", places.first_match(F.col("place"), F.col("wishes")))
    verdict = places.filter_verdict(
        F.col("place"), F.col("_hit"), F.size("wishes") == 0, F.col("remote_only"), F.col("include_remote")
    )
    return (
        parsed.withColumn("_v", verdict)
        .withColumns({"place_pass": F.col("_v.passed"), "place_reason": F.col("_v.reason")})
        .drop("_v", "_hit")
    )


def match_location(df: DataFrame, resolver=None) -> DataFrame:
    """The first preferred location met, in list order, with the reason."""
    parsed = df.withColumn("place", (resolver or places.parse)(F.col("location")))
    parsed = parsed.withColumn("_hit", places.first_match(F.col("place"), F.col("wishes")))
    hit = F.col("_hit")
    reason = (
        F.when(F.size("wishes") == 0, F.lit("no preferred location set"))
        .when(F.col("place.is_blank"), F.lit("blank job location"))
        .otherwise(F.coalesce(hit, F.lit("no preferred location match")))
    )
    return parsed.withColumns(
        {"place_match": (F.size("wishes") == 0) | hit.isNotNull(), "place_match_reason": reason}
    ).drop("_hit")


def title_score(norm: Column) -> Column:
    """(score, reason) of a normal title against the scoring terms."""
    tokens = words(norm)

    def term_score(term: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect(tokens, term["tokens"]))
        score = (
            F.when((term["norm"] != "") & norm.contains(term["norm"]), 55)
            .when(shared >= 3, 42)
            .when(shared == 2, 32)
            .when(shared == 1, 16)
            .otherwise(0)
        )
        return F.struct(score.alias("score"), (-i).alias("order"), term["title"].alias("title"))

    return let(F.array_max(F.transform("scoring_terms", term_score)), lambda best: _title_verdict(norm, best))


def _title_verdict(norm: Column, best: Column) -> Column:
    say = lambda head: F.concat(F.lit(head + " '"), best["title"], F.lit("'"))
    reason = (
        F.when(norm == "", F.lit("missing job title"))
        .when(F.size("scoring_terms") == 0, F.lit("no target titles provided"))
        .when(best["score"] == 55, say("title contains target"))
        .when(best["score"] == 42, say("strong token overlap with"))
        .when(best["score"] == 32, say("good token overlap with"))
        .when(best["score"] == 16, say("light token overlap with"))
        .otherwise(F.lit("no strong title overlap"))
    )
    score = F.when(norm == "", 0).when(F.size("scoring_terms") == 0, 20).otherwise(best["score"])
    return F.struct(score.alias("score"), reason.alias("reason"))


def match_titles(df: DataFrame) -> DataFrame:
    """Best target per posting as (title_score, title_score_reason)."""
    return (
        df.withColumn("_t", title_score(norm_match(F.col("title"))))
        .withColumns({"title_score": F.col("_t.score"), "title_score_reason": F.col("_t.reason")})
        .drop("_t")
    )


def _lane_score(norm: Column) -> Column:
    tech, adjacent = contains_any(norm, TECH_TERMS), contains_any(norm, ADJACENT_TERMS)
    other = contains_any(norm, OTHER_FUNCTION_TERMS)
    wrong = other & ~tech & ~adjacent
    score = F.when(
        F.col("targets_tech"), F.when(wrong, -35).when(tech, 25).when(adjacent, 18).otherwise(-10)
    ).otherwise(F.when(other, -15).otherwise(0))
    reason = F.when(
        F.col("targets_tech"),
        F.when(wrong, F.lit("title appears to be in a different executive function"))
        .when(tech, F.lit("strong technology-lane signal"))
        .when(adjacent, F.lit("adjacent technology-lane signal"))
        .otherwise(F.lit("limited technology-lane signal")),
    ).when(other, F.lit("different executive function detected"))
    reject = F.when(F.col("targets_tech") & wrong, F.lit("wrong function"))
    return F.struct(score.alias("score"), reason.alias("reason"), reject.alias("reject"))


def _place_score(place: Column, hit: Column) -> Column:
    remote, blank = place["is_remote"], place["is_blank"]
    only, take = F.col("remote_only"), F.col("include_remote")
    none = F.size("wishes") == 0
    cases = [
        (only & remote, 22, F.lit("remote-only preference matched"), None),
        (only & blank, 5, F.lit("location missing"), None),
        (only, -20, F.lit("role is not remote"), "not remote"),
        (none & remote & take, 12, F.lit("remote accepted"), None),
        (none & remote, -8, F.lit("location mismatch"), "location mismatch"),
        (none, 8, F.lit("no preferred locations provided"), None),
        (hit.isNotNull(), 20, hit, None),
        (take & remote, 10, F.lit("remote accepted as fallback"), None),
        (F.lit(True), -8, F.lit("location mismatch"), "location mismatch"),
    ]
    pick = lambda values: F.coalesce(*[F.when(test, v) for (test, *_), v in zip(cases, values, strict=True)])
    reject = F.nullif(pick([F.lit(c[3] or "") for c in cases]), F.lit(""))
    return F.struct(
        pick([F.lit(c[1]) for c in cases]).alias("score"), pick([c[2] for c in cases]).alias("reason"), reject.alias("reject")
    )


def _keyword_score(text: Column) -> Column:
    found = lambda c: F.filter(c, lambda k: (norm_match(k) != "") & text.contains(norm_match(k)))
    wanted, barred = found("include_list"), found("exclude_list")
    n = F.size(wanted)
    head = lambda label, c: F.concat(F.lit(label), F.array_join(F.slice(c, 1, 4), ", "))
    score = F.when(n > 0, F.least(F.lit(18), n * 3 + 8)).otherwise(0) - F.when(F.size(barred) > 0, 40).otherwise(0)
    reject = F.when(F.size(barred) > 0, head("matched excluded keywords: ", barred))
    reason = F.when(n > 0, head("matched include keywords: ", wanted))
    return F.struct(score.alias("score"), F.nullif(F.concat_ws("; ", reason, reject), F.lit("")).alias("reason"), reject.alias("reject"))


def qualify(df: DataFrame) -> DataFrame:
    """Fit score, tier, verdict and rationale per (posting, profile) row.

    Adds score, fit_tier, confidence, reject_reason, rationale, place_pass,
    place_reason, accepted, forced, match_skip, match_score and reason_text. A
    forced row passes its place with a note.
    """
    staged = df.withColumns(
        {
            "_norm": norm_match(F.col("title")),
            "place": places.parse(F.col("location")),
            "_all": norm_match(F.concat_ws(" ", "title", "company", "location", "compensation_raw")),
        }
    )
    staged = staged.withColumn("_hit", places.first_match(F.col("place"), F.col("wishes")))
    staged = staged.withColumns(
        {
            "_t": title_score(F.col("_norm")),
            "_f": _lane_score(F.col("_norm")),
            "_l": _place_score(F.col("place"), F.col("_hit")),
            "_k": _keyword_score(F.col("_all")),
            "_v": places.filter_verdict(
                F.col("place"), F.col("_hit"), F.size("wishes") == 0, F.col("remote_only"), F.col("include_remote")
            ),
        }
    )
    total = F.greatest(
        F.lit(0), F.least(F.lit(100), F.col("_t.score") + F.col("_f.score") + F.col("_l.score") + F.col("_k.score"))
    )
    no_title = F.when((F.col("_t.score") == 0) & (F.size("targets") > 0), F.lit("title mismatch"))
    scored = staged.withColumns(
        {
            "score": total,
            "reject_reason": F.coalesce("_k.reject", "_f.reject", "_l.reject", no_title, F.lit("")),
            "rationale": F.concat_ws("; ", "_t.reason", "_f.reason", "_l.reason", "_k.reason"),
            "place_pass": F.col("_v.passed"),
            "place_reason": F.col("_v.reason"),
        }
    )
    title_said = F.exists("expanded_titles", lambda t: F.lower("title").contains(t))
    accept = (F.col("score") >= 50) & (F.col("reject_reason") == "") & F.col("place_pass")
    forced = ~accept & (F.size("wishes") == 0) & (clean(F.col("title")) != "") & title_said
    out = scored.withColumns({"_accept": accept, "forced": forced})
    skip = (
        F.when(~F.col("place_pass"), F.lit("location_mismatch"))
        .when(F.col("reject_reason").contains("excluded keyword"), F.lit("excluded_keyword"))
        .when(F.col("reject_reason").contains("title mismatch"), F.lit("title_mismatch"))
        .when(F.col("reject_reason").isin("location mismatch", "not remote"), F.lit("location_mismatch"))
        .otherwise(F.lit("below_threshold"))
    )
    return out.withColumns(
        {
            "fit_tier": F.when(F.col("score") >= 75, F.lit("Strong"))
            .when(F.col("score") >= 50, F.lit("Review"))
            .otherwise(F.lit("Low")),
            "confidence": F.when(F.col("score") >= 75, F.lit("High"))
            .when(F.col("score") >= 50, F.lit("Medium"))
            .otherwise(F.lit("Low")),
            "accepted": F.col("_accept") | F.col("forced"),
            "match_skip": F.when(F.col("_accept") | F.col("forced"), F.lit("")).otherwise(skip),
            "match_score": F.when(F.col("forced"), F.greatest(F.col("score"), F.lit(AUTO_ACCEPT_SCORE))).otherwise(
                F.col("score")
            ),
            "reason_text": F.concat_ws(
                " | ",
                F.nullif(
                    F.concat_ws(
                        "; ",
                        F.nullif("rationale", F.lit("")),
                        F.when(F.col("reject_reason") != "", F.concat(F.lit("qualifier reject: "), "reject_reason")),
                        F.when(~F.col("place_pass"), F.concat(F.lit("hard reject: "), "place_reason")),
                    ),
                    F.lit(""),
                ),
                F.when(F.col("forced"), F.lit(FORCED_NOTE)),
            ),
            "place_pass": F.col("place_pass") | F.col("forced"),
            "place_reason": F.when(F.col("forced"), F.lit(FORCED_NOTE)).otherwise(F.col("place_reason")),
        }
    ).drop("_norm", "_all", "_t", "_f", "_l", "_k", "_v", "_hit", "_accept")
