"""Search queries planned per profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import titles
from ..functions.text import clean, distinct_titles, let, norm_match, split_csv, split_places, squeeze
from .profiles import include_remote, title_groups

# Site blocks of the query tiers.
ATS_SITES = (
    "(site:greenhouse.io OR site:lever.co OR site:myworkdayjobs.com OR site:ashbyhq.com OR site:smartrecruiters.com"
    " OR site:recruiting.paylocity.com OR site:jobs.jobvite.com OR site:jobs.icims.com OR site:taleo.net OR site:adp.com"
    " OR site:careers.bamboohr.com OR site:paycomonline.net OR site:ukg.com)"
)
CAREER_SIGNALS = '("jobs" OR "careers" OR "hiring" OR "employment")'
BOARD_SITES = (
    "(site:linkedin.com/jobs OR site:indeed.com OR site:glassdoor.com/Job OR site:ziprecruiter.com"
    " OR site:wellfound.com OR site:trueup.io OR site:otta.com)"
)
# Per-tier and total budgets by how specific the titles are.
TIERS = ["ats_grouped", "ats_broad", "ats_strict", "ats_loose", "career_web", "job_board_discovery"]
BUDGETS = {
    "generic": {"title_variants": 4, "location_variants": 2, "ats_grouped": 2, "ats_strict": 4, "ats_loose": 4,
                "career_web": 2, "job_board_discovery": 2, "total_queries": 12},
    "medium": {"title_variants": 5, "location_variants": 2, "ats_grouped": 2, "ats_strict": 6, "ats_loose": 6,
               "career_web": 4, "job_board_discovery": 4, "total_queries": 18},
    "specific": {"title_variants": 6, "location_variants": 3, "ats_grouped": 6, "ats_strict": 12, "ats_loose": 10,
                 "career_web": 8, "job_board_discovery": 8, "total_queries": 30},
}
# Seniority words and the query term each stands for.
SENIORITY = [
    (["vice president", "vp", "avp", "svp", "evp"], '"vice president"'),
    (["director", "head"], '"director"'),
    (["principal", "manager", "lead"], '"manager"'),
    (["chief", "cto", "cio", "cfo", "coo", "ceo"], '"chief"'),
]
NOISE_WORDS = ["of", "and", "the", "for", "in", "to", "a", "an"]


def _budget(name: str) -> Column:
    """The profile's budget for one line, by specificity and strategy."""
    base = F.when(F.lit(False), F.lit(0))
    for kind, lines in BUDGETS.items():
        base = base.when(F.col("specificity") == kind, F.lit(lines.get(name, 0)))
    broad = F.col("strategy") == "broad_recall"
    if name == "ats_broad":
        return F.when(broad, F.when(F.col("specificity") == "specific", 6).otherwise(4)).otherwise(0)
    least = {"career_web": 6, "total_queries": 36}.get(name)
    return base if least is None else F.when(broad, F.greatest(base, F.lit(least))).otherwise(base)


def _family(names: Column, most: int) -> Column:
    """The first aliases of a title family: each title, then its search-safe form."""
    both = F.flatten(
        F.transform(
            names,
            lambda t: let(titles.search_safe(t), lambda s: F.when(norm_match(t) != s, F.array(t, s)).otherwise(F.array(t))),
        )
    )
    return F.slice(distinct_titles(both), 1, most)


def _primary(aliases: Column, grouped: Column) -> Column:
    safe = F.filter(aliases, lambda a: norm_match(a) == titles.search_safe(a))
    return F.when(grouped, F.coalesce(F.get(safe, F.lit(0)), F.get(aliases, F.lit(0)))).otherwise(F.get(aliases, F.lit(0)))


def _seniority(safe: Column) -> Column:
    out = None
    for words, term in SENIORITY:
        hit = safe.rlike("|".join(words))
        out = F.when(hit, F.lit(term)) if out is None else out.when(hit, F.lit(term))
    return out.otherwise(F.concat(F.lit('"'), F.substring_index(safe, " ", 1), F.lit('"')))


def _phrase(safe: Column, most: int) -> Column:
    """The first words left once seniority and filler words go."""
    for words, _ in SENIORITY:
        for word in sorted(words, key=len, reverse=True):
            safe = F.replace(safe, F.lit(word), F.lit(" "))
    kept = F.filter(F.split(safe, " "), lambda w: (w != "") & ~w.isin(*NOISE_WORDS))
    return F.array_join(F.slice(kept, 1, most), " ")


def plan_queries(profiles: DataFrame, aliases: int = 3, phrase_words: int = 3, places_read: int = 3, board_places: int = 2) -> DataFrame:
    """The queries of every profile with tier and position.

    A family has at most `aliases` names, a broad query `phrase_words` words of its
    title; `places_read` of the wishes are looked at, and boards are searched in
    `board_places` places.
    Families, places and tiers are small arrays bounded by the budgets, so a
    profile is planned within its row; only the finished queries become rows.
    """
    if "target_title_groups" not in profiles.columns:
        profiles = profiles.withColumn("target_title_groups", F.lit(""))
    grouped = title_groups(profiles)
    base = profiles.join(grouped, "profile_id").select(
        "profile_id",
        "groups",
        (clean(F.col("target_title_groups"), False) != "").alias("has_groups"),
        distinct_titles(F.transform("groups", lambda g: g["main_title"])).alias("titles"),
        distinct_titles(split_places(F.col("preferred_locations"))).alias("wishes"),
        distinct_titles(split_csv(F.col("include_keywords"))).alias("keywords"),
        (F.lower(clean(F.col("remote_only"), False)) == "true").alias("remote_only"),
        include_remote(F.col("include_remote")).alias("include_remote"),
        F.when(F.translate(norm_match(F.col("search_strategy")), "_", " ") == "broad recall", F.lit("broad_recall"))
        .otherwise(F.lit("balanced"))
        .alias("strategy"),
    )
    base = base.withColumn("specificity", titles.specificity(F.col("titles")))
    families = F.transform(
        F.slice("groups", F.lit(1), _budget("title_variants")),
        lambda g: _family(
            F.concat(F.array(g["main_title"]), F.transform(F.filter(g["variants"], lambda v: v["selected"]), lambda v: v["title"])),
            aliases,
        ),
    )
    bare = F.flatten(
        F.transform(F.slice("wishes", 1, places_read), lambda w: F.array(w, squeeze(F.replace(w, F.lit(","), F.lit(" ")))))
    )
    remote = F.when(F.col("include_remote"), F.array(F.lit("remote"))).otherwise(F.array().cast("array<string>"))
    variants = F.when(F.col("remote_only"), F.array(F.lit("remote"))).otherwise(
        F.slice(distinct_titles(F.concat(bare, remote)), F.lit(1), _budget("location_variants"))
    )
    base = base.withColumns({"aliases": families, "places": variants})
    base = base.withColumn(
        "families",
        F.transform("aliases", lambda a: F.struct(a.alias("aliases"), _primary(a, F.col("has_groups")).alias("primary"))),
    )
    said = F.flatten(F.transform(F.flatten("aliases"), lambda a: F.split(norm_match(a), " ")))
    fresh = F.get(F.filter("keywords", lambda k: ~F.array_contains(said, norm_match(k))), F.lit(0))
    base = base.withColumn("extra", F.coalesce(F.concat(F.lit(' "'), fresh, F.lit('"')), F.lit("")))

    quoted = lambda items: F.array_join(F.transform(items, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    either = lambda a: F.when(F.size(a) == 1, quoted(a)).otherwise(F.concat(F.lit("("), quoted(a), F.lit(")")))
    at = lambda p: F.concat(F.lit(' "'), p, F.lit('"'))

    def each(build, places: Column) -> Column:
        return F.flatten(F.transform("families", lambda f: F.transform(places, lambda p: build(f, p))))

    extra, places = F.col("extra"), F.col("places")
    ats, career, boards = F.lit(" " + ATS_SITES), F.lit(" " + CAREER_SIGNALS), F.lit(" " + BOARD_SITES)
    everyone = distinct_titles(F.flatten("aliases"))
    lists = {
        "ats_grouped": F.when(
            F.size("families") > 0,
            F.transform(places, lambda p: F.concat(F.lit("("), quoted(everyone), F.lit(")"), at(p), extra, ats)),
        ),
        "ats_broad": each(
            lambda f, p: let(
                titles.search_safe(f["primary"]),
                lambda s: F.when(
                    _phrase(s, phrase_words) != "",
                    F.concat(_seniority(s), F.lit(' "'), _phrase(s, phrase_words), F.lit('"'), at(p), extra, ats),
                ).otherwise(F.lit("")),
            ),
            places,
        ),
        "ats_strict": each(lambda f, p: F.concat(either(f["aliases"]), at(p), extra, ats), places),
        "ats_loose": each(lambda f, p: F.concat(f["primary"], F.lit(" "), p, extra, ats), places),
        "career_web": each(lambda f, p: F.concat(either(f["aliases"]), at(p), career), places),
        "job_board_discovery": each(lambda f, p: F.concat(either(f["aliases"]), at(p), boards), F.slice(places, 1, board_places)),
    }

    def tier(name: str) -> Column:
        queries = distinct_titles(F.coalesce(lists[name], F.array().cast("array<string>")))
        return F.transform(
            F.slice(queries, F.lit(1), _budget(name)), lambda q: F.struct(F.lit(name).alias("tier"), q.alias("query"))
        )

    tiers = [tier(name) for name in TIERS]
    planned = base.select("profile_id", _budget("total_queries").alias("total"), F.concat(*tiers).alias("all"))
    keys = planned.withColumn("keys", F.transform("all", lambda q: norm_match(q["query"])))
    once = F.filter("all", lambda q, i: F.array_position("keys", F.get("keys", i)) == i + 1)
    return keys.select("profile_id", F.posexplode(F.slice(once, F.lit(1), F.col("total"))).alias("pos", "q")).select(
        "profile_id", "pos", "q.tier", "q.query"
    )
