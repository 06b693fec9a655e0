"""Profile settings, terms and title groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, titles
from ..functions.text import (
    clean,
    contains_any,
    distinct_by,
    distinct_titles,
    fold,
    let,
    norm_match,
    norm_plain,
    norm_term,
    split_csv,
    split_places,
    split_titles,
    squeeze,
    words,
)
from .ordered import top_n

# Setting keys with their defaults, and accepted aliases.
SETTING_DEFAULTS = {
    "resume_text": "",
    "profile_summary": "",
    "strengths_to_highlight": "",
    "target_titles": "",
    "target_title_groups": "",
    "preferred_job_levels": "",
    "preferred_locations": "",
    "include_keywords": "",
    "exclude_keywords": "",
    "include_remote": "true",
    "remote_only": "false",
    "search_strategy": "broad_recall",
    "minimum_compensation": "",
    "default_min_fit_score": "Any",
    "default_jobs_per_page": "10",
    "default_new_roles_sort": "Newest First",
    "source_layer_mode": "legacy",
}
SETTING_ALIASES = {
    "executive_summary": "profile_summary",
    "default_minimum_fit_score": "default_min_fit_score",
}
RETIRED_SETTINGS = ["require_mark_as_applied"]
# Terms that also stand for others.
TITLE_SYNONYMS = {
    "nurse": [
        "nurse",
        "registered nurse",
        "rn",
        "nursing",
        "nurse practitioner",
        "np",
        "aprn",
        "clinical nurse",
        "care coordinator",
        "care manager",
    ],
    "analyst": [
        "analyst",
        "analytics",
        "analytics engineer",
        "business intelligence",
        "bi",
        "data analyst",
        "reporting analyst",
        "insights",
        "strategy analyst",
        "financial analyst",
        "fp&a",
    ],
    "data analyst": [
        "data analyst",
        "analytics analyst",
        "business intelligence analyst",
        "bi analyst",
        "reporting analyst",
        "analytics engineer",
        "insights analyst",
    ],
    "product": ["product", "product manager", "product owner", "product operations"],
    "engineer": ["engineer", "engineering", "developer", "software", "platform", "infrastructure"],
}
LOCATION_ALIASES = {
    "boston": [
        "boston",
        "boston, ma",
        "greater boston",
        "cambridge",
        "somerville",
        "brookline",
        "quincy",
        "waltham",
        "newton",
        "watertown",
        "lexington",
        "needham",
        "massachusetts",
        "ma",
    ],
    "dallas": [
        "dallas",
        "dallas, tx",
        "plano",
        "frisco",
        "irving",
        "addison",
        "richardson",
        "carrollton",
        "texas",
        "tx",
    ],
    "new york": [
        "new york",
        "new york, ny",
        "nyc",
        "manhattan",
        "brooklyn",
        "queens",
        "bronx",
        "staten island",
        "new york state",
        "ny",
    ],
}
ACRONYMS = {
    "ceo": ["chief executive officer"],
    "cto": ["chief technology officer"],
    "cio": ["chief information officer"],
    "coo": ["chief operating officer"],
    "cfo": ["chief financial officer"],
    "cmo": ["chief marketing officer"],
    "cro": ["chief revenue officer"],
}
# Words of the technology lane, and of other functions.
TECH_TERMS = [
    "technology",
    "information technology",
    "it",
    "digital",
    "platform",
    "infrastructure",
    "enterprise systems",
    "enterprise applications",
    "architecture",
    "engineering",
    "security",
    "cybersecurity",
    "data",
    "ai",
    "artificial intelligence",
    "machine learning",
    "cloud",
    "applications",
    "systems",
    "technical",
]


def _expand(terms: Column, table: dict[str, list[str]]) -> Column:
    """Own term first, then what it stands for, distinct in order."""
    lookup = F.create_map(
        *[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(t.replace("-", " ")) for t in v]))]
    )
    each = F.transform(
        terms,
        lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(lookup, t), F.array().cast("array<string>"))),
    )
    return F.array_distinct(F.filter(F.flatten(each), lambda t: t != ""))


def expand_titles(terms: Column) -> Column:
    return _expand(F.transform(terms, norm_term), TITLE_SYNONYMS)


def expand_places(terms: Column) -> Column:
    return _expand(F.transform(terms, norm_term), LOCATION_ALIASES)


def expand_terms(profiles: DataFrame) -> DataFrame:
    """Expanded title and location terms, one row per term, in order."""
    acronym = _expand(expand_titles(split_titles(F.col("target_titles"))), ACRONYMS)
    both = F.concat(
        F.transform(acronym, lambda t, i: F.struct(F.lit("title").alias("kind"), i.alias("pos"), t.alias("term"))),
        F.transform(
            expand_places(split_places(F.col("preferred_locations"))),
            lambda t, i: F.struct(F.lit("location").alias("kind"), i.alias("pos"), t.alias("term")),
        ),
    )
    return profiles.select("profile_id", F.inline(both))


def include_remote(include: Column) -> Column:
    """Blank means yes, whatever remote_only says."""
    text = F.lower(clean(include, False))
    return (text == "") | (text == "true")


def prepare(profiles: DataFrame, resolver=None) -> DataFrame:
    """Settings text parsed once per profile into the matchers' columns.

    The result has one row per profile and no source text; jobs join it on
    profile_id and leave broadcasting to Spark's own size check.
    """
    parse = resolver or places.parse
    out = profiles.withColumns(
        {
            "targets": split_titles(F.col("target_titles")),
            "wishes": F.transform(split_places(F.col("preferred_locations")), parse),
            "include_list": split_csv(F.col("include_keywords")),
            "exclude_list": split_csv(F.col("exclude_keywords")),
            "remote_only": F.lower(clean(F.col("remote_only"), False)) == "true",
            "include_remote": include_remote(F.col("include_remote")),
            "levels": titles.preferred_levels(F.col("preferred_job_levels")),
        }
    )
    out = out.withColumns(
        {"scoring_titles": titles.search_variants(F.col("targets"), 6), "expanded_titles": expand_titles(F.col("targets"))}
    )
    out = out.withColumns(
        {
            "scoring_terms": F.transform(
                "scoring_titles",
                lambda t: F.struct(
                    t.alias("title"),
                    norm_match(t).alias("norm"),
                    words(norm_match(t)).alias("tokens"),
                    norm_plain(t).alias("plain"),
                    words(norm_plain(t)).alias("plain_tokens"),
                ),
            ),
            "hint_terms": F.transform(
                _expand(F.col("expanded_titles"), ACRONYMS),
                lambda t: F.struct(t.alias("term"), norm_plain(t).alias("plain")),
            ),
        }
    )
    groups = lambda column, field, find: F.array_distinct(
        F.flatten(F.transform(column, lambda t: find(t[field])))
    )
    hint_words = F.flatten(F.transform("hint_terms", lambda t: F.split(t["plain"], " ")))
    return out.select(
        "profile_id",
        "targets",
        "wishes",
        "include_list",
        "exclude_list",
        "remote_only",
        "include_remote",
        "levels",
        "scoring_titles",
        "scoring_terms",
        "expanded_titles",
        "hint_terms",
        contains_any(F.array_join(F.transform("scoring_terms", lambda t: t["norm"]), " "), TECH_TERMS).alias(
            "targets_tech"
        ),
        groups("scoring_terms", "plain", titles.leadership).alias("scoring_levels"),
        groups("scoring_terms", "plain", titles.lanes).alias("scoring_lanes"),
        groups("hint_terms", "plain", titles.leadership).alias("hint_levels"),
        groups("hint_terms", "plain", titles.lanes).alias("hint_lanes"),
        F.array_distinct(F.filter(hint_words, lambda t: (F.length(t) >= 3) | (t == "ai"))).alias("hint_tokens"),
    )


def load_settings(
    stored: DataFrame,
    defaults: dict[str, str] | None = None,
    aliases: dict[str, str] | None = None,
    retired: Sequence[str] = tuple(RETIRED_SETTINGS),
) -> DataFrame:
    """Stored (profile_id, key, value) over defaults, one wide row each.

    An alias counts only where its proper key is not stored; 'nan' is blank;
    a blank include_remote resolves to true.
    """
    defaults, aliases = defaults or SETTING_DEFAULTS, aliases or SETTING_ALIASES
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    proper = F.coalesce(F.try_element_at(table, F.col("key")), F.col("key"))
    known = stored.filter(~F.col("key").isin(*retired)).select(
        "profile_id", proper.alias("name"), clean(F.col("value")).alias("value"), (proper != F.col("key")).alias("alias")
    )
    picked = [
        F.coalesce(
            F.max(F.when((F.col("name") == name) & ~F.col("alias"), F.col("value"))),
            F.max(F.when((F.col("name") == name) & F.col("alias"), F.col("value"))),
            F.lit(default),
        ).alias(name)
        for name, default in defaults.items()
    ]
    wide = known.groupBy("profile_id").agg(*picked)
    return wide.withColumn("include_remote", include_remote(F.col("include_remote")).cast("string"))


def upsert_settings(
    stored: DataFrame, updates: DataFrame, aliases: dict[str, str] | None = None
) -> DataFrame:
    """M6: insert or replace per (profile, key); the last update wins."""
    aliases = aliases or SETTING_ALIASES
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    proper = F.coalesce(F.try_element_at(table, F.col("key")), F.col("key"))
    named = updates.withColumn("key", proper)
    latest = top_n(named, ["profile_id", "key"], [F.col("pos").desc()]).select(
        "profile_id", "key", clean(F.col("value")).alias("new_value")
    )
    return stored.join(latest, ["profile_id", "key"], "full_outer").select(
        "profile_id", "key", F.coalesce("new_value", "value", F.lit("")).alias("value")
    )


# --- title groups ------------------------------------------------------------

MAX_MAIN_TITLES = 10
MAX_VARIANTS = 5
GROUP_SCHEMA = "array<struct<id:string,main_title:string,variants:array<struct<title:string,selected:boolean,source:string>>>>"


def title_groups(profiles: DataFrame) -> DataFrame:
    """A profile's groups as an array; bad JSON falls back to its titles."""
    parsed = F.from_json(squeeze(clean(F.col("target_title_groups"), False)), GROUP_SCHEMA, {"mode": "PERMISSIVE"})
    usable = F.filter(
        F.coalesce(parsed, F.array().cast(GROUP_SCHEMA)), lambda g: squeeze(clean(g["main_title"], False)) != ""
    )
    plain = F.transform(
        distinct_titles(split_titles(F.col("target_titles"))),
        lambda t: F.struct(
            F.lit("").alias("id"),
            t.alias("main_title"),
            F.array().cast("array<struct<title:string,selected:boolean,source:string>>").alias("variants"),
        ),
    )
    # Bound: inside a lambda each of them would be worked out again for every element.
    groups = let(usable, lambda u: F.when(F.size(u) > 0, u).otherwise(plain))
    first = let(groups, lambda gs: _first_of_key(gs, "main_title"))
    return profiles.select(
        "profile_id",
        F.transform(
            F.slice(first, 1, MAX_MAIN_TITLES),
            lambda g: F.struct(
                squeeze(clean(g["main_title"], False)).alias("main_title"),
                _clean_variants(g["variants"], g["main_title"]).alias("variants"),
            ),
        ).alias("groups"),
    )


def _first_of_key(items: Column, field: str) -> Column:
    """The items whose folded field no earlier one has."""
    keys = F.transform(items, lambda x: fold(x[field]))
    return let(keys, lambda ks: F.filter(items, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1))


def _clean_variants(variants: Column, main_title: Column) -> Column:
    """Distinct by folded text, never the main title, at most five."""
    named = F.filter(
        F.coalesce(variants, F.array().cast("array<struct<title:string,selected:boolean,source:string>>")),
        lambda v: (fold(v["title"]) != "") & (fold(v["title"]) != fold(main_title)),
    )
    first = let(named, lambda vs: _first_of_key(vs, "title"))
    return F.transform(
        F.slice(first, 1, MAX_VARIANTS),
        lambda v: F.struct(
            squeeze(clean(v["title"], False)).alias("title"),
            F.coalesce(v["selected"], F.lit(True)).alias("selected"),
            F.coalesce(F.nullif(squeeze(clean(v["source"], False)), F.lit("")), F.lit("ai")).alias("source"),
        ),
    )


def expand_title_groups(profiles: DataFrame) -> DataFrame:
    """(profile, group, variant) rows; position 0 is the main title."""
    rows = title_groups(profiles).select("profile_id", F.posexplode("groups").alias("group_pos", "g"))
    both = F.concat(
        F.array(F.struct(F.lit(0).alias("pos"), F.col("g.main_title").alias("title"), F.lit(True).alias("selected"))),
        F.transform(
            "g.variants",
            lambda v, i: F.struct((i + 1).alias("pos"), v["title"].alias("title"), v["selected"].alias("selected")),
        ),
    )
    return rows.select("profile_id", "group_pos", F.col("g.main_title").alias("main_title"), F.inline(both))


def effective_titles(profiles: DataFrame) -> DataFrame:
    """Main titles and selected variants, and their search forms."""
    flat = F.flatten(
        F.transform(
            "groups",
            lambda g: F.concat(
                F.array(g["main_title"]),
                F.transform(F.filter(g["variants"], lambda v: v["selected"]), lambda v: v["title"]),
            ),
        )
    )
    return title_groups(profiles).select(
        "profile_id",
        distinct_titles(flat).alias("effective"),
        distinct_titles(F.transform(flat, titles.group_canonical)).alias("search"),
    )


def merge_variants(groups: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggested variants in their order, old `selected` flags kept.

    groups: (profile_id, main_title, title, selected) rows of variants and of
    groups without any (title NULL); suggestions: (profile_id, main_title,
    pos, title). Both are joined on keys, never paired within a group.
    """
    group = ["profile_id", "main_title"]
    old = groups.filter(F.col("title").isNotNull()).select(
        *group, fold(F.col("title")).alias("key"), F.col("selected").alias("was")
    )
    first_five = suggestions.filter(F.col("pos") < MAX_VARIANTS).withColumn("key", fold(F.col("title")))
    wanted = first_five.filter((F.col("key") != "") & (F.col("key") != fold(F.col("main_title"))))
    wanted = top_n(wanted, [*group, "key"], [F.col("pos").asc()])
    known = groups.select(*group).distinct()
    return (
        wanted.join(known, group, "left_semi")
        .join(top_n(old, [*group, "key"], [F.col("was").desc()]), [*group, "key"], "left")
        .select(
            *group,
            "pos",
            squeeze(clean(F.col("title"), False)).alias("title"),
            F.coalesce("was", F.lit(True)).alias("selected"),
            F.lit("ai").alias("source"),
        )
    )


# Role words a variant may not move to the front.
FRONTED_ROLES = ["manager", "mgr", "director", "dir"]


def close_variants(suggestions: DataFrame) -> DataFrame:
    """Suggested (profile_id, main_title, pos, title) rows worth keeping.

    Distinct by folded text, the first five, and of those the ones that are
    not the main title, a cut form, or the role word moved to the front.
    """
    group = ["profile_id", "main_title"]
    first_word = lambda c: F.get(words(squeeze(F.translate(fold(c), "/,", "  "))), F.lit(0))
    named = suggestions.withColumn("key", fold(F.col("title"))).filter(F.col("key") != "")
    distinct = top_n(named, [*group, "key"], [F.col("pos").asc()])
    five = top_n(distinct, group, [F.col("pos").asc()], MAX_VARIANTS)
    fronted = ~first_word(F.col("main_title")).isin(*FRONTED_ROLES) & first_word(F.col("title")).isin(*FRONTED_ROLES)
    return five.filter(
        (F.col("key") != fold(F.col("main_title"))) & ~F.col("key").rlike(r"\bvice pres\b") & ~fronted
    ).select(*group, "pos", squeeze(clean(F.col("title"), False)).alias("title"))
