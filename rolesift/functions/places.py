"""Location parsing, matching and free-text location hints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, contains_any, let, norm_place, squeeze, strip

# Region codes by name.
STATE_CODES = {
    "alabama": "al",
    "alaska": "ak",
    "arizona": "az",
    "arkansas": "ar",
    "california": "ca",
    "colorado": "co",
    "connecticut": "ct",
    "delaware": "de",
    "district of columbia": "dc",
    "florida": "fl",
    "georgia": "ga",
    "hawaii": "hi",
    "idaho": "id",
    "illinois": "il",
    "indiana": "in",
    "iowa": "ia",
    "kansas": "ks",
    "kentucky": "ky",
    "louisiana": "la",
    "maine": "me",
    "maryland": "md",
    "massachusetts": "ma",
    "michigan": "mi",
    "minnesota": "mn",
    "mississippi": "ms",
    "missouri": "mo",
    "montana": "mt",
    "nebraska": "ne",
    "nevada": "nv",
    "new hampshire": "nh",
    "new jersey": "nj",
    "new mexico": "nm",
    "new york": "ny",
    "north carolina": "nc",
    "north dakota": "nd",
    "ohio": "oh",
    "oklahoma": "ok",
    "oregon": "or",
    "pennsylvania": "pa",
    "rhode island": "ri",
    "south carolina": "sc",
    "south dakota": "sd",
    "tennessee": "tn",
    "texas": "tx",
    "utah": "ut",
    "vermont": "vt",
    "virginia": "va",
    "washington": "wa",
    "west virginia": "wv",
    "wisconsin": "wi",
    "wyoming": "wy",
}
PROVINCE_CODES = {
    "alberta": "ab",
    "british columbia": "bc",
    "manitoba": "mb",
    "new brunswick": "nb",
    "newfoundland and labrador": "nl",
    "nova scotia": "ns",
    "ontario": "on",
    "prince edward island": "pe",
    "quebec": "qc",
    "saskatchewan": "sk",
    "northwest territories": "nt",
    "nunavut": "nu",
    "yukon": "yt",
}
COUNTRY_ALIASES = {
    "us": "united states",
    "u s": "united states",
    "usa": "united states",
    "u s a": "united states",
    "united states of america": "united states",
    "uk": "united kingdom",
    "u k": "united kingdom",
    "great britain": "united kingdom",
    "england": "united kingdom",
    "scotland": "united kingdom",
    "wales": "united kingdom",
}
KNOWN_COUNTRIES = ["united states", "united kingdom", "canada"]
REMOTE_PHRASES = [
    "remote",
    "work from home",
    "wfh",
    "distributed",
    "virtual",
    "telecommute",
    "telecommuting",
    "anywhere",
]
US_SCOPE_PHRASES = [
    "united states",
    "remote united states",
    "remote us",
    "us remote",
    "usa remote",
    "anywhere in us",
    "anywhere in the us",
    "us only",
    "usa only",
    "nationwide",
    "national",
]
LEADING_NOISE = [
    "remote only in",
    "remote only",
    "remote in",
    "remote",
    "hybrid in",
    "hybrid",
    "based in",
    "located in",
    "anywhere in",
    "onsite in",
    "on site in",
    "in",
]
WORK_MODE_PARTS = ["remote", "hybrid", "onsite", "on site"]
# The metro area a posting may match by city name.
METRO_CITIES = [
    "dallas",
    "fort worth",
    "plano",
    "irving",
    "richardson",
    "frisco",
    "addison",
    "arlington",
    "southlake",
    "dfw",
]

_ANY_NOISE = "^(" + "|".join(LEADING_NOISE) + ") "


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


_REGIONS = {**STATE_CODES, **PROVINCE_CODES, **{v: v for v in [*STATE_CODES.values(), *PROVINCE_CODES.values()]}}


def _clean_part(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


def country_of(part: Column) -> Column:
    """The known country a cleaned part names, else NULL."""
    name = F.coalesce(F.try_element_at(_lookup(COUNTRY_ALIASES), part), part)
    return F.when(name.isin(*KNOWN_COUNTRIES), name)


def region_of(part: Column) -> Column:
    """The state or province code a cleaned part names, else NULL."""
    return F.try_element_at(_lookup(_REGIONS), part)


def _strip_noise(norm: Column) -> Column:
    """Leading 'remote in', 'hybrid' and the like removed to a fixed point.

    Every pass that changes the text drops at least one word, so as many
    passes as there are words reach the fixed point.
    """

    def one_pass(text: Column, _: Column) -> Column:
        for noise in LEADING_NOISE:
            text = F.regexp_replace(text, f"^{noise} ", "")
        return text

    return let(
        norm,
        lambda n: F.when(n.rlike(_ANY_NOISE), F.aggregate(F.split(n, " "), n, one_pass)).otherwise(n),
    )


def _first(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def _last(items: Column) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit(""))


def parse(c: Column) -> Column:
    """A location text as a struct of parts and flags."""
    return let(
        clean(c), lambda raw: let(norm_place(raw), lambda norm: let(_strip_noise(norm), lambda bare: _parse(raw, norm, bare)))
    )


def _parse(raw: Column, norm: Column, bare: Column) -> Column:
    no_metro = F.replace(F.replace(bare, F.lit("metro area"), F.lit("")), F.lit("metropolitan area"), F.lit(""))
    named = F.transform(
        F.filter(
            F.transform(F.split(no_metro, "[,/|]+"), _clean_part), lambda p: (p != "") & ~p.isin(*WORK_MODE_PARTS)
        ),
        _named_part,
    )
    kept = lambda parts, field: F.filter(F.transform(parts, lambda p: p[field]), lambda v: v.isNotNull())
    pieces = lambda whole, parts: F.struct(
        F.when(whole["city"].isNull(), F.lit("")).otherwise(_first(kept(parts, "city"))).alias("city"),
        F.when(whole["country"].isNotNull(), F.lit(""))
        .when(whole["region"].isNotNull(), whole["region"])
        .otherwise(_last(kept(parts, "region")))
        .alias("region"),
        F.when(whole["country"].isNotNull(), whole["country"])
        .when(whole["region"].isNotNull(), F.lit(""))
        .otherwise(_last(kept(parts, "country")))
        .alias("country"),
    )
    found = let(_named_part(_clean_part(bare)), lambda whole: let(named, lambda parts: pieces(whole, parts)))
    remote = contains_any(norm, REMOTE_PHRASES)
    return let(
        found,
        lambda f: F.struct(
            raw.alias("raw"),
            norm.alias("normalized"),
            f["city"].alias("city"),
            f["region"].alias("region"),
            f["country"].alias("country"),
            remote.alias("is_remote"),
            norm.contains("hybrid").alias("is_hybrid"),
            (remote & contains_any(norm, US_SCOPE_PHRASES)).alias("is_us_scope_remote"),
            (norm == "").alias("is_blank"),
        ),
    )


def _named_part(part: Column) -> Column:
    """A cleaned part as exactly one of country, region and city."""
    return let(
        F.struct(country_of(part).alias("country"), region_of(part).alias("region"), part.alias("part")),
        lambda p: F.struct(
            p["country"].alias("country"),
            F.when(p["country"].isNull(), p["region"]).alias("region"),
            F.when(p["country"].isNull() & p["region"].isNull(), p["part"]).alias("city"),
        ),
    )


def match_reason(place: Column, wish: Column) -> Column:
    """Why a parsed place meets a parsed wish, NULL when it does not."""
    same_region = (place["region"] != "") & (place["region"] == wish["region"])
    same_city = (place["city"] != "") & (place["city"] == wish["city"])
    has_city, has_region = wish["city"] != "", wish["region"] != ""
    tokens = lambda c, n: F.filter(F.split(c, " "), lambda t: F.length(t) >= n)
    inside = lambda a, b: (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)
    place_tokens = tokens(place["normalized"], 2)
    quote = lambda label, *cols: F.concat(F.lit(label + " '"), F.concat_ws(", ", *cols), F.lit("'"))
    reason = (
        F.when(
            (wish["country"] != "") & ~has_city & ~has_region & (place["country"] == wish["country"]),
            quote("matched country", wish["country"]),
        )
        .when(has_region & ~has_city & same_region, quote("matched region", wish["region"]))
        .when(
            has_city & has_region & same_city & same_region,
            quote("matched city+region", wish["city"], wish["region"]),
        )
        .when(has_city & ~has_region & same_city, quote("matched city", wish["city"]))
        .when(
            place["normalized"].contains(wish["normalized"]), quote("matched normalized phrase", wish["normalized"])
        )
        .when(inside(tokens(wish["normalized"], 2), place_tokens), F.lit("matched by token subset"))
        .when(
            has_city & inside(tokens(wish["city"], 3), place_tokens) & (place["country"] == "united states"),
            F.lit("matched city tokens within us location"),
        )
    )
    return F.when(
        ~place["is_blank"] & ~wish["is_blank"], F.concat(reason, F.lit(" from '"), wish["raw"], F.lit("'"))
    )


def first_match(place: Column, wishes: Column, resolver: Callable[[Column], Column] | None = None) -> Column:
    """The reason of the first wish met, NULL when none is."""
    target = resolver(place["raw"]) if resolver else place
    reasons = F.filter(F.transform(wishes, lambda w: match_reason(target, w)), lambda r: r.isNotNull())
    return F.get(reasons, F.lit(0))


def filter_verdict(place: Column, hit: Column, none: Column, remote_only: Column, include_remote: Column) -> Column:
    """(passed, reason) of the hard location filter.

    hit is first_match's result, none whether there are no wishes at all.
    """
    passed = (
        F.when(remote_only, place["is_remote"])
        .when(include_remote & place["is_remote"], F.lit(True))
        .when(none, ~place["is_blank"])
        .otherwise(hit.isNotNull())
    )
    reason = (
        F.when(remote_only & place["is_remote"], F.lit("remote_only matched remote location"))
        .when(remote_only, F.lit("remote_only_gate"))
        .when(include_remote & place["is_remote"], F.lit("matched remote location"))
        .when(none & ~place["is_blank"], F.lit("no preferred location set"))
        .when(none, F.lit("blank_location_gate"))
        .otherwise(F.coalesce(hit, F.lit("settings_location_gate")))
    )
    return F.struct(passed.alias("passed"), reason.alias("reason"))


# --- free text -----------------------------------------------------------

# Words of partly remote places, and shapes of the place behind them.
HYBRID_MARKERS = [
    "hybrid",
    "remote/in-office",
    "in-office schedule",
    "office at least",
    "days a week",
    "days per week",
]
HYBRID_TEXT_MARKERS = [
    "hybrid",
    "remote/in-office",
    "in-office schedule",
    "work from our",
    "days a week",
    "days per week",
    "office at least",
    "open to candidates in the",
]
HYBRID_PLACE_PATTERNS = [
    r"(?i)open to candidates in the\s+([A-Z][a-zA-Z .'-]+),\s*([A-Z]{2})\s+area",
    r"(?i)based in\s+([A-Z][a-zA-Z .'-]+),\s*([A-Z]{2})",
    r"(?i)located in\s+([A-Z][a-zA-Z .'-]+),\s*([A-Z]{2})",
]
CITY_COMMA_STATE = r"\b([A-Z][a-zA-Z .'-]+),\s*([A-Z]{2})\b"
CITY_DASH_STATE = r"\b([A-Z][a-zA-Z .'-]+)\s*-\s*([A-Z]{2})\b"
# Labels that are never a place, and shapes that are.
LABEL_ONLY = ["location", "locations", "job location", "apply now", "share this job"]
PLACE_SHAPES = [
    r"\b[a-z .'-]+,\s*[A-Z]{2}\b",
    r"\b[A-Z][a-zA-Z .'-]+\s*-\s*[A-Z]{2}\b",
    r"\b[A-Z][a-zA-Z .'-]+\s+Area\b",
    r"\b[A-Z][a-zA-Z .'-]+\s+[A-Z]{2}\b",
]


def tidy(c: Column) -> Column:
    """A location candidate without label, tail and edge marks."""

    def bare(text: Column) -> Column:
        rest = strip(F.regexp_replace(text, r"(?i)^(location|locations)\s*[:\-]?\s*", ""))
        rest = strip(F.regexp_replace(rest, r"\s*\|\s*.*$", ""))
        return F.when(F.lower(text).isin(*LABEL_ONLY), F.lit("")).otherwise(rest)

    return let(F.trim(squeeze(clean(c, False)), F.lit(" -|,")), bare)


def looks_like_place(c: Column) -> Column:
    codes = F.array(*[F.lit(s) for s in STATE_CODES.values()])

    def test(s: Column) -> Column:
        text, low = s["text"], s["low"]
        shape = F.lit(False)
        for pattern in PLACE_SHAPES:
            shape = shape | text.rlike(pattern)
        return (text != "") & (
            low.contains("remote")
            | contains_any(low, METRO_CITIES)
            | shape
            | F.arrays_overlap(F.split(low, r"[\s,/-]+"), codes)
        )

    return let(tidy(c), lambda text: let(F.struct(text.alias("text"), F.lower(text).alias("low")), test))


def _city_state(text: Column, pattern: str) -> Column:
    """City and state of the first match; the text is searched once."""
    part = lambda found, k: strip(F.regexp_extract(found, pattern, k))
    return let(F.regexp_extract(text, pattern, 0), lambda found: F.when(found != "", F.concat(part(found, 1), F.lit(", "), part(found, 2))))


def infer(text: Column) -> Column:
    """A location read from running page text, 'Unknown' when none shows."""

    def read(s: Column) -> Column:
        text, low = s["text"], s["low"]
        upper = lambda c: F.concat(F.substring_index(c, ", ", 1), F.lit(", "), F.upper(F.substring_index(c, ", ", -1)))
        comma, dash = _city_state(text, CITY_COMMA_STATE), _city_state(text, CITY_DASH_STATE)
        metro = F.coalesce(*[F.when(low.contains(m), F.lit(m.title())) for m in METRO_CITIES])
        return F.coalesce(
            F.when(
                contains_any(low, HYBRID_TEXT_MARKERS),
                F.coalesce(*[let(_city_state(text, p), upper) for p in HYBRID_PLACE_PATTERNS], comma, dash),
            ),
            F.when(low.contains("remote") & low.contains("united states"), F.lit("Remote, United States")),
            F.when(low.contains("remote"), F.lit("Remote")),
            comma,
            dash,
            metro,
            F.lit("Unknown"),
        )

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), read)


def remote_type(location: Column, text: Column | None = None) -> Column:
    low = F.lower(location if text is None else F.concat_ws(" ", location, text))
    return let(
        F.struct(low.alias("low"), F.lower(location).alias("place")),
        lambda s: F.when(contains_any(s["low"], HYBRID_MARKERS), F.lit("Hybrid"))
        .when(s["low"].contains("remote"), F.lit("Fully Remote"))
        .when(contains_any(s["place"], METRO_CITIES), F.lit("Dallas / DFW"))
        .otherwise(F.lit("Other")),
    )


def metro_match(location: Column) -> Column:
    low = F.lower(location)
    return F.when(contains_any(low, METRO_CITIES) | low.contains("remote"), F.lit("Yes")).otherwise(F.lit("No"))
