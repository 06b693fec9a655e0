"""Title forms, levels, lanes, families and URL hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import clean, contains_any, distinct_by, fold, let, norm_match, norm_plain

# Abbreviations written out for search.
SEARCH_WORDS = {
    "ai": "artificial intelligence",
    "vp": "vice president",
    "svp": "senior vice president",
    "evp": "executive vice president",
    "avp": "assistant vice president",
    "it": "information technology",
    "hr": "human resources",
    "ops": "operations",
    "infra": "infrastructure",
    "svc": "service",
    "svcs": "services",
    "mgmt": "management",
    "mgr": "manager",
    "eng": "engineering",
    "admin": "administration",
    "biz": "business",
    "prod": "product",
    "mktg": "marketing",
    "fin": "finance",
    "acct": "accounting",
    "corp": "corporate",
    "strat": "strategy",
    "trans": "transformation",
}
GROUP_WORDS = {
    "ai": "artificial intelligence",
    "avp": "assistant vice president",
    "dir": "director",
    "eng": "engineering",
    "evp": "executive vice president",
    "hr": "human resources",
    "infra": "infrastructure",
    "it": "information technology",
    "mgr": "manager",
    "ops": "operations",
    "sr": "senior",
    "strat": "strategy",
    "svp": "senior vice president",
    "svc": "service",
    "svcs": "services",
    "tech": "technology",
    "trans": "transformation",
    "vp": "vice president",
}
# Role prefixes after which 'of' belongs, longest first.
ROLE_PREFIXES = [
    "executive vice president",
    "assistant vice president",
    "senior vice president",
    "vice president",
    "senior manager",
    "managing director",
    "senior director",
    "manager",
    "director",
    "head",
    "chief",
]


def _search_safe(c: Column, words_out: dict[str, str], strip_dots: bool) -> Column:
    table = F.create_map(*[F.lit(x) for kv in words_out.items() for x in kv])
    tokens = F.split(norm_match(c), " ")
    if strip_dots:
        tokens = F.filter(F.transform(tokens, lambda t: F.trim(t, F.lit("."))), lambda t: t != "")
    spelled = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")
    # The first prefix that fits decides; 'of' goes in unless it is there.
    return F.regexp_replace(spelled, "^(" + "|".join(ROLE_PREFIXES) + ") (?!of( |$))(?=.)", "$1 of ")


def search_safe(c: Column) -> Column:
    """Abbreviations written out and 'of' put after a role prefix."""
    return _search_safe(c, SEARCH_WORDS, True)


def group_canonical(c: Column) -> Column:
    """As search_safe, with the shorter word list of title groups."""
    return _search_safe(c, GROUP_WORDS, True)


def search_variants(titles: Column, limit: int = 10) -> Column:
    """One search-safe form per title, distinct, the first `limit`."""
    safe = F.transform(
        distinct_by(titles, norm_match),
        lambda t: let(search_safe(t), lambda s: F.when((s != "") & (norm_match(t) != s), s).otherwise(t)),
    )
    return F.slice(distinct_by(safe, norm_match), 1, limit)


# Titles too wide to search for on their own.
GENERIC_TITLES = [
    "analyst",
    "manager",
    "engineer",
    "developer",
    "director",
    "specialist",
    "consultant",
    "architect",
    "administrator",
    "coordinator",
]


def specificity(titles: Column) -> Column:
    """'generic', 'medium' or 'specific' for a list of titles."""
    norms = F.filter(F.transform(titles, norm_match), lambda t: t != "")

    def judge(ts: Column) -> Column:
        tokens = F.array_distinct(F.flatten(F.transform(ts, lambda t: F.split(t, " "))))
        return (
            F.when(F.size(ts) == 0, F.lit("generic"))
            .when((F.size(ts) == 1) & F.get(ts, F.lit(0)).isin(*GENERIC_TITLES), F.lit("generic"))
            .when(F.size(tokens) <= 2, F.lit("medium"))
            .otherwise(F.lit("specific"))
        )

    return let(norms, judge)


# Nine levels in rank order, and the phrases that name them.
LEVELS = [
    "Individual Contributor",
    "IC Senior",
    "Manager",
    "Sr. Manager",
    "Director",
    "Sr. Director",
    "VP",
    "SVP",
    "C-Suite",
]
LEVEL_PHRASES = [
    ("C-Suite", ["chief", "ceo", "cto", "cio", "ciso", "cdo", "coo", "cao"]),
    ("SVP", ["executive vice president", "senior vice president", "evp", "svp"]),
    ("VP", ["vice president", "vp", "head of"]),
    ("Sr. Director", ["senior director", "sr director"]),
    ("Director", ["director"]),
    ("Sr. Manager", ["senior manager", "sr manager"]),
    ("Manager", ["manager"]),
    ("IC Senior", ["principal", "staff", "lead", "senior", "sr", "architect"]),
    (
        "Individual Contributor",
        [
            "engineer",
            "developer",
            "analyst",
            "specialist",
            "administrator",
            "consultant",
            "designer",
            "scientist",
            "individual contributor",
        ],
    ),
]


def level(title: Column) -> Column:
    """The level a title names; phrases by text, single words by token."""
    return let(norm_match(title), _level_of)


def _level_of(norm: Column) -> Column:
    tokens = F.split(norm, " ")
    out = F.when(norm == "", F.lit(""))
    for name, phrases in LEVEL_PHRASES:
        single = [p for p in phrases if " " not in p]
        hit = contains_any(norm, [p for p in phrases if " " in p])
        if single:
            hit = hit | F.arrays_overlap(tokens, F.array(*[F.lit(p) for p in single]))
        if name == "C-Suite":
            hit = hit | (norm == "president") | norm.startswith("president ")
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit(""))


def level_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), name)


def preferred_levels(c: Column) -> Column:
    """A levels setting as the known level names it lists, in its order."""
    text = clean(c, False)
    separator = F.when(text.contains("\n"), F.lit("\n")).when(text.contains(";"), F.lit(";")).otherwise(F.lit(","))
    raw = F.transform(F.split(F.replace(text, separator, F.lit("\u0001")), "\u0001"), fold)
    table = F.create_map(*[F.lit(x) for name in LEVELS for x in (name.lower(), name)])
    known = F.filter(F.transform(raw, lambda p: F.try_element_at(table, p)), lambda p: p.isNotNull())
    return F.array_distinct(known)


def level_penalty(title: Column, wanted: Column) -> Column:
    """(penalty, detected, reason) of a title against preferred levels."""
    return let(level(title), lambda found: _level_penalty(found, wanted))


def _level_penalty(found: Column, wanted: Column) -> Column:
    rank = level_rank(found).cast("int")
    ranks = F.transform(wanted, lambda n: level_rank(n).cast("int"))
    low, high = F.array_min(ranks), F.array_max(ranks)
    applies = (F.size(wanted) > 0) & (found != "") & ~F.array_contains(wanted, found)
    tail = F.concat(
        F.lit(" (detected: "), found, F.lit("; preferred: "), F.array_join(wanted, ", "), F.lit(")")
    )
    say = lambda head: F.concat(F.lit(head), tail)
    return F.struct(
        F.when(~applies, F.lit(0))
        .when(rank < low, F.least(F.lit(35), F.lit(10) + (low - rank) * 8))
        .when(rank > high, F.least(F.lit(15), F.lit(4) + (rank - high) * 4))
        .otherwise(F.lit(8))
        .alias("penalty"),
        F.when(F.size(wanted) > 0, found).otherwise(F.lit("")).alias("detected"),
        F.when(~applies, F.lit(""))
        .when(rank < low, say("Title level appears below selected job levels"))
        .when(rank > high, say("Title level appears above selected job levels"))
        .otherwise(say("Title level falls outside the selected job levels"))
        .alias("reason"),
    )


# Words that show a leadership level, and a function lane.
LEADERSHIP_WORDS = {
    "chief": ["chief", "ceo", "cto", "cio", "cfo", "coo", "cmo", "cro"],
    "vice_president": ["vp", "avp", "svp", "evp"],
    "director": ["director", "head"],
    "manager": ["manager", "supervisor"],
    "lead": ["lead", "principal"],
}
LANE_WORDS = {
    "technology": [
        "technology",
        "it",
        "information",
        "engineering",
        "software",
        "systems",
        "infrastructure",
        "security",
        "cybersecurity",
        "cyber",
        "architecture",
        "platform",
        "application",
        "applications",
        "data",
        "analytics",
        "digital",
        "product",
        "technical",
    ],
    "ai": ["ai", "artificial", "intelligence"],
    "finance": ["finance", "financial", "accounting", "treasury", "audit", "controller"],
    "operations": [
        "operations",
        "operational",
        "manufacturing",
        "supply",
        "procurement",
        "logistics",
        "construction",
        "plant",
        "facilities",
        "warehouse",
    ],
    "sales": ["sales", "revenue", "commercial", "growth"],
    "marketing": ["marketing", "brand", "communications", "content"],
    "people": ["people", "hr", "human", "talent", "recruiting", "acquisition"],
    "legal": ["legal", "compliance", "privacy", "regulatory", "counsel"],
}


def _groups_hit(tokens: Column, groups: dict[str, list[str]], extra: dict[str, Column]) -> Column:
    names = []
    for name, markers in groups.items():
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(m) for m in markers]))
        if name in extra:
            hit = hit | extra[name]
        names.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*names))


def leadership(norm: Column) -> Column:
    """Leadership groups named by a normal (norm_plain) text."""
    return _groups_hit(
        F.split(norm, " "), LEADERSHIP_WORDS, {"vice_president": norm.contains("vice president")}
    )


def lanes(norm: Column) -> Column:
    """Function lanes named by a normal (norm_plain) text."""
    return _groups_hit(F.split(norm, " "), LANE_WORDS, {})


def signature_fits(levels: Column, lane_names: Column, want_levels: Column, want_lanes: Column) -> Column:
    """No clash: where both sides name a level (or lane) one is shared."""
    clash = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    return ~clash(want_levels, levels) & ~clash(want_lanes, lane_names)


# Role families by title, first rule wins.
FAMILY_RULES = [
    ("Chief Digital Officer", lambda t: t.contains("chief digital officer")),
    ("CIO", lambda t: t.contains("chief information officer") | t.rlike(r"\bcio\b")),
    ("COO", lambda t: t.contains("chief operating officer") | t.rlike(r"\bcoo\b")),
    ("Head of AI", lambda t: t.contains("head of ai") | t.contains("applied ai")),
    ("Head of Platform", lambda t: t.contains("head of platform")),
    ("VP Product Technology", lambda t: t.contains("vp") & t.contains("product") & t.contains("technology")),
    ("VP IT", lambda t: t.contains("vp") & t.contains("it")),
    ("VP Technology", lambda t: t.contains("vp") & t.contains("technology")),
    ("CTO", lambda t: t.contains("chief technology officer") | t.rlike(r"\bcto\b")),
]
OTHER_FAMILY = "Adjacent Near-Exec"


def role_family(title: Column) -> Column:
    low = F.lower(title)
    return F.coalesce(*[F.when(rule(low), F.lit(name)) for name, rule in FAMILY_RULES], F.lit(OTHER_FAMILY))


def normalized_title(title: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.trim(F.lower(title)), r"[^a-z0-9\s]", ""), r"\s+", " "
    )


# Path parts that never name a title.
HINT_IGNORED = [
    "job", "jobs", "careers", "career", "positions", "position", "roles", "role",
    "opportunities", "opportunity", "opening", "openings", "external", "internal",
    "en-us", "en", "us", "apply", "view", "posting", "postings", "detail", "details",
]


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def _opaque(decoded: Column, norm: Column) -> Column:
    """Long parts with digits, or all hexadecimal, carry an id, not words."""
    readable = F.filter(F.split(norm, " "), lambda t: t.rlike(r"^\p{L}+$"))
    worded = (F.size(readable) >= 3) & F.exists(readable, lambda t: F.length(t) >= 4)
    compact = F.regexp_replace(decoded, "[-_%]", "")
    return (F.length(compact) >= 24) & (compact.rlike(r"\d") | F.lower(compact).rlike("^[0-9a-f]+$")) & ~worded


def url_hint(url: Column) -> Column:
    """Words of the last three path parts that may name a title."""
    text = clean(url)
    return let(
        F.struct(urls.host(text).alias("host"), urls.segments(urls.path(text)).alias("steps")),
        lambda u: _hint_of(u["host"], u["steps"]),
    )


def _hint_of(host: Column, steps: Column) -> Column:
    tail = F.slice(steps, F.greatest(F.size(steps) - 2, F.lit(1)), 3)
    ignored = lambda n: (n == "") | n.isin(*HINT_IGNORED)
    named = F.filter(tail, lambda p: ~ignored(norm_plain(p)))
    after_board = let(named, lambda ps: F.when(F.size(ps) >= 2, F.slice(ps, 2, 3)).otherwise(ps))
    chosen = F.when(urls.on_any_host(host, urls.VENDOR_HOSTS), after_board).otherwise(tail)
    worded = F.transform(
        F.transform(chosen, lambda p: _decode(p)),
        lambda p: F.struct(p.alias("part"), norm_plain(p).alias("norm")),
    )
    kept = F.filter(
        worded, lambda w: ~ignored(w["norm"]) & ~w["norm"].rlike(r"^\d+$") & ~_opaque(w["part"], w["norm"])
    )
    enough = lambda h: F.size(F.filter(F.split(h, " "), lambda t: (t != "") & ~t.rlike(r"^\d+$"))) >= 2
    hint = F.array_join(F.transform(kept, lambda w: w["norm"]), " ")
    return let(hint, lambda h: F.when(enough(h), h).otherwise(F.lit("")))


def display_title(company: Column, title: Column) -> Column:
    """'company - title', the company slug spaced out, unless the title
    already contains the company."""
    firm, role = clean(company), clean(title)
    spaced = F.regexp_replace(F.regexp_replace(firm, r"[_\\-]+", " "), "(?<=[a-z])(?=[A-Z])", " ")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return (
        F.when(firm == "", role)
        .when(role == "", firm)
        .when((bare(firm) != "") & bare(role).contains(bare(firm)), role)
        .otherwise(F.concat(spaced, F.lit(" - "), role))
    )
