"""Company names from hosts and page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import clean, contains_any, let, squeeze

# Word endings split off a run-together tenant name.
NAME_SUFFIXES = [
    "computer",
    "technologies",
    "technology",
    "solutions",
    "systems",
    "software",
    "services",
    "health",
    "healthcare",
    "financial",
    "group",
    "holding",
    "holdings",
    "partners",
    "networks",
    "labs",
]
LEGAL_SUFFIXES = [
    "llc",
    "inc",
    "inc.",
    "corp",
    "corp.",
    "corporation",
    "ltd",
    "ltd.",
    "limited",
    "gmbh",
    "plc",
]
GENERIC_NAMES = [
    "greenhouse",
    "greenhouse job board",
    "job board",
    "jobs",
    "careers",
    "workday",
    "myworkdayjobs",
    "smartrecruiters",
    "lever",
    "ashby",
    "page_title",
    "page title",
]
GENERIC_PARTS = ["job board", "remote", "work from anywhere", "united states"]
ROLE_WORDS = r"\b(analyst|engineer|manager|director|vice president|svp)\b"
BOARD_HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com"]
TENANT_HOST = r"^([^.]+)\.wd\d+\.myworkdayjobs\.com$"


def _title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    return F.regexp_replace(F.initcap(F.regexp_replace(c, r"([^\p{L}])", "$1 ")), r"([^\p{L}]) ", "$1")


def _tenant_name(slug: Column) -> Column:
    def named(s: Column) -> Column:
        joined = s["joined"]
        split = [
            F.when(
                joined.endswith(x) & (F.length(joined) > len(x)),
                F.concat(_title_case(F.substring(joined, F.lit(1), F.length(joined) - len(x))), F.lit(" " + x.title())),
            )
            for x in NAME_SUFFIXES
        ]
        return F.coalesce(*split, F.nullif(_title_case(s["base"]), F.lit("")), F.lit("Unknown"))

    base = squeeze(F.translate(slug, "-_", "  "))
    return let(base, lambda b: let(F.struct(b.alias("base"), F.replace(F.lower(b), F.lit(" ")).alias("joined")), named))


def from_host(url: Column) -> Column:
    """A company name read off a URL: board slug, tenant, or domain."""
    text = clean(url, False)
    name = F.regexp_replace(F.regexp_replace(urls.host(text), r"^.*@", ""), r":\d*$", "")
    name = F.replace(name, F.lit("www."))
    slug = F.get(urls.segments(urls.path(text)), F.lit(0))
    words = lambda c: _title_case(F.replace(c, F.lit("-"), F.lit(" ")))

    def read(s: Column) -> Column:
        name, slug = s["name"], s["slug"]
        tenant = F.regexp_extract(name, TENANT_HOST, 1)
        labels = F.split(name, r"\.")
        return (
            F.when(contains_any(name, BOARD_HOSTS) & slug.isNotNull(), words(slug))
            .when(tenant != "", _tenant_name(tenant))
            .when(F.size(labels) >= 2, words(F.try_element_at(labels, F.lit(-2))))
            .otherwise(F.coalesce(F.nullif(words(name), F.lit("")), F.lit("Unknown")))
        )

    return let(F.struct(name.alias("name"), slug.alias("slug")), read)


def tidy(c: Column) -> Column:
    """A name candidate without scheme, path and an 'X at' lead."""

    def last_part(text: Column) -> Column:
        pieces = F.filter(F.split(text, r"(?i)\sat\s"), lambda p: F.trim(p) != "")
        last = lambda p: F.trim(F.try_element_at(p, F.lit(-1)), F.lit(" -|,()"))
        return let(pieces, lambda p: F.when(F.size(p) >= 2, last(p)).otherwise(text))

    text = F.regexp_replace(clean(c, False), r"(?i)^https?://", "")
    text = let(F.trim(F.regexp_replace(text, r"(?s)[/#?].*$", "")), last_part)
    return F.trim(squeeze(text), F.lit(" -|,"))


def is_generic(c: Column) -> Column:
    return let(
        F.lower(tidy(c)),
        lambda low: (low == "") | low.isin(*GENERIC_NAMES) | contains_any(low, GENERIC_PARTS) | low.rlike(ROLE_WORDS),
    )


def is_legal_entity(c: Column) -> Column:
    suffixes = F.array(*[F.lit(s) for s in LEGAL_SUFFIXES])
    return F.arrays_overlap(F.split(F.lower(tidy(c)), r"[\s,]+"), suffixes)


def choose(found: Column, fallback: Column, url: Column) -> Column:
    """The name on the page unless it is generic, or a tenant's legal form."""

    def pick(s: Column) -> Column:
        page, host_name = s["page"], s["host_name"]
        legal = urls.host(url).contains("myworkdayjobs.com") & (host_name != "") & is_legal_entity(page)
        return (
            F.when((page != "") & ~is_generic(page), F.when(legal, host_name).otherwise(page))
            .when(host_name != "", host_name)
            .otherwise(page)
        )

    return let(F.struct(tidy(found).alias("page"), tidy(fallback).alias("host_name")), pick)
