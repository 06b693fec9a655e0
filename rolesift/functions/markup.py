"""Text, links and embedded records of an HTML page, by tag patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, strip

# The entities resolved in page text; '&amp;' last.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&#x27;": "'",
    "&amp;": "&",
}
HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1>"
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
JSON_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
# Where a page says its place, in order of trust.
PLACE_TAGS = [
    ("div", "class"),
    ("span", "class"),
    ("div", "data-automation-id"),
    ("span", "data-automation-id"),
    ("li", "class"),
    ("p", "class"),
]


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def text_of(fragment: Column) -> Column:
    """Visible text of a fragment, tags as blanks."""
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(fragment, HIDDEN, " "), r"<[^>]*>", " ")))


def lines_of(html: Column) -> Column:
    """Visible text with every tag as a line break."""
    bare = unescape(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), r"<[^>]*>", "\n"))
    return F.regexp_replace(bare, r"\s*\n\s*", "\n")


def tag_text(html: Column, tag: str) -> Column:
    return text_of(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def meta(html: Column, key: str, name: str) -> Column:
    """A <meta>'s content, whichever of its attributes comes first."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b{key}\s*=\s*["']{name}["'])[^>]*>""", 0)
    return strip(unescape(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)))


def canonical_href(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']canonical["'])[^>]*>""", 0)
    return strip(unescape(F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1)))


def refresh_target(html: Column) -> Column:
    """The URL of a meta refresh, '' when there is none."""
    content = meta(html, "http-equiv", "refresh")
    return F.when(F.lower(content).contains("url="), strip(F.regexp_extract(content, r"=(?s:(.*))$", 1))).otherwise("")


def anchors(html: Column) -> Column:
    """Anchors as (href, text) structs, in page order."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("text"),
    )
    return F.transform(
        pairs, lambda a: F.struct(strip(unescape(a["href"])).alias("href"), text_of(a["text"]).alias("text"))
    )


def place_candidates(html: Column) -> Column:
    """Texts of tags marked as a location, in order of trust."""
    found = [
        F.regexp_extract_all(
            html,
            F.lit(rf"""(?is)<{tag}\b[^>]*\b{attr}\s*=\s*["'][^"']*location[^"']*["'][^>]*>(.*?)</{tag}>"""),
            F.lit(1),
        )
        for tag, attr in PLACE_TAGS
    ]
    return F.transform(F.concat(*found), text_of)


def json_ld(html: Column) -> Column:
    """Every embedded JSON-LD record as a variant, lists flattened one level."""
    raw = F.transform(F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1)), strip)
    return F.filter(F.transform(raw, F.try_parse_json), lambda v: v.isNotNull())


def json_texts(records: Column, paths: list[str]) -> Column:
    """Non-blank texts found at the paths, record by record."""
    each = F.transform(
        records,
        lambda v: F.array(*[strip(F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))) for p in paths]),
    )
    return F.filter(F.flatten(each), lambda t: (t != "") & ~t.startswith("{") & ~t.startswith("["))


def json_addresses(records: Column, roots: list[str]) -> Column:
    """'locality, region, country' per record and root, where given."""

    def address(v: Column, root: str) -> Column:
        parts = [
            F.nullif(strip(F.coalesce(F.try_variant_get(v, f"{root}.{p}", "string"), F.lit(""))), F.lit(""))
            for p in ("addressLocality", "addressRegion", "addressCountry")
        ]
        return F.concat_ws(", ", *parts)

    return F.filter(
        F.flatten(F.transform(records, lambda v: F.array(*[address(v, r) for r in roots]))), lambda t: t != ""
    )
