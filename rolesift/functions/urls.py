"""URL parts, normal forms, redirect targets and vendors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, contains_any, let

# RFC 3986, appendix B. Total: it matches every text, so nothing can raise.
URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"

# Query keys that only track, by prefix.
TRACKING_PREFIXES = [
    "utm_",
    "gh_",
    "ghsrc",
    "gh_src",
    "lever-",
    "lever_",
    "source",
    "src",
    "ref",
    "refs",
    "trk",
    "tracking",
]
# Hosts of the five known posting vendors.
VENDOR_HOSTS = [
    "jobs.lever.co",
    "job-boards.greenhouse.io",
    "boards.greenhouse.io",
    "jobs.ashbyhq.com",
    "jobs.smartrecruiters.com",
    "myworkdayjobs.com",
]
# Vendor markers in a URL.
VENDOR_MARKERS = [
    ("greenhouse.io", "Greenhouse"),
    ("lever.co", "Lever"),
    ("workday", "Workday"),
    ("ashbyhq.com", "Ashby"),
    ("smartrecruiters.com", "SmartRecruiters"),
]
# Query keys that may carry a redirect target, in order.
REDIRECT_KEYS = ["url", "u", "target", "dest", "destination", "redirect", "redirect_url"]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL, 2)


def host(url: Column) -> Column:
    """The lower-cased authority, port and user kept."""
    return F.lower(authority(url))


def path(url: Column) -> Column:
    """The path without the ';parameters' of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, URL, 3), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL, 4)


def segments(path_text: Column) -> Column:
    return F.filter(F.split(path_text, "/"), lambda p: p != "")


def on_any_host(host_text: Column, markers: Iterable[str]) -> Column:
    return contains_any(host_text, markers)


def parts(url: Column) -> Column:
    """All parts of a URL as one struct."""
    return let(clean(url), _parts)


def _parts(text: Column) -> Column:
    return F.struct(
        text.alias("value"),
        F.lower(text).alias("lowered"),
        scheme(text).alias("scheme"),
        host(text).alias("host"),
        path(text).alias("path"),
        query(text).alias("query"),
        segments(path(text)).alias("segments"),
    )


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    """Form encoding with '~' kept and '*' escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query_text: Column) -> Column:
    """Decoded (key, value) pairs with a non-blank value, in order."""
    pairs = F.filter(F.split(query_text, "&"), lambda p: p.contains("=") & ~p.endswith("=") | p.rlike("=.*[^=]"))
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("key"),
            _decode(F.regexp_extract(p, r"^[^=]*=(?s:(.*))$", 1)).alias("value"),
        ),
    )
    return F.filter(decoded, lambda kv: kv["value"] != "")


def _squeezed_path(url: Column) -> Column:
    squeezed = F.regexp_replace(path(url), r"/{2,}", "/")
    return F.when(F.length(squeezed) > 1, F.regexp_replace(squeezed, r"/$", "")).otherwise(squeezed)


def _join(scheme_text: Column, host_text: Column, path_text: Column, query_text: Column) -> Column:
    return F.concat(
        scheme_text,
        F.when(host_text != "", F.concat(F.lit("://"), host_text)).otherwise(F.lit(":")),
        F.when((host_text != "") & (path_text != "") & ~path_text.startswith("/"), F.concat(F.lit("/"), path_text))
        .otherwise(path_text),
        F.when(query_text != "", F.concat(F.lit("?"), query_text)).otherwise(F.lit("")),
    )


def _or_https(scheme_text: Column) -> Column:
    return F.coalesce(F.nullif(scheme_text, F.lit("")), F.lit("https"))


def canonical(url: Column) -> Column:
    """Lower host without 'www.', one slash, no tracking keys, no fragment."""
    return let(clean(url), _canonical)


def _canonical(text: Column) -> Column:
    tracked = lambda kv: F.lower(kv["key"]).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    kept = F.filter(query_pairs(query(text)), lambda kv: ~tracked(kv))
    query_text = F.array_join(
        F.transform(kept, lambda kv: F.concat(_encode(kv["key"]), F.lit("="), _encode(kv["value"]))), "&"
    )
    rebuilt = _join(
        _or_https(scheme(text)), F.regexp_replace(host(text), r"^www\.", ""), _squeezed_path(text), query_text
    )
    return F.when(text == "", F.lit("")).otherwise(rebuilt)


def light(url: Column) -> Column:
    """Lower scheme and host, squeezed path, query kept, fragment dropped."""
    return let(clean(url, False), _light)


def _light(text: Column) -> Column:
    query_text = query(text)
    rebuilt = F.concat(
        _or_https(scheme(text)),
        F.lit("://"),
        host(text),
        _squeezed_path(text),
        F.when(query_text != "", F.concat(F.lit("?"), query_text)).otherwise(F.lit("")),
    )
    return F.when(text == "", F.lit("")).otherwise(rebuilt)


def vendor_form(url: Column) -> Column:
    """Vendor URLs without query, fragment and a trailing apply step."""
    return let(clean(url), _vendor_form)


def _vendor_form(text: Column) -> Column:
    where = host(text)
    steps = segments(path(text))
    last = F.lower(F.coalesce(F.element_at(F.filter(steps, lambda s: s != ""), -1), F.lit("")))
    base = F.concat(
        F.when(scheme(text) != "", F.concat(scheme(text), F.lit("://"))).otherwise(F.lit("//")), authority(text)
    )
    applies = (where.contains("jobs.lever.co") & (last == "apply")) | (
        where.contains("jobs.ashbyhq.com") & (last == "application")
    )
    without_step = F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/"))
    bare = F.regexp_replace(path(text), r"/+$", "")
    return (
        F.when(text == "", F.lit(""))
        .when(applies, F.concat(base, without_step))
        .when(
            on_any_host(where, VENDOR_HOSTS),
            F.concat(base, F.when(bare == "", F.lit("/")).otherwise(bare)),
        )
        .otherwise(text)
    )


def redirect_target(url: Column) -> Column:
    """The first http(s) URL among seven query keys, '' when there is none."""
    return let(query_pairs(query(clean(url, False))), _redirect_in)


def _redirect_in(pairs: Column) -> Column:
    def first_of(key: str) -> Column:
        return _decode(F.get(F.filter(pairs, lambda kv: kv["key"] == key), F.lit(0))["value"])

    found = [first_of(key) for key in REDIRECT_KEYS]
    http = [F.when(f.rlike("^https?://"), f) for f in found]
    return F.coalesce(*http, F.lit(""))


def resolve(url: Column) -> Column:
    """(url, reason): the redirect target or the URL itself, light form."""
    text = clean(url, False)
    return let(
        F.struct(text.alias("text"), redirect_target(text).alias("target")), lambda u: _resolved(u["text"], u["target"])
    )


def _resolved(text: Column, target: Column) -> Column:
    return F.struct(
        F.when(text == "", F.lit("")).when(target != "", light(target)).otherwise(light(text)).alias("url"),
        F.when(text == "", F.lit("blank"))
        .when(target != "", F.lit("redirect_target"))
        .otherwise(F.lit("direct"))
        .alias("reason"),
    )


def join_relative(base: Column, href: Column) -> Column:
    """An href made absolute against the page it stands on."""
    base_scheme, base_host = scheme(base), authority(base)
    root = F.concat(base_scheme, F.lit("://"), base_host)
    folder = F.regexp_extract(path(base), r"^(.*/)?[^/]*$", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    no_query = F.concat(root, path(base))
    no_fragment = F.regexp_replace(base, r"#(?s:.*)$", "")
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(base_scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(_without_dots(root, F.concat(folder, href)))
    )


def _without_dots(root: Column, path_text: Column) -> Column:
    """Resolve './' and '../' steps of a joined path."""
    tail = F.regexp_extract(path_text, r"([?#](?s:.*))$", 1)
    steps = F.split(F.regexp_extract(path_text, r"^/?([^?#]*)", 1), "/")
    folded = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.concat(root, F.lit("/"), F.array_join(folded, "/"), tail)


def vendor(url: Column) -> Column:
    """The vendor a URL belongs to, else 'Unknown'."""
    text = F.lower(url)
    out = None
    for marker, name in VENDOR_MARKERS:
        out = F.when(text.contains(marker), name) if out is None else out.when(text.contains(marker), name)
    return out.otherwise(F.lit("Unknown"))
