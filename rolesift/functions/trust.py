"""Source facts, trust ranks and duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import clean, contains_any, let, norm_key

# Vendors that confirm a source, listing hosts, career paths.
KNOWN_VENDORS = ["Greenhouse", "Lever", "Workday", "Ashby", "SmartRecruiters"]
LISTING_HOSTS = [
    "indeed.com",
    "linkedin.com",
    "glassdoor.com",
    "ziprecruiter.com",
    "monster.com",
    "builtin.com",
    "wellfound.com",
    "otta.com",
    "trueup.io",
]
CAREER_PATHS = ["/careers", "/career", "/jobs", "/job", "/join-us", "/work-with-us"]
# The two rank orders in use. Upserts weigh a listing and a
# web find alike; dedup and review put the web find first.
UPSERT_TRUST = {"Web Discovered": 1, "Third-Party Listing": 1, "Career Site Confirmed": 2, "ATS Confirmed": 3}
REVIEW_TRUST = {"Third-Party Listing": 1, "Web Discovered": 2, "Career Site Confirmed": 3, "ATS Confirmed": 4}
SOURCE_TYPE_RANKS = {
    "Web Discovery": 1,
    "Third-Party Listing": 1,
    "Company Careers": 2,
    "Company Career Site": 2,
    "ATS": 3,
}


def rank(name: Column, order: dict[str, int]) -> Column:
    """A label's rank in one of the orders above, 0 when it has none."""
    text = clean(name)
    out = None
    for label, value in order.items():
        out = F.when(text == label, F.lit(value)) if out is None else out.when(text == label, F.lit(value))
    return out.otherwise(F.lit(0))


def is_known_vendor(vendor: Column) -> Column:
    return clean(vendor).isin(*KNOWN_VENDORS)


def _facts(url: Column, vendor: Column) -> Column:
    """What every source rule needs of a URL, read once."""

    def read(u: Column) -> Column:
        where, low_path = u["host"], F.lower(u["path"])
        listing = F.lit(False)
        for domain in LISTING_HOSTS:
            listing = listing | where.endswith(domain)
        site = (where != "") & ~listing & contains_any(low_path, CAREER_PATHS)
        return F.struct(
            u["value"].alias("url"),
            u["scheme"].alias("scheme"),
            where.alias("host"),
            F.coalesce(F.get(u["segments"], F.lit(0)), F.lit("")).alias("slug"),
            clean(vendor).alias("vendor"),
            F.when(is_known_vendor(vendor), F.lit("vendor"))
            .when(site, F.lit("site"))
            .when(listing, F.lit("listing"))
            .otherwise(F.lit("web"))
            .alias("kind"),
        )

    return let(urls.parts(url), read)


def _by_kind(kind: Column, vendor: Column | str, site: str, listing: str, web: str) -> Column:
    return (
        F.when(kind == "vendor", F.lit(vendor) if isinstance(vendor, str) else vendor)
        .when(kind == "site", F.lit(site))
        .when(kind == "listing", F.lit(listing))
        .otherwise(F.lit(web))
    )


def source_type(url: Column, vendor: Column) -> Column:
    return _by_kind(
        _facts(url, vendor)["kind"], "ATS", "Company Careers", "Third-Party Listing", "Web Discovery"
    )


def source_trust(url: Column, vendor: Column) -> Column:
    return _by_kind(
        _facts(url, vendor)["kind"], "ATS Confirmed", "Career Site Confirmed", "Third-Party Listing", "Web Discovered"
    )


def source_detail(url: Column, vendor: Column, hint: Column) -> Column:
    blank = F.lit("")

    def build(f: Column) -> Column:
        board = F.when(f["slug"] != "", F.concat(f["vendor"], F.lit(" board: "), f["slug"])).otherwise(f["vendor"])
        middle = _by_kind(
            f["kind"], board, "Company careers page", "Third-party listing", "Broader web discovery"
        )
        return F.concat_ws(" | ", F.nullif(clean(hint), blank), middle, F.nullif(f["host"], blank))

    return let(_facts(url, vendor), build)


def source_key(url: Column, vendor: Column) -> Column:
    return let(
        _facts(url, vendor),
        lambda f: F.when(
            (f["kind"] == "vendor") & (f["slug"] != ""),
            F.concat_ws("::", F.lower(f["vendor"]), f["host"], F.lower(f["slug"])),
        ).otherwise(f["host"]),
    )


def source_root(url: Column, vendor: Column) -> Column:
    def build(f: Column) -> Column:
        base = F.concat(f["scheme"], F.lit("://"), urls.authority(f["url"]))
        return (
            F.when((f["scheme"] == "") | (f["host"] == ""), f["url"])
            .when((f["kind"] == "vendor") & (f["slug"] != ""), F.concat(base, F.lit("/"), f["slug"]))
            .otherwise(base)
        )

    return let(_facts(url, vendor), build)


# --- duplicate keys --------------------------------------------------------


def stored_key(key: Column) -> Column:
    """Every run of letters and digits, joined by '|'. Field edges vanish."""
    return F.replace(norm_key(key), F.lit(" "), F.lit("|"))


def record_key(company: Column, title: Column, location: Column, requisition: Column | None = None) -> Column:
    """company|title|location|requisition, each squeezed to [a-z0-9]."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    req = F.lit("") if requisition is None else bare(requisition)
    return F.concat_ws("|", bare(company), bare(title), bare(location), req)


def fallback_key(
    company: Column, title: Column, location: Column, vendor: Column, requisition: Column, url: Column
) -> Column:
    """Requisition, else company/title/location, else the canonical URL."""
    firm, req = norm_key(company), norm_key(requisition)
    blank = F.lit("")
    named = F.concat_ws(
        " ", F.nullif(firm, blank), F.nullif(norm_key(title), blank), F.nullif(norm_key(location), blank)
    )
    by_req = F.concat_ws(" ", firm, F.nullif(norm_key(vendor), blank), req)
    return (
        F.when((req != "") & (firm != ""), stored_key(by_req))
        .when(named != "", stored_key(named))
        .otherwise(stored_key(urls.canonical(url)))
    )
