"""Crawled pages and feeds into links and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import companies, markup, pay, places, titles, trust, urls
from ..functions.text import bound, clean, contains_any, let, norm_plain, strip
from .gates import PREFERRED_HOSTS, SENIOR_TITLE_PARTS, is_detail_url, is_gateway_host, is_preferred_host
from .lineage import cut
from .matching import match_seed_place, match_seed_title
from .ordered import top_n

# Phrases of a page that is gone, and what goes with them.
EXPIRED_PHRASES = [
    "the page you are looking for doesn't exist",
    "the page you are looking for does not exist",
    "this job is no longer available",
    "job no longer available",
    "job posting no longer available",
    "this position has been filled",
    "this requisition has been filled",
    "this opportunity is no longer available",
]
EXPIRED_SUPPORT = ["search for jobs", "search jobs", "view all jobs", "back to jobs", "back to careers"]


def extract_links(pages: DataFrame, base: str = "url") -> DataFrame:
    """Every link of every page, absolute, in page order."""
    rows = pages.select("page_id", F.col(base).alias("_base"), F.posexplode(markup.anchors(F.col("html"))).alias("pos", "a"))
    return rows.select(
        "page_id",
        "pos",
        F.col("a.href").alias("href"),
        F.col("a.text").alias("text"),
        urls.join_relative(F.col("_base"), F.col("a.href")).alias("url"),
    )


def posting_links(pages: DataFrame, base: str = "url") -> DataFrame:
    """Links to postings whose text names a target title, distinct.

    Rows carry the prepared profile's targets. A board page counts links
    under its own slug as well as '/jobs/' links.
    """
    held = pages.select("page_id", F.col(base).alias("_board"), "targets")
    rows = extract_links(pages, base).filter("href <> '' AND text <> ''").join(held, "page_id")
    slug = F.regexp_extract("_board", r"^https://jobs\.lever\.co/([^/?#]+)", 1)
    own = (slug != "") & F.col("url").contains(F.concat(F.lit("jobs.lever.co/"), slug, F.lit("/")))
    low = F.lower("text")
    named = F.when(F.size("targets") == 0, contains_any(low, SENIOR_TITLE_PARTS)).otherwise(
        F.exists("targets", lambda t: low.contains(F.lower(t)))
    )
    kept = rows.filter((F.col("url").contains("/jobs/") | own) & named)
    return kept.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def resolve_gateways(observations: DataFrame, pages: DataFrame, url: str = "raw_url") -> DataFrame:
    """A gateway URL's preferred target, read off its crawled page.

    Canonical link, then meta refresh, then anchors; the first preferred host
    wins. Pages are reduced to one link per URL before the join.
    """
    per_page = pages.select(
        urls.light(F.col("url")).alias("_light"),
        F.col("url").alias("_base"),
        F.array(markup.canonical_href(F.col("html")), markup.refresh_target(F.col("html"))).alias("_heads"),
        F.transform(markup.anchors(F.col("html")), lambda a: a["href"]).alias("_hrefs"),
        "page_id",
    )
    links = per_page.select("_light", "page_id", "_base", F.posexplode(F.concat("_heads", "_hrefs")).alias("_pos", "_href"))
    absolute = links.filter("_href <> ''").withColumn("_target", urls.light(urls.join_relative(F.col("_base"), F.col("_href"))))
    good = absolute.filter(contains_any(urls.host(F.col("_target")), PREFERRED_HOSTS))
    first = top_n(good, ["_light"], [F.asc("page_id"), F.asc("_pos")]).select("_light", "_target")
    crawled = per_page.select("_light").distinct().withColumn("_crawled", F.lit(True))

    seen = observations.withColumn("_light", urls.light(F.col(url))).withColumn("_u", urls.parts(F.col("_light")))
    found = crawled.join(first, "_light", "left")
    # Blank URLs have no page and would meet in one task of the join.
    blank = seen.filter("_light = ''").withColumns({"_crawled": F.lit(None).cast("boolean"), "_target": F.lit(None).cast("string")})
    joined = seen.filter("_light <> ''").join(found, "_light", "left").unionByName(blank)
    u = F.col("_u")
    reason = (
        F.when(F.col("_light") == "", F.lit("blank"))
        .when(is_preferred_host(u), F.lit("already_preferred"))
        .when(~is_gateway_host(u), F.lit("non_discovery_host"))
        .when(~is_detail_url(u), F.lit("discovery_non_detail"))
        .when(F.col("_crawled").isNull(), F.lit("page_resolution_failed"))
        .when(F.col("_target").isNotNull(), F.lit("page_extracted_preferred"))
        .otherwise(F.lit("no_preferred_link_found"))
    )
    return joined.withColumn("resolve_reason", reason).withColumn(
        "resolved_url",
        F.when(F.col("resolve_reason") == "already_preferred", F.col("_light"))
        .when(F.col("resolve_reason") == "page_extracted_preferred", F.col("_target"))
        .otherwise(F.lit("")),
    ).drop("_light", "_u", "_crawled", "_target")


def expired_pages(pages: DataFrame) -> DataFrame:
    """pages that say the posting is gone, and 404s of vendor hosts.

    Adds `expired` and `expired_reason`; a `status` column is optional.
    """
    text = F.lower(markup.text_of(F.col("html")))
    title = F.lower(markup.tag_text(F.col("html"), "title"))

    def said(s: Column) -> Column:
        phrase = F.coalesce(*[F.when(s["text"].contains(p) | s["title"].contains(p), F.lit(p)) for p in EXPIRED_PHRASES])
        support = contains_any(s["text"], EXPIRED_SUPPORT) | contains_any(s["title"], ["404", "not found"])
        return F.when(support, phrase)

    # A filter on the reason is pushed down whole; inside ``let`` it cleans the page once.
    reason = let(F.struct(text.alias("text"), title.alias("title")), said)
    if "status" in pages.columns:
        gone = (F.col("status") == 404) & urls.on_any_host(urls.host(F.col("url")), urls.VENDOR_HOSTS)
        reason = F.coalesce(F.when(gone, F.lit("http_404")), reason)
    return (
        pages.withColumn("expired_reason", F.coalesce(reason, F.lit("")))
        .withColumn("expired", F.col("expired_reason") != "")
    )


LD_PLACES = ["$.jobLocation", "$.applicantLocationRequirements", "$.location"]
LD_FIRMS = ["$.hiringOrganization", "$.organization", "$.publisher", "$.company"]


def _slug_words(part: Column) -> Column:
    """A URL slug as words, its trailing '_id' dropped."""
    text = strip(F.regexp_replace(F.coalesce(F.try_url_decode(part), part), r"_[A-Za-z0-9-]+$", ""))
    return F.trim(F.regexp_replace(F.translate(text, "-_", "  "), r"\s+", " "), F.lit(" -|,"))


def slug_fields(url: Column) -> Column:
    """(title, location) of a workday-style '/job/place/title' URL."""
    steps = urls.segments(urls.path(url))
    low = F.transform(steps, F.lower)
    at = F.array_position(low, "job").cast("int")
    tail = F.when(at > 0, F.slice(steps, at + 1, F.greatest(F.size(steps), F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    ignored = ["apply", "applymanually", "usemylastapplication", "external", "en-us", "en", "us"]
    kept = F.filter(tail, lambda p: ~F.lower(p).isin(*ignored))

    def place(words: Column) -> Column:
        low_words = F.lower(words)
        city = F.regexp_extract(words, r"^([A-Za-z .'-]+)\s+([A-Za-z]{2})$", 1)
        region = F.regexp_extract(words, r"^([A-Za-z .'-]+)\s+([A-Za-z]{2})$", 2)
        like = words.rlike(r"\b[A-Za-z .'-]+\s+[A-Za-z]{2}\b") | contains_any(low_words, places.METRO_CITIES)
        return (
            F.when(low_words.isin("remote us", "remote united states"), F.lit("Remote, United States"))
            .when(low_words == "remote", F.lit("Remote"))
            .when(like & (city != ""), F.concat(strip(city), F.lit(", "), F.upper(region)))
            .when(like, words)
            .otherwise(F.lit(""))
        )

    return let(
        kept,
        lambda ps: F.struct(
            F.coalesce(_slug_words(F.try_element_at(ps, F.lit(-1))), F.lit("")).alias("title"),
            F.when(F.size(ps) >= 2, let(_slug_words(F.try_element_at(ps, F.lit(-2))), place))
            .otherwise(F.lit(""))
            .alias("location"),
        ),
    )


def extract_page_fields(pages: DataFrame) -> DataFrame:
    """Title, location, company and plain text of every page.

    The page's markup is read here and not carried on.
    """
    html = F.col("html")
    staged = bound(
        pages,
        {
            "text": markup.text_of(html),
            "_lines": markup.lines_of(html),
            "_ld": markup.json_ld(html),
            "_h1": markup.tag_text(html, "h1"),
            "_title": markup.tag_text(html, "title"),
            "_slug": slug_fields(F.col("url")),
        },
    )
    blank = F.lit("")
    some = lambda c: F.nullif(c, blank)
    workday = F.lower("url").contains("workday")
    ld_title = F.get(markup.json_texts(F.col("_ld"), ["$.title", "$.name"]), F.lit(0))
    title = F.coalesce(
        some(F.col("_h1")), some(F.col("_title")), some(markup.meta(html, "property", "og:title")), ld_title,
        F.when(workday, F.col("_slug.title")), blank,
    )

    stated = F.concat(
        markup.json_addresses(F.col("_ld"), [f"{p}{a}" for p in LD_PLACES for a in (".address", "", "[0].address", "[0]")]),
        markup.json_texts(F.col("_ld"), LD_PLACES),
        markup.place_candidates(html),
    )
    labelled = F.array(
        *[
            F.regexp_extract("_lines", rf"(?i){label}\s*[:\-]\s*([^\n|]{{3,{n}}})", 1)
            for label, n in (("Location", 80), ("Locations", 120), ("Job Location", 80), ("Primary Location", 80))
        ]
    )
    metas = [markup.meta(html, "name", "keywords"), markup.meta(html, "property", "og:description"),
             markup.meta(html, "name", "description")]
    described = F.array(
        *[F.regexp_extract(m, p, 0) for m in metas for p in (places.CITY_COMMA_STATE, r"\b(Remote(?:,\s*United States)?)\b")]
    )
    tidy = F.transform(F.concat(stated, labelled, described), places.tidy)
    location = F.coalesce(
        F.get(F.filter(tidy, places.looks_like_place), F.lit(0)), F.when(workday, some(F.col("_slug.location"))), blank
    )

    ld_firms = markup.json_texts(F.col("_ld"), [f"{p}{a}" for p in LD_FIRMS for a in ("", ".name", ".legalName", "[0].name")])
    titled = F.regexp_extract("_title", r"(?i)Job Application for .+? at (.+)$", 1)
    pieces = F.reverse(F.filter(F.transform(F.split("_title", r"\s[-|]\s"), strip), lambda p: p != ""))
    site = F.array(
        markup.meta(html, "property", "og:site_name"),
        markup.meta(html, "name", "application-name"),
        markup.meta(html, "name", "apple-mobile-web-app-title"),
        titled,
    )
    names = F.transform(F.concat(ld_firms, site, pieces), companies.tidy)
    company = F.coalesce(F.get(F.filter(names, lambda n: ~companies.is_generic(n)), F.lit(0)), blank)
    hidden = [c for c in staged.columns if c.startswith("_")]
    return bound(staged, {"title": title, "page_location": location, "page_company": company}).drop(*hidden, "html")


# Families that count as a strong title.
STRONG_FAMILIES = [name for name, _ in titles.FAMILY_RULES]


def rough_fit(rows: DataFrame) -> DataFrame:
    """A first fit score, tier and rationale of a parsed record.

    rows: title, location, job_posting_url, text, role_family, ats_type.
    """
    low = F.lower("text")
    kind = places.remote_type(F.col("location"), F.col("text"))
    staged = bound(rows, {"_low": low, "_kind": kind})
    strong = F.col("role_family").isin(*STRONG_FAMILIES)
    ai = contains_any(F.col("_low"), ["ai", "artificial intelligence"])
    lead = contains_any(F.col("_low"), ["vice president", "chief", "head of"])
    tech = contains_any(F.col("_low"), ["platform", "technology", "digital", "it "])
    known = F.col("ats_type") != "Unknown"
    remote, metro = F.col("_kind") == "Fully Remote", F.col("_kind") == "Dallas / DFW"
    points = lambda test, yes, no=0: F.when(test, yes).otherwise(no)
    score = (
        points(strong, 25, 12) + points(ai, 20, 5) + F.when(remote, 15).when(metro, 12).otherwise(0)
        + points(known, 10) + points(lead, 10) + points(tech, 10)
    )
    reasons = F.array_compact(
        F.array(
            F.when(strong, F.concat(F.lit("Strong title alignment: "), "role_family")).otherwise(
                F.lit("Adjacent near-executive role")
            ),
            F.when(ai, F.lit("AI relevance detected in posting")),
            F.when(remote, F.lit("Fully remote role")).when(metro, F.lit("Dallas / DFW role")),
            F.when(known, F.concat(F.lit("Recognized ATS: "), "ats_type")),
            F.when(lead, F.lit("Leadership scope language detected")),
            F.when(tech, F.lit("Technology/platform scope detected")),
        )
    )
    risks = F.array_compact(
        F.array(
            F.when(~ai, F.lit("AI relevance not clearly stated")),
            F.when(~remote & ~metro, F.lit("Location may not fit target geography")),
        )
    )
    risks = F.when(F.size(risks) == 0, F.array(F.lit("No major risks identified"))).otherwise(risks)
    return staged.withColumn("_score", score).withColumns(
        {
            "fit_score": F.least(F.col("_score"), F.lit(100)),
            "fit_tier": F.when(F.col("_score") >= 85, F.lit("Top Priority"))
            .when(F.col("_score") >= 75, F.lit("Strong"))
            .when(F.col("_score") >= 65, F.lit("Review"))
            .otherwise(F.lit("Low")),
            "match_rationale": F.concat(
                F.array_join(F.slice(reasons, 1, 4), "; "), F.lit(" | Risks: "), F.array_join(F.slice(risks, 1, 3), "; ")
            ),
        }
    ).drop("_low", "_kind", "_score")


def build_postings(pages: DataFrame) -> DataFrame:
    """One parsed record per live page (expired ones are left out)."""
    live = expired_pages(pages).filter(~F.col("expired")).drop("expired", "expired_reason")
    fields = extract_page_fields(live)
    named = bound(
        fields,
        {
            "job_posting_url": F.col("url"),
            "company": companies.choose(F.col("page_company"), companies.from_host(F.col("url")), F.col("url")),
            "location": F.coalesce(
                F.nullif(places.tidy(F.col("page_location")), F.lit("")), places.infer(F.col("text"))
            ),
            "ats_type": urls.vendor(F.col("url")),
            "role_family": titles.role_family(F.col("title")),
            "normalized_title": titles.normalized_title(F.col("title")),
            "compensation_raw": pay.raw(F.col("text")),
        },
    )
    scored = rough_fit(named)
    good_title = F.length("normalized_title") > 3
    kind = places.remote_type(F.col("location"), F.col("text"))
    good_place = (kind != "Other") | (F.col("location") == "Unknown")
    named_place = (places.tidy(F.col("location")) != "") & (places.tidy(F.col("location")) != "Unknown")
    named_firm = (clean(F.col("company"), False) != "") & (F.lower(clean(F.col("company"), False)) != "unknown")
    parsed = good_title.cast("int") + named_place.cast("int") + named_firm.cast("int")
    return scored.withColumns(
        {
            "remote_type": places.remote_type(F.col("location")),
            "dallas_dfw_match": places.metro_match(F.col("location")),
            "compensation_status": pay.status_of_raw(F.col("compensation_raw")),
            "validation_status": F.when(good_title & good_place, F.lit("Validated"))
            .when(good_title | good_place, F.lit("Review Needed"))
            .otherwise(F.lit("Rejected")),
            "validation_confidence": F.when(good_title & good_place, F.lit("Medium")).otherwise(F.lit("Low")),
            "ai_priority": F.when(F.lower("text").contains("ai"), F.lit("High")).otherwise(F.lit("Medium")),
            "risk_flags": F.concat_ws(
                "; ",
                F.when(F.col("compensation_raw") == "", F.lit("Compensation not disclosed")),
                F.when(parsed <= 1, F.lit("Low parse confidence")),
            ),
            "duplicate_key": trust.record_key(F.col("company"), F.col("normalized_title"), F.col("location")),
            "status": F.lit("New"),
            "active_status": F.lit("Active"),
        }
    ).withColumnRenamed("text", "description_text").drop("page_company", "page_location")


# --- feeds --------------------------------------------------------------------

FEED_SCHEMA = "struct<total:long,jobPostings:array<struct<title:string,locationsText:string,externalPath:string>>>"
# Fixed value: the group format of delimited feeds (id, title, ..., place).
DELIMITED = (
    r"(?s)(\d{5,})!\|!([^!]{3,}?)!\|!\1!\|!\2!\|!\1!\|!\1!\|!\1!\|!\1!\|!\1!\|!([^!]+)!\|!false!\|!!\|!!\|!!\|!!\|!"
    r"([^!]+)!\|!([^!]+)!\|!(\d+)!\|!Apply!\|!"
)


def board_prefix(endpoint: Column) -> Column:
    """An endpoint's path without a login or search-results tail."""
    return F.regexp_replace(
        F.regexp_replace(F.regexp_replace(urls.path(endpoint), "/+$", ""), r"(?i)/(login|search-results)$", ""), "/+$", ""
    )


def feed_rows(feed_pages: DataFrame) -> DataFrame:
    """JSON feed pages exploded and checked, one row per posting.

    feed_pages: endpoint_id, endpoint_url, pass_no, page_no, body and the
    prepared profile columns. Adds title_ok, place_ok and detail_url.
    """
    body = F.from_json("body", FEED_SCHEMA)
    rows = feed_pages.withColumn("_body", body).select(
        *[c for c in feed_pages.columns if c != "body"], F.posexplode("_body.jobPostings").alias("pos", "p")
    )
    named = rows.withColumns(
        {
            "title": clean(F.col("p.title")),
            "location": clean(F.col("p.locationsText")),
            "_path": clean(F.col("p.externalPath")),
        }
    ).drop("p")
    checked = match_seed_place(match_seed_title(named, "title"), "location")
    base = F.concat(urls.scheme(F.col("endpoint_url")), F.lit("://"), urls.authority(F.col("endpoint_url")))
    rooted = F.when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat(F.lit("/"), "_path"))
    detail = (
        F.when(F.col("_path") == "", F.lit(""))
        .when(F.col("_path").rlike("^https?://"), F.col("_path"))
        .otherwise(F.concat(base, board_prefix(F.col("endpoint_url")), rooted))
    )
    return checked.withColumns(
        {"title_ok": F.col("seed_title_pass"), "place_ok": F.col("seed_place_pass"), "detail_url": detail}
    ).drop("_path", "seed_title_pass", "seed_place_pass", "seed_title_reason", "seed_place_reason")


def flatten_feed(rows: DataFrame) -> DataFrame:
    """Kept detail URLs per endpoint; a later pass only if none kept."""
    # Cut before the filter, which would take the whole matching down with it and have it worked out once for each use.
    kept = cut(rows).filter(F.col("title_ok") & F.col("place_ok") & (F.col("detail_url") != ""))
    first_pass = kept.groupBy("endpoint_id").agg(F.min("pass_no").alias("pass_no"))
    chosen = kept.join(first_pass, ["endpoint_id", "pass_no"])
    return top_n(chosen, ["endpoint_id", "detail_url"], [F.asc("page_no"), F.asc("pos")])


def parse_delimited_feed(feed_pages: DataFrame) -> DataFrame:
    """X5: '!|!'-delimited groups into postings that pass the profile.

    feed_pages: endpoint_id, endpoint_url, body and the prepared profile.
    """
    groups = F.arrays_zip(
        *[F.regexp_extract_all("body", F.lit(DELIMITED), F.lit(i)).alias(n) for i, n in ((1, "id"), (2, "title"), (3, "place"))]
    )
    rows = feed_pages.withColumn("_g", groups).select(
        *[c for c in feed_pages.columns if c != "body"], F.posexplode("_g").alias("pos", "g")
    )
    named = rows.withColumns(
        {
            "job_id": F.col("g.id"),
            "title": clean(markup.unescape(F.col("g.title"))),
            "location": clean(markup.unescape(F.col("g.place"))),
        }
    ).drop("g")
    title, place = norm_plain(F.col("title")), norm_plain(F.col("location"))
    said = lambda c, text, field: F.exists(c, lambda t: (t[field] != "") & text.contains(t[field]))
    title_ok = (F.size("scoring_terms") == 0) | said("scoring_terms", title, "plain")
    remote = place.contains("remote")
    place_ok = (
        F.when(F.col("remote_only"), remote)
        .when(F.col("include_remote") & remote, F.lit(True))
        .when(F.size("wishes") == 0, F.lit(True))
        .otherwise(F.exists("wishes", lambda w: place.contains(norm_plain(w["raw"]))))
    )
    kept = named.filter(title_ok & place_ok)
    link = urls.join_relative(F.col("endpoint_url"), F.concat(F.lit("jobdetail.ftl?job="), "job_id"))
    return top_n(kept.withColumn("detail_url", link), ["endpoint_id", "detail_url"], [F.asc("pos")])


# --- refresh -----------------------------------------------------------------------

NOTED_FIELDS = [("company", "Company"), ("title", "Title"), ("location", "Location"), ("compensation_raw", "Compensation")]


def refresh_diff(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """Notes on changed fields and a changed flag, by posting id.

    A blank new value changes nothing in the notes; the flag compares all
    the given columns, NULL equal to NULL.
    """
    side = new.select("posting_id", *[F.col(c).alias(f"_n_{c}") for c in dict.fromkeys([*compared, *[f for f, _ in NOTED_FIELDS]])])
    joined = old.join(side, "posting_id")
    blank = F.lit("")

    def note(field: str, label: str) -> Column:
        was, now = clean(F.col(field)), clean(F.col(f"_n_{field}"))
        return F.when(
            (now != "") & (now != was),
            F.concat(
                F.lit(f"Live page refresh updated {label}: "), F.coalesce(F.nullif(was, blank), F.lit("blank")), F.lit(" -> "), now
            ),
        )

    same = F.struct(*[F.col(c).alias(c) for c in compared]).eqNullSafe(F.struct(*[F.col(f"_n_{c}").alias(c) for c in compared]))
    return joined.select(
        "posting_id", F.array_compact(F.array(*[note(f, n) for f, n in NOTED_FIELDS])).alias("notes"), (~same).alias("changed")
    )


def refresh_counts(diff: DataFrame) -> DataFrame:
    """How many rows were compared, changed and noted."""
    return diff.agg(
        F.count(F.lit(1)).alias("refreshed"),
        F.count_if("changed").alias("changed"),
        F.count_if(F.size("notes") > 0).alias("noted"),
    )
