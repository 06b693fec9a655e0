"""Hand-made pages: what the crawled test pages lack."""

from rolesift.operators import pages

LD = """<script type="application/ld+json">{"title": "CIO", "hiringOrganization": {"name": "Acme Inc"},
 "jobLocation": {"address": {"addressLocality": "Plano", "addressRegion": "TX", "addressCountry": "US"}}}</script>"""


def fields(spark, html, url="https://example.com/x"):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return pages.extract_page_fields(df).collect()[0]


def test_json_ld_fields(spark):
    row = fields(spark, f"<html><head>{LD}</head><body><p>text</p></body></html>")
    assert (row.title, row.page_location, row.page_company, row.text) == ("CIO", "Plano, TX, US", "Acme Inc", "text")


def test_title_cascade(spark):
    og = '<meta property="og:title" content="From og">'
    assert fields(spark, f"<h1>A &amp; <b>B</b></h1><title>T</title>{og}").title == "A & B"
    assert fields(spark, f"<title> T </title>{og}").title == "T"
    assert fields(spark, og).title == "From og"
    assert fields(spark, "", "https://a.wd1.myworkdayjobs.com/en-US/External/job/Dallas-TX/VP-of-IT_R1").title == "VP of IT"


def test_location_cascade(spark):
    assert fields(spark, '<span class="job-Location"> Austin, TX | x</span>').page_location == "Austin, TX"
    assert fields(spark, "<p>Job Location: Denver, CO</p>").page_location == "Denver, CO"
    assert fields(spark, '<meta name="description" content="Work in Boise, ID now">').page_location.endswith("Boise, ID")


def test_company_from_title(spark):
    assert fields(spark, "<title>Job Application for CIO at Acme</title>").page_company == "Acme"
    assert fields(spark, "<title>Engineer - Acme Labs</title>").page_company == "Acme Labs"


def test_expired_pages(spark):
    gone = "<title>Careers</title><h1>The page you are looking for doesn't exist.</h1>"
    rows = [(1, "u", gone + "<a>Search for Jobs</a>"), (2, "u", gone), (3, "u", gone.replace("Careers", "404")), (4, "u", "<h1>Fine</h1>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id for r in pages.expired_pages(df).filter("expired").collect()} == {1, 3}


def test_gateway_links_in_order(spark):
    head = '<link rel="canonical" href="https://jobs.lever.co/a/canon">'
    refresh = '<meta http-equiv="refresh" content="0; url=https://jobs.lever.co/a/refresh">'
    anchor = '<a href="https://jobs.lever.co/a/anchor">x</a>'
    bodies = [head + refresh + anchor, refresh + anchor, anchor, "<a href='/x'>x</a>"]
    urls = [f"https://www.linkedin.com/jobs/view/12345{i}" for i in range(5)]
    crawled = spark.createDataFrame(list(zip(range(4), urls, bodies)), "page_id long, url string, html string")
    seen = spark.createDataFrame(list(enumerate(urls)), "obs_id long, raw_url string")
    got = {r.obs_id: (r.resolved_url, r.resolve_reason) for r in pages.resolve_gateways(seen, crawled).collect()}
    assert [got[i][0] for i in range(5)] == ["https://jobs.lever.co/a/canon", "https://jobs.lever.co/a/refresh", "https://jobs.lever.co/a/anchor", "", ""]
    assert got[3][1] == "no_preferred_link_found" and got[4][1] == "page_resolution_failed"
