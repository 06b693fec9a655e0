"""Literal cases of the column packs."""

from pyspark.sql import functions as F

from rolesift.functions import companies, pay, places, text, titles, trust, urls
from rolesift.operators.ranking import vendor_quotas


def test_comma_titles_keep_their_second_half(evaluate):
    got = evaluate(
        ["VP, IT", "Vice President, Information Technology, Infrastructure", "Data Analyst, Analyst", "a; b,c", "x\ny", "Director", ""],
        text.split_titles,
    )
    assert got == [
        ["VP, IT"],
        ["Vice President, Information Technology", "Vice President, Infrastructure"],
        ["Data Analyst", "Analyst"],
        ["a", "b,c"],
        ["x", "y"],
        ["Director"],
        [],
    ]


def test_search_safe_titles(evaluate):
    got = evaluate(["VP of IT", "Head Platform", "SVP, AI", "Sr. Mgr Ops", "Senior Manager", ""], titles.search_safe)
    assert got == [
        "vice president of information technology",
        "head of platform",
        "senior vice president of artificial intelligence",
        "sr manager operations",
        "senior manager",
        "",
    ]


def test_levels(evaluate):
    cases = {
        "Chief Information Officer": "C-Suite",
        "President of Data": "C-Suite",
        "SVP Technology": "SVP",
        "Head of Platform": "VP",
        "Sr. Director": "Director",
        "Senior Director of IT": "Sr. Director",
        "Engineering Manager": "Manager",
        "Staff Engineer": "IC Senior",
        "Data Analyst": "Individual Contributor",
        "Gardener": "",
    }
    assert evaluate(list(cases), titles.level) == list(cases.values())


def test_level_penalties(evaluate):
    wanted = F.array(F.lit("VP"), F.lit("SVP"))
    got = evaluate(["VP of IT", "Engineering Manager", "CIO", "Gardener"], lambda c: titles.level_penalty(c, wanted))
    assert [g.penalty for g in got] == [0, 35, 8, 0]
    assert got[1].reason.startswith("Title level appears below") and got[2].reason.startswith("Title level appears above")


def test_canonical_urls(evaluate):
    cases = {
        "HTTPS://www.A.com//x//y/?utm_source=z&id=5&empty=#frag": "https://a.com/x/y?id=5",
        "https://a.com": "https://a.com",
        "https://a.com/?q=a%20b": "https://a.com/?q=a+b",
        " nan ": "",
        "": "",
    }
    assert evaluate(list(cases), urls.canonical) == list(cases.values())


def test_vendor_forms(evaluate):
    cases = {
        "https://jobs.lever.co/acme/123/apply?x=1": "https://jobs.lever.co/acme/123",
        "https://jobs.ashbyhq.com/acme/vp/application": "https://jobs.ashbyhq.com/acme/vp",
        "https://boards.greenhouse.io/acme/jobs/1/?gh_src=x": "https://boards.greenhouse.io/acme/jobs/1",
        "https://example.com/jobs/1/?a=b": "https://example.com/jobs/1/?a=b",
    }
    assert evaluate(list(cases), urls.vendor_form) == list(cases.values())


def test_redirects_and_relative_links(evaluate):
    got = evaluate(
        ["https://l.com/r?u=x&url=https%3A%2F%2Fjobs.lever.co%2Fa%2Fb", "https://l.com/?u=nope", ""], urls.redirect_target
    )
    assert got == ["https://jobs.lever.co/a/b", "", ""]
    base = F.lit("https://a.com/x/y?z=1")
    got = evaluate(["/p", "q", "../q", "//b.com/r", "https://c.com", "?k=1", "#top"], lambda c: urls.join_relative(base, c))
    assert got == [
        "https://a.com/p",
        "https://a.com/x/q",
        "https://a.com/q",
        "https://b.com/r",
        "https://c.com",
        "https://a.com/x/y?k=1",
        "https://a.com/x/y?z=1#top",
    ]


def test_url_title_hints(evaluate):
    cases = {
        "https://jobs.ashbyhq.com/acme/vice-president-of-it": "vice president of it",
        "https://acme.wd1.myworkdayjobs.com/en-US/External/job/Dallas-TX/Director-of-IT_R12": "director of it_r12",
        "https://jobs.lever.co/acme/0f2c1ab4-1234-4abc-9def-1234567890ab": "",
        "https://example.com/jobs/123": "",
    }
    assert evaluate(list(cases), titles.url_hint) == list(cases.values())


def test_places(evaluate):
    got = evaluate(
        [
            "Remote in Dallas, TX",
            "Toronto, Ontario, Canada",
            "U.S.",
            "Texas",
            "Remote only remote only x",
            "Hybrid in Seattle, WA / Remote",
            "nan",
        ],
        places.parse,
    )
    assert [(p.city, p.region, p.country, p.is_remote, p.is_blank) for p in got] == [
        ("dallas", "tx", "", True, False),
        ("toronto", "on", "canada", False, False),
        ("", "", "united states", False, False),
        ("", "tx", "", False, False),
        ("only x", "", "", True, False),
        ("seattle", "wa", "", True, False),
        ("", "", "", False, True),
    ]


def test_places_in_text(evaluate):
    got = evaluate(
        ["We are hybrid, based in Austin, TX.", "remote across the United States", "Office: Denver - CO", "in plano now", "nothing"],
        places.infer,
    )
    assert got == ["Austin, TX", "Remote, United States", "Denver, CO", "Plano", "Unknown"]


def test_pay(evaluate):
    lines = ["pays $180,000 - $260,000 a year", "$120K to $150K", "Salary Range: 90000 - 110000", "none"]
    assert evaluate(lines, pay.raw) == ["$180,000 - $260,000", "$120K to $150K", "90000 - 110000", ""]
    assert evaluate(lines, lambda c: pay.status_of_raw(pay.raw(c))) == ["Qualified", "Below Target", "Below Target", "Not Disclosed"]


def test_company_names(evaluate):
    cases = {
        "https://jobs.lever.co/acme-labs/1": "Acme Labs",
        "https://brightsystems.wd5.myworkdayjobs.com/x": "Bright Systems",
        "https://www.example.co/jobs": "Example",
    }
    assert evaluate(list(cases), companies.from_host) == list(cases.values())
    got = evaluate(["VP of IT at Acme", "Careers", "https://acme.com/x", "United States Jobs"], companies.is_generic)
    assert got == [False, True, False, True]


def test_duplicate_keys_lose_field_edges(evaluate):
    assert evaluate(["TestCo|VP-Technology| Remote|1", "a|b c", "a b|c", "nan"], trust.stored_key) == [
        "testco|vp|technology|remote|1",
        "a|b|c",
        "a|b|c",
        "",
    ]


def test_vendor_quotas():
    assert [n for _, n in vendor_quotas(12)] == [5, 3, 1, 1, 1, 1]
    assert [n for _, n in vendor_quotas(25)] == [10, 7, 4, 2, 1, 1]
