"""Posting tables derived from the driver's tables.

Each statement is plain SQL that reads the same in Spark and in the checking
engine, so an oracle can start from the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import spread

#: Rows up to which Spark may broadcast a table.
BROADCAST_ROWS = 100_000

URL_OBSERVATIONS = """
SELECT event_id AS obs_id, ts, CAST(day(ts) AS INT) AS run_id, CAST(user_id % 5 AS INT) AS profile_id,
  CASE event_id % 3 WHEN 0 THEN 'board_a' WHEN 1 THEN 'board_b' ELSE 'search' END AS provider,
  CASE event_id % 10
    WHEN 0 THEN concat('https://jobs.lever.co/org', user_id % 40, '/', (event_id * 7) % 997, '/apply')
    WHEN 1 THEN concat('https://jobs.lever.co/org', user_id % 40, '/', (event_id * 7) % 997)
    WHEN 2 THEN concat('https://www.boards.greenhouse.io/org', user_id % 40, '/jobs/', (event_id * 7) % 997, '?gh_src=feed&utm_source=x')
    WHEN 3 THEN concat('https://boards.greenhouse.io/org', user_id % 40, '/jobs/', (event_id * 7) % 997)
    WHEN 4 THEN concat('https://jobs.ashbyhq.com/org', user_id % 40, '/vice-president-of-', event_type, '/application')
    WHEN 5 THEN concat('https://org', user_id % 40, '.wd1.myworkdayjobs.com/en-US/External/job/Dallas-TX/Director-of-', event_type, '_R', (event_id * 7) % 997)
    WHEN 6 THEN concat('https://www.linkedin.com/jobs/view/', 100000 + (event_id * 7) % 997)
    WHEN 7 THEN concat('https://careers.org', user_id % 40, '.com/search?keyword=', event_type)
    WHEN 8 THEN concat('https://careers.org', user_id % 40, '.com//jobs//it-manager-', (event_id * 7) % 997, '/')
    ELSE '' END AS raw_url
FROM {events}
"""

POSTINGS = """
SELECT o_orderkey AS posting_id, CAST(o_custkey % 5 AS INT) AS profile_id, c_name AS company,
  CASE o_orderkey % 16 WHEN 0 THEN 'Vice President, Information Technology' WHEN 1 THEN 'VP of IT' WHEN 2 THEN 'Vice President, Sales'
    WHEN 3 THEN 'Senior Director of Infrastructure' WHEN 4 THEN 'Engineering Manager' WHEN 5 THEN 'Chief Technology Officer'
    WHEN 6 THEN 'Data Analyst' WHEN 7 THEN 'Head of Platform' WHEN 8 THEN 'SVP Technology & Data' WHEN 9 THEN 'Staff Engineer'
    WHEN 10 THEN 'Product Manager' WHEN 11 THEN 'Director, Enterprise Applications' WHEN 12 THEN 'HR Business Partner'
    WHEN 13 THEN 'Sr Manager - Cloud/Platform' WHEN 14 THEN '' ELSE 'VP AI' END AS title,
  CASE o_custkey % 12 WHEN 0 THEN 'Remote' WHEN 1 THEN 'United States Remote' WHEN 2 THEN 'Dallas, TX' WHEN 3 THEN 'Hybrid in Seattle, WA'
    WHEN 4 THEN 'Innovation Campus (Dallas), United States of America' WHEN 5 THEN 'Toronto, Ontario, Canada' WHEN 6 THEN 'London, UK'
    WHEN 7 THEN 'Texas' WHEN 8 THEN '' WHEN 9 THEN 'Plano - TX' WHEN 10 THEN 'Mexico Remote' ELSE 'New York, NY' END AS location,
  CASE o_orderkey % 4 WHEN 0 THEN concat('https://jobs.lever.co/org', o_custkey % 40, '/', o_orderkey % 5000)
    WHEN 1 THEN concat('https://careers.org', o_custkey % 40, '.com/careers/job/', o_orderkey % 5000)
    WHEN 2 THEN concat('https://www.indeed.com/viewjob?jk=', o_orderkey % 5000) ELSE concat('https://org', o_custkey % 40, '.com/p/', o_orderkey % 5000) END AS job_posting_url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Lever' ELSE 'Unknown' END AS ats_type,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '$180,000 - $260,000' WHEN 2 THEN '$120K to $150K' WHEN 3 THEN 'Not Disclosed' ELSE 'Salary Range: 90000 - 110000' END AS compensation_raw,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 101 AS DOUBLE) END AS fit_score,
  CASE o_orderstatus WHEN 'F' THEN 'Applied' ELSE 'New' END AS workflow_status,
  CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 THEN 'Removed' ELSE 'Active' END AS active_status,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS last_seen_run_id, o_orderdate AS first_seen_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: What parsing the page of an observation gave: the posting of the same number, seen by the observation's profile.
OBSERVED_POSTINGS = POSTINGS.replace("CAST(o_custkey % 5 AS INT) AS profile_id", "CAST(user_id % 5 AS INT) AS profile_id").replace(
    "ON o_custkey = c_custkey", "ON o_custkey = c_custkey JOIN {events} ON event_id = o_orderkey"
)
PAGE_STATUS = "CASE WHEN {id} % 23 = 0 THEN '404' WHEN {id} % 29 = 0 THEN 'expired' WHEN {id} % 31 = 0 THEN '500' ELSE 'ok' END"

ENDPOINTS = """
SELECT p_partkey AS endpoint_id, CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS BIGINT) AS company_id,
  CASE p_partkey % 6 WHEN 0 THEN 'workday' WHEN 1 THEN 'icims' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'lever' WHEN 4 THEN 'sap successfactors' ELSE 'unknown' END AS ats_vendor,
  CASE p_partkey % 6 WHEN 0 THEN concat('https://org', p_partkey % 300, '.wd1.myworkdayjobs.com/en-US/External') WHEN 2 THEN concat('https://boards.greenhouse.io/org', p_partkey % 300)
    WHEN 3 THEN concat('https://jobs.lever.co/org', p_partkey % 300) ELSE concat('https://careers.org', p_partkey % 300, '.com/jobs') END AS endpoint_url,
  CASE p_size % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'unreviewed' ELSE 'rejected' END AS review_status,
  CASE p_size % 3 WHEN 0 THEN 'validated' WHEN 1 THEN 'candidate' ELSE 'blocked' END AS careers_url_status,
  CAST((p_partkey * 13) % 101 AS DOUBLE) / 100 AS confidence_score, CAST((p_partkey * 7) % 101 AS DOUBLE) / 100 AS health_score,
  CAST(p_partkey % 2 AS INT) AS is_primary,
  CASE WHEN p_size % 4 = 3 THEN 0 ELSE 1 END AS active, concat(p_name, ' ', p_type) AS notes
FROM {part}
"""

COMPANIES = """
SELECT CAST(s_suppkey AS BIGINT) AS company_id, s_name AS name,
  CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat(replace(lower(s_name), '#', ''), '.com') END AS canonical_domain,
  n_name AS hq, 1 AS company_active
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

PROFILES = """
SELECT CAST(r_regionkey AS INT) AS profile_id, concat('profile ', r_regionkey) AS profile_name,
  CASE r_regionkey WHEN 0 THEN 'VP of IT; Head of Platform' WHEN 1 THEN 'Vice President, Information Technology, Infrastructure'
    WHEN 2 THEN concat('Data Analyst', chr(10), 'Analyst') WHEN 3 THEN 'Director of Infrastructure; Engineering Manager; CTO' ELSE '' END AS target_titles,
  CASE r_regionkey WHEN 0 THEN 'Dallas, TX; Texas' WHEN 2 THEN 'New York, NY; United States' WHEN 4 THEN concat('Canada', chr(10), 'London, UK') ELSE '' END AS preferred_locations,
  CASE r_regionkey WHEN 0 THEN 'platform, cloud' WHEN 2 THEN 'data' WHEN 3 THEN 'director, sr' ELSE '' END AS include_keywords,
  CASE r_regionkey WHEN 0 THEN 'sales' WHEN 1 THEN 'hr, product' WHEN 4 THEN 'staff' ELSE '' END AS exclude_keywords,
  CASE r_regionkey WHEN 1 THEN 'true' ELSE 'false' END AS remote_only,
  CASE r_regionkey WHEN 2 THEN 'false' WHEN 1 THEN '' ELSE 'true' END AS include_remote,
  CASE r_regionkey WHEN 1 THEN 'broad recall' ELSE 'balanced' END AS search_strategy,
  CASE r_regionkey WHEN 0 THEN 'VP, SVP' WHEN 1 THEN 'director' WHEN 2 THEN 'Individual Contributor; IC Senior' WHEN 3 THEN 'C-Suite' ELSE '' END AS preferred_job_levels
FROM {region}
"""

# As many profiles as customers, with the same five kinds of settings.
MANY_PROFILES = (
    PROFILES.replace("CAST(r_regionkey AS INT)", "CAST(c_custkey AS INT)")
    .replace("r_regionkey", "c_custkey % 5")
    .replace("{region}", "{customer}")
)

MODEL_RESULTS = """
SELECT doc_id AS result_id,
  CASE WHEN doc_id % 19 = 0 THEN text
    ELSE concat(CASE WHEN doc_id % 2 = 0 THEN 'Here it is: ' ELSE '' END,
      '{{"fit_score": ', (doc_id * 13) % 140 - 20,
      CASE doc_id % 4 WHEN 0 THEN ', "fit_label": "Weird"' WHEN 1 THEN ', "fit_label": "Good Match"' ELSE '' END,
      CASE doc_id % 5 WHEN 0 THEN ', "recommended_action": "Apply"' ELSE '' END,
      CASE doc_id % 3 WHEN 0 THEN ', "confidence": "High"' WHEN 1 THEN ', "confidence": "sure"' ELSE '' END,
      ', "match_reasons": ["lang ', lang, '", "", " source ', source, ' "]',
      ', "gaps_or_risks": ["len ', n_chars % 7, '", "two"]}}') END AS raw_text
FROM {documents}
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(rows: DataFrame) -> DataFrame:
    """The same rows; above ``BROADCAST_ROWS`` they are never sent through the driver for a join.

    Spark judges a table by its compressed files, which are a small part of what the driver has to hold.
    """
    return rows.hint("merge") if rows.count() > BROADCAST_ROWS else rows


def _derive(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: _joined(_read(spark, sf_dir, n)) for n in names})


def _spread(spark: SparkSession, sf_dir: str, text: str, name: str, *columns: str) -> DataFrame:
    """The statement over one table, of which it reads these columns, spread over tasks."""
    return spark.sql(text, **{name: spread(_read(spark, sf_dir, name).select(*columns))})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's own tables."""
    return _read(spark, sf_dir, name)


def url_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, URL_OBSERVATIONS, "events", "event_id", "ts", "user_id", "event_type")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, POSTINGS, "orders", "customer")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _derive(spark, sf_dir, OBSERVED_POSTINGS, "orders", "customer", "events").selectExpr(
        "posting_id AS obs_id", PAGE_STATUS.format(id="posting_id") + " AS page_status", "title", "company", "location", "compensation_raw", "ats_type"
    )
    return rows


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, ENDPOINTS, "part", "supplier")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, COMPANIES, "supplier", "nation")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, PROFILES, "region")


def many_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir, MANY_PROFILES, "customer", "c_custkey")


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, MODEL_RESULTS, "documents")
