"""Answers for endpoint selection, source ranking and review lists."""

from __future__ import annotations

from rolesift.operators.ranking import vendor_quotas

from .base import COMPANIES, ENDPOINTS, ENRICHED, OBS, POSTINGS, add, canonical, host, path, plain, segs
from .discovery import REG

SCORED = f"""{ENDPOINTS}, {COMPANIES},
 prof(profile_id, tt, pt, ro, senior) AS (VALUES (0, ['it;', 'head', 'platform'], ['dallas', 'texas'], false, true),
  (1, ['vice', 'president', 'information', 'technology', 'infrastructure'], []::VARCHAR[], true, true), (2, ['data', 'analyst'], ['new', 'york', 'united', 'states'], false, false),
  (3, ['director', 'infrastructure;', 'engineering', 'manager;', 'cto'], []::VARCHAR[], false, true), (4, []::VARCHAR[], ['canada', 'london'], false, false)),
 ep AS (SELECT e.*, name AS company_name, canonical_domain, hq, (endpoint_id % 5)::INT AS profile_id, ats_vendor AS vendor FROM endpoints e JOIN companies c USING (company_id) WHERE active = 1),
 tx AS (SELECT ep.*, tt, pt, ro, senior, {plain("concat_ws(' ', company_name, canonical_domain, hq, notes, endpoint_url, vendor)")} AS txt, lower({path('endpoint_url')}) AS pth FROM ep JOIN prof USING (profile_id)),
 sc AS (SELECT *, CASE review_status WHEN 'approved' THEN 80 WHEN 'unreviewed' THEN 55 WHEN 'needs_review' THEN 45 ELSE 0 END
   + CASE careers_url_status WHEN 'validated' THEN 15 WHEN 'candidate' THEN 5 ELSE 0 END + 15 * is_primary + trunc(confidence_score * 10)::INT + trunc(health_score * 10)::INT
   + CASE WHEN vendor <> 'unknown' THEN 5 ELSE 0 END + 8 * least(3, len(list_filter(tt, lambda t: contains(txt, t)))) + 4 * least(3, len(list_filter(pt, lambda t: contains(txt, t))))
   + CASE WHEN ro AND contains(txt, 'remote') THEN 6 ELSE 0 END AS score,
   vendor IN ('greenhouse', 'lever', 'workday', 'icims', 'sap successfactors') AS seedable,
   CASE WHEN vendor = 'workday' THEN 4 WHEN vendor IN ('icims', 'sap successfactors', 'greenhouse', 'lever') THEN 3 ELSE 1 END AS shape_priority,
   CASE WHEN NOT senior THEN 0 ELSE CASE vendor WHEN 'workday' THEN 5 WHEN 'icims' THEN 4 WHEN 'greenhouse' THEN 3 WHEN 'lever' THEN 3 WHEN 'sap successfactors' THEN 1 ELSE 0 END END AS vendor_priority,
   vendor <> 'unknown' AND careers_url_status = 'validated' AND review_status <> 'rejected' AND confidence_score >= 0.8 AND is_primary = 1 AS preferred FROM tx)"""
add("J1_active_endpoints", f"WITH {ENDPOINTS}, {COMPANIES} SELECT endpoint_id, company_id, name AS company_name, canonical_domain, hq, endpoint_url FROM endpoints JOIN companies USING (company_id) WHERE active = 1")
add("C3_score_endpoints", f"WITH {SCORED} SELECT endpoint_id, profile_id, vendor, score::INT AS score, seedable, shape_priority, vendor_priority, preferred FROM sc")
add("A17_vendor_mix", f"""WITH {SCORED} SELECT vendor, count(*) AS endpoints, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (careers_url_status = 'candidate') AS candidates,
 count(*) FILTER (is_primary = 1) AS primary_endpoints, count(*) FILTER (preferred) AS preferred_pool FROM sc GROUP BY 1 ORDER BY endpoints DESC, vendor LIMIT 5""")
ORDER = "seedable DESC, shape_priority DESC, vendor_priority DESC, vendor <> 'unknown' DESC, score DESC, lower(company_name), lower(endpoint_url), endpoint_id"
TURN = "CASE vendor WHEN 'workday' THEN 0 WHEN 'icims' THEN 1 WHEN 'sap successfactors' THEN 2 WHEN 'greenhouse' THEN 4 WHEN 'lever' THEN 5 ELSE 6 END"


def selection(source: str, cap: int, tag: str = "") -> str:
    """The greedy passes, restated as ranks over the whole table."""
    quota = " ".join(f"WHEN vendor = '{v}' THEN {n}" for v, n in vendor_quotas(cap))
    left = " ".join(f"WHEN lft = {c} AND vendor = '{v}' THEN {n}" for c in range(1, cap + 1) for v, n in vendor_quotas(c))
    t = tag
    return f"""ra{t} AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY {ORDER}) AS r,
   bool_or(preferred) OVER (PARTITION BY profile_id, endpoint_url) AS pu, bool_or(preferred) OVER (PARTITION BY profile_id) AS ap FROM {source}),
 p1{t} AS (SELECT endpoint_id, 0 AS turn FROM ra{t} WHERE NOT senior AND (pu OR NOT ap) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY r) <= {cap}
  UNION ALL SELECT endpoint_id, {TURN} FROM (SELECT * FROM ra{t} WHERE senior AND seedable AND (pu OR NOT ap) QUALIFY row_number() OVER (PARTITION BY profile_id, endpoint_url ORDER BY r) = 1)
   QUALIFY row_number() OVER (PARTITION BY profile_id, vendor ORDER BY r) <= CASE {quota} ELSE 0 END),
 f1{t} AS (SELECT ra{t}.*, turn FROM ra{t} JOIN p1{t} USING (endpoint_id) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY turn, r) <= {cap}),
 re{t} AS (SELECT q.*, {cap} - (SELECT count(*) FROM f1{t} f WHERE f.profile_id = q.profile_id) AS lft FROM (SELECT * FROM ra{t} x WHERE NOT EXISTS (SELECT 1 FROM f1{t} f WHERE f.profile_id = x.profile_id AND f.endpoint_url = x.endpoint_url)
   QUALIFY row_number() OVER (PARTITION BY profile_id, endpoint_url ORDER BY r) = 1) q),
 p2{t} AS (SELECT *, CASE WHEN seedable AND (ap OR NOT senior) AND row_number() OVER (PARTITION BY profile_id, vendor, seedable ORDER BY r) <= CASE {left} ELSE 0 END THEN 2 WHEN seedable THEN 3 ELSE 4 END AS pass_no FROM re{t}),
 al{t} AS (SELECT profile_id, endpoint_id, endpoint_url, vendor, score, r, 1 AS pass_no, turn FROM f1{t} UNION ALL
   SELECT profile_id, endpoint_id, endpoint_url, vendor, score, r, pass_no, CASE WHEN pass_no = 2 THEN {TURN} ELSE 0 END FROM p2{t}),
 sel{t} AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY pass_no, turn, r) AS position FROM al{t} QUALIFY position <= {cap})"""


add("W5_select_endpoints", f"WITH {SCORED}, {selection('sc', 12)} SELECT profile_id, endpoint_id, vendor, score::INT AS score, pass_no, position::INT AS position FROM sel")
add("W5_select_endpoints_by_score", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, lower(company_name), lower(endpoint_url), endpoint_id) AS rn FROM sc)
SELECT profile_id, endpoint_id, vendor, score::INT AS score, (rn - 5)::INT AS position FROM r WHERE rn > 5 AND rn <= 30""")
add("W6_next_batch", f"""WITH {SCORED}, {selection('sc', 5)}, s2 AS (SELECT * FROM sc x WHERE profile_id <> 1 AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.profile_id = x.profile_id AND s.endpoint_url = x.endpoint_url)),
 {selection('s2', 5, 'b')} SELECT profile_id, endpoint_id, pass_no, position::INT AS position FROM selb""")

add("A18_selection_mix", f"""WITH {SCORED}, {selection('sc', 12)}, ch AS (SELECT s.profile_id, s.vendor, company_name, position FROM sel s JOIN sc USING (endpoint_id)),
 v AS (SELECT profile_id, vendor, count(*) AS n, min(position) AS p FROM ch GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY count(*) DESC, min(position)) <= 5),
 f AS (SELECT profile_id, company_name, min(position) AS p FROM ch GROUP BY 1, 2)
SELECT profile_id, (SELECT string_agg(vendor || ' ' || n, ', ' ORDER BY n DESC, p) FROM v WHERE v.profile_id = f.profile_id) AS top_vendors, string_agg(company_name, ', ' ORDER BY p) AS companies FROM f GROUP BY 1""")
RANKED = f"""{REG}, rr AS (SELECT *, seen_count AS s, matching_job_count AS m FROM reg), pr AS (SELECT *, round_even(CASE source_trust WHEN 'ATS Confirmed' THEN 50 WHEN 'Career Site Confirmed' THEN 35 WHEN 'Web Discovered' THEN 20 ELSE 0 END
  + CASE WHEN source_type = 'ATS' THEN 20 ELSE 0 END + least(s, 50) * 0.5 + least(m, 50) * 1.5 + m::DOUBLE / s * 30 + 10, 2)::DOUBLE AS priority_score,
  array_to_string(list_filter([CASE WHEN m / s >= 0.75 THEN 'high yield' WHEN m / s <= 0.15 AND s >= 5 THEN 'low yield' END, CASE WHEN s >= 25 THEN 'high volume' WHEN s <= 2 THEN 'low history' END], lambda x: x IS NOT NULL), ', ') AS notes FROM rr)"""
add("C2_source_priority", f"WITH {RANKED} SELECT source_key, priority_score, notes FROM pr")
add("A9_registry_mix", f"""WITH {REG}, u AS (SELECT 'source_trust' AS dimension, source_trust AS value FROM reg UNION ALL SELECT 'source_type', source_type FROM reg UNION ALL SELECT 'ats_type', ats_type FROM reg UNION ALL SELECT 'hostname', hostname FROM reg),
 c AS (SELECT dimension, value, count(*) AS n FROM u GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) <= 5""")
add("A9_root_rollup", f"WITH {RANKED} SELECT source_root, hostname, ats_type, count(*) AS sources, sum(s)::BIGINT AS seen, sum(m)::BIGINT AS matched, round(avg(priority_score), 2) AS avg_priority FROM pr GROUP BY 1, 2, 3")
add("O3_top_bottom_sources", f"""WITH {RANKED} SELECT 'top' AS side, source_key, priority_score FROM (SELECT * FROM pr ORDER BY priority_score DESC, m DESC, s DESC, source_key LIMIT 15)
UNION ALL SELECT 'bottom', source_key, priority_score FROM (SELECT * FROM pr ORDER BY priority_score, m, s, source_key LIMIT 15)""")
add("O4_low_yield", f"WITH {RANKED} SELECT source_key, seen_count, m % 4 AS matching_job_count FROM pr WHERE s >= 3 AND m % 4 <= 1 ORDER BY priority_score, s DESC, source_key LIMIT 10")
add("W8_split_and_cap_sources", f"""WITH {RANKED}, d AS (SELECT *, priority_score >= 60 OR m >= 3 AS strong FROM pr QUALIFY row_number() OVER (PARTITION BY ats_type, source_root ORDER BY priority_score DESC, m DESC, s DESC, source_key) = 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY ats_type, strong ORDER BY priority_score DESC, m DESC, s DESC, source_root) AS rn, CASE WHEN ats_type = 'Lever' THEN CASE WHEN strong THEN 10 ELSE 5 END ELSE CASE WHEN strong THEN 25 ELSE 15 END END AS cap FROM d)
SELECT ats_type, source_root, strong, rn <= cap AS kept, CASE WHEN rn <= cap THEN rn ELSE 0 END::INT AS rank_in_class FROM k""")
add("W7_cap_per_group", f"WITH {POSTINGS} SELECT posting_id, company FROM postings QUALIFY row_number() OVER (PARTITION BY company ORDER BY posting_id) <= 2")
SCAN = f"""{POSTINGS}, j AS (SELECT *, CASE WHEN NOT (lower(title) LIKE '%vice%' OR lower(title) LIKE '%director%' OR lower(title) LIKE '%head%') THEN 'title'
   WHEN lower(location) LIKE '%canada%' THEN 'location' END AS skip FROM postings),
 c AS (SELECT *, count(*) FILTER (skip IS NULL) OVER (PARTITION BY company ORDER BY posting_id) AS kept_so_far FROM j),
 r AS (SELECT *, kept_so_far < 2 OR (kept_so_far = 2 AND skip IS NULL) AS reached FROM c)"""
add("W7_capped_scan", f"""WITH {SCAN} SELECT company, count(*) FILTER (reached) AS scanned, count(*) FILTER (reached AND skip = 'title') AS title_skips,
 count(*) FILTER (reached AND skip = 'location') AS location_skips, count(*) FILTER (NOT reached) AS not_reached, count(DISTINCT job_posting_url) FILTER (reached AND skip IS NULL) AS kept FROM r GROUP BY 1""")
add("W7_capped_scan_kept", f"WITH {SCAN} SELECT company, min(posting_id) AS posting_id, job_posting_url FROM r WHERE reached AND skip IS NULL GROUP BY company, job_posting_url")
add("W7_wide_cap", f"""WITH {POSTINGS} SELECT profile_id, posting_id, row_number() OVER (PARTITION BY profile_id ORDER BY fit_score DESC NULLS LAST, posting_id) AS place
 FROM postings QUALIFY place <= 3000""")
add("W9_latest_per_key", f"WITH {OBS} SELECT profile_id, provider, run_id, obs_id FROM obs QUALIFY row_number() OVER (PARTITION BY profile_id, provider ORDER BY run_id DESC, obs_id DESC) <= 3")
add("W10_label_latest_run", f"""WITH {POSTINGS} SELECT posting_id, CASE WHEN last_seen_run_id < (SELECT max(last_seen_run_id) FROM postings) THEN '' WHEN posting_id % 3 <= 1 THEN 'Net New' ELSE 'Rediscovered' END AS discovery_state FROM postings""")
OPEN = "postings WHERE workflow_status = 'New' AND active_status = 'Active'"
add("W12_page", f"""WITH {POSTINGS}, o AS (SELECT posting_id, row_number() OVER (ORDER BY fit_score DESC NULLS LAST, company, title, posting_id) AS rn, count(*) OVER () AS n FROM {OPEN})
SELECT posting_id, rn::INT AS row_no, 3::BIGINT AS page_no, n AS total_rows, ceil(n / 25.0)::BIGINT AS total_pages FROM o WHERE rn BETWEEN 51 AND 75""")
add("W12_last_page", f"""WITH {POSTINGS}, o AS (SELECT posting_id, row_number() OVER (ORDER BY fit_score DESC NULLS LAST, company, title, posting_id) AS rn, count(*) OVER () AS n FROM {OPEN})
SELECT posting_id, rn::INT AS row_no, ceil(n / 25.0)::BIGINT AS page_no, n AS total_rows, ceil(n / 25.0)::BIGINT AS total_pages FROM o WHERE rn > (ceil(n / 25.0) - 1) * 25""")
add("W13_new_per_tier", f"""WITH {OBS}, v AS (SELECT (obs_id % 6)::INT AS tier, {canonical('raw_url')} AS url FROM obs), f AS (SELECT url, min(tier) AS tier FROM v GROUP BY 1)
SELECT tier, count(*) AS results, (SELECT count(*) FROM f WHERE f.tier = v.tier) AS new_urls FROM v GROUP BY 1""")
PAY = "coalesce(list_max(list_transform(regexp_extract_all(replace(compensation_raw, ',', ''), '[0-9]+([.][0-9]+)?'), lambda x: x::DOUBLE)), -1)"
TRUST = "CASE source_trust WHEN 'ATS Confirmed' THEN 4 WHEN 'Career Site Confirmed' THEN 3 WHEN 'Web Discovered' THEN 2 ELSE 1 END"
for name, key in {"newest_first": "first_seen_at DESC", "highest_compensation": f"{PAY} DESC", "highest_source_trust": f"{TRUST} DESC", "company_a_z": "lower(company)",
                  "highest_fit_score": "coalesce(fit_score, -1) DESC"}.items():
    add(f"O1_review_sort_{name}", f"""WITH {ENRICHED} SELECT posting_id, company, title FROM enriched WHERE workflow_status = 'New' AND active_status = 'Active'
ORDER BY {key}, fit_score DESC NULLS LAST, company, title, posting_id LIMIT 100""")
add("O2_open_list", f"""WITH {POSTINGS} SELECT posting_id, CASE WHEN title = '' THEN company ELSE company || ' - ' || title END AS display_title, coalesce(fit_score, -1.0) AS fit_score FROM {OPEN}""")
add("O2_applied_list", f"""WITH {POSTINGS} SELECT posting_id, CASE posting_id % 4 WHEN 0 THEN strftime(first_seen_at, '%Y-%m-%d') WHEN 1 THEN strftime(first_seen_at, '%m/%d/%Y') WHEN 2 THEN strftime(first_seen_at, '%Y/%m/%d') ELSE 'soon' END AS applied_date,
 CASE WHEN posting_id % 4 = 3 THEN -1 ELSE date_diff('day', first_seen_at::DATE, DATE '1999-01-01') END::INT AS days_ago FROM postings WHERE workflow_status = 'Applied'""")
assert host and segs
