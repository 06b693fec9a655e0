"""Answers for the posting store, settings and the endpoint contract."""

from __future__ import annotations

from rolesift.plans import derived

from .base import COMPANIES, ENDPOINTS, ENRICHED, POSTINGS, add, canonical, sql

RANK = "CASE {} WHEN 'ATS Confirmed' THEN 3 WHEN 'Career Site Confirmed' THEN 2 WHEN 'Web Discovered' THEN 1 WHEN 'Third-Party Listing' THEN 1 ELSE 0 END"
TYPE_RANK = "CASE {} WHEN 'ATS' THEN 3 WHEN 'Company Careers' THEN 2 WHEN 'Web Discovery' THEN 1 WHEN 'Third-Party Listing' THEN 1 ELSE 0 END"
SNAP = f"""{ENRICHED}, canon AS (SELECT *, {canonical('job_posting_url')} AS curl FROM enriched),
 snap AS (SELECT * EXCLUDE (source_trust, applied), CASE WHEN posting_id % 6 = 0 THEN 'Web Discovered' ELSE source_trust END AS source_trust,
   CASE WHEN workflow_status = 'Applied' THEN strftime(first_seen_at, '%Y-%m-%d') ELSE '' END AS applied_date
  FROM (SELECT *, 0 AS applied FROM canon WHERE posting_id % 2 = 0 AND active_status = 'Active'
   QUALIFY row_number() OVER (PARTITION BY duplicate_key ORDER BY posting_id) = 1)),
 tomb AS (SELECT DISTINCT duplicate_key FROM enriched WHERE posting_id % 17 = 0)"""
RESOLVED = f"""{SNAP}, bk AS (SELECT duplicate_key AS k, min(posting_id) AS i FROM snap GROUP BY 1), bc AS (SELECT curl AS k, min(posting_id) AS i FROM snap GROUP BY 1),
 bu AS (SELECT job_posting_url AS k, min(posting_id) AS i FROM snap GROUP BY 1),
 res AS (SELECT c.*, coalesce(bk.i, bc.i, bu.i) AS eid FROM canon c LEFT JOIN bk ON c.duplicate_key = bk.k LEFT JOIN bc ON c.curl = bc.k
   LEFT JOIN bu ON c.job_posting_url = bu.k WHERE posting_id % 3 = 0)"""
UPS = f"""{RESOLVED}, live AS (SELECT * FROM res WHERE duplicate_key NOT IN (SELECT duplicate_key FROM tomb)),
 start AS MATERIALIZED (SELECT coalesce(max(posting_id), 0) AS start FROM snap),
 seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY posting_id) AS i, posting_id AS pos, duplicate_key AS k, curl AS c, job_posting_url AS u FROM live),
 held(kind, id, ent, k, c, u, step) USING KEY (kind, id) AS (
  SELECT 0, posting_id, posting_id, duplicate_key, curl, job_posting_url, 0::BIGINT FROM snap
   WHERE duplicate_key IN (SELECT k FROM seq) OR curl IN (SELECT c FROM seq) OR job_posting_url IN (SELECT u FROM seq)
  UNION ALL SELECT 1, -1, -1, '', '', '', 0
  UNION
  SELECT o.kind, CASE o.kind WHEN 0 THEN e.ent ELSE e.pos END, e.ent, e.k, e.c, e.u, e.i
  FROM (SELECT r.i, r.pos, r.k, r.c, r.u, coalesce(min(x.ent) FILTER (x.k = r.k AND r.k <> ''), min(x.ent) FILTER (x.c = r.c AND r.c <> ''),
     min(x.ent) FILTER (x.u = r.u AND r.u <> ''), any_value(start.start) + r.pos + 1) AS ent
    FROM (SELECT max(step) AS step FROM held) w JOIN seq r ON r.i = w.step + 1 CROSS JOIN start
    LEFT JOIN (SELECT * FROM recurring.held WHERE kind = 0) x ON (x.k = r.k OR x.c = r.c OR x.u = r.u) GROUP BY r.i, r.pos, r.k, r.c, r.u) e
  CROSS JOIN (VALUES (0), (1)) o(kind)),
 ent AS (SELECT live.* EXCLUDE (eid), h.ent AS entity, CASE WHEN h.ent <= start.start THEN h.ent END AS eid FROM live JOIN held h ON h.kind = 1 AND h.id = live.posting_id CROSS JOIN start),
 fold AS (SELECT e.entity, any_value(e.eid) AS eid, min(e.posting_id) AS fp, max(e.posting_id) AS lp, count(*) AS n, bool_or(e.fit_score IS NOT NULL) AS sc,
   list({{'t': {RANK.format('e.source_trust')}, 'd': e.source_detail, 'n': e.source_trust, 'y': {TYPE_RANK.format('e.source_type')}, 'm': e.source_type}} ORDER BY e.posting_id) AS hist FROM ent e GROUP BY 1),
 base AS (SELECT f.*, s.posting_id IS NOT NULL AS old, list_reduce(CASE WHEN s.posting_id IS NULL THEN hist ELSE list_concat([{{'t': {RANK.format('s.source_trust')}, 'd': s.source_detail,
     'n': s.source_trust, 'y': {TYPE_RANK.format('s.source_type')}, 'm': s.source_type}}], hist) END,
   lambda a, x: {{'t': greatest(a.t, x.t), 'd': CASE WHEN a.d = '' THEN x.d WHEN x.t > a.t AND x.d <> '' THEN x.d ELSE a.d END,
    'n': CASE WHEN x.t > a.t THEN x.n ELSE a.n END, 'y': greatest(a.y, x.y), 'm': CASE WHEN x.y > a.y THEN x.m ELSE a.m END}}) AS fin,
   f.entity AS id FROM fold f LEFT JOIN snap s ON f.eid = s.posting_id)"""
add("J2_drop_tombstoned", f"""WITH {SNAP} SELECT profile_id, count(*) FILTER (duplicate_key NOT IN (SELECT duplicate_key FROM tomb)) AS live,
 count(*) FILTER (duplicate_key IN (SELECT duplicate_key FROM tomb)) AS skipped FROM enriched GROUP BY 1""")
add("J3_resolve_existing", f"WITH {RESOLVED} SELECT posting_id AS pos, coalesce(eid, -1) AS existing_id FROM res")
add("M1_upsert_postings", f"""WITH RECURSIVE {UPS}
SELECT b.id AS posting_id, p.company, p.title, p.job_posting_url, p.curl AS canonical_job_posting_url, fin.n AS source_trust, fin.m AS source_type, fin.d AS source_detail,
 CASE WHEN s.workflow_status = 'Applied' THEN 'Applied' ELSE 'New' END AS workflow_status, CASE WHEN s.workflow_status = 'Applied' THEN s.applied_date ELSE '' END AS applied_date,
 p.duplicate_key, coalesce(s.seen, 0) + b.n AS seen_count, 199901::BIGINT AS last_seen_run_id, coalesce(strftime(s.first_seen_at, '%Y-%m-%d'), '1999-01-01') AS first_seen_at,
 '1999-01-01' AS last_seen_at, CASE WHEN b.sc THEN '1999-01-01' ELSE '' END AS last_score_refresh_at
FROM base b JOIN canon p ON p.posting_id = b.lp LEFT JOIN (SELECT *, 1 AS seen FROM snap) s ON s.posting_id = b.eid
UNION ALL SELECT posting_id, company, title, job_posting_url, curl, source_trust, source_type, source_detail, workflow_status, applied_date, duplicate_key, 1, last_seen_run_id,
 strftime(first_seen_at, '%Y-%m-%d'), strftime(first_seen_at, '%Y-%m-%d'), '' FROM snap WHERE posting_id NOT IN (SELECT eid FROM fold WHERE eid IS NOT NULL)""")
add("M1_upsert_outcomes", f"""WITH RECURSIVE {UPS}, o AS (SELECT e.posting_id AS pos, b.id AS job_id, b.old, e.posting_id = b.fp AS fst, coalesce((SELECT last_seen_run_id FROM snap s WHERE s.posting_id = b.eid), 0) = 199901 AS now_seen,
  {RANK.format('e.source_trust')} > coalesce(max({RANK.format('e.source_trust')}) OVER (PARTITION BY e.entity ORDER BY e.posting_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
  AND {RANK.format('e.source_trust')} > coalesce((SELECT {RANK.format('s.source_trust')} FROM snap s WHERE s.posting_id = b.eid), -1) AS up
  FROM ent e JOIN base b USING (entity))
SELECT pos, job_id, CASE WHEN fst AND NOT old THEN 'inserted' ELSE 'updated' END AS status,
 CASE WHEN fst AND NOT old THEN 'net_new' WHEN fst AND NOT now_seen THEN 'rediscovered' ELSE 'duplicate_in_run' END AS discovery_state, up AND (old OR NOT fst) AS trust_promoted FROM o
UNION ALL SELECT posting_id, -1, 'skipped_removed', 'skipped_removed', false FROM res WHERE duplicate_key IN (SELECT duplicate_key FROM tomb)""")
add("M1_upsert_matches", f"WITH RECURSIVE {UPS} SELECT posting_id AS pos, entity AS posting_id FROM ent")
STATE = f"""{ENRICHED}, st AS (SELECT *, lag(last_seen_run_id) OVER (PARTITION BY company, title ORDER BY posting_id) AS prev FROM enriched)"""
add("A4_ingest_summary", f"""WITH {STATE} SELECT last_seen_run_id AS run_id, count(*) AS total_seen, count(*) FILTER (prev IS NULL) AS inserted_count, count(*) FILTER (prev IS NOT NULL) AS updated_count,
 0::BIGINT AS skipped_removed_count, 0::BIGINT AS skipped_invalid_count, count(*) FILTER (prev IS NULL) AS net_new_count,
 count(*) FILTER (prev <> last_seen_run_id) AS rediscovered_count, count(*) FILTER (prev = last_seen_run_id) AS duplicate_in_run_count FROM st GROUP BY 1""")
add("A4_ingest_label_counts", f"""WITH {ENRICHED} SELECT last_seen_run_id AS run_id, 'source_trust' AS label, source_trust AS value, count(*) AS n FROM enriched GROUP BY ALL
UNION ALL SELECT last_seen_run_id, 'source_type', source_type, count(*) FROM enriched GROUP BY ALL""")
add("A4_ingest_ids", f"""WITH {STATE} SELECT last_seen_run_id AS run_id, CASE WHEN prev IS NULL THEN 'net_new' WHEN prev = last_seen_run_id THEN 'duplicate_in_run' ELSE 'rediscovered' END AS discovery_state, posting_id AS job_id FROM st""")
add("M7_artifact_records", f"""WITH {SNAP}, a AS (SELECT DISTINCT l_orderkey, l_orderkey * 10 + l_linenumber AS i FROM lineitem)
SELECT i AS artifact_id, coalesce(duplicate_key, '?') AS duplicate_key, coalesce(trim(company), '?') AS company, coalesce(title, '?') AS title, '/out/' || i || '.txt' AS output_path FROM a LEFT JOIN snap ON l_orderkey = posting_id""")
add("F9_record_gate", f"WITH {POSTINGS} SELECT posting_id, posting_id % 4 > 0 AND posting_id % 6 > 0 AND coalesce(fit_score, 0) >= 65 AS record_ok FROM postings")
add("M2_mark_applied", f"""WITH {SNAP} SELECT posting_id, CASE WHEN posting_id % 10 = 0 THEN 'Applied' ELSE workflow_status END AS workflow_status,
 CASE WHEN posting_id % 10 = 0 THEN 'Applied' ELSE 'New' END AS status, CASE WHEN posting_id % 10 = 0 AND applied_date = '' THEN '1999-01-02' ELSE applied_date END AS applied_date FROM snap""")
add("M3_remove_postings", f"""WITH {SNAP}, gone AS (SELECT duplicate_key FROM snap WHERE posting_id % 10 = 0)
SELECT 'kept' AS side, duplicate_key, '' AS removed_date FROM snap WHERE posting_id % 10 <> 0 UNION ALL SELECT 'tombstone', duplicate_key, '1999-01-02' FROM gone
UNION ALL SELECT 'tombstone', duplicate_key, '1998-12-31' FROM tomb WHERE duplicate_key NOT IN (SELECT duplicate_key FROM gone)""")
add("M4_apply_refresh", f"""WITH {SNAP} SELECT posting_id, CASE WHEN posting_id % 8 = 0 THEN upper(title) ELSE title END AS title,
 CASE WHEN posting_id % 8 = 0 THEN '$300,000 - $310,000' ELSE compensation_raw END AS compensation_raw, CASE WHEN posting_id % 8 = 0 THEN 'refreshed' ELSE 'discovered' END AS last_refresh_status,
 CASE WHEN posting_id % 8 = 0 THEN (posting_id % 100)::DOUBLE ELSE coalesce(fit_score, -1.0) END AS fit_score, CASE WHEN posting_id % 16 = 0 THEN '1999-01-01' ELSE '' END AS scored_on,
 CASE WHEN posting_id % 8 = 0 THEN '1999-01-01' ELSE strftime(first_seen_at, '%Y-%m-%d') END AS updated_on FROM snap""")
MANY = "profiles AS (" + sql(derived.MANY_PROFILES) + ")"
KV = f"""{MANY}, kv AS (SELECT profile_id, 'target_titles' AS key, target_titles AS value FROM profiles UNION ALL SELECT profile_id, 'preferred_locations', preferred_locations FROM profiles
 UNION ALL SELECT profile_id, 'include_keywords', include_keywords FROM profiles UNION ALL SELECT profile_id, 'remote_only', remote_only FROM profiles
 UNION ALL SELECT profile_id, 'include_remote', include_remote FROM profiles UNION ALL SELECT profile_id, 'require_mark_as_applied', 'x' FROM profiles
 UNION ALL SELECT profile_id, 'default_minimum_fit_score', ' nan ' FROM profiles)"""
add("M6_upsert_settings", f"""WITH {KV} SELECT profile_id, key, CASE WHEN profile_id % 2 = 0 AND key NOT IN ('remote_only') THEN trim('new ' || value) ELSE value END AS value FROM kv WHERE profile_id % 2 = 1 OR key <> 'default_minimum_fit_score'
UNION ALL SELECT profile_id, 'default_minimum_fit_score', ' nan ' FROM profiles WHERE profile_id % 2 = 0
UNION ALL SELECT profile_id, 'default_min_fit_score', 'new  nan' FROM profiles WHERE profile_id % 2 = 0
UNION ALL SELECT profile_id, 'profile_summary', trim('new ' || remote_only) FROM profiles WHERE profile_id % 2 = 0""")
add("S5_load_settings", f"""WITH {MANY} SELECT profile_id, target_titles, CASE WHEN include_remote IN ('', 'true') THEN 'true' ELSE 'false' END AS include_remote, remote_only,
 'broad_recall' AS search_strategy, '' AS default_min_fit_score, '10' AS default_jobs_per_page FROM profiles""")
add("M7_append_artifact", f"""WITH {SNAP}, a AS (SELECT l_orderkey, max(l_orderkey * 10 + l_linenumber) AS i FROM lineitem GROUP BY 1)
SELECT posting_id, CASE WHEN i IS NULL THEN '' ELSE '/out/' || i || '.txt' END AS artifact_path FROM snap LEFT JOIN a ON l_orderkey = posting_id""")
add("S9_align_schema", f"""WITH {POSTINGS} SELECT posting_id, CASE WHEN posting_id % 2 = 0 THEN 'New' ELSE workflow_status END AS status, 'Local Pipeline' AS source, active_status, 'rolesift_v1' AS parser_version,
 '' AS source_type, '' AS risk_flags, array_to_string(list_filter(string_split(regexp_replace(lower(company || ' ' || title || ' ' || location), '[^a-z0-9]+', ' ', 'g'), ' '), lambda s: s <> ''), '|') AS duplicate_key,
 {canonical('job_posting_url')} AS canonical_job_posting_url, coalesce(fit_score, -1.0) AS fit_score FROM postings""")

CONTRACT = f"""{ENDPOINTS}, {COMPANIES}, con AS (SELECT endpoint_id AS pos, CASE WHEN endpoint_id % 13 = 0 THEN '' WHEN endpoint_id % 4 = 0 THEN 'New Co ' || endpoint_id % 50 ELSE name END AS company_name,
  lower(CASE WHEN endpoint_id % 4 = 0 THEN 'NEW' || endpoint_id % 50 || '.com' ELSE replace(name, '#', '') || '.com' END) AS dom, endpoint_url, lower(CASE WHEN endpoint_id % 29 = 0 THEN 'weird' ELSE careers_url_status END) AS st,
  review_status, ats_vendor, CASE WHEN endpoint_id % 31 = 0 THEN NULL ELSE confidence_score END AS conf, e.company_id AS cid FROM endpoints e JOIN companies c USING (company_id)),
 chk AS (SELECT *, CASE WHEN company_name = '' THEN 'missing required field(s): company_name'
   ELSE array_to_string(list_filter([CASE WHEN st = 'weird' THEN 'invalid careers_url_status: weird' END, CASE WHEN conf IS NULL THEN 'confidence_score must be numeric' END], lambda x: x IS NOT NULL), '; ') END AS errors FROM con),
 ver AS (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN st = 'blocked' THEN 'skipped' ELSE 'kept' END AS verdict FROM chk),
 kept AS (SELECT v.*, coalesce(c1.company_id, c2.company_id) AS id FROM ver v LEFT JOIN companies c1 ON c1.canonical_domain = v.dom AND v.dom <> '' LEFT JOIN companies c2 ON c2.name = v.company_name WHERE verdict = 'kept'),
 who AS (SELECT *, coalesce(id::VARCHAR, dom) AS ent FROM kept)"""
add("F10_validate_contract_records", f"WITH {CONTRACT} SELECT pos, verdict, errors FROM ver")
add("J4_resolve_company", f"""WITH {CONTRACT} SELECT pos, coalesce(c1.company_id, c2.company_id, -1) AS company_id FROM ver v
LEFT JOIN companies c1 ON c1.canonical_domain = v.dom LEFT JOIN companies c2 ON c2.name = v.company_name""")
add("S2_endpoint_contract", f"""WITH {CONTRACT} SELECT row_number() OVER (ORDER BY pos % 2, pos) - 1 AS pos, CASE WHEN company_name = '' THEN ' ' ELSE company_name END AS company_name, endpoint_url AS careers_url,
 CASE WHEN conf IS NULL THEN 'high' ELSE conf::VARCHAR END AS confidence_score, notes FROM con JOIN (SELECT endpoint_id AS pos, notes FROM endpoints) USING (pos)""")
OLD_EP = "known AS (SELECT company_id, endpoint_url FROM endpoints WHERE endpoint_id % 3 = 0)"
add("M5_import_endpoints", f"""WITH {CONTRACT}, {OLD_EP}, pairs AS (SELECT ent, id, endpoint_url, count(*) AS n FROM who GROUP BY 1, 2, 3),
 pk AS (SELECT p.*, EXISTS (SELECT 1 FROM known k WHERE k.company_id = p.id AND k.endpoint_url = p.endpoint_url) AS old FROM pairs p)
SELECT (SELECT count(*) FROM ver) AS total_records, (SELECT count(*) FROM ver WHERE verdict = 'invalid') AS invalid, (SELECT count(*) FROM ver WHERE verdict = 'skipped') AS skipped,
 (SELECT count(DISTINCT ent) FROM who WHERE id IS NULL) AS company_inserted, (SELECT count(*) FROM who) - (SELECT count(DISTINCT ent) FROM who WHERE id IS NULL) AS company_updated,
 (SELECT count(*) FROM pk WHERE NOT old) AS endpoint_inserted, (SELECT count(*) FROM who) - (SELECT count(*) FROM pk WHERE NOT old) AS endpoint_updated""")
FIRM = """firm AS (SELECT ent, coalesce(any_value(id), (SELECT coalesce(max(company_id), 0) FROM companies) + min(pos) + 1) AS fid, arg_max(company_name, pos) AS nm,
  arg_min(dom, pos) AS dm FROM who GROUP BY 1)"""
add("M5_imported_endpoints", f"""WITH {CONTRACT}, {FIRM}, fresh AS (SELECT fid, endpoint_url, arg_max(ats_vendor, pos) AS v, arg_max(review_status, pos) AS r,
  arg_max(conf, pos) AS c, max(pos) AS pos FROM who JOIN firm USING (ent) GROUP BY 1, 2),
 old AS (SELECT * FROM endpoints WHERE endpoint_id % 3 = 0)
SELECT f.fid AS company_id, f.endpoint_url, coalesce(o.endpoint_id, (SELECT coalesce(max(endpoint_id), 0) FROM old) + f.pos + 1) AS endpoint_id, f.v AS ats_vendor,
  CASE WHEN f.v = 'unknown' THEN 'careers_page' ELSE f.v END AS extraction_method, f.r AS review_status, CASE WHEN f.r = 'rejected' THEN 0 ELSE 1 END AS active, f.c AS confidence_score
FROM fresh f LEFT JOIN old o ON o.company_id = f.fid AND o.endpoint_url = f.endpoint_url
UNION ALL SELECT o.company_id, o.endpoint_url, o.endpoint_id, o.ats_vendor, '', o.review_status, o.active, o.confidence_score FROM old o
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.fid = o.company_id AND f.endpoint_url = o.endpoint_url)""")
add("M5_imported_companies", f"""WITH {CONTRACT}, {FIRM} SELECT coalesce(c.company_id, fid) AS company_id, coalesce(nm, name) AS name,
  coalesce(nullif(canonical_domain, ''), dm, '') AS canonical_domain, coalesce(hq, '') AS hq, coalesce(company_active, -1) AS company_active
FROM companies c FULL JOIN firm ON c.company_id = fid""")
add("U3_registry_delta", f"WITH {CONTRACT} SELECT pos, endpoint_url FROM con WHERE endpoint_url NOT IN (SELECT endpoint_url FROM endpoints WHERE endpoint_id % 7 = 0)")
add("U3_registry_delta_count", f"""WITH {CONTRACT} SELECT count(*) AS export_rows, (SELECT count(*) FROM endpoints WHERE endpoint_id % 7 = 0) AS registry_rows,
 greatest(count(*) - (SELECT count(*) FROM endpoints WHERE endpoint_id % 7 = 0), 0) AS delta FROM con""")
