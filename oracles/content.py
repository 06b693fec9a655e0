"""Answers for planned queries, title groups, pages, feeds, results and reports."""

from __future__ import annotations

from rolesift.operators.planning import ATS_SITES, BOARD_SITES, CAREER_SIGNALS
from rolesift.operators.results import SCORE_LISTS
from rolesift.plans import derived

from .base import ENRICHED, MODEL_RESULTS, OBS, POSTINGS, PREPARED, add, host, norm, plain, sql
from .discovery import CLASSIFY, GATED, LOC, OK, QUAL, fits, flat, gate, groups
from .discovery import LANES, LEVELS
from .ranking import SCORED, selection

MANY = "many AS (" + sql(derived.MANY_PROFILES) + ")"
BY_KIND = PREPARED.replace("prepared(profile_id", "kinds(kind").replace("WHERE col0 IN (SELECT r_regionkey FROM region)", "")
add("J7_expand_terms", f"""WITH {BY_KIND}, c AS (SELECT c_custkey::INT AS profile_id, k.* FROM customer JOIN kinds k ON k.kind = c_custkey % 5)
SELECT profile_id, 'title' AS kind, (generate_subscripts(hints, 1) - 1)::INT AS pos, unnest(hints) AS term FROM c
UNION ALL SELECT profile_id, 'location', (generate_subscripts(wishes, 1) - 1)::INT, lower(unnest(wishes)) FROM c""")

# Planned queries: families, places and keyword of each kind written out.
PLAN = """fam(kind, f, alias, prim) AS (VALUES (0, 1, ['VP of IT', 'vice president of information technology'], 'VP of IT'), (0, 2, ['Head of Platform'], 'Head of Platform'),
  (1, 1, ['Vice President, Information Technology', 'vice president of information technology'], 'Vice President, Information Technology'),
  (1, 2, ['Vice President, Infrastructure', 'vice president of infrastructure'], 'Vice President, Infrastructure'),
  (2, 1, ['Data Analyst'], 'Data Analyst'), (2, 2, ['Analyst'], 'Analyst'), (3, 1, ['Director of Infrastructure'], 'Director of Infrastructure'),
  (3, 2, ['Engineering Manager'], 'Engineering Manager'), (3, 3, ['CTO'], 'CTO')),
 plc(kind, l, p) AS (VALUES (0, 1, 'Dallas, TX'), (0, 2, 'Texas'), (0, 3, 'remote'), (1, 1, 'remote'), (2, 1, 'New York, NY'), (2, 2, 'United States'), (3, 1, 'remote')),
 kw(kind, x) AS (VALUES (0, ' "cloud"'), (1, ''), (2, ''), (3, ' "sr"')),
 brd(kind, f, q) AS (VALUES (1, 1, '"vice president" "information technology"'), (1, 2, '"vice president" "infrastructure"')),
 q AS (SELECT f.*, l, p, x, CASE WHEN len(alias) = 1 THEN '"' || alias[1] || '"' ELSE '("' || array_to_string(alias, '" OR "') || '")' END AS e FROM fam f JOIN plc USING (kind) JOIN kw USING (kind)),
 al AS (SELECT kind, '("' || string_agg(a, '" OR "' ORDER BY f, i) || '")' AS every FROM (SELECT kind, f, unnest(alias) AS a, generate_subscripts(alias, 1) AS i FROM fam) GROUP BY kind)"""
add("W11_plan_queries", f"""WITH {PLAN}, u AS (SELECT kind, 0 AS t, 'ats_grouped' AS tier, 0 AS f, l, every || ' "' || p || '"' || x || ' {ATS_SITES}' AS query FROM al JOIN plc USING (kind) JOIN kw USING (kind)
 UNION ALL SELECT kind, 1, 'ats_broad', f, l, brd.q || ' "' || p || '" {ATS_SITES}' FROM brd JOIN plc USING (kind)
 UNION ALL SELECT kind, 2, 'ats_strict', f, l, e || ' "' || p || '"' || x || ' {ATS_SITES}' FROM q
 UNION ALL SELECT kind, 3, 'ats_loose', f, l, prim || ' ' || p || x || ' {ATS_SITES}' FROM q
 UNION ALL SELECT kind, 4, 'career_web', f, l, e || ' "' || p || '" {CAREER_SIGNALS}' FROM q
 UNION ALL SELECT kind, 5, 'job_board_discovery', f, l, e || ' "' || p || '" {BOARD_SITES}' FROM q WHERE l <= 2),
 n AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY t, f, l) - 1)::INT AS pos FROM u)
SELECT c_custkey::INT AS profile_id, pos, tier, query FROM customer JOIN n ON kind = c_custkey % 5""")

TITLES = "ttl(kind, i, t) AS (VALUES (0, 0, 'VP of IT'), (0, 1, 'Head of Platform'), (1, 0, 'Vice President, Information Technology'), (1, 1, 'Vice President, Infrastructure'), (2, 0, 'Data Analyst'), (2, 1, 'Analyst'), (3, 0, 'Director of Infrastructure'), (3, 1, 'Engineering Manager'), (3, 2, 'CTO'))"
add("J15_expand_title_groups", f"""WITH {TITLES}, j(g, m, pos, t, s) AS (VALUES (0, 'VP of IT', 0, 'VP of IT', true), (0, 'VP of IT', 1, 'Head of IT', true), (0, 'VP of IT', 2, 'CIO', false))
SELECT c_custkey::INT AS profile_id, g::INT AS group_pos, m AS main_title, pos::INT AS pos, t AS title, s AS selected FROM customer, j WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey::INT, 1, 'Kind ' || c_custkey % 7, 0, 'Kind ' || c_custkey % 7, true FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey::INT, i, t, 0, t, true FROM customer JOIN ttl ON kind = c_custkey % 5 WHERE c_custkey % 3 <> 0""")
add("J15_effective_titles", """WITH e(kind, eff, s) AS (VALUES (0, 'VP of IT; Head of Platform', 'vice president of information technology; head of platform'),
 (1, 'Vice President, Information Technology; Vice President, Infrastructure', 'vice president of information technology; vice president of infrastructure'),
 (2, 'Data Analyst; Analyst', 'data analyst; analyst'), (3, 'Director of Infrastructure; Engineering Manager; CTO', 'director of infrastructure; engineering manager; cto'), (4, '', ''))
SELECT c_custkey::INT AS profile_id, CASE WHEN c_custkey % 3 = 0 THEN 'VP of IT; Head of IT; Kind ' || c_custkey % 7 ELSE eff END AS effective,
 CASE WHEN c_custkey % 3 = 0 THEN 'vice president of information technology; head of information technology; kind ' || c_custkey % 7 ELSE s END AS search FROM customer JOIN e ON kind = c_custkey % 5""")
add("J13_merge_variants", f"""WITH {TITLES}, s AS (SELECT c_custkey::INT AS profile_id, t FROM customer JOIN ttl ON kind = c_custkey % 5)
SELECT profile_id, t AS main_title, h || ' ' || t AS title, CASE h WHEN 'Senior' THEN profile_id % 2 = 0 ELSE true END AS selected FROM s, (VALUES ('Senior'), ('Lead'), ('Interim')) v(h)""")
add("C7_close_variants", f"""WITH {TITLES}, s AS (SELECT c_custkey::INT AS profile_id, t FROM customer JOIN ttl ON kind = c_custkey % 5)
SELECT profile_id, t AS main_title, h || t AS title FROM s, (VALUES ('Senior '), ('Head of ')) v(h) UNION ALL SELECT profile_id, t, 'Director, ' || t FROM s WHERE t LIKE 'Director%'
UNION ALL SELECT profile_id, t, 'Vice Pres ' || t FROM s WHERE false""")

# --- pages -----------------------------------------------------------------------------
LINKS = """hrefs AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)"""
add("X1_extract_links", f"""WITH {LINKS} SELECT page_id, pos::INT AS pos, replace(href, '&amp;', '&') AS href, CASE WHEN href LIKE 'http%' THEN replace(href, '&amp;', '&')
 ELSE regexp_extract(base, '^[a-z]+://[^/]+') || replace(href, '&amp;', '&') END AS url FROM hrefs""")
add("X1_posting_links", f"""WITH {PREPARED}, l AS (SELECT page_id, (page_id % 5)::INT AS profile_id, 0 AS pos, 'https://jobs.lever.co/org' || page_id % 40 || '/' || page_id AS url, 'vp of it' AS t FROM pages
 UNION ALL SELECT page_id, (page_id % 5)::INT, 1, 'https://boards.greenhouse.io/org/jobs/' || page_id, 'data analyst & more' FROM pages)
SELECT page_id, url, pos::INT AS pos FROM l JOIN prepared USING (profile_id) WHERE CASE WHEN len(targets) = 0 THEN regexp_matches(t, 'vp|chief|head of|cto|cio|coo') ELSE len(list_filter(targets, lambda x: contains(t, lower(x)))) > 0 END""")
UNESC = "replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&')"
BARE = "regexp_replace(regexp_replace(regexp_replace({}, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"


def visible(x: str) -> str:
    return f"trim(regexp_replace({UNESC.format(BARE.format(x))}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


add("X2_extract_page_fields", f"""SELECT page_id, {visible("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS title, length({visible('html')})::INT AS text_length FROM pages""")
add("X3_build_postings", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Acme Labs ' || page_id % 40 WHEN 1 THEN 'Bright Systems' ELSE upper(regexp_extract(url, '([a-z])[a-z]*[.][a-z]+/', 1)) || regexp_extract(url, '[a-z]([a-z]*)[.][a-z]+/', 1) END AS company,
 CASE page_id % 3 WHEN 0 THEN 'Lever' WHEN 1 THEN 'Workday' ELSE 'Unknown' END AS ats_type, 'Adjacent Near-Exec' AS role_family,
 '$' || (page_id % 7 + 1) * 50000 || ' - $' || (page_id % 7 + 2) * 50000 AS compensation_raw, CASE WHEN (page_id % 7 + 2) * 50000 < 250000 THEN 'Below Target' ELSE 'Qualified' END AS compensation_status, 'New' AS status
FROM pages WHERE page_id % 10 <> 0""")
add("C6_rough_fit", f"""WITH {POSTINGS}, x AS (SELECT *, lower(title) AS lt, lower(concat_ws(' ', title, location, company, compensation_raw)) AS tx FROM postings),
 y AS (SELECT *, CASE WHEN contains(lt, 'chief information officer') OR regexp_matches(lt, '(^|[^a-z])cio([^a-z]|$)') THEN 'CIO' WHEN contains(lt, 'head of ai') THEN 'Head of AI' WHEN contains(lt, 'head of platform') THEN 'Head of Platform'
   WHEN contains(lt, 'vp') AND contains(lt, 'product') AND contains(lt, 'technology') THEN 'VP Product Technology' WHEN contains(lt, 'vp') AND contains(lt, 'it') THEN 'VP IT' WHEN contains(lt, 'vp') AND contains(lt, 'technology') THEN 'VP Technology'
   WHEN contains(lt, 'chief technology officer') THEN 'CTO' END AS fam, contains(tx, 'ai') AS ai, contains(tx, 'hybrid') AS hyb, contains(tx, 'remote') AS rem, regexp_matches(lower(location), 'dallas|plano') AS metro FROM x),
 z AS (SELECT *, NOT hyb AND rem AS r, NOT hyb AND NOT rem AND metro AS m, ats_type <> 'Unknown' AS k, regexp_matches(tx, 'vice president|chief|head of') AS l, regexp_matches(tx, 'platform|technology|digital|it ') AS t FROM y),
 s AS (SELECT *, CASE WHEN fam IS NULL THEN 12 ELSE 25 END + CASE WHEN ai THEN 20 ELSE 5 END + CASE WHEN r THEN 15 WHEN m THEN 12 ELSE 0 END + 10 * k::INT + 10 * l::INT + 10 * t::INT AS sc FROM z)
SELECT posting_id, least(sc, 100)::INT AS fit_score, CASE WHEN sc >= 85 THEN 'Top Priority' WHEN sc >= 75 THEN 'Strong' WHEN sc >= 65 THEN 'Review' ELSE 'Low' END AS fit_tier,
 array_to_string((list_filter([CASE WHEN fam IS NULL THEN 'Adjacent near-executive role' ELSE 'Strong title alignment: ' || fam END, CASE WHEN ai THEN 'AI relevance detected in posting' END, CASE WHEN r THEN 'Fully remote role' WHEN m THEN 'Dallas / DFW role' END,
  CASE WHEN k THEN 'Recognized ATS: ' || ats_type END, CASE WHEN l THEN 'Leadership scope language detected' END, CASE WHEN t THEN 'Technology/platform scope detected' END], lambda v: v IS NOT NULL))[1:4], '; ') || ' | Risks: '
 || coalesce(nullif(array_to_string(list_filter([CASE WHEN NOT ai THEN 'AI relevance not clearly stated' END, CASE WHEN NOT r AND NOT m THEN 'Location may not fit target geography' END], lambda v: v IS NOT NULL), '; '), ''), 'No major risks identified') AS match_rationale FROM s""")
add("F14_expired_pages", """SELECT page_id, (page_id % 22 = 0) OR page_id % 6 = 0 AS expired, CASE WHEN page_id % 22 = 0 THEN 'http_404' WHEN page_id % 6 = 0 THEN 'the page you are looking for doesn''t exist' ELSE '' END AS expired_reason FROM pages""")
add("J12_resolve_gateways", f"""WITH {OBS}, o AS (SELECT obs_id, event_id, raw_url FROM obs JOIN events ON event_id = obs_id), g AS (SELECT *, (event_id * 7) % 997 AS n FROM o)
SELECT obs_id, CASE WHEN raw_url = '' THEN '' WHEN obs_id % 10 IN (0, 1, 2, 3, 4, 5) THEN regexp_replace(raw_url, '/$', '') WHEN obs_id % 10 = 6 AND n IN (SELECT page_id FROM pages WHERE page_id % 3 > 0) THEN 'https://jobs.lever.co/org' || n % 40 || '/' || n || '/apply' ELSE '' END AS resolved_url,
 CASE WHEN raw_url = '' THEN 'blank' WHEN obs_id % 10 <= 5 THEN 'already_preferred' WHEN obs_id % 10 <> 6 THEN 'non_discovery_host' WHEN n NOT IN (SELECT page_id FROM pages) THEN 'page_resolution_failed'
  WHEN n % 3 > 0 THEN 'page_extracted_preferred' ELSE 'no_preferred_link_found' END AS resolve_reason FROM g""")

# --- feeds -------------------------------------------------------------------------------
SEED = f"""{POSTINGS}, {PREPARED}, s0 AS (SELECT posting_id, title, location, posting_id // 20 AS page_no, (posting_id // 20) % 50 AS endpoint_id FROM postings),
 s1 AS (SELECT s0.*, (row_number() OVER (PARTITION BY page_no ORDER BY posting_id) - 1)::INT AS pos, page_no % 2 + 1 AS pass_no, r.*, {plain('title')} AS hint, {plain('location')} AS pl FROM s0 JOIN prepared r ON r.profile_id = endpoint_id % 5),
 s2 AS (SELECT *, {groups('hint', LEVELS)} AS hl, {groups('hint', LANES)} AS hn, {flat('scoring', LEVELS)} AS sl, {flat('scoring', LANES)} AS sn,
   list_max(list_transform(scoring, lambda t: CASE WHEN contains(hint, {plain('t')}) THEN 1.0 ELSE len(list_intersect(list_distinct(string_split({plain('t')}, ' ')), list_distinct(string_split(hint, ' ')))) / len(list_distinct(string_split({plain('t')}, ' '))) END)) AS best,
   len(list_filter(wishes, lambda w: contains(pl, {plain('w')}) OR list_has_any(list_filter(string_split({plain('w')}, ' '), lambda k: length(k) >= 4), string_split(pl, ' ')))) > 0 AS wish, contains(pl, 'remote') AS rem FROM s1),
 fd AS (SELECT *, len(scoring) = 0 OR hint = '' OR len(list_filter(string_split(hint, ' '), lambda w: length(w) >= 3)) = 0 OR (({fits('sl', 'sn')}) AND (best >= 0.34 OR (list_has_any(sl, hl) AND list_has_any(sn, hn)))) AS title_ok,
   CASE WHEN len(wishes) = 0 AND NOT remote_only AND NOT include_remote THEN true WHEN pl = '' THEN true WHEN rem AND (remote_only OR include_remote) THEN NOT contains(pl, 'mexico') WHEN rem THEN false WHEN remote_only THEN false ELSE wish END AS place_ok FROM s2)"""
add("X4_flatten_feed", f"""WITH {SEED}, k AS (SELECT *, 'https://org' || endpoint_id || '.wd1.myworkdayjobs.com/External/job/' || posting_id % 10 AS detail_url FROM fd WHERE title_ok AND place_ok),
 m AS (SELECT endpoint_id, min(pass_no) AS pass_no FROM k GROUP BY 1)
SELECT endpoint_id, pass_no, page_no, pos, detail_url FROM k JOIN m USING (endpoint_id, pass_no) QUALIFY row_number() OVER (PARTITION BY endpoint_id, detail_url ORDER BY page_no, pos) = 1""")
SCAN = f"""{SEED}, {SCORED}, {selection('sc', 12)}, cnt AS (SELECT endpoint_id, count(*) AS found, count(*) FILTER (title_ok AND place_ok) AS kept, count(*) FILTER (NOT title_ok) AS title_skipped, count(*) FILTER (title_ok AND NOT place_ok) AS place_skipped FROM fd GROUP BY 1),
 scan AS (SELECT profile_id, endpoint_id, vendor <> 'unknown' AS supported, coalesce(found, 0) AS found, coalesce(kept, 0) AS kept, coalesce(title_skipped, 0) AS title_skipped, coalesce(place_skipped, 0) AS place_skipped FROM sel LEFT JOIN cnt USING (endpoint_id))"""
add("A18_seed_scan_summary", f"WITH {SCAN} SELECT * FROM scan")
add("A18_seed_run_totals", f"""WITH {SCAN} SELECT profile_id, count(*) FILTER (supported) AS scanned, count(*) FILTER (NOT supported) AS unsupported, sum(found)::BIGINT AS found, sum(kept)::BIGINT AS seeded,
 sum(title_skipped)::BIGINT AS title_skipped, sum(place_skipped)::BIGINT AS place_skipped FROM scan GROUP BY 1""")
add("X5_parse_delimited_feed", f"""WITH {POSTINGS}, {PREPARED}, f AS (SELECT posting_id // 20 AS endpoint_id, posting_id, CASE WHEN title = '' THEN 'None given' ELSE title END AS title, CASE WHEN location = '' THEN '-' ELSE location END AS location FROM postings),
 g AS (SELECT f.*, r.* FROM f JOIN prepared r ON r.profile_id = endpoint_id % 5)
SELECT endpoint_id, (posting_id + 10000)::VARCHAR AS job_id, title, location, 'https://a.taleo.net/careersection/2/jobdetail.ftl?job=' || (posting_id + 10000) AS detail_url FROM g
WHERE (len(scoring) = 0 OR len(list_filter(scoring, lambda t: contains({plain('title')}, {plain('t')}))) > 0) AND
 CASE WHEN remote_only THEN contains(lower(location), 'remote') WHEN include_remote AND contains(lower(location), 'remote') THEN true WHEN len(wishes) = 0 THEN true ELSE len(list_filter(wishes, lambda w: contains({plain('location')}, {plain('w')}))) > 0 END""")
DIFF = f"""{POSTINGS}, df AS (SELECT posting_id, title <> '' AND posting_id % 3 > 0 AND posting_id % 5 = 0 AND upper(title) <> title AS nt, posting_id % 4 = 0 AS np, title, compensation_raw AS cr,
  (posting_id % 3 = 0 AND title <> '') OR (posting_id % 3 > 0 AND posting_id % 5 = 0 AND upper(title) <> title) AS ct FROM postings)"""
add("X6_refresh_diff", f"""WITH {DIFF} SELECT posting_id, array_to_string(list_filter([CASE WHEN nt THEN 'Live page refresh updated Title: ' || title || ' -> ' || upper(title) END,
 CASE WHEN np THEN 'Live page refresh updated Compensation: ' || CASE WHEN cr = '' THEN 'blank' ELSE cr END || ' -> $1 - $2' END], lambda x: x IS NOT NULL), '; ') AS notes, ct OR np AS changed FROM df""")
add("X6_refresh_counts", f"WITH {DIFF} SELECT count(*) AS refreshed, count(*) FILTER (ct OR np) AS changed, count(*) FILTER (nt OR np) AS noted FROM df")

# --- results ------------------------------------------------------------------------------
LEVEL = "CASE posting_id % 16 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 6 WHEN 4 THEN 3 WHEN 5 THEN 9 WHEN 6 THEN 1 WHEN 7 THEN 7 WHEN 8 THEN 8 WHEN 9 THEN 2 WHEN 10 THEN 3 WHEN 11 THEN 5 WHEN 13 THEN 4 WHEN 15 THEN 7 ELSE 0 END"
NAMES = "['Individual Contributor','IC Senior','Manager','Sr. Manager','Director','Sr. Director','VP','SVP','C-Suite']"
RES = f"""{MODEL_RESULTS}, {POSTINGS}, pf(kind, lo, hi, txt) AS (VALUES (0, 7, 8, 'VP, SVP'), (1, 5, 5, 'Director'), (2, 1, 2, 'Individual Contributor, IC Senior'), (3, 9, 9, 'C-Suite'), (4, 0, 99, '')),
 r0 AS (SELECT result_id AS posting_id, raw_text, result_id % 19 > 0 AS ok, {LEVEL} AS lv, lo, hi, txt, d.lang, d.source, d.n_chars, greatest(0, least(100, (result_id * 13) % 140 - 20)) AS base
  FROM model_results JOIN postings ON posting_id = result_id JOIN documents d ON doc_id = result_id JOIN pf ON kind = result_id % 5),
 r1 AS (SELECT *, CASE WHEN lv = 0 OR txt = '' OR lv BETWEEN lo AND hi THEN 0 WHEN lv < lo THEN least(35, 10 + 8 * (lo - lv)) ELSE least(15, 4 + 4 * (lv - hi)) END AS pen FROM r0),
 r AS (SELECT *, CASE WHEN NOT ok THEN 0 ELSE greatest(0, base - pen) END AS fs, ok AND pen > 0 AS hit FROM r1)"""
ACTION = "CASE WHEN fs >= 80 THEN 'Apply' WHEN fs >= 60 THEN 'Apply with Caution' WHEN fs >= 40 THEN 'Hold' ELSE 'Skip' END"
add("C4_normalise_scores", f"""WITH {RES} SELECT posting_id, CASE WHEN ok THEN 'scored' ELSE 'error' END AS status, fs::INT AS fit_score, CASE WHEN fs >= 80 THEN 'Strong' WHEN fs >= 60 THEN 'Moderate' WHEN fs >= 40 THEN 'Weak' ELSE 'Not Recommended' END AS fit_label,
 {ACTION} AS recommended_action, CASE WHEN ok AND posting_id % 3 = 0 THEN 'High' ELSE 'Low' END AS confidence,
 CASE WHEN NOT ok THEN 'AI job scoring returned a non-JSON response.' WHEN hit THEN 'Detected title level: ' || {NAMES}[lv] || '.' ELSE '' END AS match_rationale,
 CASE WHEN NOT ok THEN 'Could not parse model response as JSON' ELSE 'len ' || n_chars % 7 || '; two' || CASE WHEN hit THEN concat('; Title level appears ', CASE WHEN lv < lo THEN 'below' ELSE 'above' END, ' selected job levels (detected: ', {NAMES}[lv], '; preferred: ', txt, ')') ELSE '' END END AS risk_flags,
 CASE WHEN ok THEN concat('- lang ', lang, chr(10), '- source ', source) ELSE '' END AS application_angle FROM r""")
add("A12_profile_scoreboard", f"""WITH {RES} SELECT (posting_id % 5)::INT AS profile_id, count(*) AS scored, round(avg(fs), 1) AS avg_fit_score, count(*) FILTER ({ACTION} = 'Apply') AS apply_count,
 count(*) FILTER ({ACTION} = 'Apply with Caution') AS apply_caution_count, count(*) FILTER ({ACTION} = 'Hold') AS hold_count, count(*) FILTER ({ACTION} = 'Skip') AS skip_count FROM r GROUP BY 1""")
add("C5_apply_corrections", f"""WITH {ENRICHED}, b AS (SELECT *, posting_id % 7 > 0 AND posting_id % 5 > 0 AS sure, posting_id % 4 = 0 AS ht, posting_id % 6 = 0 AS hl FROM enriched),
 c AS (SELECT *, sure AND ht AS tt, sure AND hl AS tl FROM b)
SELECT posting_id, CASE WHEN tt THEN 'Fixed Title' ELSE title END AS title, CASE WHEN tl THEN 'Plano, TX' ELSE location END AS location, CASE WHEN tt OR tl THEN '' ELSE duplicate_key END AS duplicate_key,
 CASE WHEN tt THEN '' ELSE lower(title) END AS normalized_title, CASE WHEN tl THEN 'Hybrid' ELSE 'Other' END AS remote_type, CASE WHEN tl THEN 'Yes' ELSE 'No' END AS dallas_dfw_match,
 concat('one; two; three', CASE WHEN tt THEN concat('; AI scrub updated Title: ', CASE WHEN title = '' THEN 'blank' ELSE title END, ' -> Fixed Title') ELSE '' END,
  CASE WHEN tl THEN concat('; AI scrub updated Location: ', CASE WHEN location = '' THEN 'blank' ELSE location END, ' -> Plano, TX') ELSE '' END) AS risk_flags,
 CASE WHEN posting_id % 3 = 1 THEN 'Skip' WHEN posting_id % 3 = 2 AND posting_id % 2 = 0 THEN 'Hold' WHEN posting_id % 2 = 0 THEN 'Apply' ELSE 'Hold' END AS ai_priority FROM c""")
CAL = """cal AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS e, ['no', 'maybe', 'yes'][doc_id % 3 + 1] AS p, 'qualifier' AS scorer FROM labels
 UNION ALL SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'maybe' WHEN quality = 1 THEN 'yes' ELSE 'no' END, CASE WHEN doc_id % 13 = 0 THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END, 'model' FROM labels),
 cg AS (SELECT *, abs(list_position(['no', 'maybe', 'yes'], e) - list_position(['no', 'maybe', 'yes'], p)) AS g FROM cal)"""
add("A13_calibration_report", f"""WITH {CAL} SELECT scorer, count(*) AS cases, count(*) FILTER (g = 0) AS exact, count(*) FILTER (g = 1) AS adjacent, count(*) FILTER (g = 2) AS far_misses, count(*) FILTER (p = 'skipped') AS skipped,
 round(count(*) FILTER (g = 0)::DOUBLE * 100 / count(*) FILTER (p <> 'skipped'), 1) AS exact_pct FROM cg GROUP BY 1""")
add("A13_calibration_cross", f"""WITH {CAL} SELECT scorer, e AS expected_label, count(*) FILTER (p = 'no') AS no, count(*) FILTER (p = 'maybe') AS maybe, count(*) FILTER (p = 'yes') AS yes FROM cg GROUP BY 1, 2""")

# --- reports -------------------------------------------------------------------------------
REP = f"""{OBS}, rp AS (SELECT *, {gate('raw_url')} AS g, {CLASSIFY} AS c, CASE WHEN obs_id % 2 = 0 THEN 'legacy' ELSE 'next_gen' END AS mode, 'g' || profile_id AS grp,
  concat_ws('-', profile_id, provider, CASE WHEN obs_id % 2 = 0 THEN 'legacy' ELSE 'next_gen' END) AS report_id FROM obs),
 ca AS (SELECT report_id, grp, provider, mode, count(*) AS seen_urls, count(*) FILTER (g IN {OK} AND g NOT IN ('greenhouse_detail', 'workday_detail')) AS accepted_jobs,
  count(*) FILTER (g IN ('greenhouse_detail', 'workday_detail')) AS broken_url_count, count(*) FILTER (c = 'blocked_domain') AS blocked, count(*) FILTER (g = 'blocked_generic_host') AS weak,
  count(*) FILTER (raw_url <> '') AS url_count, count(DISTINCT {host('raw_url')}) FILTER (raw_url <> '') AS domain_count, max(obs_id) AS created FROM rp GROUP BY 1, 2, 3, 4)"""
add("A2_flatten_drop_counts", f"WITH {REP} SELECT c AS reason, count(*) AS dropped FROM rp WHERE c NOT IN {OK} GROUP BY 1")
add("A14_case_metrics", f"""WITH {REP} SELECT report_id, seen_urls, accepted_jobs, round(accepted_jobs::DOUBLE * 100 / seen_urls, 1) AS acceptance_pct, broken_url_count, blocked AS blocked_domain_drop_count,
 weak AS weak_title_match_count, 0::BIGINT AS duplicate_count, url_count, domain_count FROM ca""")
OVER = f"""{REP}, gv AS (SELECT grp || '/' || mode AS grp, count(DISTINCT provider) AS variants, max(accepted_jobs) - min(accepted_jobs) AS accepted_gap, max(broken_url_count) - min(broken_url_count) AS broken_gap FROM ca GROUP BY 1),
 gu AS (SELECT grp || '/' || mode AS grp, lower(raw_url) AS u, count(DISTINCT provider) AS n FROM rp WHERE raw_url <> '' GROUP BY 1, 2),
 ov AS (SELECT grp AS "group", variants, accepted_gap, broken_gap, count(*) AS union_urls, count(*) FILTER (n = variants) AS shared_urls, round(count(*) FILTER (n = variants)::DOUBLE * 100 / count(*), 1) AS overlap_pct FROM gv JOIN gu USING (grp) GROUP BY 1, 2, 3, 4)"""
add("A10_variant_overlap", f"WITH {OVER} SELECT * FROM ov")
add("A11_benchmark_overall", f"""WITH {OVER} SELECT count(*) AS cases, sum(seen_urls)::BIGINT AS seen_urls, sum(accepted_jobs)::BIGINT AS accepted_jobs, sum(broken_url_count)::BIGINT AS broken_urls, round(sum(accepted_jobs)::DOUBLE * 100 / sum(seen_urls), 2) AS acceptance_pct,
 (SELECT count(*) FROM ov) AS groups, (SELECT count(*) FROM ov WHERE overlap_pct < 50 OR accepted_gap > 2 OR broken_gap > 1) AS flagged_groups FROM ca""")
add("J9_compare_reports", f"""WITH {REP} SELECT n.grp AS "group", n.provider AS variant, n.url_count, n.accepted_jobs, n.broken_url_count, n.url_count - coalesce(o.url_count, 0) AS url_count_delta,
 n.accepted_jobs - coalesce(o.accepted_jobs, 0) AS accepted_jobs_delta, n.broken_url_count - coalesce(o.broken_url_count, 0) AS broken_url_count_delta
FROM ca n LEFT JOIN ca o ON o.grp = n.grp AND o.provider = n.provider AND o.mode = 'legacy' AND o.provider <> 'search' WHERE n.mode = 'next_gen'""")
add("J10_pair_modes", f"""WITH {REP} SELECT grp || '/' || provider AS title, max(url_count) FILTER (mode = 'legacy') AS legacy_url_count, max(accepted_jobs) FILTER (mode = 'legacy') AS legacy_accepted_jobs,
 max(url_count) FILTER (mode = 'next_gen') AS next_gen_url_count, max(accepted_jobs) FILTER (mode = 'next_gen') AS next_gen_accepted_jobs FROM ca GROUP BY 1""")
add("U2_url_set_algebra", f"""WITH {REP} SELECT lower(raw_url) AS url, CASE WHEN count(DISTINCT mode) = 2 THEN 'shared' WHEN min(mode) = 'legacy' THEN 'first_only' ELSE 'second_only' END AS side FROM rp WHERE raw_url <> '' GROUP BY 1""")
assert GATED and LOC and norm and MANY

add("S1_S7_url_list_round_trip", "SELECT url FROM pages WHERE url <> ''")
add("S6_append_run_ledger", f"""WITH {OBS} SELECT run_id, count(*) AS total_seen, count(*) AS items, (count(*) FILTER (provider = 'search'))::VARCHAR AS search, 'legacy' AS mode FROM obs GROUP BY 1""")
add("S8_write_report", f"""WITH {GATED}, r AS (SELECT run_id, reason, count(*) AS n, min(obs_id) AS p FROM gated WHERE reason NOT IN ('', 'duplicate_in_batch') GROUP BY 1, 2)
SELECT run_id, count(*) AS seen, count(*) FILTER (reason = '') AS accepted, (SELECT reason FROM r WHERE r.run_id = g.run_id ORDER BY n DESC, p LIMIT 1) AS dominant_reason FROM gated g GROUP BY 1""")

# --- files, notes and the stream ---------------------------------------------------------------
add("T18_run_durations", """WITH x AS (SELECT event_id, event_id % 5 AS f, event_id % 7 AS o, greatest(0, event_id % 9000 - 100) AS s FROM events)
SELECT event_id, CASE WHEN o = 0 THEN (event_id % 11) || '.50s' WHEN f <= 2 THEN printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE 'Unknown' END AS duration FROM x""")
add("T19_note_fields", """SELECT p_partkey, CASE WHEN p_partkey % 50 > 0 THEN p_partkey % 50 ELSE p_size END::BIGINT AS picked, 0::BIGINT AS "none", 'next gen' AS mode, p_name AS more,
 CASE WHEN p_partkey % 3 > 0 THEN 'size: ' || p_size || '; name: ' || p_name ELSE '' END AS items FROM part""")
add("T21_profile_text", """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Executive Summary:' || chr(10) || c_name END AS a, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Strengths to Highlight:' || chr(10) || 'segment ' || c_mktsegment END AS b,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Supporting Candidate Evidence:' || chr(10) || 'Resume Text:' || chr(10) || c_name END AS c FROM customer),
 q AS (SELECT c_custkey, array_to_string(list_filter([a, b], lambda s: s <> ''), chr(10) || chr(10)) AS h, c FROM p),
 t AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN h <> '' THEN 'High Priority Candidate Signals:' || chr(10) || h ELSE '' END, c], lambda s: s <> ''), chr(10) || chr(10)) AS profile_text FROM q)
SELECT c_custkey, profile_text, CASE WHEN length(profile_text) > 60 THEN rtrim(profile_text[1:60], chr(10) || ' ') || chr(10) || chr(10) || '[TRUNCATED]' ELSE profile_text END AS short FROM t""")
add("C4_score_lists", "SELECT doc_id, " + ", ".join(
    f"CASE WHEN doc_id % 9 > 0 THEN '{k} ' || lang ELSE '{'Could not parse model response as JSON' if c == 'gaps_or_risks' else ''}' END AS {c}" for k, c in enumerate(SCORE_LISTS)
) + " FROM documents")
add("S3_labelled_cases", """SELECT doc_id::VARCHAR AS id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS expected_label, 'a "}{" title' AS title FROM labels""")
add("Z1_ingest_runs", """WITH x AS (SELECT (day(ts) - 1) // 16 + 1 AS run_id, user_id || '|' || event_type AS k, event_id, event_type FROM events),
 gone AS (SELECT DISTINCT k FROM x WHERE event_type = 'purchase' OR event_id % 1000 = 7),
 u AS (SELECT run_id, k, count(*) AS n FROM x GROUP BY 1, 2), f AS (SELECT k, min(run_id) AS first FROM u GROUP BY 1),
 j AS (SELECT u.*, k IN (SELECT k FROM gone) AS removed, run_id = first AS new FROM u JOIN f USING (k))
SELECT run_id::INT AS run_id, 'completed' AS status, count(*) AS total_seen, count(*) FILTER (new AND NOT removed) AS inserted_count, count(*) FILTER (NOT new AND NOT removed) AS updated_count, count(*) FILTER (removed) AS skipped_removed_count,
 count(*) FILTER (new AND NOT removed) AS net_new_count, count(*) FILTER (NOT new AND NOT removed) AS rediscovered_count, sum(n - 1)::BIGINT AS dropped_duplicates, count(*) AS items, count(*) FILTER (NOT removed) AS postings FROM j GROUP BY 1""")
add("X2_page_fields_by_form", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Data Head ' || page_id % 7 WHEN 1 THEN 'Og Title ' || page_id % 5 WHEN 2 THEN 'VP of Data' WHEN 3 THEN 'Chief & Data ' || page_id % 3 ELSE 'Ld Title ' || page_id % 9 END AS title,
 CASE page_id % 5 WHEN 0 THEN 'Denver, CO' WHEN 1 THEN 'Boston, MA' WHEN 2 THEN 'Dallas, TX' WHEN 3 THEN 'Chicago, IL' ELSE 'Austin, TX' END AS page_location,
 CASE page_id % 5 WHEN 0 THEN 'Blue Labs' WHEN 1 THEN 'Site Nine' WHEN 2 THEN '' WHEN 3 THEN 'Green Farm' ELSE 'Ld Works' END AS page_company FROM pages""")
