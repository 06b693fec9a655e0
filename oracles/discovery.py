"""Answers for gates, matching, duplicates and run metrics."""

from __future__ import annotations

from rolesift.plans import derived

from .base import (
    ENDPOINTS, ENRICHED, OBS, POSTINGS, PREPARED, add, canonical, host, norm, path, plain, segs, sql, vendor_form,
)

# --- F2: the gate as a ladder over the test URLs' shapes -----------------------
BLOCKED = ["?error=", "?keyword=", "/search", "/jobs/search", "/about-us/", "/about/", "/leadership", "/executive-team",
           "/executive_team", "/team/", "/our-team", "/people/", "/our-people", "/company/", "/companies/"]


def gate(u: str) -> str:
    blocked = " ".join(f"WHEN contains(lower({u}), '{m}') THEN 'blocked_pattern:{m}'" for m in BLOCKED)
    prefixes = " ".join(
        f"WHEN regexp_matches(lower({path(u)}), '^{m}(/|$)') THEN 'blocked_path:{m}'"
        for m in ["/leadership", "/team", "/people", "/about-us", "/about", "/company", "/companies", "/executives", "/our-team", "/our-people"]
    )
    n = f"len({segs(u)})"
    return f"""CASE WHEN {u} = '' THEN 'blank_url' {blocked} {prefixes}
      WHEN regexp_matches(lower(split_part({u}, '?', 2)), '(keyword|location|search|query)=') THEN 'blocked_query_listing'
      WHEN contains({host(u)}, 'jobs.lever.co') THEN CASE WHEN {n} >= 2 THEN 'lever_detail' ELSE 'lever_board_root' END
      WHEN contains({host(u)}, 'boards.greenhouse.io') THEN CASE WHEN {n} >= 2 AND list_contains({segs(u)}, 'jobs') THEN 'greenhouse_detail' ELSE 'greenhouse_board_root' END
      WHEN contains({host(u)}, 'jobs.ashbyhq.com') THEN CASE WHEN {n} >= 2 THEN 'ashby_detail' ELSE 'ashby_board_root' END
      WHEN contains({host(u)}, 'myworkdayjobs.com') THEN CASE WHEN contains(lower({path(u)}), '/job/') THEN 'workday_detail' ELSE 'workday_root' END
      WHEN contains(lower({u}), '/careers/') THEN 'blocked_pattern:/careers/'
      WHEN contains({host(u)}, 'linkedin.com') THEN 'blocked_generic_host'
      WHEN regexp_matches(lower({path(u)}), '/(job|jobs|positions|role|roles|vacancies|opportunities|open-positions)/') THEN 'generic_jobish_path'
      ELSE 'unclassified_non_job' END"""


OK = "('lever_detail','greenhouse_detail','ashby_detail','workday_detail','generic_jobish_path')"
add("F2_url_quality_gate", f"""WITH {OBS}, g AS (SELECT obs_id, raw_url, {gate('raw_url')} AS gate_reason FROM obs)
SELECT obs_id, raw_url, gate_reason IN {OK} AS is_posting_url, gate_reason FROM g""")

CLASSIFY = f"""CASE WHEN raw_url = '' THEN 'blank_url' WHEN contains(raw_url, '?keyword=') THEN 'blocked_pattern:?keyword='
  WHEN contains(raw_url, '/search') THEN 'blocked_pattern:/search'
  WHEN NOT regexp_matches(raw_url, 'greenhouse\\.io|lever\\.co|myworkdayjobs\\.com|ashbyhq\\.com|smartrecruiters\\.com') THEN 'blocked_domain'
  ELSE {gate('raw_url')} END"""
CLASSIFIED = f"{OBS}, c AS (SELECT *, {CLASSIFY} AS class_reason FROM obs)"
add("F3_classify_source_url", f"""WITH {CLASSIFIED} SELECT provider, class_reason, count(*) AS dropped FROM c
WHERE class_reason NOT IN {OK} GROUP BY ALL""")
add("F3_kept_urls", f"WITH {CLASSIFIED} SELECT raw_url, min(obs_id) AS first_pos FROM c WHERE class_reason IN {OK} GROUP BY 1")
add("A1_tier_samples", f"""WITH {CLASSIFIED}, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY obs_id) AS rn FROM c WHERE class_reason NOT IN {OK}),
s AS (SELECT provider, string_agg(class_reason, ' | ' ORDER BY obs_id) AS samples FROM r WHERE rn <= 5 GROUP BY 1)
SELECT provider, class_reason, count(*) AS n, any_value(samples) AS samples FROM r JOIN s USING (provider) GROUP BY 1, 2""")

LIGHT = "CASE WHEN raw_url = '' THEN '' ELSE regexp_replace(regexp_replace(raw_url, '([^:])/+', '\\1/', 'g'), '/$', '') END"
add("F4_pick_best_url", f"""WITH {OBS}, l AS (SELECT obs_id // 4 AS result_id, obs_id, {LIGHT} AS u FROM obs),
k AS (SELECT *, CASE WHEN u = '' THEN 3 WHEN regexp_matches({host('u')}, 'greenhouse\\.io|lever\\.co|myworkdayjobs\\.com|ashbyhq\\.com') THEN 0
  WHEN contains({host('u')}, 'linkedin.com') AND contains(u, '/jobs/view/') THEN 1 ELSE 2 END AS c FROM l)
SELECT result_id, CASE WHEN c <= 1 THEN u ELSE '' END AS best_url,
 CASE c WHEN 0 THEN 'preferred_host' WHEN 1 THEN 'detail_like_discovery_url' WHEN 2 THEN 'no_preferred_or_detail_candidate' ELSE 'no_candidate_url' END AS pick_reason
FROM k QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY c, obs_id) = 1""")

# --- F5-F7: hints of the test URLs, then the profile rules ------------------------


def hint(u: str) -> str:
    """What is left of the last three path parts once ids and labels go."""
    ignored = "['job','jobs','careers','career','positions','roles','external','internal','apply','view','en','us']"
    vendor = f"regexp_matches({host(u)}, 'jobs\\.lever\\.co|boards\\.greenhouse\\.io|jobs\\.ashbyhq\\.com|myworkdayjobs\\.com')"
    tail = f"({segs(u)})[-3:]"
    named = f"list_filter({tail}, lambda s: NOT list_contains({ignored}, {plain('s')}))"
    chosen = f"CASE WHEN {vendor} THEN CASE WHEN len({named}) >= 2 THEN ({named})[2:] ELSE {named} END ELSE {tail} END"
    kept = f"list_filter({chosen}, lambda s: NOT list_contains({ignored}, {plain('s')}) AND NOT regexp_matches(s, '^\\d+$'))"
    text = f"array_to_string(list_transform({kept}, lambda s: {plain('s')}), ' ')"
    return f"(SELECT CASE WHEN len(list_filter(string_split(t, ' '), lambda w: w <> '' AND NOT regexp_matches(w, '^\\d+$'))) < 2 THEN '' ELSE t END FROM (SELECT {text} AS t))"


LEVELS = {"chief": "chief|ceo|cto|cio|cfo|coo|cmo|cro", "vice_president": "vp|avp|svp|evp|vice president",
          "director": "director|head", "manager": "manager|supervisor", "lead": "lead|principal"}
LANES = {
    "technology": "technology|it|information|engineering|software|systems|infrastructure|security|cybersecurity|cyber|architecture|platform|application|applications|data|analytics|digital|product|technical",
    "ai": "ai|artificial|intelligence",
    "finance": "finance|financial|accounting|treasury|audit|controller",
    "operations": "operations|operational|manufacturing|supply|procurement|logistics|construction|plant|facilities|warehouse",
    "sales": "sales|revenue|commercial|growth",
    "marketing": "marketing|brand|communications|content",
    "people": "people|hr|human|talent|recruiting|acquisition",
    "legal": "legal|compliance|privacy|regulatory|counsel",
}


def groups(x: str, table: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({x}, '(^| )({words})( |$)') THEN '{name}' END" for name, words in table.items())
    return f"list_filter([{cases}], lambda g: g IS NOT NULL)"


def flat(titles: str, table: dict[str, str]) -> str:
    return f"coalesce(list_distinct(flatten(list_transform({titles}, lambda t: {groups(plain('t'), table)}))), [])"


SIDES = f"""{OBS}, {PREPARED}, h0 AS (SELECT obs_id, raw_url, profile_id, {hint('raw_url')} AS hint FROM obs),
h AS (SELECT h0.*, p.*EXCLUDE(profile_id), {groups('hint', LEVELS)} AS hl, {groups('hint', LANES)} AS hn,
 {flat('hints', LEVELS)} AS tl, {flat('hints', LANES)} AS tn, {flat('scoring', LEVELS)} AS sl, {flat('scoring', LANES)} AS sn
 FROM h0 JOIN prepared p USING (profile_id))"""


def fits(levels: str, lanes: str) -> str:
    return f"NOT (len({levels}) > 0 AND len(hl) > 0 AND NOT list_has_any({levels}, hl)) AND NOT (len({lanes}) > 0 AND len(hn) > 0 AND NOT list_has_any({lanes}, hn))"


PRE = f"""{SIDES}, f AS (SELECT *, ({fits('tl', 'tn')}) AS fit,
  (list_filter(hints, lambda t: contains(hint, {plain('t')})))[1] AS said,
  list_sort(list_filter(list_distinct(string_split(hint, ' ')), lambda w: (length(w) >= 3 OR w = 'ai') AND
    list_contains(flatten(list_transform(hints, lambda t: string_split({plain('t')}, ' '))), w))) AS shared FROM h),
t AS (SELECT obs_id, raw_url, profile_id, hint AS title_hint,
  len(targets) = 0 OR hint = '' OR said IS NOT NULL OR (len(shared) > 0 AND fit) AS title_pass,
  CASE WHEN len(targets) = 0 THEN 'no target titles configured' WHEN hint = '' THEN 'no reliable url title hint'
   WHEN said IS NOT NULL THEN concat('url title hint matched ''', said, '''')
   WHEN len(shared) > 0 AND NOT fit THEN 'url title signature mismatch: ' || hint
   WHEN len(shared) > 0 THEN 'url title hint token overlap: ' || array_to_string(shared[1:3], ', ')
   WHEN NOT fit THEN 'url title signature mismatch: ' || hint ELSE 'url title prefilter mismatch: ' || hint END AS title_reason FROM f)"""
add("F5_title_prefilter", f"WITH {PRE} SELECT obs_id, profile_id, title_hint, title_pass, title_reason FROM t")

add("F6_seed_title_prefilter", f"""WITH {SIDES}, best AS (
 SELECT obs_id, t, contains(hint, {plain('t')}) AS ph,
  len(list_intersect(list_distinct(string_split({plain('t')}, ' ')), list_distinct(string_split(hint, ' ')))) / len(list_distinct(string_split({plain('t')}, ' '))) AS ov
 FROM (SELECT obs_id, hint, unnest(scoring) AS t, generate_subscripts(scoring, 1) AS i FROM h)
 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY ph DESC, ov DESC, i) = 1),
j AS (SELECT h.*, t, coalesce(ph, false) AS ph, coalesce(ov, 0) AS ov, ({fits('sl', 'sn')}) AS fit,
  len(list_filter(string_split(hint, ' '), lambda w: length(w) >= 3)) = 0 AS sparse,
  list_has_any(sl, hl) AND list_has_any(sn, hn) AS both_ok FROM h LEFT JOIN best USING (obs_id))
SELECT obs_id, profile_id, len(scoring) = 0 OR hint = '' OR sparse OR (fit AND (ph OR ov >= 0.34 OR both_ok)) AS seed_title_pass,
 CASE WHEN len(scoring) = 0 THEN 'no target titles configured' WHEN hint = '' THEN 'no reliable url title hint'
  WHEN sparse THEN 'url title hint too sparse for seed filtering' WHEN NOT fit THEN 'seed title signature mismatch: ' || hint
  WHEN ph THEN concat('seed title phrase matched ''', t, '''')
  WHEN ov >= 0.34 THEN concat('seed title overlap matched ''', t, ''' (', printf('%.2f', ov), ')')
  WHEN both_ok THEN 'seed leadership/function lane matched: ' || hint ELSE 'seed title prefilter mismatch: ' || hint END AS seed_title_reason FROM j""")

add("F7_seed_location_prefilter", f"""WITH {OBS}, {PREPARED}, s AS (SELECT obs_id, profile_id,
  trim({path('raw_url')} || ' ' || split_part(raw_url, '?', 2)) AS src FROM obs),
n AS (SELECT s.*, p.*EXCLUDE(profile_id), {plain('src')} AS n FROM s JOIN prepared p USING (profile_id)),
w AS (SELECT *, contains(n, 'remote') AS rem, (list_filter(list_transform(wishes, lambda x:
   CASE WHEN contains(n, {plain('x')}) THEN concat('url location hint matched ''', x, '''')
    WHEN list_has_any(list_filter(string_split({plain('x')}, ' '), lambda k: length(k) >= 4), string_split(n, ' '))
     THEN 'url location hint token overlap: ' || array_to_string(list_sort(list_filter(string_split({plain('x')}, ' '), lambda k: length(k) >= 4))[1:2], ', ') END),
   lambda r: r IS NOT NULL))[1] AS hit FROM n)
SELECT obs_id, profile_id,
 CASE WHEN n = '' THEN true WHEN rem THEN remote_only OR include_remote WHEN remote_only THEN false ELSE hit IS NOT NULL END AS seed_place_pass,
 CASE WHEN n = '' THEN 'no reliable url location hint' WHEN rem THEN 'url location hint matched remote'
  WHEN remote_only THEN 'url location prefilter mismatch: remote_only'
  ELSE coalesce(hit, 'url location prefilter mismatch: ' || src) END AS seed_place_reason FROM w""")

GATED = f"""{PRE}, v AS (SELECT obs_id, run_id, obs.profile_id, provider, {vendor_form('obs.raw_url')} AS url, title_pass
  FROM obs JOIN t USING (obs_id)), g0 AS (SELECT *, {gate('url')} IN {OK} AS ok FROM v),
 g1 AS (SELECT *, ok AND title_pass AND obs_id = min(CASE WHEN ok AND title_pass THEN obs_id END) OVER (PARTITION BY run_id, url) AS fst FROM g0),
 gated AS (SELECT obs_id, run_id, profile_id, provider, url,
  CASE WHEN NOT ok THEN 'url_gate' WHEN NOT title_pass THEN 'url_title_prefilter' WHEN NOT fst THEN 'batch_dedup' ELSE 'accepted' END AS stage,
  CASE WHEN NOT ok THEN 'non_job_url' WHEN NOT title_pass THEN 'weak_url_title_match' WHEN NOT fst THEN 'duplicate_in_batch' ELSE '' END AS reason,
  ok AND title_pass AND fst AS passed FROM g1)"""
add("F1_gate_cascade", f"WITH {GATED} SELECT * FROM gated")
add("A1_reason_summary", f"""WITH {GATED} SELECT reason, count(*) AS n, min(obs_id) AS first_pos,
  coalesce(arg_min(url, obs_id) FILTER (url <> ''), '') AS example, (SELECT count(*) FROM gated WHERE reason <> '') AS total
FROM gated WHERE reason <> '' GROUP BY 1 ORDER BY n DESC, first_pos LIMIT 8""")


def quality(rows: str, drops: str = "") -> str:
    """A3 over the rows (run_id, obs_id, reason) of a CTE; drops: a CTE of (run_id, drop_reason)."""
    post = "('parse_failed', 'processing_error', 'title_mismatch', 'location_mismatch', 'excluded_keyword', 'below_threshold')"
    dropped = f"""WHEN (SELECT bool_or(drop_reason = 'blocked_domain') FROM {drops} d WHERE d.run_id = a.run_id) THEN 'noisy_sources'
  WHEN len(shown) > 0 OR EXISTS (SELECT 1 FROM {drops} d WHERE d.run_id = a.run_id) THEN 'hidden_in_mix'""" if drops else "WHEN len(shown) > 0 THEN 'hidden_in_mix'"
    return f"""r AS (SELECT run_id, reason, count(*) AS n, min(obs_id) AS p FROM {rows} GROUP BY 1, 2),
 dom AS (SELECT run_id, reason, n FROM r WHERE reason NOT IN ('', 'duplicate_in_batch') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, p) = 1),
 top8 AS (SELECT run_id, list(reason) AS shown FROM (SELECT * FROM r WHERE reason <> '' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, p) <= 8) GROUP BY 1),
 a AS (SELECT run_id, count(*) AS seen, count(*) FILTER (reason = '') AS accepted, count(*) FILTER (reason IN ('non_job_url', 'weak_url_title_match')) AS pre_parse,
  count(*) FILTER (reason IN {post}) AS post_parse, count(*) FILTER (reason = 'duplicate_in_batch') AS duplicates, count(*) FILTER (reason <> '') AS skipped FROM {rows} GROUP BY 1)
SELECT a.*, coalesce(dom.reason, '') AS dominant_reason, coalesce(dom.n, 0) AS dominant_count,
 round(accepted::DOUBLE * 100 / seen, 1) AS accepted_pct, round(pre_parse::DOUBLE * 100 / seen, 1) AS pre_parse_pct, round(post_parse::DOUBLE * 100 / seen, 1) AS post_parse_pct,
 round(duplicates::DOUBLE * 100 / seen, 1) AS duplicates_pct, round(coalesce(dom.n, 0)::DOUBLE * 100 / greatest(skipped, 1), 1) AS dominant_pct,
 CASE WHEN accepted = 0 AND pre_parse > post_parse THEN 'weak_discovery' WHEN accepted = 0 THEN 'poor_fit'
  WHEN dom.reason IS NOT NULL THEN 'limited_by_' || dom.reason ELSE 'clean' END AS verdict,
 CASE WHEN list_contains(shown, 'location_mismatch') THEN 'location_strictness' WHEN list_contains(shown, 'title_mismatch') THEN 'title_drift'
  WHEN list_contains(shown, 'weak_url_title_match') THEN 'url_title_prefilter' {dropped} ELSE '' END AS limiter
 FROM a LEFT JOIN dom USING (run_id) LEFT JOIN top8 USING (run_id)"""


add("A3_run_quality", f"WITH {GATED}, {quality('gated')}")

# --- locations: the twelve test places and the wishes, parsed by hand ----------------
PLACE_ROWS = """places(location, nrm, city, region, country, rem) AS (SELECT * FROM (VALUES
 ('Remote', 'remote', '', '', '', true), ('United States Remote', 'united states remote', 'united states remote', '', '', true),
 ('Dallas, TX', 'dallas, tx', 'dallas', 'tx', '', false), ('Hybrid in Seattle, WA', 'hybrid in seattle, wa', 'seattle', 'wa', '', false),
 ('Innovation Campus (Dallas), United States of America', 'innovation campus dallas , united states of america', 'innovation campus dallas', '', 'united states', false),
 ('Toronto, Ontario, Canada', 'toronto, ontario, canada', 'toronto', 'on', 'canada', false), ('London, UK', 'london, uk', 'london', '', 'united kingdom', false),
 ('Texas', 'texas', '', 'tx', '', false), ('', '', '', '', '', false), ('Plano - TX', 'plano tx', 'plano tx', '', '', false),
 ('Mexico Remote', 'mexico remote', 'mexico remote', '', '', true), ('New York, NY', 'new york, ny', '', 'ny', '', false)) x)"""
WISH_ROWS = """wish(w, wn, wcity, wregion, wcountry) AS (SELECT * FROM (VALUES ('Dallas, TX', 'dallas, tx', 'dallas', 'tx', ''), ('Texas', 'texas', '', 'tx', ''),
 ('New York, NY', 'new york, ny', '', 'ny', ''), ('United States', 'united states', '', '', 'united states'), ('Canada', 'canada', '', '', 'canada'),
 ('London, UK', 'london, uk', 'london', '', 'united kingdom')) y)"""
LOC = f"""{POSTINGS}, {PREPARED}, {PLACE_ROWS}, {WISH_ROWS},
 tok AS (SELECT *, list_filter(string_split(nrm, ' '), lambda t: length(t) >= 2) AS pt FROM places),
 hits AS (SELECT location, profile_id, i, CASE
   WHEN wcountry <> '' AND wcity = '' AND wregion = '' AND country = wcountry THEN concat('matched country ''', wcountry, '''')
   WHEN wregion <> '' AND wcity = '' AND region = wregion THEN concat('matched region ''', wregion, '''')
   WHEN wcity <> '' AND wregion <> '' AND city = wcity AND region = wregion THEN concat('matched city+region ''', wcity, ', ', wregion, '''')
   WHEN wcity <> '' AND wregion = '' AND city = wcity THEN concat('matched city ''', wcity, '''')
   WHEN contains(nrm, wn) THEN concat('matched normalized phrase ''', wn, '''')
   WHEN list_has_all(pt, list_filter(string_split(wn, ' '), lambda t: length(t) >= 2)) THEN 'matched by token subset'
   WHEN wcity <> '' AND list_has_all(pt, list_filter(string_split(wcity, ' '), lambda t: length(t) >= 3)) AND country = 'united states' THEN 'matched city tokens within us location'
   END || concat(' from ''', w, '''') AS why
  FROM tok, (SELECT profile_id, unnest(wishes) AS w, generate_subscripts(wishes, 1) AS i FROM prepared) q JOIN wish USING (w) WHERE nrm <> ''),
 hit AS (SELECT location, profile_id, why FROM hits WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location, profile_id ORDER BY i) = 1),
 loc AS (SELECT p.*, r.* EXCLUDE (profile_id), nrm, rem, why FROM postings p JOIN prepared r USING (profile_id) JOIN places USING (location) LEFT JOIN hit USING (location, profile_id)),
 verdict AS (SELECT *, CASE WHEN remote_only THEN rem WHEN include_remote AND rem THEN true WHEN len(wishes) = 0 THEN nrm <> '' ELSE why IS NOT NULL END AS place_pass,
  CASE WHEN remote_only AND rem THEN 'remote_only matched remote location' WHEN remote_only THEN 'remote_only_gate' WHEN include_remote AND rem THEN 'matched remote location'
   WHEN len(wishes) = 0 THEN CASE WHEN nrm <> '' THEN 'no preferred location set' ELSE 'blank_location_gate' END ELSE coalesce(why, 'settings_location_gate') END AS place_reason FROM loc)"""
add("F8_location_filter", f"WITH {LOC} SELECT posting_id, profile_id, place_pass, place_reason FROM verdict")
add("J5_match_location", f"""WITH {LOC} SELECT posting_id, profile_id, len(wishes) = 0 OR why IS NOT NULL AS place_match,
 CASE WHEN len(wishes) = 0 THEN 'no preferred location set' WHEN nrm = '' THEN 'blank job location' ELSE coalesce(why, 'no preferred location match') END AS place_match_reason FROM loc""")

add("J5_match_locations_keyed", f"""WITH {LOC} SELECT posting_id, profile_id, len(wishes) = 0 OR why IS NOT NULL AS place_match,
 CASE WHEN len(wishes) = 0 THEN 'no preferred location set' WHEN nrm = '' THEN 'blank job location' ELSE coalesce(why, 'no preferred location match') END AS place_match_reason FROM loc""")

# Five kinds of profile, one for each customer by its number.
add("J14_top_profiles", f"""WITH {POSTINGS}, {PREPARED}, tt AS (SELECT DISTINCT title, {norm('title')} AS nt FROM postings WHERE title <> ''),
 sc AS (SELECT title, profile_id AS kind, max(CASE WHEN contains(nt, {norm('t')}) THEN 55
   ELSE (CASE len(list_intersect(list_distinct(string_split(nt, ' ')), list_distinct(string_split({norm('t')}, ' ')))) WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 42 END) END) AS s
  FROM (SELECT title, nt, profile_id, unnest(scoring) AS t FROM tt, prepared) GROUP BY 1, 2
  UNION ALL SELECT title, profile_id, 20 FROM tt, prepared WHERE len(scoring) = 0),
 pl AS (SELECT title, c_custkey AS profile_id, s, row_number() OVER (PARTITION BY title ORDER BY s DESC, c_custkey) AS place FROM sc JOIN customer ON c_custkey % 5 = kind WHERE s > 0 QUALIFY place <= 3)
SELECT posting_id, pl.profile_id::INT AS profile_id, s::INT AS title_score, place::INT AS place FROM postings p JOIN pl USING (title)""")

TITLE = f"""best AS (SELECT posting_id, score, t FROM (SELECT posting_id, i, t, CASE WHEN contains(nt, {norm('t')}) THEN 55
   ELSE (CASE len(list_intersect(list_distinct(string_split(nt, ' ')), list_distinct(string_split({norm('t')}, ' ')))) WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 42 END) END AS score
  FROM (SELECT posting_id, {norm('title')} AS nt, unnest(scoring) AS t, generate_subscripts(scoring, 1) AS i FROM verdict))
  QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY score DESC, i) = 1),
 titled AS (SELECT v.*, {norm('title')} AS nt, CASE WHEN title = '' THEN 0 WHEN len(scoring) = 0 THEN 20 ELSE score END AS ts,
  CASE WHEN title = '' THEN 'missing job title' WHEN len(scoring) = 0 THEN 'no target titles provided'
   WHEN score = 0 THEN 'no strong title overlap' ELSE concat(CASE score WHEN 55 THEN 'title contains target' WHEN 42 THEN 'strong token overlap with'
    WHEN 32 THEN 'good token overlap with' ELSE 'light token overlap with' END, ' ''', t, '''') END AS tr
  FROM verdict v LEFT JOIN best USING (posting_id))"""
add("J6_match_titles", f"WITH {LOC}, {TITLE} SELECT posting_id, profile_id, ts AS title_score, tr AS title_score_reason FROM titled")

TECH = "technology|it|digital|platform|infrastructure|enterprise systems|enterprise applications|architecture|engineering|security|data|ai|artificial intelligence|machine learning|cloud|applications|systems|technical"
OTHER = "sales|marketing|revenue|customer success|finance|financial|legal|hr|human resources|people|talent|operations|clinical|medicare|aca marketplace|commercial|partnerships|growth"
QUAL = f"""{LOC}, {TITLE},
 q0 AS (SELECT *, regexp_matches(nt, '{TECH}') AS tt, regexp_matches(nt, '{OTHER}') AS ot,
   {norm("concat_ws(' ', title, company, location, compensation_raw)")} AS alltext FROM titled),
 q1 AS (SELECT *, list_filter(inc, lambda k: contains(alltext, k)) AS ki, list_filter(exc, lambda k: contains(alltext, k)) AS ke,
  CASE WHEN tech THEN CASE WHEN tt THEN 25 WHEN ot THEN -35 ELSE -10 END WHEN ot THEN -15 ELSE 0 END AS fs,
  CASE WHEN tech THEN CASE WHEN tt THEN 'strong technology-lane signal' WHEN ot THEN 'title appears to be in a different executive function'
    ELSE 'limited technology-lane signal' END WHEN ot THEN 'different executive function detected' END AS fr,
  CASE WHEN tech AND ot AND NOT tt THEN 'wrong function' END AS fx,
  CASE WHEN remote_only THEN CASE WHEN rem THEN 22 WHEN nrm = '' THEN 5 ELSE -20 END
   WHEN len(wishes) = 0 THEN CASE WHEN rem THEN CASE WHEN include_remote THEN 12 ELSE -8 END ELSE 8 END
   WHEN why IS NOT NULL THEN 20 WHEN include_remote AND rem THEN 10 ELSE -8 END AS ls,
  CASE WHEN remote_only THEN CASE WHEN rem THEN 'remote-only preference matched' WHEN nrm = '' THEN 'location missing' ELSE 'role is not remote' END
   WHEN len(wishes) = 0 THEN CASE WHEN rem THEN CASE WHEN include_remote THEN 'remote accepted' ELSE 'location mismatch' END ELSE 'no preferred locations provided' END
   WHEN why IS NOT NULL THEN why WHEN include_remote AND rem THEN 'remote accepted as fallback' ELSE 'location mismatch' END AS lr FROM q0),
 q2 AS (SELECT *, CASE WHEN lr IN ('location mismatch') THEN 'location mismatch' WHEN lr = 'role is not remote' THEN 'not remote' END AS lx,
  CASE WHEN len(ke) > 0 THEN 'matched excluded keywords: ' || array_to_string(ke[1:4], ', ') END AS kx,
  CASE WHEN len(ki) > 0 THEN 'matched include keywords: ' || array_to_string(ki[1:4], ', ') END AS kr,
  greatest(0, least(100, ts + fs + ls + CASE WHEN len(ki) > 0 THEN least(18, 8 + 3 * len(ki)) ELSE 0 END - CASE WHEN len(ke) > 0 THEN 40 ELSE 0 END)) AS score FROM q1),
 q3 AS (SELECT *, coalesce(kx, fx, lx, CASE WHEN ts = 0 AND len(targets) > 0 THEN 'title mismatch' END, '') AS reject_reason,
  array_to_string(list_filter([tr, fr, lr, kr, kx], lambda s: s IS NOT NULL), '; ') AS rationale FROM q2),
 q4 AS (SELECT *, score >= 50 AND reject_reason = '' AND place_pass AS acc FROM q3),
 q AS (SELECT *, NOT acc AND len(wishes) = 0 AND title <> '' AND len(list_filter(CASE profile_id WHEN 3 THEN hints[1:3] ELSE hints END, lambda h: contains(lower(title), h))) > 0 AS forced FROM q4)"""
NOTED = """array_to_string(list_filter([nullif(array_to_string(list_filter([nullif(rationale, ''), CASE WHEN reject_reason <> '' THEN 'qualifier reject: ' || reject_reason END,
  CASE WHEN NOT place_pass THEN 'hard reject: ' || place_reason END], lambda s: s IS NOT NULL), '; '), ''), CASE WHEN forced THEN 'blank-location title override' END], lambda s: s IS NOT NULL), ' | ')"""
MATCH_SCORE = "(CASE WHEN forced THEN greatest(score, 45) ELSE score END)::INT"
add("C1_qualify", f"""WITH {QUAL} SELECT posting_id, profile_id, score::INT AS score, CASE WHEN score >= 75 THEN 'Strong' WHEN score >= 50 THEN 'Review' ELSE 'Low' END AS fit_tier,
 acc OR forced AS accepted, forced, reject_reason, rationale, {MATCH_SCORE} AS match_score, {NOTED} AS reason_text, place_pass OR forced AS place_pass,
 CASE WHEN forced THEN 'blank-location title override' ELSE place_reason END AS place_reason,
 CASE WHEN acc OR forced THEN '' WHEN NOT place_pass THEN 'location_mismatch' WHEN contains(reject_reason, 'excluded keyword') THEN 'excluded_keyword'
  WHEN reject_reason = 'title mismatch' THEN 'title_mismatch' WHEN reject_reason IN ('location mismatch', 'not remote') THEN 'location_mismatch' ELSE 'below_threshold' END AS match_skip FROM q""")

SKIPPED = """CASE WHEN acc OR forced THEN '' WHEN NOT place_pass THEN 'location_mismatch' WHEN contains(reject_reason, 'excluded keyword') THEN 'excluded_keyword'
  WHEN reject_reason = 'title mismatch' THEN 'title_mismatch' WHEN reject_reason IN ('location mismatch', 'not remote') THEN 'location_mismatch' ELSE 'below_threshold' END"""
RECORDS = "postings AS (" + sql(derived.OBSERVED_POSTINGS) + ")"
FULL = f"""{PRE}, v AS (SELECT obs_id, run_id, obs.profile_id, provider, {vendor_form('obs.raw_url')} AS url, title_pass FROM obs JOIN t USING (obs_id)),
 g0 AS (SELECT *, {gate('url')} IN {OK} AS ok FROM v), {QUAL.replace(POSTINGS, RECORDS).replace(PREPARED + ", ", "", 1)},
 rec AS (SELECT posting_id AS obs_id, {derived.PAGE_STATUS.format(id='posting_id')} AS page_status, acc OR forced AS good, forced, {SKIPPED} AS match_skip, {MATCH_SCORE} AS match_score, {NOTED} AS reason_text,
   array_to_string(list_filter([regexp_replace(lower(company), '[^a-z0-9]', '', 'g'), regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(location), '[^a-z0-9]', '', 'g')], lambda s: s <> ''), '|') AS bkey FROM q),
 p0 AS (SELECT g0.*, rec.* EXCLUDE (obs_id), CASE WHEN page_status = 'ok' THEN '' WHEN page_status = 'expired' OR (page_status = '404' AND
   regexp_matches(lower(url), '^https?://[^/]*(jobs[.]lever[.]co|boards[.]greenhouse[.]io|myworkdayjobs[.]com|jobs[.]smartrecruiters[.]com|jobs[.]ashbyhq[.]com)')) THEN 'stale_ats_posting' ELSE 'parse_failed' END AS pf FROM g0 LEFT JOIN rec USING (obs_id)),
 p1 AS (SELECT *, ok AND title_pass AND pf = '' AS parsed FROM p0),
 p2 AS (SELECT *, obs_id = min(CASE WHEN parsed AND good THEN obs_id END) OVER (PARTITION BY run_id, CASE WHEN parsed AND good THEN bkey ELSE 'row ' || obs_id END) AS fst FROM p1),
 whole AS (SELECT obs_id, run_id, profile_id, provider, url,
  CASE WHEN NOT ok THEN 'url_gate' WHEN NOT title_pass THEN 'url_title_prefilter' WHEN pf <> '' THEN 'page_parse' WHEN NOT good THEN 'match_score' WHEN NOT fst THEN 'batch_dedup' ELSE 'accepted' END AS stage,
  CASE WHEN NOT ok THEN 'non_job_url' WHEN NOT title_pass THEN 'weak_url_title_match' WHEN pf <> '' THEN pf WHEN NOT good THEN match_skip WHEN NOT fst THEN 'duplicate_in_batch' ELSE '' END AS reason,
  parsed AND good AND fst AS passed, CASE WHEN parsed THEN match_score ELSE 0 END::INT AS match_score, parsed AND forced AS forced, CASE WHEN parsed THEN reason_text ELSE '' END AS reason_text FROM p2)"""
add("F1_full_cascade", f"WITH {FULL} SELECT * FROM whole")
add("A3_full_skip_reasons", f"WITH {FULL} SELECT run_id, stage, reason, count(*) AS n FROM whole GROUP BY 1, 2, 3")
add("A3_full_run_quality", f"WITH {FULL}, drp AS (SELECT run_id, c AS drop_reason FROM (SELECT run_id, {CLASSIFY} AS c FROM obs) WHERE c NOT IN {OK}), {quality('whole', 'drp')}")

add("F9_settings_gates", f"""WITH {POSTINGS}, {PREPARED}, x AS (SELECT p.*, r.* EXCLUDE (profile_id), lower(title) AS lt, lower(location) AS ll,
  lower(concat_ws(' ', title, company, location, compensation_raw)) AS al FROM postings p JOIN prepared r USING (profile_id))
SELECT posting_id, NOT regexp_matches(lt, 'director|manager|principal|lead|staff |counsel|recruiting|sales|tax|design|safety')
  AND regexp_matches(lt, 'vp|vice president|head of|chief|cto|cio|coo')
  AND regexp_matches(lt, 'technology|it|information|digital|platform|ai|systems|security|data|machine learning|ml|applications|infrastructure|engineering platform') AS strict_title_ok,
 len(targets) = 0 OR len(list_filter(targets, lambda t: contains(lt, lower(t)))) > 0 AS title_ok,
 CASE WHEN remote_only THEN contains(ll, 'remote') WHEN include_remote AND contains(ll, 'remote') THEN true
  WHEN len(wishes) > 0 THEN len(list_filter(wishes, lambda w: contains(ll, lower(w)))) > 0 ELSE NOT contains(ll, 'remote') OR include_remote END AS place_ok,
 len(list_filter(exc, lambda k: contains(al, lower(k)))) = 0 AS keywords_ok FROM x""")
add("F11_review_filters", f"""WITH {ENRICHED} SELECT posting_id, fit_score, location, compensation_raw, source_trust FROM enriched
WHERE fit_score >= 50 AND location ILIKE '%remote%' AND compensation_raw NOT IN ('', 'Not Disclosed') AND source_trust = 'ATS Confirmed'""")
WF = "CASE workflow_status WHEN 'New' THEN 0 WHEN 'Applied' THEN 1 ELSE 2 END"
add("F12_select_for_rescore", f"""WITH {POSTINGS} SELECT posting_id, workflow_status, strftime(first_seen_at, '%Y-%m-%d') AS updated_on FROM postings
WHERE active_status <> 'Removed' AND first_seen_at <= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY ORDER BY {WF}, first_seen_at DESC, posting_id DESC LIMIT 200""")
add("F13_select_for_maintenance", f"""WITH {POSTINGS} SELECT posting_id, title, compensation_raw, workflow_status FROM postings
WHERE active_status <> 'Removed' AND last_seen_run_id <> 199803 AND (title = '' OR compensation_raw = '' OR posting_id % 3 = 0 OR first_seen_at <= TIMESTAMP '1998-06-01' - INTERVAL 7 DAY)
ORDER BY CASE WHEN title = '' THEN 0 WHEN compensation_raw = '' THEN 1 WHEN posting_id % 3 = 0 THEN 2 ELSE 3 END, {WF}, fit_score DESC NULLS LAST, first_seen_at DESC, posting_id DESC LIMIT 500""")

# --- duplicates and sightings ---------------------------------------------------------
KEYED = f"""{ENRICHED}, k AS (SELECT *, CASE WHEN posting_id % 3 = 0 THEN 'url:' || lower(job_posting_url) ELSE 'dup:' || duplicate_key END AS batch_key FROM enriched)"""
add("W1_dedupe_batch", f"WITH {KEYED} SELECT min(posting_id) AS posting_id, batch_key, count(*) - 1 AS duplicates FROM k GROUP BY batch_key")
add("W1_dedupe_batch_best", f"""WITH {KEYED} SELECT posting_id, batch_key, count(*) OVER (PARTITION BY batch_key) - 1 AS duplicates FROM k
QUALIFY row_number() OVER (PARTITION BY batch_key ORDER BY CASE source_trust WHEN 'ATS Confirmed' THEN 4 WHEN 'Career Site Confirmed' THEN 3 WHEN 'Web Discovered' THEN 2 ELSE 1 END DESC,
 length(source_detail) DESC, length(job_posting_url) DESC, length(title) DESC, posting_id) = 1""")
add("W2_distinct_in_order", f"WITH {OBS}, v AS (SELECT obs_id, {vendor_form('raw_url')} AS url FROM obs) SELECT min(obs_id) AS obs_id, url FROM v WHERE url <> '' GROUP BY url")
ENTITY = f"{OBS}, e AS (SELECT *, {canonical('raw_url')} AS entity FROM obs)"
add("W3_discovery_state", f"""WITH {ENTITY}, r AS (SELECT DISTINCT entity FROM e WHERE obs_id % 17 = 0 AND entity LIKE '%lever.co%')
SELECT obs_id, entity, run_id, CASE WHEN entity IN (SELECT entity FROM r) THEN 'skipped_removed'
 ELSE CASE WHEN lag(run_id) OVER w IS NULL THEN 'net_new' WHEN lag(run_id) OVER w = run_id THEN 'duplicate_in_run' ELSE 'rediscovered' END END AS discovery_state
FROM e WINDOW w AS (PARTITION BY entity ORDER BY obs_id)""")
add("W4_sighting_stats", f"""WITH {ENTITY} SELECT obs_id, count(*) OVER w AS seen_count, strftime(min(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS first_seen_at,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_seen_at, coalesce(strftime(max(ts) FILTER (obs_id % 4 = 1) OVER w, '%Y-%m-%d %H:%M:%S'), '') AS last_score_at
FROM e WINDOW w AS (PARTITION BY entity ORDER BY obs_id)""")
add("J8_skip_known", f"""WITH {ENRICHED} SELECT posting_id, duplicate_key FROM enriched WHERE duplicate_key NOT IN
 (SELECT duplicate_key FROM enriched WHERE posting_id % 5 = 0 OR posting_id % 17 = 0)""")
add("J11_seed_attribution", f"""WITH {ENRICHED}, s AS (SELECT DISTINCT lower(job_posting_url) AS u FROM enriched WHERE posting_id % 6 = 0)
SELECT profile_id, count(*) FILTER (lower(job_posting_url) IN (SELECT u FROM s)) AS seeded_jobs,
 count(*) FILTER (lower(job_posting_url) NOT IN (SELECT u FROM s)) AS legacy_jobs FROM enriched GROUP BY 1""")
add("J11_seed_totals", f"""WITH {ENRICHED}, s AS (SELECT DISTINCT lower(job_posting_url) AS u FROM enriched WHERE posting_id % 6 = 0),
 x AS (SELECT profile_id, posting_id, CASE WHEN posting_id % 97 = 0 THEN '(unknown company)' ELSE company END AS company, lower(job_posting_url) IN (SELECT u FROM s) AS seeded FROM enriched),
 c AS (SELECT profile_id, company, min(posting_id) AS p FROM x WHERE seeded GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY min(posting_id)) <= 5),
 n AS (SELECT profile_id, string_agg(company, ', ' ORDER BY p) AS seeded_companies FROM c GROUP BY 1)
SELECT profile_id, count(*) FILTER (seeded) AS seeded_jobs, count(*) FILTER (NOT seeded) AS legacy_jobs, coalesce(any_value(seeded_companies), '') AS seeded_companies FROM x LEFT JOIN n USING (profile_id) GROUP BY 1""")
add("A18_provider_mix", f"WITH {OBS} SELECT run_id, provider, count(DISTINCT raw_url) AS urls FROM obs WHERE raw_url <> '' GROUP BY 1, 2")
add("F4_resolve_redirects", f"""WITH {OBS}, l AS (SELECT obs_id, raw_url, {LIGHT} AS u FROM obs)
SELECT obs_id, CASE obs_id % 4 WHEN 0 THEN CASE WHEN raw_url = '' THEN 'https://go.example.com/r?x=1&target=' ELSE u END WHEN 1 THEN 'https://go.example.com/r?target=soon' ELSE u END AS url,
 CASE WHEN obs_id % 4 = 0 AND raw_url <> '' THEN 'redirect_target' WHEN obs_id % 4 > 1 AND raw_url = '' THEN 'blank' ELSE 'direct' END AS reason FROM l""")
add("U1_merge_providers", f"""WITH {OBS}, v AS (SELECT *, {vendor_form('raw_url')} AS url FROM obs WHERE raw_url <> ''), f AS (SELECT * FROM v
 QUALIFY row_number() OVER (PARTITION BY url ORDER BY CASE provider WHEN 'search' THEN 0 WHEN 'board_a' THEN 1 ELSE 2 END, obs_id) = 1)
SELECT provider, count(*) AS urls, sum(obs_id)::BIGINT AS obs_sum FROM f GROUP BY 1""")

# --- source metrics -------------------------------------------------------------------
YROOT = f"""CASE WHEN posting_id % 3 = 0 THEN source_detail WHEN ats_type = 'Lever' THEN {host('job_posting_url')} || '/' || ({segs('job_posting_url')})[1] ELSE {host('job_posting_url')} END"""
add("A5_source_yield", f"""WITH {ENRICHED}, y AS (SELECT *, ats_type || '::' || {YROOT} AS source_key FROM enriched),
 c AS (SELECT last_seen_run_id, source_key, ats_type, count(*) AS job_count, arg_min(source_trust, posting_id) AS source_trust, arg_min(source_type, posting_id) AS source_type FROM y GROUP BY 1, 2, 3)
SELECT * EXCLUDE (ats_type) FROM c QUALIFY row_number() OVER (PARTITION BY last_seen_run_id ORDER BY job_count DESC, ats_type DESC, source_key DESC) <= 8""")
add("A6_source_dominance", f"""WITH {ENRICHED}, c AS (SELECT last_seen_run_id, ats_type, source_detail, count(*) AS n FROM enriched GROUP BY 1, 2, 3)
SELECT last_seen_run_id, sum(n)::BIGINT AS total_seen, max(n) AS top_count, round(max(n) / sum(n), 4) AS share, max(n) >= 10 AND max(n) / sum(n) >= 0.35 AS flag FROM c GROUP BY 1""")
REG = f"""{ENRICHED}, rk AS (SELECT *, {host('job_posting_url')} AS hostname, CASE WHEN ats_type = 'Lever' THEN 'lever::' || {host('job_posting_url')} || '::' || ({segs('job_posting_url')})[1] ELSE {host('job_posting_url')} END AS source_key FROM enriched),
 reg AS (SELECT source_key, arg_max(CASE WHEN ats_type = 'Lever' THEN 'https://jobs.lever.co/' || ({segs('job_posting_url')})[1] ELSE 'https://' || hostname END, o) AS source_root, any_value(hostname) AS hostname,
  any_value(ats_type) AS ats_type, any_value(source_type) AS source_type, any_value(source_trust) AS source_trust, arg_max(job_posting_url, o) AS example_job_url,
  CASE WHEN max(o) >= 1000000000 THEN 'late' ELSE 'early' END AS source_name, 'run ' || arg_max(last_seen_run_id, o) AS source_detail,
  'active' AS status, count(*) AS seen_count, count(*) AS matching_job_count, min(first_seen_at) AS fs, max(first_seen_at) AS ls
  FROM (SELECT *, CASE WHEN last_seen_run_id >= 199500 THEN 1000000000 ELSE 0 END + posting_id AS o FROM rk) GROUP BY 1)"""
add("A7_build_source_registry", f"""WITH {REG} SELECT * EXCLUDE (fs, ls), strftime(fs, '%Y-%m-%d') AS first_seen_at, strftime(ls, '%Y-%m-%d') AS last_seen_at FROM reg""")
add("A8_registry_totals", f"""WITH {REG} SELECT count(*) AS total_sources, count(*) FILTER (source_trust = 'ATS Confirmed') AS ats_confirmed_sources,
 count(*) FILTER (source_trust = 'Career Site Confirmed') AS career_site_sources, count(*) FILTER (source_trust = 'Web Discovered') AS web_discovered_sources,
 count(*) FILTER (source_trust = 'Third-Party Listing') AS other_sources, count(*) AS active_sources, sum(seen_count)::BIGINT AS total_seen_count, sum(matching_job_count)::BIGINT AS total_matching_job_count FROM reg""")
add("A8_recent_sources", f"WITH {REG} SELECT source_key, source_trust, matching_job_count FROM reg ORDER BY ls DESC, source_key DESC LIMIT 8")
add("A15_review_kpis", f"""WITH {POSTINGS} SELECT count(*) FILTER (workflow_status = 'New' AND active_status = 'Active') AS new_roles,
 count(*) FILTER (workflow_status = 'Applied' AND posting_id % 9 <> 0 AND first_seen_at >= DATE '1998-07-01' - 7) AS applied_this_week,
 round_even(avg(fit_score) FILTER (workflow_status = 'New' AND active_status = 'Active'), 0) AS avg_fit FROM postings""")
add("A16_status_counts", f"""WITH {ENRICHED}, {ENDPOINTS}, {OBS} SELECT 'postings' AS metric, count(*) AS value FROM enriched
UNION ALL SELECT 'new_postings', count(*) FROM enriched WHERE workflow_status = 'New' UNION ALL SELECT 'applied_postings', count(*) FROM enriched WHERE workflow_status = 'Applied'
UNION ALL SELECT 'with_duplicate_key', count(*) FROM enriched WHERE duplicate_key <> '' UNION ALL SELECT 'missing_company', count(*) FROM enriched WHERE company = ''
UNION ALL SELECT 'missing_title', count(*) FROM enriched WHERE title = '' UNION ALL SELECT 'removed_postings', count(*) FROM enriched WHERE posting_id % 17 = 0
UNION ALL SELECT 'endpoints', count(*) FROM endpoints UNION ALL SELECT 'active_endpoints', count(*) FROM endpoints WHERE active = 1
UNION ALL SELECT 'approved_endpoints', count(*) FROM endpoints WHERE review_status = 'approved' UNION ALL SELECT 'latest_run_id', max(run_id) FROM obs""")
