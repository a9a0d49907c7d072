"""SQL equivalents of the catalogue, written from the typed columns.

Where a query renders a text and reads it back, the SQL states the value that was
rendered; it never parses the text.
"""

from __future__ import annotations

OD = "(o_orderdate::DATE + INTERVAL 360 MONTH)::DATE"
LD = "(l_shipdate::DATE + INTERVAL 360 MONTH)::DATE"


def iso(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def plus(d: str, n: int | str) -> str:
    return f"({d} + ({n})::INTEGER)"


def entities(x: str) -> str:
    return f"""replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')"""


def readable(h: str) -> str:
    t = f"regexp_replace({h}, '(?s)<script.*?</script>|<style.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>|</p>|</li>|</div>|</tr>', chr(10), 'g')"
    t = entities(f"regexp_replace({t}, '<[^>]+>', ' ', 'g')")
    return f"trim(regexp_replace({t}, '[ \\t\\r\\f\\v\\x{{a0}}]+', ' ', 'g'), ' ' || chr(10))"


def one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


SCRIPTS = "(?is)<script\\b[^>]*>.*?</script\\s*>|<!--.*?-->"

JUDGED = f"""
j0 AS (
  SELECT o.*, c.c_name, c.c_mktsegment, n.n_name, {OD} AS od, o_orderkey % 12 AS years,
         o_orderpriority = '1-URGENT' AS portal, o_orderpriority IN ('2-HIGH','3-MEDIUM','4-NOT SPECIFIED') AS api
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey),
j1 AS (
  SELECT *, CASE WHEN portal THEN 'Portal Co' WHEN api THEN c_name ELSE 'Low Co' END AS company,
    CASE WHEN api AND c_mktsegment = 'FURNITURE' THEN n_name END AS affiliate_of,
    CASE o_orderstatus WHEN 'F' THEN '환경안전 담당 채용' WHEN 'P' THEN 'EHS 매니저 모집'
      ELSE '회계 담당 채용' || CASE WHEN o_orderpriority = '2-HIGH' THEN ' (안전관리)' ELSE '' END END AS title,
    {plus('od', 45)} AS due
  FROM j0),
j2 AS (
  SELECT *, CASE WHEN portal OR affiliate_of IS NOT NULL THEN 1 WHEN o_orderpriority = '2-HIGH' THEN 2
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS size_rank FROM j1),
j3 AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN '환경,안전' WHEN o_orderstatus = 'P' AND size_rank <= 2 THEN '환경,안전'
      WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN '안전' ELSE '' END AS sec FROM j2),
judged AS (
  SELECT *, CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '2-HIGH' THEN 'off_topic'
      WHEN o_orderpriority = '3-MEDIUM' AND affiliate_of IS NULL THEN 'not_group_affiliate'
      WHEN years > 7 THEN 'min_years' WHEN years = 0 AND affiliate_of IS NULL THEN 'new_grad_small'
      WHEN due < DATE '2028-06-15' THEN 'past_deadline' WHEN o_totalprice > 450000 THEN 'closed_wording'
      WHEN sec = '' THEN 'off_profile' END AS drop_reason
  FROM j3)"""

STATE = f"""
state AS (
  SELECT 's-' || o_orderkey AS id, o_orderkey, o_custkey, c_name AS company, c_mktsegment, c_acctbal, o_orderstatus, n_name,
    CASE WHEN o_orderstatus = 'F' THEN '환경안전 담당 채용 ' ELSE 'EHS 매니저 모집 ' END || o_orderkey AS title,
    CASE WHEN o_orderstatus = 'P' THEN '신입' ELSE '경력' END AS track, (o_orderkey % 12) || '년 이상' AS exp,
    CASE WHEN o_totalprice > 100000 THEN {iso(OD)} END AS posted,
    CASE WHEN o_orderstatus = 'P' THEN '상시' ELSE {iso(plus(OD, 90))} END AS deadline,
    'https://www.saramin.co.kr/v?rec_idx=' || o_orderkey AS link, o_orderpriority AS source,
    {iso(OD)} AS first_seen, {iso(plus(OD, 'o_orderkey % 60'))} AS last_seen,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status,
    CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN '마감됨 · 원문 확인' WHEN o_totalprice > 400000 THEN '원문 확인' END AS verify,
    CASE WHEN o_totalprice > 200000 THEN {iso(OD)} END AS verified_at,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 WHEN 'FURNITURE' THEN 4 ELSE 2 END AS size_rank,
    c_acctbal / 10000 AS rel_score, CASE WHEN c_acctbal > 5000 THEN '추천' ELSE '검토' END AS tier
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)"""

DOC_HEALTH = """
h AS (
  SELECT source, found, ok, ok AND text_len < 20 AS suspicious, source < 'src15' AS is_api
  FROM (SELECT source, count(*) AS found, count_if(contains(text, 'tion')) % 3 = 0 AS ok, min(n_chars) AS text_len FROM documents GROUP BY source))"""

DOC_SECTIONS = """
s AS (
  SELECT *, regexp_matches(text, 'tion|ung', 'i') AND NOT regexp_matches(text || ' ' || source, 'quest|schwer', 'i')
      AND regexp_matches(text, 'ment|ing', 'i') AND NOT regexp_matches(text || ' ' || source, 'zzz', 'i') AS a,
    regexp_matches(text, 're', 'i') AND NOT regexp_matches(CASE WHEN regexp_matches(text, 'TION', 'i')
      THEN regexp_replace(text || ' ' || source, 'que', ' ', 'gi') ELSE text || ' ' || source END, 'que|der ', 'i') AS b,
    regexp_matches(text, 'th', 'i') AS c_in, regexp_matches(text || ' ' || source, 'ion', 'i') AS gate, regexp_matches(text, 'eaux', 'i') AS site
  FROM documents)"""


def parsing() -> dict[str, str]:
    hits = "regexp_extract_all(h, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"[^>]*>(.*?)</a>', {})"
    five = "CASE o_orderpriority WHEN '1-URGENT' THEN {0} WHEN '2-HIGH' THEN {1} WHEN '3-MEDIUM' THEN {2} WHEN '4-NOT SPECIFIED' THEN {3} ELSE {4} END"
    seg = "CASE c_mktsegment WHEN 'BUILDING' THEN {0} WHEN 'MACHINERY' THEN {1} WHEN 'FURNITURE' THEN {2} WHEN 'HOUSEHOLD' THEN {3} ELSE {4} END"
    n = "regexp_replace(lower(c_name), '#0*', '')"
    words_list = "list_sort(list_distinct({}))"
    duty = "E\\.?H\\.?S|H\\.?S\\.?E|(^|[^\\pL\\pN_])(SHE|ESH)($|[^\\pL\\pN_])|HSSE|PSM|Safety|Environment"
    return {
        "anchor_candidates": f"""
            WITH p AS (SELECT page_id, regexp_replace(html, '{SCRIPTS}', '', 'g') AS h FROM pages),
            a AS (SELECT page_id, unnest({hits.format(1)}) AS href, unnest({hits.format(2)}) AS t FROM p),
            b AS (SELECT page_id, href, {one_line(entities("regexp_replace(t, '<[^>]+>', ' ', 'g')"))} AS title FROM a)
            SELECT DISTINCT page_id, title, href FROM b WHERE length(title) BETWEEN 4 AND 220 AND regexp_matches(title, '[aeiou]', 'i')""",
        "page_stats": f"""
            WITH b AS (SELECT page_id, html, {one_line(readable("regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1), ''), html), '(?s)<!--.*?-->', ' ', 'g')"))} AS t FROM pages)
            SELECT page_id, length(t) AS text_len, len(regexp_extract_all(html, '(?i)<a\\b')) AS anchors,
              NOT (length(t) < 2000 AND regexp_matches(t, 'que|the', 'i')) AS ok FROM b""",
        "html_text_stats": f"""
            WITH b AS (SELECT page_id, {readable('html')} AS t FROM pages)
            SELECT page_id, length(t) AS n_chars, len(string_split(t, chr(10))) AS n_lines FROM b""",
        "static_pages": """
            SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?i)(<head\\b[^>]*>)',
              '\\1<base href="' || replace(url, '&', '&amp;') || '">')) AS digest FROM pages""",
        "url_canonical_key": """
            SELECT page_id, CASE WHEN number <> '' THEN tld || ':' || number END AS canon, host,
              CASE WHEN tld = 'org' AND number <> '' THEN 'number' WHEN contains(host, 'example.net') THEN 'direct'
                WHEN contains(host, 'spam-farm.example.org') OR contains(host, 'cheap-pills.example.com') THEN 'blocked' ELSE 'search' END AS kind, url AS link
            FROM (SELECT page_id, url, regexp_extract(url, '://([^/]*)', 1) AS host, regexp_extract(url, 'example\\.(org|net|com)', 1) AS tld,
                  regexp_extract(url, 'example\\.[a-z]+/[a-z]{2}/(\\d+)', 1) AS number FROM pages)""",
        "cards_feed": f"""
            WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS card, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS pos FROM pages),
            f AS (SELECT page_id, pos, regexp_extract(card, 'href="(/[^"]*)"', 1) AS k, {one_line(entities("regexp_extract(card, '(?s)>(.*?)</a>', 1)"))} AS title FROM c)
            SELECT page_id, k AS rec_key, arg_min(title, pos) AS title, 'https://x.example' || k AS href FROM f GROUP BY page_id, k HAVING arg_min(title, pos) <> ''""",
        "script_feed": f"""
            WITH r AS (SELECT *, unnest([CASE WHEN l_returnflag IN ('A','R') THEN 'role ' || l_returnflag END, CASE WHEN l_linestatus = 'O' THEN 'status O' END]) AS role
              FROM lineitem WHERE {LD} <= DATE '2029-01-01' AND {plus(LD, 365)} >= DATE '2029-01-01')
            SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
              CASE WHEN l_linenumber > 4 THEN '[Sup ' || l_suppkey || '] ' ELSE '' END || 'part ' || l_partkey || ' | ' || role AS title,
              'https://x.example/' || l_partkey AS href, CASE WHEN l_linenumber > 4 THEN 'Sup ' || l_suppkey ELSE 'Feed Co' END AS company,
              'other / role ' || l_returnflag || ' / status ' || l_linestatus AS block FROM r WHERE role IS NOT NULL""",
        "json_props": """
            SELECT event_type AS source, k, count(*) AS n FROM (SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events)
            WHERE substr(k::VARCHAR, 1, 1) IN ('1','2','3','4','5','6','7','8') GROUP BY 1, 2""",
        "variant_feed": """
            WITH w AS (SELECT * FROM lineitem WHERE l_linenumber < 6 AND NOT (l_linenumber = 2 AND l_returnflag = 'A') AND NOT (l_linenumber = 3 AND l_returnflag = 'R'))
            SELECT l_orderkey, l_linenumber, 0 AS pos, 'part ' || l_partkey AS title, 'https://x.example/' || l_partkey AS href, l_partkey::BIGINT AS number,
              'line={"n":' || l_linenumber || '};mode=' || l_returnflag AS rest FROM w
            UNION ALL SELECT l_orderkey, l_linenumber, 1, 'sup ' || l_suppkey, 'https://x.example/S' || l_suppkey, NULL, '' FROM w WHERE l_linenumber <= 4""",
        "variant_rejects": """
            WITH d AS (SELECT *, CASE WHEN l_linenumber >= 6 THEN 'empty' WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN 'broken' WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'no records' END AS state FROM lineitem),
            r AS (SELECT l_returnflag AS source, state AS reason, 0 AS rec FROM d WHERE state IS NOT NULL
              UNION ALL SELECT l_returnflag, 'no title', 1 FROM d WHERE state IS NULL AND l_linenumber > 4
              UNION ALL SELECT l_returnflag, 'no object', 1 FROM d WHERE state IS NULL AND l_linestatus = 'O')
            SELECT source, reason, count(*) AS n, sum(rec)::BIGINT AS n_records FROM r GROUP BY ALL""",
        "variant_props": """SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, '{"k":"' || (props::JSON ->> 'k') || '"}' AS rest FROM events""",
        "feed_counts": """
            SELECT d.source, coalesce(n, 0)::BIGINT AS anchors, CASE WHEN n IS NULL THEN 0 ELSE chars + 1000 END::BIGINT AS text_len, CASE WHEN n IS NULL THEN 'empty feed' END AS error
            FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN (SELECT source, count(*) AS n, sum(length(lang) + length(text)) AS chars FROM documents
              WHERE contains(text, 'tionier') GROUP BY source) r USING (source)""",
        "kinds_join": """
            SELECT c_custkey, k AS kinds FROM customer LEFT JOIN (SELECT o_custkey, concat_ws('/', max(CASE WHEN o_orderstatus = 'P' THEN 'P' END),
              max(CASE WHEN o_orderstatus = 'F' THEN 'F' END), max(CASE WHEN o_orderstatus = 'O' THEN 'O' END)) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
        "code_labels": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '마감' WHEN 'O' THEN '진행' ELSE o_orderstatus END AS label FROM orders",
        "ordered_lists": """
            WITH p AS (SELECT *, list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type), 'ring']))) AS w FROM part)
            SELECT p_partkey, array_to_string(w, ', ') AS unique_words,
              array_to_string(list_concat(list_filter(w, lambda x: x[1] = 'r'), list_filter(w, lambda x: x[1] <> 'r')), ', ') AS r_first,
              p_name || CASE WHEN p_size > 25 THEN '' ELSE ' | small size' END || ' | ' || p_type AS joined FROM p""",
        "detail_join": """
            SELECT o_orderkey, o_orderstatus || coalesce(chr(10) || c_mktsegment, '') AS block FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
        "keyword_union": """
            WITH u AS (SELECT doc_id, md5(text) AS href, lang, k, unnest([0,1,2,3]) AS s, unnest(['tion','que','ing','der']) AS kw, text FROM documents, (SELECT 1 AS k)),
            f AS (SELECT *, row_number() OVER (PARTITION BY href, lang ORDER BY s, doc_id) AS rn FROM u WHERE contains(text, kw))
            SELECT href, lang AS title, kw AS keyword, doc_id FROM f WHERE rn = 1""",
        "registry_fill": """
            SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events""",
        "registry_table": """
            SELECT s_suppkey, row, 'N ' || s_nationkey AS "group", s_name || CASE WHEN row = 1 THEN ' B' ELSE '' END AS name, 'ind' AS industry,
              CASE WHEN row = 0 THEN (floor(abs(s_acctbal)) * 10)::BIGINT END AS employees FROM supplier, (SELECT unnest([0, 1])::BIGINT AS row)""",
        "latest_period": f"""
            WITH o AS (SELECT o_orderkey, strftime({OD}, '%Y%m') AS ym FROM orders) SELECT o_orderkey, ym FROM o WHERE ym = (SELECT max(ym) FROM o)""",
        "source_registry": "SELECT s_name AS name FROM supplier WHERE contains(s_name, '1') AND s_acctbal >= 3000",
        "group_registry": """
            SELECT n_name AS "group", EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS designated,
              (SELECT count(*) FROM supplier x WHERE x.s_nationkey = n_nationkey) AS listed_affiliates, s_name AS name, upper(s_name) AS norm
            FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey""",
        "unranked_groups": """
            SELECT DISTINCT o_custkey::VARCHAR AS "group" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)""",
        "deadline_roundtrip": f"""
            SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'dated' WHEN o_orderstatus = 'O' THEN 'rolling' WHEN o_orderstatus = 'F' THEN 'dated' ELSE 'unknown' END AS kind,
              CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN {iso(plus(OD, 20))} WHEN o_orderstatus = 'F' THEN {iso(OD)} END AS deadline FROM orders""",
        "posted_roundtrip": f"""
            SELECT o_orderkey, {five.format(*[iso(plus(OD, '-(o_orderkey % 90)'))] * 3, iso(OD), 'NULL')} AS posted FROM orders""",
        "experience_roundtrip": """
            SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size || '~99년' WHEN 'STANDARD' THEN p_size || '년 이상' WHEN 'PROMO' THEN p_size || '년 이상'
                WHEN 'SMALL' THEN '신입·경력 / 무관' WHEN 'MEDIUM' THEN '신입' ELSE '경력' END AS label,
              CASE WHEN p_type IN ('ECONOMY','STANDARD','PROMO') THEN p_size WHEN p_type IN ('SMALL','MEDIUM') THEN 0 END AS min_years, p_type = 'MEDIUM' AS new_grad_only,
              '경력 ' || p_size || '년 ↑' AS official, p_type NOT IN ('ECONOMY','STANDARD','PROMO') OR p_size <= 7 AS within_cap FROM part""",
        "year_guess": f"""
            SELECT o_orderkey, CASE WHEN o_orderkey % 12 + 1 > month({OD}) + 6 THEN year({OD}) - 1 WHEN o_orderkey % 12 + 1 < month({OD}) - 6 THEN year({OD}) + 1
              ELSE year({OD}) END::INTEGER AS year FROM orders""",
        "compact_dates": """
            SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%d %H:%M') AS t, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS kst FROM events""",
        "org_names": f"""
            SELECT c_custkey, {seg.format(n, f"{n} || '그룹'", f"'엘에스' || {n} || 'ls-' || c_custkey", f"{n} || 'electric'", f"{n} || '→client'")} AS posting,
              {seg.format(f"upper({n})", f"upper({n}) || '그룹'", f"'엘에스' || upper({n}) || '(LS-' || c_custkey || ')'", f"upper({n}) || 'ELECTRIC'", f"upper({n}) || '→CLIENT'")} AS registry,
              {seg.format(n, f"{n} || '그룹'", f"'ls' || {n} || '(ls' || c_custkey || ')'", f"{n} || '일렉트릭'", n)} AS folded,
              {seg.format(n, f"{n} || '|' || {n} || '그룹'", f"array_to_string(list_sort(list_distinct(['ls' || {n} || 'ls' || c_custkey, 'ls' || {n}, 'ls' || c_custkey])), '|')", f"{n} || '일렉트릭'", n)} AS variants
            FROM customer""",
        "title_features": f"""
            WITH p AS (SELECT *, lower(p_type) AS t, string_split(p_name, ' ') AS w FROM part)
            SELECT p_partkey, replace(p_name, ' ', '') || 'manager' || t || '채용(' || p_size || '월)' AS core,
              array_to_string({words_list.format("list_concat(w, [t, 'manager', '급구'])")}, ' ') AS tokens, 'manager' AS fields,
              array_to_string({words_list.format("list_concat(w, ['급구'])")}, ' ') AS base, '급구' || replace(p_name, ' ', '') AS hiring,
              '[급구] ' || p_brand || ' ' || p_name || ' | manager ' || t || ' 채용' AS bare, p_brand || ' ' || p_name || ' | manager ' || t || ' 채용 (' || p_size || '월)' AS shown,
              replace(lower(p_brand), '#', '') || replace(p_name, ' ', '') || 'manager' || t || '채용' || p_size || '월' AS key FROM p""",
        "size_words": f"""
            SELECT c_custkey, ({seg.format(4, 2, 3, 1, 5)})::INTEGER AS word_rank, ({seg.format(4, 2, 3, 4, 5)})::INTEGER AS form_rank,
              c_mktsegment = 'MACHINERY' AND NOT (floor(c_acctbal) > 0 AND floor(c_acctbal) < 300) AS form_large,
              {seg.format("'중견(코스닥)'", "'외국계 대기업'", "'공기업'", "'중견'", "'기타'")} AS size FROM customer""",
        "detail_pages": f"""
            SELECT o_orderkey, 'C' || o_orderkey AS csn, 'Company ' || o_custkey AS company_full, 'Order & ' || o_orderkey AS title_full, {iso(OD)} AS start,
              CASE WHEN o_totalprice > 300000 THEN '상시' ELSE {iso(plus(OD, 30))} END AS deadline, CASE WHEN o_totalprice <= 300000 THEN '18:00' END AS deadline_time,
              '경력 ' || (o_orderkey % 9) || '년 ↑' AS exp, '대졸' AS edu, CASE WHEN o_orderstatus = 'F' THEN '계약직' ELSE '정규직' END AS emp_type, 'Zone ' || o_orderstatus AS location,
              FALSE AS closed FROM orders""",
        "linked_data": f"""
            SELECT o_orderkey, 'Order ' || o_orderkey AS title_full, 'Company ' || o_custkey AS company_full, {iso(OD)} AS start, {iso(plus(OD, 30))} AS deadline, '23:59' AS deadline_time,
              CASE WHEN o_orderkey % 100 > 0 THEN '경력 ' || ((o_orderkey % 100) // 12) || '년↑' END AS exp, CASE WHEN o_orderstatus = 'F' THEN '정규직, 인턴' ELSE '계약직' END AS emp_type,
              o_orderpriority || ' ' || o_orderstatus AS location, {plus(OD, 30)} < DATE '2028-01-01' AS closed FROM orders""",
        "duty_evidence": f"""
            WITH d AS (SELECT doc_id, lang, regexp_matches(text, '{duty}', 'i') AS hit FROM documents)
            SELECT doc_id, CASE lang WHEN 'de' THEN '의심' WHEN 'es' THEN CASE WHEN hit THEN '확인' ELSE '의심' END
                WHEN 'fr' THEN CASE WHEN hit THEN '확인' ELSE '제목만' END ELSE CASE WHEN hit THEN '확인' ELSE '의심' END END AS duty,
              CASE lang WHEN 'de' THEN '환경·안전 분야 마감: (마감)위험물' WHEN 'es' THEN '아파트, 건설현장' ELSE '' END AS duty_flag FROM d""",
    }


def analysis() -> dict[str, str]:
    run = "2031-07-15"
    versioned = "id, company, exp, deadline, source, first_seen, last_seen, status"
    merged = f"""
        WITH {STATE}, b0 AS (
          SELECT *, {iso(LD)} AS ship, l_discount > 0.08 AS fresh, l_tax > 0.07 AS closed, l_returnflag <> 'N' AS known,
            'j-' || sha1('Part ' || l_partkey || '|안전담당')[1:16] AS hash FROM lineitem),
        b1 AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN known THEN l_orderkey::VARCHAR ELSE hash END ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM b0),
        b2 AS (SELECT b1.*, CASE WHEN known AND s.id IS NOT NULL THEN s.id ELSE hash END AS rid FROM b1 LEFT JOIN state s ON known AND s.o_orderkey = l_orderkey WHERE rn = 1),
        b AS (SELECT *, 'Part ' || l_partkey AS bcompany, CASE WHEN known THEN 'https://www.saramin.co.kr/r?a=1&rec_idx=' || l_orderkey ELSE 'https://new.example/' || l_partkey END AS blink,
            l_linenumber || '년 이상' AS bexp, CASE WHEN l_linenumber > 3 THEN ship END AS bdue,
            CASE WHEN fresh AND l_linenumber > 5 THEN {iso(plus(LD, 30))} END AS vdue
          FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn2 FROM b2) WHERE rn2 = 1),
        x AS (SELECT s.*, b.* EXCLUDE (rn, rn2), s.id IS NOT NULL AS have, b.rid IS NOT NULL AS seen, coalesce(b.closed, FALSE) AS closing FROM state s FULL JOIN b ON s.id = b.rid),
        y AS (SELECT *, have AND seen AND NOT closing AS touch, NOT have AND seen AS ins, coalesce(fresh, FALSE) AS vnow FROM x WHERE have OR NOT closing),
        z AS (SELECT *, touch AND NOT (verified_at IS NOT NULL AND NOT vnow) AS refreshed FROM y),
        m AS (SELECT coalesce(id, rid) AS id, CASE WHEN ins THEN bcompany ELSE company END AS company, CASE WHEN ins THEN '안전 담당' ELSE title END AS title,
            CASE WHEN ins OR refreshed THEN bexp ELSE exp END AS exp, CASE WHEN ins OR refreshed THEN coalesce(posted, ship) ELSE posted END AS posted,
            coalesce(CASE WHEN (touch OR ins) AND vnow THEN vdue END, CASE WHEN ins OR refreshed THEN coalesce(bdue, deadline) ELSE deadline END) AS deadline,
            CASE WHEN ins OR refreshed THEN blink ELSE link END AS link, CASE WHEN touch OR ins THEN 'feed' ELSE source END AS source,
            CASE WHEN ins THEN '{run}' ELSE first_seen END AS first_seen, CASE WHEN touch OR ins THEN '{run}' ELSE last_seen END AS last_seen,
            CASE WHEN have AND closing THEN 'closed' WHEN ins OR (touch AND (NOT coalesce(starts_with(verify, '마감'), FALSE) OR vnow)) THEN 'open' ELSE status END AS status,
            CASE WHEN have AND closing THEN CASE WHEN vnow THEN '원문 확인' END WHEN (touch OR ins) AND vnow THEN '원문 확인' ELSE verify END AS verify,
            CASE WHEN have AND closing THEN CASE WHEN vnow THEN '{run}' ELSE verified_at END WHEN (touch OR ins) AND vnow THEN '{run}' ELSE verified_at END AS verified_at, NOT have AS is_new FROM z)
        SELECT * REPLACE (CASE WHEN status = 'open' AND (last_seen < '2031-07-08' AND (source <> '1-URGENT' OR last_seen < '2031-06-15')
            OR deadline <> '상시' AND coalesce(deadline < '{run}', FALSE)) THEN 'closed' ELSE status END AS status) FROM m"""
    tokens = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z]+|[0-9]+'), lambda x: length(x) >= 2)))"
    cover = "len(list_filter({0}, lambda x: len(list_filter({1}, lambda y: starts_with(x, y) OR starts_with(y, x))) = 0)) = 0"
    part_rows = """
        p AS (SELECT 'p' || lpad(p_partkey::VARCHAR, 9, '0') AS id, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'closed' END AS status, p_brand AS company,
            CASE WHEN p_size < 20 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS title,
            CASE WHEN p_size > 40 THEN 'https://x.example/jobs/' || lpad(p_partkey::VARCHAR, 9, '0') ELSE 'https://x.example/list/' || lower(p_type) END AS link,
            CASE WHEN p_size > 45 THEN '원문 확인' END AS verify, CASE WHEN p_size > 25 THEN strftime(DATE '2001-01-01' + p_size, '%Y-%m-%d') END AS deadline,
            strftime(DATE '2000-01-01' + p_size, '%Y-%m-%d') AS first_seen, CASE WHEN p_size < 30 THEN '환경' ELSE '안전' END AS sec, p_size FROM part)"""
    sessions = """
        e AS (SELECT user_id, ts, ts + CASE WHEN event_type = 'error' THEN INTERVAL 16 HOUR ELSE INTERVAL 8 HOUR END AS ends FROM events),
        m AS (SELECT *, max(ends) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM m),
        l AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_seen, max(ends) AS closes_at FROM g GROUP BY user_id, grp)"""
    shown = """SELECT user_id, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, n_seen,
        strftime(closes_at, '%Y-%m-%d %H:%M:%S') AS closes_at FROM l"""
    word_terms = """
        w0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[가-힣A-Za-z]{2,}') AS w FROM documents),
        wt AS (SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w0)"""
    sec_case = "CASE WHEN o_orderstatus = 'F' OR size_rank <= 2 THEN '환경,안전' ELSE '' END"
    why = f"""CASE WHEN c_mktsegment = 'MACHINERY' THEN 'contract' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'contract_evidence'
        WHEN o_orderkey % 12 > 7 THEN 'min_years' WHEN {sec_case} = '' THEN 'off_profile' END"""
    kept = "(status = 'open' OR last_seen >= '2028-05-02')"
    return {
        "judged_orders": f"""
            WITH {JUDGED} SELECT o_orderkey, company, title, CASE WHEN years = 0 THEN '신입' ELSE '경력' END AS track, CASE WHEN years = 0 THEN '신입' ELSE years || '년 이상' END AS exp,
              {iso('od')} AS posted, {iso('due')} AS deadline, size_rank, affiliate_of, sec, drop_reason FROM judged""",
        "drop_reasons_by_source": f"WITH {JUDGED} SELECT o_orderpriority AS source, drop_reason, count(*) AS n FROM judged WHERE drop_reason IS NOT NULL GROUP BY 1, 2",
        "source_health": f"""
            WITH {JUDGED} SELECT o_orderpriority AS source, count_if(o_orderstatus = 'F') % 2 = 0 AS ok, count(*) AS found, count_if(drop_reason IS NULL)::BIGINT AS kept,
              count_if(o_orderstatus = 'F') % 2 = 0 AND count(*) % 600 < 300 AS suspicious FROM judged GROUP BY 1""",
        "health_thresholds": f"""
            WITH {DOC_HEALTH}, t AS (SELECT count_if(ok AND NOT suspicious) AS fine, count(*) AS n, count_if(ok) AS good, count_if(ok AND is_api) AS good_api, count_if(is_api) AS n_api,
              max(CASE WHEN source = 'src7' THEN found END) AS key_found FROM h)
            SELECT 'overall' AS problem, fine::BIGINT AS good, n::BIGINT AS total FROM t WHERE fine / n < 0.9 UNION ALL
            SELECT 'host', good::BIGINT, n::BIGINT FROM t WHERE n >= 10 AND good / n < 0.9 UNION ALL
            SELECT 'key_source', key_found::BIGINT, 10000000 FROM t UNION ALL
            SELECT 'api', good_api::BIGINT, n_api::BIGINT FROM t WHERE n_api >= 4 AND good_api / n_api < 0.9""",
        "failure_list": f"WITH {DOC_HEALTH} SELECT source, 'TIMEOUT ' || source AS error FROM h WHERE NOT ok ORDER BY source LIMIT 80",
        "run_totals": f"WITH {DOC_HEALTH} SELECT count_if(ok AND NOT suspicious)::BIGINT AS sources_ok, count(*) AS sources_total FROM h",
        "include_exclude_sections": f"""
            WITH {DOC_SECTIONS}, q AS (SELECT *, c_in AND NOT (gate AND (source >= 'src15' OR site)) AS c, c_in AND NOT (gate AND site) AS c_loose FROM s)
            SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END], lambda x: x IS NOT NULL), ',') AS sec,
              a OR b OR c_loose AS loose FROM q""",
        "section_counts": f"""
            WITH {DOC_SECTIONS}, q AS (SELECT unnest([CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c_in AND NOT (gate AND site) THEN 'c' END]) AS section FROM s WHERE lang <> 'es')
            SELECT section, count(*) AS n_open FROM q WHERE section IS NOT NULL GROUP BY 1""",
        "rule_confusion": """
            WITH d AS (SELECT quality = 1 AS keep, regexp_matches(text, 'tion|ung|ment', 'i') AND NOT regexp_matches(text || ' ' || source, 'quest', 'i') AS got FROM documents JOIN labels USING (doc_id))
            SELECT count(*) AS n, count_if(keep)::BIGINT AS n_keep, count_if(got AND NOT keep)::BIGINT AS false_admits, count_if(keep AND NOT got)::BIGINT AS misses,
              count_if(keep AND got)::BIGINT AS hits, count_if(keep AND NOT got) > 0 AS failed FROM d""",
        "feed_recall": f"""
            WITH {JUDGED}, w AS (SELECT *, regexp_matches(title, '환경|안전') AS wide FROM judged)
            SELECT o_orderpriority AS source, count(*) AS n_rows, count_if(wide)::BIGINT AS n_hits, count_if(wide AND drop_reason IS NULL)::BIGINT AS n_kept,
              count_if(wide AND drop_reason IS NOT NULL)::BIGINT AS n_dropped FROM w GROUP BY 1""",
        "longest_name_match": """
            WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark),
            h AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS rn FROM documents JOIN w ON contains(lower(text), name))
            SELECT d.doc_id, h.name FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id AND rn = 1""",
        "listed_names": """
            WITH p AS (SELECT p_partkey, p_name || ' ' || p_size || lower(p_type) AS t FROM part),
            n AS (SELECT p_partkey, CASE WHEN regexp_matches(t, '(^|[^a-z])old gear($|[^a-z])') THEN 'old gear' WHEN regexp_matches(t, '(^|[^a-z])anvil 9($|[^a-z])') THEN 'anvil 9'
                WHEN regexp_matches(t, '(^|[^a-z])hot r($|[^a-z])') THEN 'hot r' WHEN regexp_matches(t, '(^|[^a-z])plate($|[^a-z])') THEN 'PLATE'
                WHEN regexp_matches(t, '(^|[^a-z])gear($|[^a-z])') THEN 'gear' WHEN regexp_matches(t, '(^|[^a-z])ring($|[^a-z])') THEN 'Ring' END AS name FROM p)
            SELECT p_partkey, name, name IS NOT NULL AS any_name FROM n""",
        "alias_lookup": """SELECT c_custkey, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN n_name END AS "group" FROM customer JOIN nation ON n_nationkey = c_nationkey""",
        "tier_cascade": """
            WITH c AS (SELECT *, floor(c_acctbal)::INTEGER AS bal, CASE WHEN floor(c_acctbal) > 6000 THEN floor(floor(c_acctbal) / 5) WHEN floor(c_acctbal) > 0 THEN floor(floor(c_acctbal) / 20) ELSE 0 END AS emp,
                CASE WHEN floor(c_acctbal) > 3000 THEN floor(c_acctbal) ELSE 0 END AS sal, c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 5 AS grouped FROM customer)
            SELECT c_custkey, CASE WHEN grouped THEN '대기업' WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN c_acctbal > 5000 THEN '대기업' ELSE '중견·기타' END
                WHEN c_mktsegment = 'BUILDING' THEN '대기업' WHEN emp >= 1000 OR (sal >= 7000 AND emp >= 300) OR c_nationkey = 7 THEN '우량 중견'
                WHEN emp = 0 AND sal = 0 AND contains(c_name, '11') THEN '우량 중견' ELSE '중견·기타' END AS tier, CASE WHEN grouped THEN c_nationkey::VARCHAR END AS "group" FROM c""",
        "compare_bands": """
            WITH b AS (SELECT s_nationkey, floor(avg(s_acctbal))::INTEGER AS base FROM supplier GROUP BY 1),
            j AS (SELECT *, floor(s_acctbal)::INTEGER AS bal, s_nationkey < 8 AS big, s_suppkey > 50 AS base_big FROM supplier JOIN b USING (s_nationkey)),
            r AS (SELECT *, bal > 0 AND base > 0 AS known, CASE WHEN base <> 0 THEN bal / base - 1 END AS r, CASE WHEN base <> 0 THEN bal / base END AS e FROM j)
            SELECT s_suppkey, CASE WHEN NOT known THEN '정보 없음' WHEN r > 0.05 THEN '높음 +' || round_even(r * 100, 0)::INTEGER || '%'
                WHEN r < -0.05 THEN '낮음 ' || round_even(r * 100, 0)::INTEGER || '%' ELSE '비슷' END AS salary,
              CASE WHEN known THEN CASE WHEN NOT big AND base_big THEN '작음' WHEN e >= 1.3 THEN '더 큼' WHEN e < 0.7 THEN '작음' ELSE '비슷' END
                WHEN base_big THEN CASE WHEN big THEN '비슷' ELSE '작음' END ELSE '정보 없음' END AS size,
              CASE WHEN s_acctbal / 10000 >= 0.6 THEN '상' WHEN s_acctbal / 10000 >= 0.3 THEN '중' ELSE '하' END AS fit FROM r""",
        "fresh_profile_join": """
            WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events),
            f AS (SELECT c_custkey, coalesce(ts >= TIMESTAMP '2024-01-30', FALSE) AS fresh, value, event_type FROM customer LEFT JOIN l ON user_id = c_custkey AND rn = 1)
            SELECT c_custkey, fresh, CASE WHEN fresh THEN value END AS value, CASE WHEN fresh THEN event_type END AS event_type FROM f""",
        "best_company": """
            WITH s AS (SELECT c_nationkey AS q, c_custkey AS pos, CASE WHEN c_acctbal > 9700 THEN 3 WHEN c_acctbal > 8000 THEN 2 END AS score FROM customer),
            r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rn FROM s WHERE score IS NOT NULL)
            SELECT q, pos, score::INTEGER AS score FROM r WHERE rn = 1""",
        "fuzzy_link": """
            WITH p AS (SELECT *, p_size % 12 AS m, replace(p_name, ' ', '') AS n FROM part),
            l AS (SELECT DISTINCT p_brand, n, m, n || m || 'M' AS ka FROM p WHERE p_size <= 25),
            r AS (SELECT p_partkey AS other, p_brand, CASE WHEN p_size > 40 THEN m END AS mb, CASE WHEN p_size > 40 THEN n || 's' || m || 'M' ELSE n || 's' END AS kb FROM p WHERE p_size > 25),
            r1 AS (SELECT p_brand, mb, kb, min(other) AS other FROM r GROUP BY ALL),
            s AS (SELECT l.p_brand, n, m, other, round(1 - levenshtein(ka, kb) / greatest(length(ka), length(kb)), 6) AS score FROM l JOIN r1 USING (p_brand) WHERE mb IS NULL OR mb = m),
            b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, n, m ORDER BY score DESC, other) AS rn FROM s WHERE score >= 0.7)
            SELECT p_partkey, other AS other_match, round(score, 4) AS score FROM p LEFT JOIN b ON p.p_brand = b.p_brand AND p.n = b.n AND p.m = b.m AND rn = 1 WHERE p_size <= 25""",
        "evidence_link": """
            WITH p AS (SELECT *, p_size % 12 AS m, replace(p_name, ' ', '') AS n, lower(p_brand) AS org FROM part),
            l AS (SELECT p_partkey, m, n || m || 'M' AS ka, CASE WHEN p_partkey % 7 > 0 THEN org ELSE '' END AS ca FROM p WHERE p_size <= 25),
            r AS (SELECT p_partkey AS other, CASE WHEN p_size > 40 THEN m END AS mb, CASE WHEN p_size > 40 THEN n || 's' || m || 'M' ELSE n || 's' END AS kb,
              CASE WHEN p_size > 40 THEN replace(org, ' ', '') || 'works' ELSE left(org, 7) END AS cb FROM p WHERE p_size > 25),
            s AS (SELECT p_partkey, other, 1 - levenshtein(lower(ka), lower(kb)) / greatest(length(ka), length(kb)) AS sim,
              ca <> '' AND (contains(cb, ca) OR contains(ca, cb)) AS agree FROM l JOIN r ON mb IS NULL OR mb = m),
            k AS (SELECT * FROM (VALUES ('strict', 0.95, -0.5), ('loose', 0.9, 0.0)) AS v(kind, accept, malus)),
            c AS (SELECT kind, p_partkey, other, round(sim + CASE WHEN agree THEN 0.35 ELSE malus::DOUBLE END, 6) AS score FROM s, k WHERE round(sim + CASE WHEN agree THEN 0.35 ELSE malus::DOUBLE END, 6) >= accept),
            b AS (SELECT *, row_number() OVER (PARTITION BY kind, p_partkey ORDER BY score DESC, other) AS rn FROM c)
            SELECT k.kind, l.p_partkey, other AS other_match, round(score, 4) AS score FROM l CROSS JOIN k LEFT JOIN b ON b.kind = k.kind AND b.p_partkey = l.p_partkey AND rn = 1""",
        "import_anti": """
            WITH d AS (SELECT p_partkey, p_brand, lower(p_brand) AS org, p_name || ' ' || p_type AS title, replace(lower(p_name || p_type), ' ', '') AS k, p_size > 35 AS known FROM part)
            SELECT 'p' || p_partkey AS id, p_brand AS company, title FROM d WHERE NOT known AND p_partkey NOT IN (SELECT p_partkey + 7 FROM d WHERE known)
              AND NOT EXISTS (SELECT 1 FROM d x WHERE x.known AND x.k = d.k AND (starts_with(x.org, d.org) OR starts_with(d.org, x.org)))""",
        "designated_flag": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer",
        "total_reconcile": """
            SELECT o_orderkey, o_orderkey % 7 AS declared, coalesce(n, 0)::BIGINT AS n_rows FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
            WHERE o_orderkey % 7 <> coalesce(n, 0)""",
        "count_and_sum": "SELECT count(*) AS n, count_if(l_linestatus = 'O')::BIGINT AS n_true FROM lineitem",
        "first_batch_wins": "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2",
        "feedback_latest": """
            WITH f AS (SELECT event_type AS title, user_id::VARCHAR AS company, (value > 40)::INTEGER AS label, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
            SELECT title, company, label FROM f WHERE rn = 1 UNION ALL
            SELECT 'view', c_custkey::VARCHAR, 1 FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'view' AND user_id = c_custkey)""",
        "survivorship": """
            WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events)
            SELECT user_id, arg_min(event_id, rn) AS event_id, arg_min(value, rn) AS value, arg_min(CASE WHEN event_type = 'click' THEN props END, CASE WHEN event_type = 'click' THEN rn END) AS note,
              min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n_merged FROM e GROUP BY 1""",
        "budget_topn": f"""
            WITH {STATE} SELECT id, first_seen FROM state WHERE NOT coalesce(verified_at >= '2031-07-27', FALSE)
              AND NOT (status = 'open' AND last_seen >= '2031-07-23' AND last_seen IS DISTINCT FROM verified_at) ORDER BY first_seen DESC, id LIMIT 120""",
        "budget_per_source": """
            SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn <= 3""",
        "outage_runs": """
            WITH e AS (SELECT *, event_type IN ('error','signup') AS failed FROM events),
            g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM e),
            r AS (SELECT user_id, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS run_length FROM g WHERE failed GROUP BY user_id, grp)
            SELECT * FROM r""",
        "view_order_topk": f"""
            WITH {STATE} SELECT id, size_rank, tier, track, deadline FROM state WHERE status = 'open'
            ORDER BY size_rank, CASE WHEN tier = '추천' THEN 0 ELSE 1 END, CASE WHEN track = '신입' THEN 1 ELSE 0 END, CASE WHEN deadline <> '상시' THEN deadline END NULLS LAST, id LIMIT 50""",
        "tab_counts": f"""
            WITH {STATE} SELECT count_if(status = 'open' AND first_seen = '2031-01-10')::BIGINT AS tab_new, count_if(status = 'open' AND deadline <> '상시' AND deadline <= '2031-01-13')::BIGINT AS tab_due,
              count_if(status = 'open')::BIGINT AS tab_open, count_if(status = 'open' AND rel_score > 0.8)::BIGINT AS tab_starred, count_if(status = 'closed')::BIGINT AS tab_closed FROM state""",
        "report_filter": f"WITH {STATE} SELECT id, first_seen FROM state WHERE track = '신입' AND rel_score >= 0 AND contains(company || ' ' || title, '#0000001')",
        "token_sets": f"""
            WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), p_name[1:3], 'ring'] AS b FROM part)
            SELECT p_partkey, len(list_intersect(a, b)) > 0 AS overlap, {cover.format('a', 'b')} AS covered,
              array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS rest FROM p""",
        "snapshot_merge": merged,
        "snapshot_versions": f"""
            WITH {STATE} SELECT 1 AS run, {versioned} FROM state UNION ALL SELECT 2, {versioned} FROM ({merged})""",
        "stale_close": f"""
            WITH {STATE} SELECT id, CASE WHEN status = 'open' AND (last_seen < '2030-02-22' AND (source IN ('1-URGENT','5-LOW') OR last_seen < '2030-01-30')
              OR deadline <> '상시' AND deadline < '2030-03-01') THEN 'closed' ELSE status END AS status FROM state""",
        "canon_collapse": f"""
            WITH {STATE}, s AS (SELECT * EXCLUDE (company), CASE WHEN track = '신입' THEN company ELSE 'X' || source END AS company FROM state),
            t AS (SELECT *, CASE WHEN verified_at IS NOT NULL THEN '(주)' || company END AS company_full, CASE WHEN rel_score > 0.8 THEN '관심' END AS mark, lower(replace(company, ' ', '')) AS own FROM s),
            f AS (SELECT o_custkey, arg_min(own, (first_seen, id)) FILTER (WHERE verified_at IS NOT NULL) AS official, count(*) AS n FROM t WHERE status = 'open' GROUP BY 1),
            r AS (SELECT t.*, coalesce(contains(own, official) OR contains(official, own), FALSE) AS same FROM t JOIN f USING (o_custkey) WHERE status = 'open' AND n > 1),
            k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY NOT same, CASE WHEN same THEN -length(own) ELSE 0 END, verified_at IS NULL, mark IS NULL, first_seen, id) AS rn FROM r),
            a AS (SELECT o_custkey, arg_min(id, rn) AS keep, min(first_seen) AS fs, max(last_seen) AS ls, arg_min(verify, CASE WHEN verify IS NOT NULL THEN rn END) AS v,
                arg_min(company_full, CASE WHEN company_full IS NOT NULL THEN rn END) AS cf, arg_min(mark, CASE WHEN mark IS NOT NULL THEN rn END) AS mk FROM k GROUP BY 1)
            SELECT t.id, CASE WHEN k.rn > 1 THEN 'closed' ELSE t.status END AS status, CASE WHEN k.rn > 1 THEN '중복: ' || keep WHEN k.rn = 1 THEN v ELSE t.verify END AS verify,
              CASE WHEN k.rn = 1 THEN fs ELSE t.first_seen END AS first_seen, CASE WHEN k.rn = 1 THEN ls ELSE t.last_seen END AS last_seen,
              CASE WHEN k.rn = 1 THEN cf ELSE t.company_full END AS company_full, CASE WHEN k.rn = 1 THEN mk ELSE t.mark END AS mark
            FROM t LEFT JOIN k ON t.id = k.id LEFT JOIN a ON a.o_custkey = k.o_custkey""",
        "run_log": f"""
            WITH r AS (SELECT {OD} AS d, count(*) AS n, count_if(o_orderstatus = 'O')::BIGINT AS o FROM orders GROUP BY 1), l AS (SELECT * FROM r ORDER BY d DESC LIMIT 1)
            SELECT (SELECT max({iso(OD)}) FROM orders WHERE o_orderstatus = 'P') AS run_date, '00:00' AS run_time, {iso('d')} || 'T00:00' AS run_at, n AS new, o AS open,
              CASE WHEN n > 5 THEN 4 ELSE 3 END::BIGINT AS sources_ok, 5::BIGINT AS sources_total FROM l""",
        "redacted_copy": "SELECT c_custkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer WHERE NOT contains(c_name, '11')",
        "verified_rows": "SELECT o_orderkey, c_mktsegment AS segment, c_nationkey AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey",
        "export_reasons": f"WITH {STATE} SELECT id, {why} AS why FROM state WHERE {kept}",
        "published_rows": f"""
            WITH {STATE} SELECT id, status, '대기업' AS co_tier, CASE WHEN c_mktsegment = 'FURNITURE' THEN n_name END AS "group",
              CASE WHEN c_mktsegment = 'FURNITURE' THEN '대기업 계열' ELSE '중견' END AS size, exp, CASE WHEN rel_score >= 0.6 THEN '상' WHEN rel_score >= 0.3 THEN '중' ELSE '하' END AS fit,
              link, {sec_case} AS sec, size_rank FROM state WHERE {kept} AND ({why}) IS NULL""",
        "wrong_tails": """SELECT p_partkey, p_name || ' (안전관리)' AS title FROM part WHERE p_size % 2 = 0 AND p_size > 10 AND p_type NOT IN ('PROMO','SMALL')""",
        "exact_dedup": """
            SELECT 'j-' || sha1(source || '|' || regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g'))[1:16] AS id, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1""",
        "near_dup_components": f"""
            WITH RECURSIVE {part_rows},
            sig AS (SELECT status, company, title, min(id) AS sig, lower(company) AS org, replace(title, ' ', '') AS core, {tokens} AS w FROM p GROUP BY 1, 2, 3),
            e AS (SELECT a.sig AS a, b.sig AS b FROM sig a JOIN sig b ON a.status = b.status AND a.sig <> b.sig AND (contains(a.org, b.org) OR contains(b.org, a.org))
              WHERE a.core = b.core OR (least(length(a.core), length(b.core)) >= 10 AND abs(length(a.core) - length(b.core)) <= 4 AND (starts_with(a.core, b.core) OR starts_with(b.core, a.core)))
                OR {cover.format('a.w', 'b.w')} OR {cover.format('b.w', 'a.w')}),
            lab AS (SELECT sig AS node, sig AS root FROM sig UNION SELECT e.b, lab.root FROM lab JOIN e ON e.a = lab.node WHERE lab.root < e.b),
            best AS (SELECT node, min(root) AS root FROM lab GROUP BY 1)
            SELECT p.id, best.root FROM p JOIN sig USING (status, company, title) JOIN best ON best.node = sig.sig""",
        "representative_view": f"""
            WITH {part_rows}, s AS (SELECT *, (p_size > 45)::INTEGER * 4 + (p_size > 40)::INTEGER * 2 + 1 + (p_size > 25)::INTEGER AS score FROM p),
            r AS (SELECT *, row_number() OVER (PARTITION BY company, status ORDER BY score DESC, first_seen DESC, id) AS rn FROM s)
            SELECT arg_min(id, rn) AS id, company, status, arg_min(title, rn) AS title, arg_min(link, rn) AS link, min(first_seen) AS first_seen,
              arg_min(deadline, CASE WHEN deadline IS NOT NULL THEN rn END) AS deadline,
              concat_ws(',', max(CASE WHEN sec = '환경' THEN sec END), max(CASE WHEN sec = '안전' THEN sec END)) AS sec, count(*) AS n_merged FROM r GROUP BY company, status""",
        "member_parts": "SELECT l_suppkey AS k, count(*) AS n, sum(l_orderkey)::BIGINT AS s FROM lineitem GROUP BY 1",
        "tfidf_terms": f"""
            WITH {word_terms}, c0 AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM documents),
            c1 AS (SELECT doc_id, w, unnest([1, 2, 3, 4]) AS n FROM (SELECT DISTINCT doc_id, w FROM c0)),
            ct AS (SELECT doc_id, unnest(list_transform(generate_series(1, length(w) - n + 1), lambda i: substr(w, i, n))) AS term FROM c1),
            df AS (SELECT 'c' AS block, term, count(DISTINCT doc_id) AS df FROM ct GROUP BY term HAVING count(DISTINCT doc_id) >= 2 UNION ALL
                   SELECT 'w', term, count(DISTINCT doc_id) FROM wt GROUP BY term)
            SELECT block, length(term)::INTEGER AS len, count(*) AS n_terms, sum(df)::BIGINT AS sum_df, round(sum(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 2) AS sum_idf FROM df GROUP BY 1, 2""",
        "word_weights": f"""
            WITH {word_terms}, tf AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM wt GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
            x AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term))
            SELECT doc_id, count(*) AS n_terms, round(max(x) / sqrt(sum(x * x)), 6) AS max_weight FROM x GROUP BY 1""",
        "weighted_scores": r"""
            WITH words AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark),
            terms AS (SELECT DISTINCT 'w' AS block, word AS term FROM words UNION
                      SELECT 'c', substr(word, i, 3) FROM words, generate_series(1, 60) AS g(i) WHERE i + 2 <= length(word)),
            m AS (SELECT block, term, 1 + length(term) / 8.0::DOUBLE AS idf, (ascii(term) % 7 - 3) / 4.0::DOUBLE AS weight FROM terms),
            d AS (SELECT doc_id, lower(coalesce(text, '') || ' || ' || coalesce(source, '')) AS t FROM documents),
            cw AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) || ' ' AS w FROM d),
            cc AS (SELECT doc_id, w, count(*) AS k FROM cw GROUP BY 1, 2),
            ct AS (SELECT doc_id, 'c' AS block, term, sum(k) AS n FROM
                   (SELECT doc_id, k, unnest(list_transform(generate_series(1, length(w) - 2), lambda i: substr(w, i, 3))) AS term FROM cc) GROUP BY 1, 3),
            wl AS (SELECT doc_id, regexp_extract_all(t, '[가-힣A-Za-z]{2,}') AS ws FROM d),
            wt AS (SELECT doc_id, 'w' AS block, term, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS term FROM wl) GROUP BY 1, 3),
            x AS (SELECT doc_id, block, (1 + ln(n)) * idf AS x, weight FROM (SELECT * FROM ct UNION ALL SELECT * FROM wt) JOIN m USING (block, term)),
            b AS (SELECT doc_id, sum(x * weight) / sqrt(sum(x * x)) AS z FROM x GROUP BY doc_id, block),
            z AS (SELECT doc_id, sum(z) AS z FROM b GROUP BY 1)
            SELECT doc_id, round(1 / (1 + exp(-(coalesce(z, 0) - 0.25::DOUBLE))), 6) AS p FROM documents LEFT JOIN z USING (doc_id)""",
        "training_mix": """
            WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)),
            r AS (SELECT doc_id::VARCHAR AS title, source AS company, quality AS label FROM d UNION ALL
                  SELECT doc_id::VARCHAR, lang, toxic FROM d, generate_series(1, 3) WHERE quality <> toxic)
            SELECT title, company, label, count(*) AS n_rows FROM r GROUP BY 1, 2, 3""",
        "model_gate": """
            WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN 0.1::DOUBLE ELSE floor(value) / 512 END AS p FROM events),
            g AS (SELECT *, p < 0.1::DOUBLE AS low, event_type = 'click' AS safe FROM e)
            SELECT event_id, round_even(p * 1000, 0) / 1000 AS rel_score, CASE WHEN NOT low AND p >= 0.3 THEN '추천' ELSE '검토' END AS tier,
              CASE WHEN event_type = 'error' THEN 'off_topic' WHEN low AND NOT safe THEN 'low_score' END AS drop_reason,
              CASE WHEN low AND safe THEN '안전' WHEN safe THEN '환경,안전' ELSE '환경' END AS sec FROM g""",
        "lifecycle_table": f"WITH {sessions} {shown}",
        "lifecycle_stream": f"WITH {sessions} {shown} WHERE closes_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
        "closed_periods_stream": f"WITH {sessions} {shown} WHERE closes_at <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
        "outage_windows": """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n_fetches, count_if(event_type = 'error')::BIGINT AS n_failed FROM events GROUP BY 1, 2""",
        "first_sightings_stream": "SELECT DISTINCT user_id, event_type FROM events",
    }


def sql() -> dict[str, str]:
    return {**parsing(), **analysis()}
