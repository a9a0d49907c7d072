"""Queries that reach the rarer branches of merge, filters, page fallback and page checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shorten
from ..operators import merge, rules, verify, view
from ..operators.judge import join_sources, judge
from ..sources import pages, state
from .oracle import STATE
from .postings import landed, order_state, table

RUN = "2031-07-15"
FIRMS = rules.RuleSet(rule_include="안전", profiles=(rules.Profile("안전", include="안전", construction="건설"),), large_companies=("한빛전자",), mid_companies=("대솔소재",))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _by(c: str, n: int) -> Column:
    return F.pmod(F.col(c), F.lit(n))


def merge_details(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that point to another row, official values, notes without a check, sections, tries and comparisons"""
    key = F.substring_index("id", "-", -1).cast("long")
    stored = order_state(spark, sf).withColumn("verify", F.when(F.pmod(key, F.lit(9)) == 0, F.concat(F.lit("중복: s-"), (key + 1).cast("string"))).otherwise(F.col("verify")))
    o = table(spark, sf, "orders").filter(_by("o_orderkey", 4) < 3)
    j, by = _text("o_orderkey"), lambda n: _by("o_orderkey", n)
    batch = o.select(
        F.concat(F.lit("C"), j).alias("company"), F.lit("안전 담당").alias("title"), F.lit("경력").alias("track"), F.lit("1년 이상").alias("exp"), F.lit("2031-07-01").alias("posted"),
        F.when(by(2) == 0, "2031-08-08").alias("deadline"), F.concat(F.lit("https://www.saramin.co.kr/v?rec_idx="), j).alias("link"), F.lit("feed").alias("source"), F.lit("s").alias("snippet"),
        F.lit(4).alias("size_rank"), F.lit("중견").alias("size"), F.lit(0.5).alias("rel_score"), F.lit("검토").alias("tier"),
        F.when(by(5) == 0, RUN).alias("verified_at"), F.when(by(5) == 0, "원문 확인").when(by(5) == 1, "원문 확인 필요 (목록)").alias("verify"), F.when(by(5) == 1, RUN).alias("verify_tried_at"),
        F.concat(F.lit("판정"), by(3).cast("string")).alias("duty"), F.concat(F.lit("ev "), j).alias("duty_evidence"), F.when(by(3) == 0, "주의").otherwise("").alias("duty_flag"),
        F.concat(F.lit("L"), by(10).cast("string")).alias("location"), F.when(by(2) == 1, "대졸").alias("edu"), F.lit("정규직").alias("emp_type"), F.lit("18:00").alias("deadline_time"),
        F.concat(F.lit("(주)C"), j).alias("company_full"), F.when(by(10) == 0, "2031-01-01").alias("v_start"), F.when(by(15) == 0, "2031-09-09").alias("v_deadline"), F.when(by(10) == 5, "9년").alias("v_exp"),
        F.when(by(3) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("환경"), F.lit("안전"))).alias("sec"),
        F.when(by(6) == 0, "높음").alias("cmp_salary"), F.when(by(6) == 1, "큼").alias("cmp_size"), F.concat(F.lit("n"), j).alias("csn"), F.lit("대기업").alias("company_form"),
        F.col("o_orderkey").cast("int").alias("employees"), F.lit(5000).alias("avg_salary"), F.lit(2030).alias("salary_year"), F.lit(False).alias("closed"), F.col("o_orderkey").alias("batch_pos"))
    return merge.merge_snapshot(stored, batch, RUN).select(
        "id", "verify", "verified_at", "verify_tried_at", "exp", "posted", "deadline", "location", "edu", "emp_type", "deadline_time", "company_full", "duty", "duty_evidence", "duty_flag", "sec",
        "csn", "company_form", "employees", "avg_salary", "salary_year", "cmp_salary", "cmp_size")


def posting_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Links of known sites with and without the posting marker, hiring words, card words"""
    by = lambda n: _by("o_orderkey", n)
    title = F.when(by(4) == 0, "회계 결산").when(by(4) == 1, "안전 CHEF 채용 안내").when(by(4) == 2, "Plant LEAD").otherwise("설비 점검")
    href = (F.when(by(5) == 0, "https://www.saramin.co.kr/v?rec_idx=7").when(by(5) == 1, "https://www.saramin.co.kr/zf_user/jobs").when(by(5) == 2, "https://m.jobkorea.co.kr/Recruit/1")
            .when(by(5) == 3, "https://x.example/rec_idx=1"))
    words = F.when(by(3) == 0, "").when(by(3) == 1, " 담당 업무 자격요건").otherwise(" 담당업무 담당 업무")
    block = F.concat(title, F.when(by(7) == 0, "").otherwise("·" * 45), words)
    return landed(spark, sf, "orders").select("o_orderkey", rules.not_a_posting(title, href, block).alias("reason"))


def list_elements(spark: SparkSession, sf: str) -> DataFrame:
    """A3: list elements of pages without a usable anchor"""
    k = _text("o_orderkey")
    html = F.concat(F.lit('<html><body><a href="/home">회사 소개</a><p>안전 머리글입니다</p><ul><li><strong>환경 담당 '), k, F.lit("</strong> <em>경력 "), _by("o_orderkey", 9).cast("string"), F.lit("년</em></li><li>회계 "), k,
                    F.lit("</li><li>안전 순찰 "), k, F.lit('</li></ul><div class="card"><p>보건 안전 '), _text("o_custkey"), F.lit("</p></div>"),
                    F.when(_by("o_orderkey", 7) == 0, F.concat(F.lit('<a href="/j/'), k, F.lit('">안전 채용 '), k, F.lit("</a>"))).otherwise(""), F.lit("</body></html>"))
    found = pages.page_candidates(landed(spark, sf, "orders").select("o_orderkey", html.alias("html")), "환경|안전")
    return found.select("o_orderkey", "pos", "title", "href", "block")


def short_values(spark: SparkSession, sf: str) -> DataFrame:
    """Long values cut at the first stop word, else at a length"""
    head = F.repeat(F.lit("ab "), _by("o_orderkey", 20).cast("int"))
    value = F.concat(head, F.when(_by("o_orderkey", 3) == 0, F.repeat(F.lit("x"), 30)).when(_by("o_orderkey", 3) == 1, " 접수 온라인 · 근무 울산 · 연락처 없음 · 그 밖의 안내").otherwise(" 마감 빠름"))
    return table(spark, sf, "orders").select("o_orderkey", shorten(value).alias("short"))


def profile_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache with the newest entry per name"""
    e = table(spark, sf, "events")
    row = lambda rows: rows.select(F.col("user_id").alias("norm"), F.col("event_id").alias("fetched"), "value")
    put = state.put_profiles(row(e.filter("event_type <> 'click'")), row(e.filter("event_type = 'click'")).withColumn("form", F.lit("대기업")))
    return put.select("norm", "fetched", "value", "form")


def detail_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Other company, closed, past and unread pages"""
    by = lambda n: _by("o_orderkey", n)
    o = landed(spark, sf, "orders").withColumn("company", F.concat(F.lit("Firm "), _text("o_custkey")))
    detail = F.struct(
        F.lit("안전 담당").alias("title_full"), F.lit("산업안전 업무를 맡습니다").alias("body"), F.when(by(2) == 0, F.concat(F.lit("(주)"), "company")).when(by(7) > 0, F.lit("Other Co")).alias("company_full"),
        F.when(by(5) == 0, "2031-07-01").when(by(5) == 1, "2031-08-01").when(by(5) == 2, "상시").when(by(5) == 3, RUN).alias("deadline"), F.when(by(11) < 9, by(11) == 0).alias("closed"),
        F.lit("2031-06-01").alias("start"), F.lit("3년").alias("exp"), F.concat(F.lit("L"), by(6).cast("string")).alias("location"), F.lit("대졸").alias("edu"), F.lit("정규직").alias("emp_type"), F.lit("18:00").alias("deadline_time"))
    jobs = o.select("o_orderkey", "company", F.lit("안전 담당").alias("title"), F.lit("목록").alias("link_kind"), F.lit("추천").alias("tier"), F.when(by(3) < 2, by(3) == 0).alias("check_company"), F.when(by(4) > 0, detail).alias("detail"))
    return verify.apply_details(jobs, RUN).select("o_orderkey", "verify", "verified_at", "closed", "v_start", "v_deadline", "v_exp", "location", "company_full")


def judged_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Listed companies, size filter, affiliates and head-hunters, doubtful search pages"""
    by = lambda n: _by("o_orderkey", n)
    kind, firm = by(5), by(3)
    name = F.col("name")
    sources = table(spark, sf, "region").select(_text("r_regionkey").alias("name")).select(
        "name", F.when(name == "0", "portal").when(name == "1", "search").when(name == "4", "company").otherwise("api").alias("type"),
        F.lit("https://s.example/search?x=1").alias("url"), F.when(name == "0", "Portal Co").when(name == "4", "Own Co").alias("company"),
        F.lit("groups:x").alias("adapter"), (name == "2").alias("size_filter"), (name == "3").alias("groups_only"))
    company = F.when(firm == 0, "한빛전자").when(firm == 1, "대솔소재").when(kind == 3, "써치 파트너스").otherwise("Firm")
    title = (F.when((kind == 0) & (firm == 1), "안전 점검 안내").when((kind == 3) & (firm == 2) & (by(2) == 0), "대기업 안전 담당 채용")
             .when((kind == 2) & (by(2) == 1), "안전 담당 채용 건설").otherwise("안전 담당 채용"))
    block = F.concat(F.when(kind == 1, F.concat(company, F.lit(" · "))).when((kind == 4) & (by(2) == 0), "Own Co · ").otherwise(""), F.lit("경력 "), (by(9) + 1).cast("string"), F.lit("년 이상"))
    rows = landed(spark, sf, "orders").select(
        "o_orderkey", kind.cast("string").alias("source"), title.alias("title"), F.when((kind == 0) & (firm == 2), "https://www.saramin.co.kr/list").otherwise("https://x.example/1").alias("href"),
        block.alias("block"), company.alias("company"))
    aliases = spark.createDataFrame([("한빛전자", "한빛")], "alias string, group string")
    return judge(join_sources(rows, sources), FIRMS, F.lit(RUN).cast("date"), aliases).select("o_orderkey", "company", "affiliate_of", "size_rank", "check_company", "drop_reason")


def export_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """C14: every reason why a stored posting is not published"""
    by = lambda n: _by("o_orderkey", n)
    b = by(8)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(by(16) == 8, "판정 오류 · 회계").when(b == 0, "중복: s-1").otherwise("원문 확인").alias("verify"), F.when(by(3) == 0, "그리팅 A").otherwise("feed").alias("source"),
        F.when(b == 1, "안전 점검 안내").when(b == 6, "안전 팀 매니저").when(b == 7, "회계 담당 채용").otherwise("안전 담당 채용").alias("title"),
        F.lit("https://x.example/1").alias("link"), F.lit("s").alias("snippet"), F.when((b == 2) & (by(5) == 0), "정규직·계약직").when(b == 2, "계약직").alias("emp_type"),
        F.when(b == 3, "고용형태: 기간제").alias("duty_evidence"), F.when(b == 4, "건설현장 가능").alias("duty_flag"), F.when(by(3) == 1, "대한건설").otherwise("Firm").alias("company"),
        F.when(b == 5, "9년 이상").otherwise("3년 이상").alias("exp"), F.when(by(7) == 0, 2).otherwise(4).alias("size_rank"))
    return rows.select("o_orderkey", view.export_reason(FIRMS).alias("why"))


QUERIES = {f.__name__: f for f in (merge_details, posting_filter, list_elements, short_values, profile_cache, detail_verdicts, judged_kinds, export_kinds)}


def sql() -> dict[str, str]:
    return {
        "merge_details": f"""
            WITH {STATE}, s AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN '중복: s-' || (o_orderkey + 1) ELSE verify END AS v0,
                CASE c_mktsegment WHEN 'MACHINERY' THEN '계약직' WHEN 'BUILDING' THEN '정규직·계약직' END AS e0, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '고용형태: 파견' END AS d0 FROM state),
            b0 AS (SELECT o_orderkey AS j, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS k FROM orders WHERE o_orderkey % 4 < 3),
            b AS (SELECT k, min(j) AS j FROM b0 GROUP BY k),
            m AS (SELECT s.*, j, j IS NOT NULL AND j % 5 = 0 AS official, j IS NOT NULL AND j % 5 = 1 AND verified_at IS NULL AS noted,
                j IS NOT NULL AND NOT (verified_at IS NOT NULL AND j % 5 <> 0) AS refreshed, j IS NOT NULL AND j % 6 < 2 AS compared FROM s LEFT JOIN b ON o_orderkey = k)
            SELECT id, CASE WHEN official THEN '원문 확인' WHEN noted THEN '원문 확인 필요 (목록)' ELSE v0 END AS verify, CASE WHEN official THEN '{RUN}' ELSE verified_at END AS verified_at,
              CASE WHEN j % 5 = 1 THEN '{RUN}' END AS verify_tried_at, CASE WHEN official AND j % 10 = 5 THEN '9년' WHEN refreshed THEN '1년 이상' ELSE exp END AS exp,
              CASE WHEN official AND j % 10 = 0 THEN '2031-01-01' WHEN refreshed THEN coalesce(posted, '2031-07-01') ELSE posted END AS posted,
              CASE WHEN official AND j % 15 = 0 THEN '2031-09-09' WHEN refreshed AND j % 2 = 0 THEN '2031-08-08' ELSE deadline END AS deadline,
              CASE WHEN official THEN 'L' || (j % 10) END AS location, CASE WHEN official AND j % 2 = 1 THEN '대졸' END AS edu, CASE WHEN official THEN '정규직' ELSE e0 END AS emp_type,
              CASE WHEN official THEN '18:00' END AS deadline_time, CASE WHEN official THEN '(주)C' || j END AS company_full, CASE WHEN official OR noted THEN '판정' || (j % 3) END AS duty,
              CASE WHEN official OR noted THEN 'ev ' || j ELSE d0 END AS duty_evidence, CASE WHEN (official OR noted) AND j % 3 = 0 THEN '주의' END AS duty_flag,
              CASE WHEN j % 3 > 0 THEN '환경,안전' END AS sec, CASE WHEN compared THEN 'n' || j END AS csn, CASE WHEN compared THEN '대기업' END AS company_form, CASE WHEN compared THEN j END::INTEGER AS employees,
              CASE WHEN compared THEN 5000 END AS avg_salary, CASE WHEN compared THEN 2030 END AS salary_year, CASE WHEN j % 6 = 0 THEN '높음' END AS cmp_salary, CASE WHEN j % 6 = 1 THEN '큼' END AS cmp_size FROM m""",
        "posting_filter": """
            SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 2) THEN NULL WHEN o_orderkey % 5 = 1 THEN 'not_posting_link'
              WHEN o_orderkey % 4 IN (0, 3) AND NOT (o_orderkey % 3 = 1 AND o_orderkey % 7 > 0) THEN 'not_posting_text' END AS reason FROM orders""",
        "list_elements": """
            SELECT o_orderkey, 0 AS pos, CASE WHEN o_orderkey % 7 = 0 THEN '안전 채용 ' ELSE '환경 담당 ' END || o_orderkey AS title, CASE WHEN o_orderkey % 7 = 0 THEN '/j/' || o_orderkey ELSE '' END AS href,
              CASE WHEN o_orderkey % 7 = 0 THEN '안전 채용 ' || o_orderkey ELSE '환경 담당 ' || o_orderkey || ' 경력 ' || (o_orderkey % 9) || '년' END AS block FROM orders
            UNION ALL SELECT o_orderkey, 1, '안전 순찰 ' || o_orderkey, '', '안전 순찰 ' || o_orderkey FROM orders WHERE o_orderkey % 7 > 0
            UNION ALL SELECT o_orderkey, 2, '보건 안전 ' || o_custkey, '', '보건 안전 ' || o_custkey FROM orders WHERE o_orderkey % 7 > 0""",
        "short_values": """
            WITH h AS (SELECT o_orderkey, repeat('ab ', (o_orderkey % 20)::INTEGER) AS head FROM orders),
            v AS (SELECT *, trim(head || CASE o_orderkey % 3 WHEN 0 THEN repeat('x', 30) WHEN 1 THEN ' 접수 온라인 · 근무 울산 · 연락처 없음 · 그 밖의 안내' ELSE ' 마감 빠름' END) AS v FROM h)
            SELECT o_orderkey, CASE WHEN length(v) <= 40 THEN v WHEN o_orderkey % 3 = 0 THEN trim(left(v, 40)) ELSE trim(left(trim(head), 40)) END AS short FROM v""",
        "profile_cache": """
            SELECT user_id AS norm, max(event_id) AS fetched, arg_max(value, event_id) AS value, CASE WHEN arg_max(event_type, event_id) = 'click' THEN '대기업' END AS form FROM events GROUP BY 1""",
        "detail_verdicts": f"""
            WITH o AS (SELECT *, 'Firm ' || o_custkey AS c, o_orderkey % 4 > 0 AS have, o_orderkey % 2 = 1 AND o_orderkey % 7 > 0 AS foreign_name, o_orderkey % 11 = 0 AS shut FROM orders),
            r AS (SELECT *, have AND o_orderkey % 3 = 0 AND foreign_name AS other FROM o)
            SELECT o_orderkey, CASE WHEN other THEN '다른 회사 공고라 제외 (원문 회사: Other Co)' WHEN have THEN CASE WHEN shut THEN '마감됨 · ' ELSE '' END || '원문 확인 07.15' ELSE '원문 확인 필요 (목록)' END AS verify,
              CASE WHEN have THEN '{RUN}' END AS verified_at, have AND (other OR shut OR o_orderkey % 5 = 0) AS closed, CASE WHEN have THEN '2031-06-01' END AS v_start,
              CASE WHEN have THEN CASE o_orderkey % 5 WHEN 0 THEN '2031-07-01' WHEN 1 THEN '2031-08-01' WHEN 2 THEN '상시' WHEN 3 THEN '{RUN}' END END AS v_deadline,
              CASE WHEN have THEN '3년' END AS v_exp, CASE WHEN have THEN 'L' || (o_orderkey % 6) END AS location,
              CASE WHEN have THEN CASE WHEN o_orderkey % 2 = 0 THEN '(주)' || c WHEN foreign_name THEN 'Other Co' END END AS company_full FROM r""",
        "judged_kinds": """
            WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 3 AS f, o_orderkey % 2 AS h, o_orderkey % 9 + 1 AS y FROM orders),
            c AS (SELECT *, CASE WHEN k = 0 THEN 'Portal Co' WHEN k = 4 THEN 'Own Co' WHEN f = 0 THEN '한빛전자' WHEN f = 1 THEN '대솔소재' WHEN k = 2 THEN 'Firm' WHEN k = 3 THEN '써치 파트너스' END AS company FROM o)
            SELECT o_orderkey, company, CASE WHEN company = '한빛전자' THEN '한빛' END AS affiliate_of, CASE WHEN k = 0 OR company = '한빛전자' THEN 1 WHEN company = '대솔소재' THEN 4 ELSE 5 END AS size_rank,
              k = 4 AND h = 1 AS check_company,
              CASE WHEN k = 0 AND f = 1 THEN 'not_posting_text' WHEN k = 0 AND f = 2 THEN 'not_posting_link' WHEN k IN (1, 2) AND f = 2 THEN 'unlisted_company'
                WHEN k = 3 AND (f = 1 OR f = 2 AND h = 1) THEN 'not_group_affiliate' WHEN y > 7 THEN 'min_years' WHEN k = 2 AND f = 1 AND h = 1 THEN 'off_profile' END AS drop_reason FROM c""",
        "export_kinds": """
            WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS b, o_orderkey % 3 AS f, o_orderkey % 5 AS p, o_orderkey % 7 = 0 AS big FROM orders)
            SELECT o_orderkey, CASE WHEN b = 0 THEN 'hidden' WHEN b = 1 AND f <> 0 THEN 'not_posting' WHEN b = 2 AND p <> 0 THEN 'contract' WHEN b = 3 THEN 'contract_evidence'
              WHEN b = 4 AND f = 1 THEN 'site_work' WHEN b = 5 THEN 'min_years' WHEN b = 6 THEN 'staff_profile' WHEN b = 7 OR f = 1 AND NOT big THEN 'off_profile' END AS why FROM o""",
    }
