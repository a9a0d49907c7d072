"""Rules, judging, tiers and page checks on invented rows."""

import datetime as dt

from pyspark.sql import functions as F

from tidewell.functions import bands
from tidewell.functions import fixed
from tidewell.functions.text import matches
from tidewell.operators import rules as R
from tidewell.operators.judge import drop_label, join_sources, judge
from tidewell.operators.verify import duty_check, labelled_detail, linked_data_detail

DAY = dt.date(2031, 5, 1)


def test_sections(evaluate, rules):
    cases = [
        ("환경안전팀 경력", "한빛전자", 1, ["환경", "안전"]), ("HSE 담당", "대솔", 4, ["환경", "안전"]), ("mesHSEt 개발", "대솔", 4, []),
        ("식품 안전 담당", "대솔", 4, []), ("안전관리자(본사)", "한빛건설", 1, ["안전"]), ("안전관리자(본사)", "어느건설", 5, []),
        ("안전관리자(본사)", "어느건설", None, ["안전"]), ("신축 안전관리자", "한빛건설", 1, []), ("안전 담당", "한빛건설기계", 5, ["안전"]),
        ("산업안전&소방 담당", "대솔", 4, ["안전"]), ("소방 안전 담당", "대솔", 4, []), ("안전관리 대행", "대솔", 4, []),
        ("안전관리", "대솔대행", 4, []), ("근무 환경 최고", "대솔", 4, []), ("회계", "대솔", 4, []), ("hse 담당 (계약직)", "대솔", 1, []),
    ]
    got = evaluate([c[:3] for c in cases], "t string, c string, r int", R.sections(rules, "t", "c", F.col("r")))
    assert got == [c[3] for c in cases]
    loose = evaluate([c[:2] for c in cases], "t string, c string", R.sections_loose(rules, "t", "c"))
    assert all(lo for lo, c in zip(loose, cases) if c[3])


def test_not_a_posting(evaluate):
    """Links of known boards need their marker, other rows a hiring word or the fields of a card."""
    boards = {"https://www.saramin.co.kr/v?rec_idx=4": None, "https://www.saramin.co.kr/company/4": "not_posting_link",
              "https://www.jobkorea.co.kr/Recruit/GI_Read/4": None, "https://www.jobkorea.co.kr/Company/4": "not_posting_link",
              "https://job.incruit.com/jobdb_info/4": None, "https://m.incruit.com/list": "not_posting_link", "https://own.example/4": None, "": None, None: None}
    cases = [("배관 점검 모집", link, "배관 점검 모집", want) for link, want in boards.items()]
    cases += [("체육관 안내", "https://own.example/gym", "체육관 안내", "not_posting_text"),
              ("배관 소음", "", "배관 소음 측정 담당 업무 기록과 정리, 지원 자격 무관, 우대 사항 없음, 근무지 당진, 접수 방문", None)]
    got = evaluate([c[:3] for c in cases], "t string, h string, b string", R.not_a_posting("t", "h", "b"))
    assert got == [c[3] for c in cases]


def test_find_company(evaluate, rules):
    """A listed name counts as a word of its own, the longer one first, and not as the client of a contractor."""
    names = [*rules.large_companies, *rules.mid_companies]
    plain = evaluate([(f"수질 점검 {n} 모집",) for n in names], "t string", R.find_company(rules, "t"))
    assert plain == names
    assert evaluate([(f"{n} 협력업체 수질 점검",) for n in names], "t string", R.find_company(rules, "t")) == [None] * len(names)
    assert evaluate([("XHBZ 모집",), ("A3Q1 점검",), ("이름 없음",), (None,)], "t string", R.find_company(rules, "t")) == [None] * 4


def test_block_field(evaluate):
    pairs = [f"{a}{sep}{b}" for a, b in (("환경", "안전"), ("안전", "보건"), ("안전", "환경")) for sep in ("", "/", " · ", ", ")]
    assert evaluate([(f"구분: {p} 2명",) for p in pairs], "b string", matches("b", fixed.BLOCK_FIELD)) == [True] * len(pairs)
    assert evaluate([("친환경 포장 2명",), ("구분: 도장, 조립",)], "b string", matches("b", fixed.BLOCK_FIELD)) == [False] * 2


def test_judge_first_reason_wins(spark, rules):
    sources = spark.createDataFrame([
        ("co", "company", "https://co.example/jobs", "한빛전자", None, None, False, False, None),
        ("small", "company", "https://small.example/search?q=1", "작은회사", None, None, False, False, None),
        ("find", "search", "https://find.example", None, None, None, False, False, None),
        ("feed", "api", "https://feed.example", "한빛전자", "대기업 계열", "groups:x", False, False, None),
        ("agg", "api", "https://agg.example", None, None, "aggregators:x", False, False, 4),
        ("only", "api", "https://only.example", None, None, "aggregators:y", False, True, None),
        ("size", "api", "https://size.example", None, None, "aggregators:z", True, False, None),
    ], "name string, type string, url string, company string, `group` string, adapter string, size_filter boolean, groups_only boolean, default_rank int")
    rows = [
        ("co", "환경안전 담당 채용", "/1", "경력 3~5년 ~5.20", None, None),
        ("co", "회계 채용", "/2", "경력", None, "off_topic"),
        ("co", "안전 생각하는 동료", "/3", "안전 생각하는 동료", None, "not_posting_text"),
        ("co", "환경안전 팀장 채용", "/4", "경력 12년↑ 2031.04.01 ~ 2031.04.20", None, "min_years"),
        ("small", "환경안전 신입 채용", "/5", "신입", None, "new_grad_small"),
        ("co", "환경안전 신입 채용", "/6", "신입 ~5.9", None, None),
        ("co", "환경안전 경력 채용", "/7", "2031.04.01 ~ 2031.04.30", None, "past_deadline"),
        ("co", "환경안전 경력 채용", "/8", "접수마감", None, "closed_wording"),
        ("co", "환경안전 경력 채용", "/8b", "접수마감일 5.20", None, None),
        ("find", "환경안전 담당 모집", "/9", "대솔 · 경력", None, None),
        ("find", "환경안전 담당 모집", "/10", "모르는회사 · 경력", None, "unlisted_company"),
        ("feed", "경력사원 상시채용", "/11", "직무: 환경/안전, 회계", None, None),
        ("agg", "보안사원 모집", "/12", "~ 5/30 · 검색:환경안전", "대솔", "off_topic"),
        ("only", "환경안전 담당", "/13", "경력", "빛나리", "not_group_affiliate"),
        ("only", "환경안전 담당", "/14", "경력", "(주)새빛물산", None),
        ("only", "환경안전 담당 (대기업)", "/14b", "경력", "바른서치", None),
        ("size", "환경안전 담당", "/15", "경력", "빛나리", "unlisted_company"),
        ("size", "환경안전 담당", "/16", "경력", "새빛물산", None),
        ("co", "건축 현장 안전 담당 채용", "/17", "경력", None, "off_topic"),
        ("agg", "건설 본사 안전관리자 채용", "/18", "경력", "이름건설", "off_profile"),
    ]
    cand = spark.createDataFrame([r[:5] for r in rows], "source string, title string, href string, block string, company string")
    aliases = spark.createDataFrame([("새빛물산", "새빛")], "alias string, `group` string")
    got = {r["link"]: r for r in judge(join_sources(cand, sources), rules, F.lit(DAY), aliases).collect()}
    assert {k: got[k]["drop_reason"] for k in got} == {r[2]: r[5] for r in rows}
    assert (got["/1"]["size_rank"], got["/1"]["size"], got["/1"]["deadline"], got["/1"]["sec"]) == (1, "대기업", "2031-05-20", ["환경", "안전"])
    assert got["/11"]["title"] == "경력사원 상시채용 (환경/안전)" and got["/11"]["size_rank"] == 1
    assert got["/12"]["size_rank"] == 4 and got["/14"]["affiliate_of"] == "새빛" and got["/14"]["size_rank"] == 1
    assert got["/5"]["check_company"] and not got["/1"]["check_company"]
    label = spark.createDataFrame([("min_years", 12), ("off_topic", None)], "r string, y int").select(drop_label(F.col("r"), F.col("y"))).collect()
    assert [x[0] for x in label] == ["경력 하한 12년", "직무 규칙 불통과"]


def test_tiers(evaluate):
    """One plain company; each case changes what it names."""
    plain = dict(c="가람산업", t="", g=None, r=4, s="중견", e=None, sal=None, f=None, m=False)
    top, mid, rest = fixed.TIER_TOP, fixed.TIER_MID, fixed.TIER_REST
    cases = [({}, rest), (dict(e=1000), mid), (dict(e=999), rest), (dict(e=300, sal=7000), mid), (dict(e=299, sal=7000), rest), (dict(e=300, sal=6999), rest),
             (dict(r=3), top), (dict(r=None), rest), (dict(s="대기업 계열"), top), (dict(g="가람", r=5), top), (dict(c="일자리센터", g="가람", r=1), rest),
             (dict(c="가람헌터", t="글로벌 제조사 안전"), top), (dict(c="가람헌터", t="안전"), rest), (dict(c="가람 → 상장 중견"), rest), (dict(c="가람공단", r=5), top),
             (dict(f="중견기업, 1000대기업"), mid), (dict(m=True), mid), (dict(m=True, e=10), rest)]
    rows = [tuple({**plain, **change}.values()) for change, _ in cases]
    got = evaluate(rows, "c string, t string, g string, r int, s string, e int, sal int, f string, m boolean",
                   bands.company_tier("c", "t", F.col("g"), F.col("r"), "s", F.col("e"), F.col("sal"), "f", F.col("m"))["tier"])
    assert got == [want for _, want in cases]


def test_bands(evaluate):
    sal = evaluate([(5300, 5000), (4700, 5000), (5100, 5000), (None, 5000), (5625, 5000)], "a int, b int", bands.compare_salary(F.col("a"), F.col("b")))
    assert sal == ["높음 +6%", "낮음 -6%", "비슷", "정보 없음", "높음 +12%"]
    size = evaluate([(1500, "대기업", 1000, "대기업"), (1500, "중견기업", 1000, "대기업"), (600, "중견기업", 1000, "중견기업"), (None, "대기업", None, "대기업"),
                     (None, "중소기업", None, "대기업"), (1000, "", 1000, ""), (None, "", None, "")], "e int, f string, be int, bf string",
                    bands.compare_size(F.col("e"), "f", F.col("be"), "bf"))
    assert size == ["더 큼", "작음", "작음", "비슷", "작음", "비슷", "정보 없음"]
    ranks = evaluate([(1, "중견기업"), (1, "대기업, 중견기업"), (2, "중소기업, 외국 법인기업"), (4, "중견기업")], "r int, f string", bands.form_rank(F.col("r"), "f"))
    assert ranks == [4, 1, 2, 4]


def test_duty(spark):
    """A duty word under a heading confirms, one in the title alone is less, none or only a closed one is doubt."""
    duties, other = ("폐수 처리장 운전", "위험물 저장소 점검", "작업환경측정 계획"), "전표 입력과 정리"
    cases = [("사원 모집", f"{head}\n{d}", "확인", "") for head in ("담당업무", "주요 업무", "모집분야") for d in duties]
    cases += [("사원 모집", f"담당업무\n{other}", "의심", ""), ("사원 모집", "", "의심", ""), ("수질 담당 모집", "", "제목만", ""),
              ("사원 모집", f"모집분야\n(마감)토양 조사, {other}", "의심", "마감"), ("사원 모집", "나" * 9000 + " 폐기물 담당", "확인", "")]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, title string, body string")
    got = duty_check(df).orderBy("i").collect()
    assert [g["duty"] for g in got] == [c[2] for c in cases]
    assert all(c[3] in g["duty_flag"] for g, c in zip(got, cases)) and all(d in g["duty_evidence"] for g, d in zip(got, duties))


def test_page_checks_keep_whole_texts(spark):
    """Flags, closing notes and places beyond 60 signs stay; only the published columns are cut."""
    site = ["건설현장", "공사현장", "시공", "현장대리인", "아파트", "공동주택", "분양", "건축현장", "플랜트현장", "PJT직", "데이터센터공사", "데이터센터현장", "데이터센터신축"]
    closing = ["(마감)환경관리 담당자", "(마감)안전관리 담당자", "(마감)보건관리 담당자", "(마감)위험물 저장소 점검", "(마감)공정안전 보고서", "(마감)화학물질 취급"]
    rows = [("사원 모집", "담당업무\n" + ", ".join(site)), ("사원 모집", "모집분야\n" + ", ".join(closing))]
    flags = [r["duty_flag"] for r in duty_check(spark.createDataFrame(rows, "title string, body string").coalesce(1)).collect()]
    assert flags[0] == ", ".join(site) and len(flags[0]) > 60
    assert all(c in flags[1] for c in closing) and sum(map(len, closing)) > 60
    place = " ".join(f"울산 남구 {n}번길" for n in range(12))
    labelled = f"<p>근무형태 정규직 급여 협의 근무지역 {place} 지도</p>"
    assert labelled_detail(spark.createDataFrame([("u", labelled)], "url string, html string")).first().location == place
    ld = f'<script type="application/ld+json">{{"@type":"JobPosting","title":"EHS","jobLocation":{{"address":{{"streetAddress":"{place}"}}}}}}</script>'
    assert linked_data_detail(spark.createDataFrame([("u", ld)], "url string, html string"), "2031-05-01").first().location == place


def test_detail_pages(spark):
    labelled = ('<meta property="og:description" content="한빛전자, 환경 담당"><a href="/company-info/view?csn=AB1"></a>'
                "<p>경력 경력 3~5년 학력 대졸 근무형태 정규직 급여 협의 근무지역 울산 남구 지도</p><p>시작일 2031.05.01 09:00 마감일 2031.05.20 18:00</p>")
    row = labelled_detail(spark.createDataFrame([("u", labelled)], "url string, html string")).first()
    assert (row.csn, row.company_full, row.title_full, row.start, row.deadline, row.deadline_time) == ("AB1", "한빛전자", "환경 담당", "2031-05-01", "2031-05-20", "18:00")
    assert (row.exp, row.edu, row.emp_type, row.location, row.closed) == ("경력 3~5년", "대졸", "정규직", "울산 남구", False)
    ld = ('<script type="application/ld+json">{"@type":"WebSite"}</script><script type="application/ld+json">{"@graph":[{"@type":"X"},'
          '{"@type":"JobPosting","title":"EHS &amp; 안전","hiringOrganization":{"name":"대솔"},"datePosted":"2031-04-01T00:00","validThrough":"2031-04-20T23:59",'
          '"employmentType":["FULL_TIME","INTERN"],"experienceRequirements":{"monthsOfExperience":40},"educationRequirements":"대졸",'
          '"jobLocation":[{"address":{"addressRegion":"울산","addressLocality":"남구"}}],"description":"<p>담당업무 안전관리</p>"}]}</script>')
    row = linked_data_detail(spark.createDataFrame([("u", ld), ("v", "<p>none</p>")], "url string, html string"), "2031-05-01").collect()
    assert len(row) == 1
    row = row[0]
    assert (row.title_full, row.company_full, row.start, row.deadline, row.deadline_time) == ("EHS & 안전", "대솔", "2031-04-01", "2031-04-20", "23:59")
    assert (row.emp_type, row.exp, row.edu, row.location, row.closed) == ("정규직, 인턴", "경력 3년↑", "대졸", "울산 남구", True)


def test_linked_data_is_parsed_once(spark):
    """the filter on pages with a posting does not parse them a second time."""
    pages = spark.createDataFrame([("u", '<script type="application/ld+json">{"@type":"JobPosting","title":"a"}</script>'), ("v", "<p>none</p>")], "url string, html string")
    out = linked_data_detail(pages.repartition(2), "2031-05-01")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1 and [r.url for r in out.collect()] == ["u"]


def test_candidates_of_one_company_are_judged_in_many_tasks(spark):
    """a portal's candidates all have its company; they do not meet the affiliates in one task."""
    src = "named_struct('name', 'p', 'type', 'portal', 'url', 'u', 'company', if(id < 0, 'x', 'Portal Co'), 'group', null, 'adapter', null, 'size_filter', false, 'groups_only', false, 'default_rank', null)"
    rows = spark.range(800).selectExpr("id", "'환경안전 담당' title", "concat('h', id) href", "'경력 3년' block", "'x' company", f"{src} src")
    aliases = spark.createDataFrame([("portal co", "G"), ("portalco", "G"), ("other", "H")], "alias string, group string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = judge(rows, R.RuleSet(candidate_pattern="환경", rule_include="환경", rule_exclude="대행", profiles=()), F.lit("2031-05-01").cast("date"), aliases)
        held = out.select("id", "affiliate_of").rdd.glom().map(lambda p: [r.affiliate_of for r in p]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(map(len, held)) == 800 and {a for p in held for a in p} == {"G"} and max(map(len, held)) < 600


def test_duty_check_searches_a_text_once(spark):
    """every whole-text search is in the plan once, and behind a look at the first sign it finds the same."""
    from tidewell.functions import fixed
    from tidewell.functions.text import led, rx
    from tidewell.operators.verify import duty_check

    rows = spark.createDataFrame([(1, "안전 관리자", "a. 로그인. 아파트\n(마감)위험물 b"), (2, "title", None)], "id int, title string, body string")
    out = duty_check(rows)
    plan = out.select("duty", "duty_flag")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(concat(_flat") == 1 and plan.count("regexp_extract_all(_flat") == 1
    assert [tuple(r)[3:] for r in out.orderBy("id").collect()] == [("의심", "", "환경·안전 분야 마감: (마감)위험물 b · 아파트"), ("의심", "", "")]
    texts = spark.createDataFrame([(w,) for w in ("ehs", "xE.H.S", "Ehs-she", "SHEET she", "ſhe", "환경 안전", "수질 폐수 Safety", "로그인 ai 추천", "공유 하기", "")], "t string")
    for pattern in (fixed.DUTY, fixed.SITE_WORK, fixed.DUTY_SECTION, fixed.PAGE_BOILERPLATE):
        assert led(pattern) != pattern
        for fold in (False, True):
            plain, guarded = (F.regexp_extract_all("t", F.lit(rx(p, fold)), 0) for p in (pattern, led(pattern)))
            assert texts.filter(plain != guarded).count() == 0
    assert led("(a)|b") == "(a)|b" and led("a?b|c") == "a?b|c"
