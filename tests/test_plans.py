"""Whole runs: collect twice, export, report, model, streams."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewell import session
from tidewell.catalog import analysis, parsing
from tidewell.functions import terms
from tidewell.functions.terms import COUNTERS
from tidewell.operators import score
from tidewell.operators.rules import RuleSet
from tidewell.plans import collect, export, report, verify
from tidewell.operators.health import HealthLimits
from tidewell.session import scratch_path
from tidewell.sources.state import STATE_SCHEMA, conform_state
from tidewell.streaming import lifecycle

SOURCES = [("표", "company", "https://table.example/open", "대솔"), ("줄", "portal", "https://rows.example", "누리소재"), ("찾기", "search", "https://seek.example", None),
           ("문", "company", "https://door.example", "HB")]
PAGES = [
    ("표", "<table><tr><td><a href='/p/9'>수처리 환경안전 담당자 채용</a></td><td>경력 4년↑</td><td>2031.05.02 ~ 2031.05.21</td></tr>"
          "<tr><td><a href='/p/10'>전산 개발 채용</a></td></tr><tr><td><a href='/p/11'>보건 안전 책임 채용</a></td><td>경력 9~12년</td></tr></table>"),
    ("줄", "<table><tr onclick='open(3)'><td><b>공정안전 PSM 담당 모집</b></td><td>경력 1~5년 · 2031.05.04 ~ 2031.05.30</td></tr>"
          "<tr onclick='open(4)'><td><b>구내식당 조리 모집</b></td><td>안전한 일터</td></tr></table>"),
    ("찾기", "<p><a href='/q/5'>수질 EHS 담당 모집</a> <i>HB · 경력 3년↑ · ~5.28</i></p><p><a href='/q/6'>환경 안전 담당 모집</a> <i>어딘가상사 · 경력 2년↑</i></p>"
            "<p><a href='/q/7'>안전 보건 담당 채용</a> <i>대솔 · 경력 · 2031.04.01 ~ 2031.04.22</i></p>"),
    ("문", "<body>Access Denied <a href=/x>환경안전 채용</a></body>"),
]
KEEP = {"수처리 환경안전 담당자 채용", "공정안전 PSM 담당 모집", "수질 EHS 담당 모집"}


def _run(spark, rules, state, run_date, **kw):
    sources = spark.createDataFrame(SOURCES, "name string, type string, url string, company string")
    cand, fetches = collect.candidates_of(spark.createDataFrame(PAGES, "source string, html string"), None, rules)
    return collect.run(cand, fetches, sources, state, rules, run_date, **kw), sources


def test_collect_export_report(spark, rules):
    empty = spark.createDataFrame([], STATE_SCHEMA)
    result, sources = _run(spark, rules, empty, "2031-05-05")
    first = result.state.cache()
    assert {r["title"] for r in first.collect()} == KEEP and first.filter("is_new").count() == len(KEEP)
    reasons = {r["title"]: r["drop_reason"] for r in result.judged.collect() if r["drop_reason"]}
    assert reasons == {"보건 안전 책임 채용": "min_years", "환경 안전 담당 모집": "unlisted_company", "안전 보건 담당 채용": "past_deadline", "구내식당 조리 모집": "off_topic"}
    health = {r["source"]: r for r in result.health.collect()}
    assert not health["문"]["ok"] and (health["찾기"]["found"], health["찾기"]["kept"]) == (3, 1)
    assert tuple(result.totals.first()) == (0, 4)
    row = collect.run_row(result, "2031-05-05T08:00").first()
    assert (row["new"], row["open"], row["sources_total"]) == (3, 3, 4)
    # next day: nothing new, all seen again
    again, _ = _run(spark, rules, first.drop("is_new"), "2031-05-06")
    assert again.state.filter("is_new").count() == 0 and {r["last_seen"] for r in again.state.collect()} == {"2031-05-06"}
    aliases = spark.createDataFrame([], "alias string, `group` string")
    out = export.export(first.drop("is_new"), rules, aliases, spark.createDataFrame([row]), "2031-05-05")
    jobs = {r["title"]: r for r in out["jobs"].collect()}
    assert set(jobs) == KEEP and jobs["수처리 환경안전 담당자 채용"]["co_tier"] == "우량 중견" and jobs["수질 EHS 담당 모집"]["co_tier"] == "대기업"
    assert out["meta"].first()["run_date"] == "2031-05-05"
    rep = report.report(first.drop("is_new"), first.filter("is_new"), result.health, sources, "2031-05-19")
    tiles = rep["tiles"].first()
    assert (tiles["tab_new"], tiles["tab_open"], tiles["tab_due"]) == (3, 3, 1)
    assert {r["name"] for r in rep["shortcuts"].collect()} == {"줄", "찾기"}
    problems, failed = report.health_gate(result.health, HealthLimits())
    assert [r["problem"] for r in problems.collect()] == ["overall"] and [r["source"] for r in failed.collect()] == ["문"]


def test_scored_run_gates_survivors(spark, rules):
    rows = [("환경안전 담당자 채용", "대솔", 1), ("공정안전 PSM 담당", "누리소재", 1), ("수질 EHS 담당 모집", "HB", 1), ("수처리 환경 담당", "대솔", 1),
            ("회계 담당", "한빛전자", 0), ("생산 신입", "HB", 0), ("조리사 모집", "누리", 0), ("영업 담당", "대솔", 0)]
    model = score.fit(spark.createDataFrame(rows, "title string, company string, label int"), max_iter=30)
    result, _ = _run(spark, rules, spark.createDataFrame([], STATE_SCHEMA), "2031-05-05", model=model)
    judged = result.judged.collect()
    assert {r["title"] for r in result.state.collect()} == KEEP
    assert all((r["p"] is None) == (r["drop_reason"] not in (None, "low_score")) for r in judged)
    assert all(r["tier"] == "추천" and r["rel_score"] > 0.3 for r in result.state.collect())


def test_sources_without_a_page_have_failed(spark, rules):
    """A feed whose payload is missing and a source without a page count as failed, and their postings stay open."""
    sources = spark.createDataFrame([*SOURCES[:1], ("빈곳", "company", "https://none.example", "HB"), ("새벽", "api", "https://feed1.example", None),
                                     ("저녁", "api", "https://feed2.example", None)], "name string, type string, url string, company string")
    feed = spark.createDataFrame([("새벽", "환경안전 담당 채용", "https://feed1.example/1", "경력 3년↑ ~5.30", "HB", 0)],
                                 "source string, title string, href string, block string, company string, pos int")
    kept = spark.createDataFrame([(n, n, "환경 담당", s, "2031-04-20", "2031-04-24", "open") for n, s in (("a", "빈곳"), ("b", "저녁"), ("c", "새벽"))],
                                 "id string, company string, title string, source string, first_seen string, last_seen string, status string")
    pages = spark.createDataFrame(PAGES[:1], "source string, html string")
    cand, fetches = collect.candidates_of(pages, feed, rules)
    result = collect.run(cand, fetches, sources, conform_state(kept), rules, "2031-05-05")
    health = {r["source"]: (r["ok"], r["error"]) for r in result.health.collect()}
    assert health == {"표": (True, None), "빈곳": (False, "NOT FETCHED"), "새벽": (True, None), "저녁": (False, "NOT FETCHED")}
    assert result.totals.first()["sources_total"] == 4
    status = {r["id"]: r["status"] for r in result.state.filter("id in ('a', 'b', 'c')").collect()}
    assert status == {"a": "open", "b": "open", "c": "closed"}


def test_profiles_and_lookups(spark, rules):
    batch = spark.createDataFrame([("(주)한빛", "https://a.example", 1), ("대솔", "https://a.example", 2), ("모름", "https://a.example", 3), ("낡음", "file://x", 4)], "company string, link string, batch_pos int")
    from tidewell.sources.state import PROFILE_SCHEMA
    prof = spark.createDataFrame([
        ("한빛", "1", "대기업", 1300, 2030, 5300, None, None, None, None, "2031-05-01"), ("대솔", None, None, None, None, None, None, None, None, True, "2031-05-01"),
        ("낡음", "2", "중견기업", 10, 2030, 100, None, None, None, None, "2031-01-01")], "norm string, " + PROFILE_SCHEMA.replace("fetched date", "fetched string")).withColumn("fetched", F.to_date("fetched"))
    got = {r["company"]: r for r in collect.with_profiles(batch, prof, "2031-05-05", {"avg_salary": 5000, "employees": 1000, "form": "대기업"}).collect()}
    assert (got["(주)한빛"]["cmp_salary"], got["(주)한빛"]["cmp_size"], got["(주)한빛"]["company_form"]) == ("높음 +6%", "더 큼", "대기업")
    assert got["대솔"]["cmp_salary"] is None and got["낡음"]["avg_salary"] is None
    assert [r["norm"] for r in collect.lookups_due(batch, prof, "2031-05-05", 5).collect()] == ["모름"]


def test_verify_batch(spark):
    page = ('<meta property="og:description" content="{co}, {ti}"><p>경력 경력 4년 ↑ 학력 대졸 근무형태 정규직 급여 x</p><p>담당업무 안전관리</p>'
            "<p>시작일 2031.05.01 마감일 {due} 18:00</p>")
    pages = spark.createDataFrame([
        ("https://www.saramin.co.kr/v?rec_idx=1", page.format(co="한빛전자", ti="안전 담당", due="2031.05.30")),
        ("https://www.saramin.co.kr/v?rec_idx=2", page.format(co="대솔", ti="환경 담당자 모집 공고", due="2031.05.01"))], "url string, html string")
    jobs = spark.createDataFrame([
        ("a", "한빛전자", "안전 담당", "https://www.saramin.co.kr/x?rec_idx=1", False, "추천"), ("b", "대솔", "환경 담당자 모집공고", "https://www.linkedin.com/1", False, "추천"),
        ("c", "누리", "수질 담당", "https://www.linkedin.com/2", False, "추천"), ("d", "누리", "안전 담당", "https://www.saramin.co.kr/x?rec_idx=1", True, "추천")],
        "id string, company string, title string, link string, check_company boolean, tier string")
    got = {r["id"]: r for r in verify.verify_batch(jobs, pages, "2031-05-05").collect()}
    assert (got["a"]["v_deadline"], got["a"]["v_exp"], got["a"]["closed"], got["a"]["duty"], got["a"]["emp_type"]) == ("2031-05-30", "경력 4년 ↑", False, "확인", "정규직")
    assert got["b"]["closed"] and got["b"]["verified_at"] == "2031-05-05"
    assert got["c"]["verified_at"] is None and got["c"]["verify"].startswith("원문 확인 필요")
    assert got["d"]["closed"] and got["d"]["verify"].startswith("다른 회사")


def test_model_separates_and_matches_hand_weights(spark):
    good = [f"환경안전 담당 {w} 채용" for w in ("울산", "여수", "서산", "대전", "부산", "인천")]
    bad = [f"홀서비스 조리 {w} 모집" for w in ("울산", "여수", "서산", "대전", "부산", "인천")]
    rows = spark.createDataFrame([(t, "한빛", 1) for t in good] + [(t, "누리", 0) for t in bad], "title string, company string, label int")
    user = spark.createDataFrame([("환경 담당", "대솔", 1)], "title string, company string, label int")
    train = score.training_rows(rows, user)
    assert train.count() == 15
    model = score.fit(train, max_iter=50)
    got = {r["title"]: r["p"] for r in score.score(rows.withColumn("id", F.monotonically_increasing_id()), model, "id").collect()}
    assert min(got[t] for t in good) > 0.8 and max(got[t] for t in bad) < 0.2
    # one word, by hand: tf = 1 + ln 2, idf = ln(3 / 2) + 1 on two documents
    docs = spark.createDataFrame([(1, "aa aa"), (2, "bb")], "id int, t string")
    counts = score.term_counts(docs, "id", F.col("t"), chars=False)
    idf = score.idf_weights(counts, docs.agg(F.count(F.lit(1)).alias("n")))
    w = {(r["id"], r["term"]): r["x"] for r in score.tfidf(counts, idf, "id").collect()}
    a, b = (1 + math.log(2)) * (math.log(1.5) + 1), 1 * (math.log(1.5) + 1)
    assert abs(w[(1, "aa")] - a / math.hypot(a, b)) < 1e-9 and w[(2, "bb")] == 1.0
    grams = spark.createDataFrame([("ab c",)], "t string").select(score.char_ngrams(F.col("t"))).first()[0]
    assert sorted(grams) == sorted([" ", "a", "b", " ", " a", "ab", "b ", " ab", "ab ", " ab ", " ", "c", " ", " c", "c ", " c "])
    path = scratch_path(spark, "model")
    model.save(path)
    assert score.RelevanceModel.load(spark, path).terms.count() == model.terms.count()


def test_gate_degrades_without_model(spark):
    df = spark.createDataFrame([(None, None, ["환경"]), (0.05, None, ["환경", "안전"]), (0.05, None, ["환경"]), (0.5, "off_topic", [])], "p double, drop_reason string, sec array<string>")
    got = [(r["tier"], r["drop_reason"], r["sec"]) for r in score.gate(df, RuleSet()).collect()]
    assert got == [("검토", None, ["환경"]), ("검토", None, ["안전"]), ("검토", "low_score", ["환경"]), ("추천", "off_topic", [])]


SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    last = events.agg(F.max("ts").cast("timestamp").alias("m")).first()["m"]
    batch = lifecycle.lifecycles(events, "user_id", "ts", F.col("event_type") == "error", "8 hours", "16 hours")
    done = batch.filter(F.col("closes_at") <= F.lit(last) - F.expr("interval 1 hour"))
    stream = analysis.lifecycle_stream(spark, SF)
    assert stream.exceptAll(analysis._shown(done)).count() == 0 and stream.count() == done.count()


def test_terms_are_counted_in_the_row(spark):
    """Against plain windows of every occurrence, and the same as the column forms."""
    texts = ["", None, "환경 안전  환경\tab　ab", "A b!\nab-ab x" + "y" * 90, "é é éa", "한빛 전자 EHS 담당 ehs", "w " * 40_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, "twice", "")]
    df = spark.createDataFrame(rows, "id int, t string, n string")
    got = sorted((r["id"], r["block"], r["term"], round(r["tf"], 9)) for r in score.term_counts(df, "id", F.col("t")).collect())
    want = []
    for i, t, _ in rows:
        chars, words = Counter(), re.findall("[가-힣A-Za-z]{2,}", (t or "").lower())
        for w in re.split(r"\s+", (t or "").lower()):
            for n in range(1, 5):
                chars.update(f" {w} "[k:k + n] for k in range(len(w) + 3 - n) if w)
        pairs = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        want += [(i, b, term, round(1 + math.log(n), 9)) for b, c in (("c", chars), ("w", pairs)) for term, n in c.items()]
    assert got == sorted(want)
    small = df.filter("id between 2 and 5")
    occurrences = small.select("id", F.explode(score.char_ngrams(F.col("t"))).alias("term")).groupBy("id", "term").count()
    assert {(r["id"], r["term"], round(1 + math.log(r["count"]), 9)) for r in occurrences.collect()} == {(i, t, x) for i, b, t, x in got if b == "c" and 2 <= i <= 5}
    assert "Exchange" not in score.term_counts(df, "id", F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert score.term_counts(df.limit(0), "id", F.col("t")).count() == 0


def test_counts_of_neighbouring_texts_are_added_up_in_the_task(spark):
    """document frequencies from folded parts equal those from the terms of each text, and few rows leave a task."""
    texts = ["", None, " ", "환경 안전  환경\tab　ab", "A b!\nab-ab x", "é🙂 é éa \x1c a", "w " * 5000, "a"] * 20 + ["".join(map(chr, range(0x4e00, 0x4e00 + 9000)))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    parts, each = score.term_counts(df, "id", F.col("t"), by_text=False), score.term_counts(df, "id", F.col("t"))
    few = df.filter("id < 160")
    assert score.term_counts(few, "id", F.col("t"), by_text=False).count() < score.term_counts(few, "id", F.col("t")).count() / 2
    for least in (None, {"c": 1, "w": 3}):
        assert sorted(map(tuple, score.idf_weights(parts, n, least).collect())) == sorted(map(tuple, score.idf_weights(each, n, least).collect()))
    assert score.term_counts(df.limit(0), "id", F.col("t"), by_text=False).count() == 0
    for most in (1, 60, 1 << 22):
        batch = pa.record_batch([pa.array([(t or "").lower() for t in texts])], names=["t"])
        got, want = Counter(), Counter()
        for part in terms.folded(batch, ("c", "w"), most):
            for block, term, _, k in zip(*(c.to_pylist() for c in part.columns)):
                got[block, term] += k
        for t in texts:
            for block, count in COUNTERS.items():
                want.update({(block, term): k for term, k in count((t or "").lower()).items()})
        assert got == want


def test_scores_in_the_row_equal_those_by_join(spark):
    rnd = random.Random(3)
    words = ["환경", "안전", "EHS", "영업", "ab", "b", "x-y"]
    rows = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randint(0, 6))), rnd.choice(["한빛", None])) for i in range(60)], "id int, title string, company string")
    table = score.term_counts(rows.limit(20), "id", F.col("title")).select("block", "term").distinct()
    table = table.select("block", "term", (1 + F.length("term") / 3).alias("idf"), (F.crc32("term") % 9 / 4.0 - 1).alias("weight"))
    model = score.RelevanceModel(table.cache(), 0.1)
    here = {r["id"]: r["p"] for r in score.score(rows, model, "id").collect()}
    joined = {r["id"]: r["p"] for r in score.score(rows, model, "id", most_terms=0).collect()}
    assert here.keys() == joined.keys() and all(abs(here[i] - joined[i]) < 1e-12 for i in here) and len(set(here.values())) > 10
    none = score.RelevanceModel(table.limit(0), 0.0)
    assert {r["p"] for r in score.score(rows, none, "id").collect()} == {0.5}


def test_terms_of_one_text_fold_into_one_feature(spark):
    """The same weights as a fit on all terms by plain gradient descent on the same objective."""
    rows = [("환경 안전 담당", "한빛", 1), ("환경 설비 zq", "대솔", 1), ("영업 사원", "한빛", 0), ("영업 기획 담당 kx", "누리", 0), ("안전 점검", "대솔", 1)]
    df = spark.createDataFrame(rows, "title string, company string, label int")
    model = score.fit(df, max_iter=400, c=2.0)
    got = {(r["block"], r["term"]): (r["idf"], r["weight"]) for r in model.terms.collect()}
    texts = [f"{t} || {c}" for t, c, _ in rows]
    counts = [{b: COUNTERS[b](t) for b in "cw"} for t in texts]
    df_of = Counter((b, t) for own in counts for b in own for t in own[b])
    keys = sorted(k for k, n in df_of.items() if n > 1 or k[0] == "w")
    assert sorted(got) == keys
    x = np.zeros((5, len(keys)))
    for i, own in enumerate(counts):
        for b in "cw":
            at = [j for j, k in enumerate(keys) if k[0] == b and k[1] in own[b]]
            v = np.array([(1 + math.log(own[b][keys[j][1]])) * (math.log(6 / (1 + df_of[keys[j]])) + 1) for j in at])
            x[i, at] = v / np.linalg.norm(v)
    y = np.array([1, 1, -1, -1, 1])
    weight = np.array([5 / (2 * (y == s).sum()) for s in y])
    w, bias = np.zeros(len(keys)), 0.0
    for _ in range(20_000):
        g = -weight * y / (1 + np.exp(y * (x @ w + bias)))
        w, bias = w - 0.2 * (x.T @ g / 5 + w / (2.0 * 5)), bias - 0.2 * g.sum() / 5
    assert max(abs(got[k][1] - w[j]) for j, k in enumerate(keys)) < 1e-3 and abs(model.intercept - bias) < 1e-3


def test_weighing_looks_up_windows_as_numbers(monkeypatch):
    """Against the counters of all terms: blanks, signs of no term, signs beyond 16 bits, pieces of a long text."""
    rnd = random.Random(5)
    monkeypatch.setattr(terms, "PIECE", 37)
    signs = "aab환경é\U0001f600\x1c!x"
    texts = ["", " ", "\x1c", "a", "a b", "ab  ab\tab　a", "w" * 90 + " ab"]
    texts += ["".join(rnd.choice(signs + "   ") for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    for block, keep in ((terms.CHAR, 0.6), (terms.WORD, 0.8), (terms.CHAR, 0.05)):
        every = sorted({t for x in texts for t in COUNTERS[block](x)})
        own = [t for t in every if rnd.random() < keep]
        idf, weight = np.linspace(1, 3, len(own)), np.linspace(-1, 2, len(own))
        table = terms.Weights(pa.array(own, pa.string()), idf, weight)
        for coded in (table.coded, False):
            table.coded = coded
            for text in texts:
                x = {t: (1 + math.log(n)) * idf[i] for t, n in COUNTERS[block](text).items() if t in own for i in [own.index(t)]}
                norm = math.sqrt(sum(v * v for v in x.values()))
                want = sum(v * weight[own.index(t)] for t, v in x.items()) / norm if norm else 0.0
                assert abs(terms.weigh(text, {block: table}) - want) < 1e-12
    assert terms.Weights(pa.array([], pa.string()), np.zeros(0), np.zeros(0)).chars("ab c")[0].size == 0


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    path = str(tmp_path / "one")
    pq.write_table(pa.table({"id": list(range(40_000)), "text": [f"{i * 7919 % 40_009:064x}" * 3 for i in range(40_000)]}), path, row_group_size=1 << 20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 8  # many splits, and one has all rows
        dealt = session.spread(scan)
        sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) * 8 <= 2 * 40_000 and sum(sizes) == 40_000
        assert dealt.select(F.sum("id")).first()[0] == sum(range(40_000))
        even = dealt.repartition(16)
        even.write.parquet(str(tmp_path / "even"))
        assert "Exchange" not in session.spread(spark.read.parquet(str(tmp_path / "even")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_weights_of_a_text_without_arrays_of_its_terms(spark):
    """Unit length per text and block against plain sums; no text's terms are collected into one value."""
    rows = [(i, f"{w} " * (i % 3 + 1) + v) for i, (w, v) in enumerate([("환경", "ab cd"), ("안전", "ab"), ("환경", "ab ef"), ("zz", ""), ("", "")])]
    counts = score.term_counts(spark.createDataFrame(rows, "id int, t string"), "id", F.col("t"))
    idf = score.idf_weights(counts, spark.range(1).select(F.lit(len(rows)).alias("n")))
    out = score.tfidf(counts, idf, "id")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate explode(_t" not in plan
    held = {(r["block"], r["term"]): r["idf"] for r in idf.collect()}
    want = {}
    for r in counts.collect():
        if (r["block"], r["term"]) in held:
            want[r["id"], r["block"], r["term"]] = r["tf"] * held[r["block"], r["term"]]
    norms = Counter()
    for (i, b, _), x in want.items():
        norms[i, b] += x * x
    got = {(r["id"], r["block"], r["term"]): r["x"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - x / math.sqrt(norms[k[:2]])) < 1e-12 for k, x in want.items())


def test_titles_of_a_single_file_are_parsed_in_many_tasks(spark):
    assert parsing.title_features(spark, SF).rdd.getNumPartitions() >= 8


def test_rounds_of_a_fit_take_blocks_larger_than_a_gradient(spark, monkeypatch):
    """Spark adds a whole gradient a block, so blocks grow with the features; vectors lie evenly in the fit's partitions."""
    df = spark.createDataFrame([(f"aa{i % 5} bb{i % 7}", "co", i % 2) for i in range(60)], "title string, company string, label int")
    plain, seen = score.LogisticRegression, {}

    class Spy:
        def __init__(self, **kw):
            seen.update(kw)
            self.lr = plain(**kw)

        def fit(self, train):
            seen["rows"] = train.rdd.glom().map(len).collect()
            return self.lr.fit(train)

    monkeypatch.setattr(score, "LogisticRegression", Spy)
    monkeypatch.setattr(score, "block_mb", lambda size: 3.0)
    score.fit(df, max_iter=5, rows_per_partition=20)
    assert seen["maxBlockSizeInMB"] == 3.0 and len(seen["rows"]) == 3 and min(seen["rows"]) > 10


def test_block_size_follows_the_features():
    assert score.block_mb(10) == 1.0 and 50 < score.block_mb(1_000_000) < 80 and score.block_mb(10**9) == 256.0


def test_rounds_of_a_fit_move_a_number_per_row(spark, monkeypatch):
    """a round shuffled a gradient of all features per partition; now it returns one number per labelled row, and terms meet the model by slice."""
    from tidewell.operators import logistic

    rnd = random.Random(2)
    rows = [(" ".join(rnd.choices([f"ab{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], k=40)), "co", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "title string, company string, label int")
    seen, plain = [], logistic._round
    monkeypatch.setattr(logistic, "_round", lambda held, v: seen.append(held.mapPartitions(lambda b: [sum(len(set(x[2])) for x in b)]).collect()) or plain(held, v))
    model = score.fit(df, max_iter=4)
    assert 0 < len(seen) <= 4 and len(seen[0]) == 8 and max(seen[0]) < sum(seen[0]) / 4  # features lie evenly in the tasks
    plan = score.score(df.withColumn("id", F.monotonically_increasing_id()), model, "id", most_terms=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "tf" not in plan


def test_fit_in_the_space_of_the_rows(spark):
    """Against plain gradient descent over the features, whatever the number of blocks."""
    from tidewell.operators.logistic import LogisticRegression

    rnd = np.random.default_rng(4)
    x = rnd.random((30, 12)) * (rnd.random((30, 12)) < 0.5)
    x[:, 0] = 1.0  # every row has an entry
    y, w = (x[:, 1] + rnd.normal(0, 0.3, 30) > 0.3).astype(float), rnd.random(30) + 0.5
    rows = [(i, float(y[i]), float(w[i]), [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)]
    train = spark.createDataFrame(rows, "doc long, label double, w double, indices array<int>, values array<double>").repartition(3)
    for mb in (64.0, 20 * 16 / 2**20):
        model = LogisticRegression(regParam=0.05, maxIter=300, tol=1e-9, maxBlockSizeInMB=mb).fit(train)
        got = np.zeros(12)
        for r in model.coefficients.collect():
            got[r["idx"]] = r["weight"]
        coef, bias, s, sign = np.zeros(12), 0.0, w / w.sum(), 2 * y - 1
        for _ in range(20_000):
            g = -s * sign / (1 + np.exp(sign * (x @ coef + bias)))
            coef, bias = coef - 0.5 * (x.T @ g + 0.05 * coef), bias - 0.5 * g.sum()
        assert np.abs(got - coef).max() < 1e-4 and abs(model.intercept - bias) < 1e-4


def test_slices_span_batches_and_hold_empty_texts():
    texts = ["", None, "ab cd", "x" * 90, "", "ab ab", "cd"] * 4
    batches = [pa.record_batch([pa.array(range(i, i + 7)), pa.array(texts[i:i + 7])], names=["id", "t"]) for i in range(0, 28, 7)]
    rows = list(terms.numbered(batches, 5 << 32, most=100))
    number = [n for b in rows for n in b.column("slice").to_pylist()]
    assert [n for b in rows for n in b.column("at").to_pylist()] == list(range(28)) and number == sorted(number) and number[0] == 5 << 32 and 4 < len(set(number)) < 28
    found = dict(terms.neighbours([b.select(["slice", "t"]) for b in rows]))
    assert [t for s in sorted(found) for t in found[s]] == [t or "" for t in texts] and all(len(found[s]) == number.count(s) for s in found)
    got = Counter()
    for b in terms.placed([b.select(["slice", "t"]) for b in rows], ("c", "w")):
        for block, term, n in zip(*(b.column(c).to_pylist() for c in ("block", "term", "n"))):
            got[block, term] += n
    assert got == sum((Counter({(b, t): n for t, n in count(x or "").items()}) for x in texts for b, count in COUNTERS.items()), Counter())


def test_weights_by_slice_shuffle_no_row_per_term(spark):
    """the rows of the plain path, from one packed row per slice and part of the terms."""
    rnd = random.Random(6)
    texts = ["", None, "é é éa", "\U0001f600 ab ab"] + [" ".join(rnd.choices(["ab", "cd ef", "환경", "안전", "zz" * 30, "x-y"], k=30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    for blocks, least in ((("w",), None), (("c", "w"), None), (("c", "w"), {"c": 3, "w": 4})):
        chars = "c" in blocks
        plain = score.term_counts(df, "id", F.col("t"), chars=chars)
        want = {(r["id"], r["block"], r["term"]): r["x"] for r in score.tfidf(plain, score.idf_weights(plain, n, least), "id").collect()}
        own = score.sliced(df, F.col("t"), "id", most=600)
        packed = score.term_counts(own, "id", F.col("_text"), chars=chars, by_slice=True, parts=7)
        idf = score.idf_weights(packed, n, least, parts=7)
        slices = own.select("slice").distinct().count()
        assert slices > 5 and packed.count() <= 7 * slices < plain.count() / 4 and idf.count() <= 7 * slices
        out = score.tfidf(packed, idf, "id", own, blocks)
        got = {(r["id"], r["block"], r["term"]): r["x"] for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-12 for k, x in want.items()) and out.count() == len(got)
    assert score.meeting_parts(own) == 4 * spark.sparkContext.defaultParallelism
    empty = score.sliced(df.limit(0), F.col("t"), "id")
    none = score.term_counts(empty, "id", F.col("_text"), by_slice=True, parts=7)
    assert score.tfidf(none, score.idf_weights(none, n, parts=7), "id", empty).count() == 0
