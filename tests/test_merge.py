"""Snapshot merge: identities, re-opening, official values, closing."""

from pyspark.sql import functions as F

from tidewell.functions.links import job_id
from tidewell.operators.merge import collapse_canon, merge_snapshot, new_ids, resolve_ids, to_import_rows
from tidewell.operators.lookup import import_new
from tidewell.sources.state import conform_state

RUN = "2031-05-10"
SR = "https://www.saramin.co.kr/v?rec_idx="
STATE = "id string, company string, title string, track string, exp string, posted string, deadline string, link string, source string, first_seen string, last_seen string, status string, verify string, verified_at string"
BATCH = "company string, title string, exp string, deadline string, link string, source string, posted string, verify string, verified_at string, v_deadline string, closed boolean, sec array<string>, batch_pos int"


def _id(spark, company, title):
    return spark.createDataFrame([(company, title)], "c string, t string").select(job_id("c", "t")).first()[0]


SEEN, LONG_AGO = "2031-04-27", "2031-02-02"


def _stored(i, **changed):
    """A stored posting of its own company; only what a situation needs differs."""
    row = dict(id=i, company=f"회사{i}", title=f"직무 {i}", track="경력", exp="", posted="", deadline="상시", link=f"https://keep.example/{i}", source="steady",
               first_seen=SEEN, last_seen=SEEN, status="open", verify="", verified_at="")
    return {**row, **changed}


def _found(pos, **changed):
    row = dict(company=None, title=None, exp="경력", deadline="", link="", source="steady", posted=None, verify=None, verified_at=None, v_deadline=None,
               closed=False, sec=None, batch_pos=pos)
    return {**row, **changed}


def _frame(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def _state(spark):
    checked = _id(spark, "솔빛정유", "방류수 분석")
    return _frame(spark, [
        _stored("number", exp="2년", deadline="2031-06-14", link=SR + "7001"),
        _stored(checked, company="솔빛정유", title="방류수 분석", exp="경력 5~9년", posted="2031-03-21", deadline="2031-05-28", link=SR + "7002",
                verify="원문 확인", verified_at="2031-05-08"),
        _stored("ended", link=SR + "7003", status="closed", verify="마감됨 · 원문 확인", verified_at="2031-05-08"),
        _stored("silent", source="broken"), _stored("vanished"), _stored("forgotten", source="broken", first_seen=LONG_AGO, last_seen="2031-03-30"),
        _stored("overdue", source="broken", deadline="2031-05-09", last_seen="2031-05-09"),
        _stored("pointer", link=SR + "7004", status="closed", verify="중복: number"),
        _stored("ending", link=SR + "7005", last_seen="2031-05-09"), _stored("returning", link=SR + "7006", status="closed", verify="마감됨", verified_at="2031-04-30"),
    ], STATE)


def _batch(spark):
    return _frame(spark, [
        _found(1, company="다른 표기", title="[급구] 고친 제목", link=SR + "7001&ref=mail", posted="2031-05-02", sec=["환경"]),
        _found(2, company="다른 표기", title="같은 번호의 둘째 줄", exp="신입", deadline="2031-07-01", link=SR + "7001"),
        _found(3, company="솔빛정유", title="방류수 분석", deadline="2031-05-12", link="https://www.saramin.co.kr/search?q=1", source="second"),
        _found(4, company="회사ended", title="직무 ended", link=SR + "7003"),
        _found(5, company="첫눈상사", title="토양 조사", deadline="2031-06-20", link="https://first.example/a", sec=["환경", "안전"]),
        _found(6, company="첫눈상사", title="이미 닫힘", link="https://first.example/b", verify="마감됨", verified_at=RUN, closed=True),
        _found(7, company="회사ending", title="직무 ending", link=SR + "7005", verify="마감됨", verified_at=RUN, closed=True),
        _found(8, company="회사returning", title="직무 returning", link=SR + "7006", verify="원문 확인 05.10", verified_at=RUN, v_deadline="2031-07-07"),
        _found(9, company="첫눈상사", title="토양-조사", exp="신입", link=SR + "7009"),
    ], BATCH)


def test_merge_rules(spark):
    state, failed = _state(spark), spark.createDataFrame([("broken",)], "source string")
    merged = merge_snapshot(state, _batch(spark), RUN, failed).cache()
    got = {r["id"]: r for r in merged.collect()}
    checked, new = _id(spark, "솔빛정유", "방류수 분석"), _id(spark, "첫눈상사", "토양 조사")
    assert set(got) == {r["id"] for r in state.collect()} | {new} and [r[0] for r in new_ids(merged).collect()] == [new]
    first = got["number"]
    assert (first["status"], first["exp"], first["deadline"], first["posted"], first["last_seen"], first["sec"]) == ("open", "경력", "2031-06-14", "2031-05-02", RUN, "환경")
    official = got[checked]
    assert (official["link"], official["deadline"], official["exp"], official["source"]) == (SR + "7002", "2031-05-28", "경력 5~9년", "second")
    assert {k: got[k]["status"] for k in ("ended", "silent", "vanished", "forgotten", "overdue", "ending")} == {
        "ended": "closed", "silent": "open", "vanished": "closed", "forgotten": "closed", "overdue": "closed", "ending": "closed"}
    assert (got["returning"]["status"], got["returning"]["deadline"], got["returning"]["verified_at"]) == ("open", "2031-07-07", RUN)
    assert (got[new]["first_seen"], got[new]["sec"], got[new]["exp"]) == (RUN, "환경,안전", "경력")
    # same batch again: nothing new, nothing moves
    again = merge_snapshot(merged.drop("is_new"), _batch(spark), RUN, failed)
    assert new_ids(again).count() == 0
    assert again.drop("is_new").exceptAll(merged.drop("is_new")).count() == 0


def test_pointer_hop(spark):
    batch = _batch(spark).filter("batch_pos = 1").withColumn("link", F.lit(SR + "7004"))
    # the number belongs to a closed duplicate, so the row it points to is updated
    got = {r["id"]: r for r in merge_snapshot(_state(spark), batch, RUN).collect()}
    assert got["number"]["last_seen"] == RUN and got["pointer"]["last_seen"] == SEEN


def test_collapse_canon(spark):
    rows = [
        ("a", "대솔", "t", "경력", "", "", "", SR + "1", "A", "2031-02-01", "2031-03-01", "open", "", ""),
        ("b", "한빛", "t", "경력", "", "", "", SR + "1&x=2", "A", "2031-01-01", "2031-04-01", "open", "", ""),
        ("c", "(주)한빛전자", "t", "경력", "", "", "", SR + "1", "B", "2031-03-01", "2031-03-01", "open", "원문 확인", "2031-03-02"),
        ("d", "한빛", "u", "경력", "", "", "", SR + "2", "A", "2031-01-01", "2031-04-01", "open", "", ""),
        ("e", "한빛", "v", "경력", "", "", "", SR + "1", "A", "2031-01-01", "2031-04-01", "closed", "", ""),
    ]
    state = conform_state(spark.createDataFrame(rows, STATE)).withColumn(
        "company_full", F.when(F.col("id") == "b", "한빛전자")).withColumn("mark", F.when(F.col("id") == "b", "관심"))
    got = {r["id"]: r for r in collapse_canon(state).collect()}
    assert {k: (v["status"], v["verify"]) for k, v in got.items()} == {
        "a": ("closed", "중복: c"), "b": ("closed", "중복: c"), "c": ("open", "원문 확인"), "d": ("open", None), "e": ("closed", None)}
    assert (got["c"]["first_seen"], got["c"]["last_seen"], got["c"]["mark"], got["c"]["company_full"]) == ("2031-01-01", "2031-04-01", "관심", "한빛전자")


def test_import_new(spark):
    state = _state(spark)
    schema = "id string, company string, title string, link string, size string, fit string, deadline string, reason string, track string, status string"
    rows = [("number", "x", "y", "", "", "", "", "", "", ""), ("n1", "(주)회사silent", "직무  silent", "", "", "", "", "", "", ""), ("n2", "다른", "z", SR + "7003", "", "", "", "", "", ""),
            ("n3", "솔빛정유(울산)", "방류수 분석", "", "", "", "", "", "", ""), ("n4", "회사vanished", "[급] 직무 vanished", "", "", "", "", "", "", ""),
            ("n5", "정유", "새 분석", "", "중견(코스닥)", "상", "2031-06-01", "r", "", ""), ("n6", "", "방류수 분석", "", "외국계 대기업", "하", "곧", "r", "신입", "closed")]
    got = to_import_rows(import_new(spark.createDataFrame(rows, schema), state)).collect()
    got = {r["id"]: r for r in got}
    assert set(got) == {"n5", "n6"}
    assert (got["n5"]["size_rank"], got["n5"]["rel_score"], got["n5"]["tier"], got["n5"]["status"], got["n5"]["track"]) == (4, 0.7, "추천", "open", "경력")
    assert (got["n6"]["size_rank"], got["n6"]["deadline"], got["n6"]["status"]) == (2, None, "closed")


def test_long_titles_that_differ_late(spark):
    """Titles and stored texts are compared and kept whole."""
    title = "가나다라마바사" * 20
    state = conform_state(_frame(spark, [_stored("old", company="긴제목상사", title=title + "하나")], STATE))
    schema = "id string, company string, title string, link string, size string, fit string, deadline string, reason string, track string, status string"
    rows = [("same", "긴제목상사", title + " 하나", "", "", "", "", "x" * 900, "", ""), ("other", "긴제목상사", title + "둘", "", "", "", "", "x" * 900, "", "")]
    got = to_import_rows(import_new(spark.createDataFrame(rows, schema), state)).collect()
    assert [(r["id"], len(r["snippet"])) for r in got] == [("other", 900)]


def test_batch_without_numbers_meets_no_null_key(spark):
    """Rows without a posting number are resolved by company and title, each on a key of its own."""
    state = conform_state(_frame(spark, [_stored("kept"), _stored("numbered", link=SR + "81")], STATE))
    rows = [_found(i, company=f"새회사{i % 40}", title=f"새 직무 {i % 40}", link="") for i in range(80)]
    found = resolve_ids(_frame(spark, rows, BATCH), state)
    assert found.count() == 40 and found.filter("batch_pos >= 40").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "none:" in plan


def test_lines_of_an_order_are_dealt_together(spark):
    """Dealt apart, the lines of a posting are folded only behind a shuffle of all of them."""
    from tidewell.catalog import postings

    lines = postings.landed(spark, "/root/testdata/sf0.01", "lineitem", ["l_orderkey"])
    places = lines.select("l_orderkey", F.spark_partition_id().alias("p")).distinct().groupBy("l_orderkey").count()
    assert lines.rdd.getNumPartitions() >= 8 and places.filter("count > 1").count() == 0
    plan = postings.line_batch(spark, "/root/testdata/sf0.01", "2031-07-15")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and "l_quantity" not in plan.split("Relation")[0]
