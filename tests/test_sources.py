"""Pages, feeds, registries and state files on invented inputs."""

import json

from pyspark.sql import functions as F

from tidewell.functions import orgs
from tidewell.operators import groups
from tidewell.operators.lookup import affiliate_group
from tidewell.sources import feeds, pages, registry, state

PAGES = [
    ("list", '<html><body><ul><li><a href="/1">환경안전 담당 채용</a><span>경력 3년</span></li><li><a href="/2">회계 담당</a></li>'
             '<li><a href="/1">환경안전 담당 채용</a><i>다시</i></li><li><a href=\'/3\'>안전 &amp; 보건</a></li></ul></body></html>'),
    ("cards", '<div class="list"><div class="item" onclick="go(1)"><strong>[한빛] 환경 경력</strong><p>경력 2~7년</p></div>'
              '<div class="item" onclick="go(2)"><strong>생산</strong><p>신입</p></div><section><p>환경 문구</p></section></div>'),
    ("script", "<body><script>document.write('<a href=x>환경 가짜 공고</a>')</script><!-- <a href=y>안전 주석</a> --></body>"),
    ("blocked", "<body>사람인지 확인 <a href=z>안전 확인 링크</a></body>"),
]


def test_page_candidates(spark):
    df = spark.createDataFrame(PAGES, "source string, html string")
    got = [tuple(r) for r in pages.page_candidates(df, "환경|안전").orderBy("source", "pos").select("source", "title", "href", "block").collect()]
    assert got == [
        ("blocked", "안전 확인 링크", "z", "안전 확인 링크"),
        ("cards", "[한빛] 환경 경력", "", "[한빛] 환경 경력 경력 2~7년"),
        ("list", "환경안전 담당 채용", "/1", "환경안전 담당 채용 경력 3년"),
        ("list", "안전 & 보건", "/3", "안전 & 보건"),
    ]
    stats = {r["source"]: r for r in pages.page_stats(df, "사람인지 확인").collect()}
    assert stats["blocked"]["error"] == "BLOCKED" and not stats["blocked"]["ok"] and stats["list"]["ok"] and stats["list"]["anchors"] == 4


def test_json_feed_with_roles_codes_and_open_flag(spark):
    payload = json.dumps({"data": [
        {"id": 7, "name": " <b>공채</b>&amp; ", "end": "20310601", "kind": "A", "jobs": [{"n": "환경 관리"}, {"n": "회계"}, {"n": "안전 관리"}], "areas": ["울산", "서울", None, "울산"]},
        {"id": 7, "name": "again", "end": "20310601", "kind": "A", "jobs": [], "areas": []},
        {"id": 8, "name": "지난 안전 공고", "end": "20310101", "kind": "B", "jobs": [], "areas": []},
        {"id": 9, "name": "안전 단독", "end": None, "kind": "Z", "jobs": [], "areas": None},
        {"id": 10, "name": "회계", "end": None, "kind": "A", "jobs": [{"n": "세무"}], "areas": []}]}, ensure_ascii=False)
    spec = feeds.FeedSpec(
        "f", "json", {"title": lambda r: feeds.strip_tags(r["name"]), "href": lambda r: F.concat(F.lit("https://x.example/"), r["id"].cast("string")),
                      "block": lambda r: F.concat_ws(" | ", feeds.translate(r["kind"], {"A": "신입", "B": "경력"}), feeds.ordered_unique(r["areas"]))},
        schema="data array<struct<id:bigint,name:string,end:string,kind:string,jobs:array<struct<n:string>>,areas:array<string>>>",
        items=lambda d: d["data"], key=lambda r: r["id"], is_open=lambda r, now: F.coalesce(r["end"] >= now, F.lit(True)),
        roles=lambda r: r["jobs"], role_name=lambda x: x["n"], role_net="환경|안전")
    raw = spark.createDataFrame([("s", payload), ("s", "not json")], "source string, payload string")
    got = sorted(tuple(r) for r in feeds.normalize_feed(raw, spec, F.lit("20310501")).select("rec_key", "title", "block").collect())
    assert got == [("7", "공채 & | 안전 관리", "신입 | 서울, 울산"), ("7", "공채 & | 환경 관리", "신입 | 서울, 울산"), ("9", "안전 단독", "Z")]


def test_script_feed_takes_the_block_with_the_key(spark):
    inner = json.dumps({"content": [{"no": 1, "title": "환경"}]}, ensure_ascii=False).replace('"', '\\"')
    html = f'<script>push([1,"{{\\"content\\":[]}}"])</script><script>push([1,"{inner}"])</script>'
    spec = feeds.FeedSpec("s", "script", {"title": lambda r: r["title"]}, schema="content array<struct<no:bigint,title:string>>",
                          pattern=r'push\(\[1,"((?:[^"\\]|\\.)*)"\]\)', items=lambda d: d["content"], escaped=True)
    got = feeds.normalize_feed(spark.createDataFrame([("s", html)], "source string, payload string"), spec).collect()
    assert [r["title"] for r in got] == ["환경"]


def test_cards_kinds_details_sweeps(spark):
    html = '<li><b class="co">한빛</b><a href="/d/5" class="t">안전 <i>담당</i></a><p class="date">5/1</p></li><li><a href="/d/5" class="t">again</a></li><li>none</li>'
    spec = feeds.cards_feed("c", r"<li>(.*?)</li>", r'href="(/d/\d+)"', r'class="t">(.*?)</a>', "https://x.example", r'class="co">(.*?)</b>', [r'class="date">(.*?)</p>'])
    got = feeds.normalize_feed(spark.createDataFrame([("s", html)], "source string, payload string"), spec).collect()
    assert [(r["title"], r["company"], r["href"], r["block"]) for r in got] == [("안전 담당", "한빛", "https://x.example/d/5", "5/1")]
    main = spark.createDataFrame([(1, "t", "b"), (2, "u", "")], "id int, title string, block string")
    kinds = feeds.attach_kinds(main, {"신입": main.filter("id = 1"), "경력": main}, "id")
    assert {r["id"]: r["kinds"] for r in kinds.collect()} == {1: "신입/경력", 2: "경력"}
    detailed = feeds.attach_details(main, spark.createDataFrame([(2, "본문")], "id int, detail string"), "id")
    assert {r["id"]: r["block"] for r in detailed.collect()} == {1: "b", 2: "본문"}
    a = spark.createDataFrame([("h", "t", "first", 5)], "href string, title string, block string, pos int")
    b = spark.createDataFrame([("h", "t", "second", 1), ("h", "u", "third", 2)], "href string, title string, block string, pos int")
    assert {r["title"]: r["block"] for r in feeds.keyword_union([a, b]).collect()} == {"t": "first", "u": "third"}
    warn = feeds.feed_counts(spark.createDataFrame([("x",), ("y",)], "source string"), spark.createDataFrame([("x", "t", "b")], "source string, title string, block string"))
    assert {r["source"]: (r["anchors"], r["error"]) for r in warn.collect()} == {"x": (1, None), "y": (0, "empty feed")}


def test_registry(spark):
    cell = lambda xs: "<tr>" + "".join(f"<td>{x}</td>" for x in xs) + "</tr>"
    rows = [["한빛", "에스케이한빛(주)"] + ["x"] * 4 + ["제조", "1,200"] + ["x"] * 10, ["한빛소재"] + ["x"] * 4 + ["소재", "-"] + ["x"] * 10, ["short"], ["대솔", "대솔"] + ["x"] * 16]
    landed = spark.createDataFrame([("202605", "<tbody>" + "".join(map(cell, rows)))], "ym string, html string")
    members = registry.affiliates(registry.table_rows(landed), ["ym"]).cache()
    assert [(r["group"], r["name"], r["employees"]) for r in members.orderBy("row").collect()] == [
        ("한빛", "에스케이한빛(주)", 1200), ("한빛", "한빛소재", None), ("대솔", "대솔", None)]
    ranks = spark.createDataFrame([("202605", cell(["1", "한빛", "홍", "2", "1,000", "N"]) + cell(["x"]))], "ym string, html string")
    ranked = registry.ranking(registry.table_rows(ranks), ["ym"])
    assert [(r["rank"], r["assets_100m_krw"]) for r in ranked.collect()] == [(1, 1000)]
    reg = registry.build_registry(ranked, members, spark.createDataFrame([("한빛",)], "`group` string"))
    assert {(r["designated"], r["listed_affiliates"]) for r in reg.collect()} == {(True, 2)}
    assert [r["group"] for r in registry.unranked_groups(ranked, members).collect()] == ["대솔"]
    counts = registry.registry_counts(ranked, members, spark.createDataFrame([("한빛",)], "`group` string")).first()
    assert tuple(counts) == (1, 1, 2)
    names = spark.createDataFrame([("SK 한빛",), ("한빛",)], "company string").withColumn("company_full", F.lit(None).cast("string"))
    found = affiliate_group(names, registry.alias_table(reg), ["company_full", "company"])
    assert {r["company"]: r["group"] for r in found.collect()} == {"SK 한빛": "한빛", "한빛": None}
    assert orgs  # imported for readers of this table


def test_files(spark, tmp_path):
    (tmp_path / "fb").mkdir()
    for i, rows in enumerate([[{"title": "a", "company": "c", "label": 0}, {"title": "", "label": 1}, {"title": "b", "label": 7}], [{"title": "a", "company": "c", "label": 1}]]):
        p = tmp_path / "fb" / f"fb{i}.json"
        p.write_text(json.dumps(rows))
        import os
        os.utime(p, (1_900_000_000 + i, 1_900_000_000 + i))
    (tmp_path / "fb" / "fb9.json").write_text("[{broken")
    fb = state.read_feedback(spark, str(tmp_path / "fb" / "*.json"))
    old = spark.createDataFrame([("z", None, 1)], state.LABEL_SCHEMA)
    assert sorted(tuple(r) for r in state.merge_feedback(old, fb).collect()) == [("a", "c", 1), ("z", "", 1)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "d1.json").write_text(json.dumps({"id": "x", "data": {"title": "t1"}}))
    (tmp_path / "docs" / "d2.json").write_text(json.dumps({"title": "t2"}))
    docs = state.read_documents(spark, str(tmp_path / "docs"), "title:string")
    assert sorted(tuple(r) for r in docs.collect()) == [("d2", "t2"), ("x", "t1")]
    (tmp_path / "base.json").write_text(json.dumps({"a": 1, "ml": {"k": 1, "r": 2}}))
    (tmp_path / "local.json").write_text(json.dumps({"b": 2, "ml": {"k": 5}}))
    assert state.load_settings(spark, str(tmp_path / "base.json"), str(tmp_path / "local.json")) == {"a": 1, "b": 2, "ml": {"k": 5, "r": 2}}
    (tmp_path / "src.json").write_text(json.dumps([{"name": "A x", "type": "api"}, {"name": "A y", "disabled": True}, {"name": "B"}]))
    assert [r["name"] for r in state.read_registry(spark, str(tmp_path / "src.json"), "A").collect()] == ["A x"]
    st = state.conform_state(spark.createDataFrame([("1", "open", "2031-01-01", 0), ("2", "closed", "2030-01-01", 5)], "id string, status string, last_seen string, employees int"))
    path = state.write_snapshot(st, str(tmp_path / "state"), "2031-01-01")
    back = state.read_state(spark, path, "2030-12-01").collect()
    assert [(r["id"], r["employees"]) for r in back] == [("1", None)]
    state.write_export(st, st, st, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "jobs")).count() == 2
    cache = spark.createDataFrame([("n", "2031-01-01", 1), ("m", "2031-01-01", 1)], "norm string, fetched string, v int")
    put = state.put_profiles(cache, spark.createDataFrame([("n", "2031-01-02", 2)], "norm string, fetched string, v int"))
    assert {r["norm"]: r["v"] for r in put.collect()} == {"n": 2, "m": 1}
    assert state.redact_cache(cache, "n").count() == 1


def test_chunked_scans_do_not_depend_on_the_chunk(spark):
    df = spark.createDataFrame([(k, i, (i if i % 7 == 0 else None)) for k in ("a", None) for i in range(50)], "k string, i int, v int")
    want = groups.forward_fill(df, ["k"], "i", "v", F.lit(0)).orderBy("k", "i").collect()
    for size in (1, 3, 10):
        assert groups.forward_fill(df, ["k"], "i", "v", F.floor(F.col("i") / size)).orderBy("k", "i").collect() == want
    for levels in (0, 1, 2, 3):
        assert groups.forward_fill(df, ["k"], "i", "v", F.col("i"), levels=levels, fan=3).orderBy("k", "i").collect() == want
        days = groups.forward_fill(df, ["k"], "i", "v", F.date_add(F.lit("2031-01-01").cast("date"), F.col("i")), "v", levels, 5)
        assert days.orderBy("k", "i").collect() == want
        seen = groups.running_count(df, ["k"], "i", F.col("v").isNotNull(), F.floor(F.col("i") / 2), "n", levels, 2)
        assert sorted((r["k"] or "", r["i"], r["n"]) for r in seen.collect()) == [(k, i, i // 7 + 1) for k in ("", "a") for i in range(50)]
    fails = df.filter("k = 'a'").withColumn("bad", (F.col("i") % 10) < 6)
    runs = groups.outage_runs(fails, "k", "i", F.col("bad"), F.floor(F.col("i") / 4))
    assert sorted(tuple(r)[1:] for r in runs.collect()) == [(s, s + 5, 6) for s in (0, 10, 20, 30, 40)]


def test_one_key_with_all_rows_is_scanned_in_small_windows(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"))
    out = groups.forward_fill(df, ["k"], "i", "v", F.floor(F.col("i") / 20), fan=10, levels=2)
    assert out.filter(~F.col("v").eqNullSafe(F.when(F.col("i") >= 5, F.floor((F.col("i") - 5) / 97) * 97 + 5))).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 4  # rows in chunks, chunks, chunks of chunks, and what is left: 10 rows of the key


def test_feeds_without_a_schema(spark):
    docs = [
        ("a", '{"d":{"list":[{"no":3,"t":" one  two ","deep":{"x":[1,2]},"nil":null},{"no":"x","t":7},{"t":""},null,4]}}'),
        ("a", '{"d":{"list":['), ("a", None), ("b", "  "), ("b", '{"d":{"list":{}}}'), ("b", '{"d":{"list":[]}}'), ("b", "[1]"), ("b", "broken"),
    ]
    raw = spark.createDataFrame(docs, "source string, payload string")
    spec = feeds.FeedSpec("v", "variant", {"title": feeds.variant_field("t")}, path="$.d.list", known=["t"],
                          extra={"no": feeds.variant_field("no", "bigint"), "x": feeds.variant_field("deep.x[1]", "int")})
    got = feeds.normalize_feed(raw, spec).orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["no"], r["x"], r["rest"]) for r in got] == [
        (0, "one two", 3, 2, {"no": "3", "deep": '{"x":[1,2]}', "nil": None}), (1, "7", None, None, {"no": "x"})]
    bad = feeds.feed_rejects(raw, spec)
    assert sorted((r["source"], -1 if r["pos"] is None else r["pos"], r["reason"], r["rejected"]) for r in bad.collect() if r["rejected"] is not None) == [
        ("a", -1, "broken", '{"d":{"list":['), ("a", 2, "no title", '{"t":""}'), ("a", 3, "no object", "null"), ("a", 4, "no object", "4"),
        ("b", -1, "broken", "broken"), ("b", -1, "empty", "  "), ("b", -1, "no records", "[1]"), ("b", -1, "no records", '{"d":{"list":{}}}')]
    counts = {(r["source"], r["reason"]): (r["n"], r["n_records"]) for r in feeds.reject_counts(bad).collect()}
    assert counts == {("a", "broken"): (1, 0), ("a", "empty"): (1, 0), ("a", "no title"): (1, 1), ("a", "no object"): (2, 2),
                      ("b", "broken"): (1, 0), ("b", "empty"): (1, 0), ("b", "no records"): (2, 0)}
    assert feeds.feed_rejects(raw.limit(0), spec).count() == 0
    assert "Exchange" not in feeds.feed_rejects(raw, spec)._jdf.queryExecution().executedPlan().toString()
