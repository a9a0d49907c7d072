"""Queries over pages, feeds and card texts (inventory A and J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, dates, experience, links, orgs, text, titles
from ..operators.groups import forward_fill
from ..operators.verify import duty_check, labelled_detail, linked_data_detail
from ..sources import feeds, pages, registry, state
from .postings import day, landed, table


def anchor_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3"""
    found = pages.page_candidates(landed(spark, sf, "pages"), "[aeiou]")
    return found.select("page_id", "title", "href")


def page_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A4, A5"""
    return pages.page_stats(landed(spark, sf, "pages"), "que|the").select(
        "page_id", F.col("text_len").cast("long").alias("text_len"), F.col("anchors").cast("long").alias("anchors"), "ok")


def html_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    """J10"""
    t = text.html_to_text("html")
    return landed(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.size(F.split(t, "\n")).cast("long").alias("n_lines"))


def static_pages(spark: SparkSession, sf: str) -> DataFrame:
    """J11"""
    return pages.static_pages(landed(spark, sf, "pages")).select("page_id", F.md5("html").alias("digest"))


CANON = [("org", r"example\.org/[a-z]{2}/(\d+)"), ("net", r"example\.net/[a-z]{2}/(\d+)"), ("com", r"example\.com/[a-z]{2}/(\d+)")]


def url_canonical_key(spark: SparkSession, sf: str) -> DataFrame:
    """H13, J24, C17"""
    return landed(spark, sf, "pages").select(
        "page_id", links.canon_key("url", CANON).alias("canon"), links.host_of("url").alias("host"),
        links.link_kind("url", ("example.net",), ("spam-farm.example.org", "cheap-pills.example.com"), r"example\.org/[a-z]{2}/(\d+)").alias("kind"),
        links.web_link("url").alias("link"))


def cards_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A7"""
    spec = feeds.cards_feed("nav", r"<li>(.*?)</li>", r'href="(/[^"]*)"', r">(.*?)</a>", "https://x.example")
    raw = landed(spark, sf, "pages").select("page_id", F.col("html").alias("payload"))
    return feeds.normalize_feed(raw, spec).select("page_id", "rec_key", "title", "href")


ITEM = "struct<no:bigint,name:string,roles:array<string>,start:string,end:string>"


def script_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A8, A9, A10, A13, A15"""
    x = landed(spark, sf, "lineitem")
    item = F.struct(
        F.col("l_partkey").alias("no"),
        F.concat(F.when(F.col("l_linenumber") > 4, F.concat(F.lit("[Sup "), F.col("l_suppkey").cast("string"), F.lit("] "))).otherwise(""), F.lit("part "), F.col("l_partkey").cast("string")).alias("name"),
        F.array(F.concat(F.lit("role "), F.col("l_returnflag")), F.concat(F.lit("status "), F.col("l_linestatus")), F.lit("other")).alias("roles"),
        F.date_format(day("l_shipdate"), "yyyyMMdd").alias("start"), F.date_format(F.date_add(day("l_shipdate"), 365), "yyyy.MM.dd").alias("end"))
    payload = F.concat(F.lit('<html><script>window.x={"other":[]};</script><script>window.x='),
                       F.to_json(F.struct(F.array(item).alias("items"))), F.lit(";</script></html>"))
    raw = x.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", payload.alias("payload"))
    spec = feeds.FeedSpec(
        "script", "script",
        {"title": lambda r: r["name"], "href": lambda r: F.concat(F.lit("https://x.example/"), r["no"].cast("string")),
         "company": lambda r: orgs.poster_name(r["name"], F.lit("Feed Co")),
         "block": lambda r: feeds.ordered_unique(r["roles"], " / ")},
        schema=f"items array<{ITEM}>", pattern=r"window\.x=(\{.*?\});</script>", items=lambda d: d["items"],
        is_open=lambda r, now: dates.open_now(dates.compact_date(r["start"]), dates.compact_date(r["end"]), now),
        roles=lambda r: r["roles"], role_name=lambda x: x, role_net="role [AR]|status O")
    return feeds.normalize_feed(raw, spec, F.lit("2029-01-01").cast("date")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "title", "href", "company", "block")


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A6, A9"""
    spec = feeds.FeedSpec("props", "json", {"title": lambda r: F.concat(F.lit("k "), r["k"].cast("string")), "block": lambda r: F.lit("")},
                          schema="k bigint", items=lambda d: F.array(d), extra={"k": lambda r: r["k"]})
    raw = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("props").alias("payload"))
    out = feeds.net_filter(feeds.normalize_feed(raw, spec), "k [1-8]")
    return out.groupBy("source", "k").agg(F.count(F.lit(1)).alias("n"))


def _variant_payloads(spark: SparkSession, sf: str) -> tuple[DataFrame, feeds.FeedSpec]:
    """Payloads without a schema: two kinds of records in one list, some of them no objects, some documents cut off."""
    x = landed(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    part = F.concat(F.lit('{"no":'), text("l_partkey"), F.lit(',"name":" part  '), text("l_partkey"), F.lit('","mode":"'), F.col("l_returnflag"), F.lit('","line":{"n":'), text("l_linenumber"), F.lit("}}"))
    supplier = F.concat(F.lit(',{"name":'), F.when(F.col("l_linenumber") > 4, F.lit("null")).otherwise(F.concat(F.lit('"sup '), text("l_suppkey"), F.lit('"'))), F.lit(',"no":"S'), text("l_suppkey"), F.lit('"}'))
    whole = F.concat(F.lit('{"v":2,"data":{"list":['), part, supplier, F.when(F.col("l_linestatus") == "O", ",5").otherwise(""), F.lit("]}}"))
    late = F.col("l_linenumber")
    payload = F.when((late == 2) & (F.col("l_returnflag") == "A"), F.substring(whole, 1, 40)).when((late == 3) & (F.col("l_returnflag") == "R"), '{"data":[]}').when(late < 6, whole)
    spec = feeds.FeedSpec("variant", "variant", {"title": feeds.variant_field("name"), "href": lambda r: F.concat(F.lit("https://x.example/"), feeds.variant_field("no")(r))},
                          path="$.data.list", known=["no", "name"], extra={"number": feeds.variant_field("no", "bigint")})
    return x.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("source"), payload.alias("payload")), spec


def variant_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Records read without a schema, unknown keys kept"""
    raw, spec = _variant_payloads(spark, sf)
    rest = F.array_join(F.array_sort(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return feeds.normalize_feed(raw, spec).select("l_orderkey", "l_linenumber", "pos", "title", "href", "number", rest.alias("rest"))


def variant_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Broken documents and unusable records counted"""
    raw, spec = _variant_payloads(spark, sf)
    return feeds.reject_counts(feeds.feed_rejects(raw, spec))


def variant_props(spark: SparkSession, sf: str) -> DataFrame:
    """One record a document, every key of it kept"""
    raw = table(spark, sf, "events").select("event_id", F.col("props").alias("payload"))
    doc = F.try_parse_json(F.col("payload"))
    return raw.select("event_id", feeds.variant_field("k", "bigint")(doc).alias("k"), F.to_json(F.try_variant_get(doc, "$", "map<string,string>")).alias("rest"))


def feed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A6"""
    d = landed(spark, sf, "documents")
    rows = d.filter(F.col("text").rlike("tionier")).select("source", F.col("lang").alias("title"), F.col("text").alias("block"))
    return feeds.feed_counts(d, rows).select("source", "anchors", "text_len", "error")


def kinds_join(spark: SparkSession, sf: str) -> DataFrame:
    """A12, G7"""
    o = table(spark, sf, "orders")
    tagged = {s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey")) for s in ("P", "F", "O")}
    return feeds.attach_kinds(table(spark, sf, "customer").select("c_custkey"), tagged, "c_custkey")


def code_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A14"""
    label = feeds.translate(F.col("o_orderstatus"), {"F": "마감", "O": "진행"})
    return table(spark, sf, "orders").select("o_orderkey", label.alias("label"))


def ordered_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A11, E12, G4, J21"""
    words = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lit("ring")))
    return table(spark, sf, "part").select(
        "p_partkey", feeds.ordered_unique(words).alias("unique_words"), feeds.stable_first(words, "^r").alias("r_first"),
        text.join_present("p_name", F.when(F.col("p_size") > 25, F.lit(" ")).otherwise(F.lit("small  size")), "p_type").alias("joined"))


def detail_join(spark: SparkSession, sf: str) -> DataFrame:
    """A16"""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("block"))
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("detail"))
    return feeds.attach_details(o, c, "c_custkey").select("o_orderkey", "block")


def keyword_union(spark: SparkSession, sf: str) -> DataFrame:
    """A17"""
    d = landed(spark, sf, "documents").select("doc_id", F.md5("text").alias("href"), F.col("lang").alias("title"), "text")
    parts = [d.filter(F.contains("text", F.lit(k))).select("href", "title", F.lit(k).alias("keyword"), F.col("doc_id").alias("pos")) for k in ("tion", "que", "ing", "der")]
    return feeds.keyword_union(parts).select("href", "title", "keyword", F.col("pos").alias("doc_id"))


def registry_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A18, F5"""
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("value")))
    return forward_fill(e, ["user_id"], "event_id", "v", F.floor(F.col("event_id") / 1000)).select("event_id", "user_id", "v")


def registry_table(spark: SparkSession, sf: str) -> DataFrame:
    """Registry tables landed as HTML, one page per nation row block"""
    s = table(spark, sf, "supplier")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    money = F.format_number(F.floor(F.abs("s_acctbal")) * 10, 0)
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("N "), F.col("s_nationkey").cast("string"))), cell(F.col("s_name")),
                   *[cell(F.lit(str(i))) for i in range(4)], cell(F.lit("ind")), cell(money), *[cell(F.lit("x")) for _ in range(10)], F.lit("</tr>"))
    second = F.concat(F.lit("<tr>"), cell(F.concat(F.col("s_name"), F.lit(" B"))), *[cell(F.lit(str(i))) for i in range(4)], cell(F.lit("ind")),
                      cell(F.lit("-")), *[cell(F.lit("x")) for _ in range(10)], F.lit("</tr>"))
    landed = s.select("s_suppkey", F.concat(F.lit("<table><tbody>"), row, second, F.lit("</tbody></table>")).alias("html"))
    return registry.affiliates(registry.table_rows(landed), ["s_suppkey"]).select("s_suppkey", F.col("row").cast("long").alias("row"), "group", "name", "industry",
                                                                                 F.col("employees").cast("long").alias("employees"))


def latest_period(spark: SparkSession, sf: str) -> DataFrame:
    """A19"""
    o = table(spark, sf, "orders").withColumn("ym", F.date_format(day("o_orderdate"), "yyyyMM"))
    return registry.latest_period(o, "ym").select("o_orderkey", "ym")


def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A1"""
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 3000, F.lit(True)).when(F.col("s_acctbal") > 8000, F.lit(False)).alias("disabled"))
    return state.active_sources(rows, "1").select("name")


def group_registry(spark: SparkSession, sf: str) -> DataFrame:
    """D13, J19, B6, E9"""
    n, s, c = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    ranked = n.select("n_nationkey", F.col("n_name").alias("group"), F.col("n_nationkey").alias("rank"))
    members = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("group"), F.col("s_name").alias("name"), F.lit("i").alias("industry"), F.lit(1).alias("employees"))
    rich = c.filter("c_acctbal > 9900").join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("group"))
    out = registry.build_registry(ranked, members, rich)
    return out.select("group", "designated", "listed_affiliates", "name", "norm")


def unranked_groups(spark: SparkSession, sf: str) -> DataFrame:
    """D14"""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    members = o.select(F.col("o_custkey").cast("string").alias("group"))
    return registry.unranked_groups(c.filter("c_acctbal < 2000").select(F.col("c_custkey").cast("string").alias("group")), members)


def deadline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The due date written in five ways, read back"""
    d, run = F.date_add(day("o_orderdate"), 20), day("o_orderdate")
    p = F.col("o_orderpriority")
    written = (
        F.when(p == "1-URGENT", F.concat(F.lit("접수 "), F.date_format(run, "yyyy.MM.dd"), F.lit(" 09:00 ~ "), F.date_format(d, "yyyy.MM.dd"), F.lit(" 18:00")))
        .when(p == "2-HIGH", F.concat(F.lit("~ "), F.date_format(d, "M/d"), F.lit(" 접수")))
        .when(p == "3-MEDIUM", F.concat(F.date_format(d, "yyyy년 M월 d일"), F.lit("(월) 마감")))
        .when(p == "4-NOT SPECIFIED", F.when(F.col("o_orderstatus") == "O", F.lit("상시 채용")).when(F.col("o_orderstatus") == "F", F.lit("오늘마감")).otherwise("경력 3년"))
        .otherwise("경력 2~7년 D-20"))
    found = dates.parse_deadline(written, run)
    return landed(spark, sf, "orders").select("o_orderkey", found.alias("f")).select(
        "o_orderkey", F.col("f.kind").alias("kind"), F.date_format("f.date", "yyyy-MM-dd").alias("deadline"))


def posted_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """J4"""
    run, p, n = day("o_orderdate"), F.col("o_orderpriority"), F.pmod("o_orderkey", F.lit(90)).cast("int")
    d = F.date_sub(run, n)
    written = (
        F.when(p == "1-URGENT", F.concat(F.date_format(d, "yyyy.MM.dd"), F.lit("(월) ~ 채용시")))
        .when(p == "2-HIGH", F.concat(n.cast("string"), F.lit("일 전 등록")))
        .when(p == "3-MEDIUM", F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 게시")))
        .when(p == "4-NOT SPECIFIED", F.lit("3시간 전")).otherwise("경력"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dates.parse_posted(written, run), "yyyy-MM-dd").alias("posted"))


def experience_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """J5, J6, C9"""
    n, t = F.col("p_size").cast("string"), F.col("p_type")
    written = (
        F.when(t == "ECONOMY", F.concat(F.lit("경력 "), n, F.lit("~99년")))
        .when(t == "STANDARD", F.concat(F.lit("경력 "), n, F.lit("년↑ 우대"))).when(t == "PROMO", F.concat(n, F.lit("년 이상")))
        .when(t == "SMALL", F.lit("신입/경력")).when(t == "MEDIUM", F.lit("신입 공채")).otherwise("경력사원"))
    page = F.concat(F.lit("모집 경력 채용 경력 경력 "), n, F.lit("년 ↑ 학력 대졸"))
    e = experience.parse_exp(written)
    return table(spark, sf, "part").select("p_partkey", e.alias("e"), experience.official_exp(page).alias("official"), experience.years_cap(written, 7).alias("within_cap")).select(
        "p_partkey", F.col("e.label").alias("label"), F.col("e.min_years").alias("min_years"), F.col("e.new_grad_only").alias("new_grad_only"), "official", "within_cap")


def year_guess(spark: SparkSession, sf: str) -> DataFrame:
    """J2"""
    run = day("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.guess_year(F.pmod("o_orderkey", F.lit(12)).cast("int") + 1, run).alias("year"))


def compact_dates(spark: SparkSession, sf: str) -> DataFrame:
    """J20"""
    e = table(spark, sf, "events")
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return e.select("event_id", F.date_format(dates.compact_date(F.date_format("ts", "yyyy.MM.dd HH:mm")), "yyyy-MM-dd").alias("d"),
                    F.date_format(dates.compact_timestamp(F.date_format("ts", "yyyyMMddHHmm")), "yyyy-MM-dd HH:mm").alias("t"),
                    F.date_format(dates.utc_to_local(utc), "yyyy-MM-dd HH:mm").alias("kst"))


def org_names(spark: SparkSession, sf: str) -> DataFrame:
    """I1, I2, J9"""
    seg = F.col("c_mktsegment")
    name = F.regexp_replace("c_name", "#0*", " ")
    written = (F.when(seg == "BUILDING", F.concat(F.lit("(주)"), name)).when(seg == "MACHINERY", F.concat(name, F.lit("그룹")))
               .when(seg == "FURNITURE", F.concat(F.lit("엘에스"), name, F.lit("(LS-"), F.col("c_custkey").cast("string"), F.lit(")")))
               .when(seg == "HOUSEHOLD", F.concat(name, F.lit(" ELECTRIC"))).otherwise(F.concat(name, F.lit(" → client"))))
    v = orgs.org_variants(written)
    return table(spark, sf, "customer").select(
        "c_custkey", orgs.normalize_org(written, "posting").alias("posting"), orgs.normalize_org(written, "registry").alias("registry"),
        orgs.org_fold(written).alias("folded"), F.array_join(v, "|").alias("variants"))


def title_features(spark: SparkSession, sf: str) -> DataFrame:
    """I4, I6, I7, I12, I13, I14, J8, J9"""
    title = F.concat(F.lit("[급구] "), F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" | manager "), F.lower("p_type"), F.lit(" 채용 ("), F.col("p_size").cast("string"), F.lit("월)"))
    staged = landed(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("company"), title.alias("title"))
    return staged.select(
        "p_partkey", titles.title_core("title", "company").alias("core"), F.array_join(titles.title_tokens("title", "company"), " ").alias("tokens"),
        F.array_join(titles.title_fields("title"), " ").alias("fields"), F.array_join(titles.base_tokens("title", "company"), " ").alias("base"),
        titles.hiring_name("title", "company").alias("hiring"), titles.bare_title("title").alias("bare"), text.normalize_title("title").alias("shown"),
        text.title_key("title").alias("key"))


def size_words(spark: SparkSession, sf: str) -> DataFrame:
    """J16, J17, J25"""
    seg, emp = F.col("c_mktsegment"), F.floor(F.col("c_acctbal")).cast("int")
    words = (F.when(seg == "BUILDING", "중견(코스닥)").when(seg == "MACHINERY", "외국계 대기업").when(seg == "FURNITURE", "공기업")
             .when(seg == "HOUSEHOLD", "대기업").otherwise("기타"))
    form = F.when(seg == "BUILDING", "중견기업, 코스닥").when(seg == "MACHINERY", "대기업, 외국 법인기업").when(seg == "HOUSEHOLD", "중소기업").otherwise("1000대기업")
    rank = bands.rank_from_size_words(words)
    fixed_rank = bands.form_rank(rank, form)
    return table(spark, sf, "customer").select(
        "c_custkey", rank.alias("word_rank"), fixed_rank.alias("form_rank"), bands.is_form_large(form, emp).alias("form_large"),
        bands.repaired_size(fixed_rank, words, form, emp).alias("size"))


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """J12"""
    o = landed(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit('<meta property="og:description" content="Company '), F.col("o_custkey").cast("string"), F.lit(', Order &amp; '), key, F.lit('"><a href="/company-info/view?csn=C'), key,
        F.lit('"></a><p>경력 경력 '), F.pmod("o_orderkey", F.lit(9)).cast("string"), F.lit("년 ↑ 학력 대졸</p><p>근무형태 "),
        F.when(F.col("o_orderstatus") == "F", "계약직").otherwise("정규직"), F.lit(" 급여 협의</p><p>근무지역 Zone "), F.col("o_orderstatus"),
        F.lit(" 지도</p><p>시작일 "), F.date_format(day("o_orderdate"), "yyyy.MM.dd HH:mm"), F.lit(" 마감일 "),
        F.when(F.col("o_totalprice") > 300000, F.lit("상시채용")).otherwise(F.concat(F.date_format(F.date_add(day("o_orderdate"), 30), "yyyy.MM.dd"), F.lit(" 18:00"))), F.lit("</p>"))
    return labelled_detail(o.select("o_orderkey", html.alias("html"))).select(
        "o_orderkey", "csn", "company_full", "title_full", "start", "deadline", "deadline_time", "exp", "edu", "emp_type", "location", "closed")


def linked_data(spark: SparkSession, sf: str) -> DataFrame:
    """J13"""
    o = landed(spark, sf, "orders")
    months = F.pmod("o_orderkey", F.lit(100)).cast("int")
    posting = F.struct(
        F.lit("JobPosting").alias("@type"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.struct(F.concat(F.lit("Company "), F.col("o_custkey").cast("string")).alias("name")).alias("hiringOrganization"),
        F.date_format(day("o_orderdate"), "yyyy-MM-dd'T'HH:mm").alias("datePosted"), F.date_format(F.date_add(day("o_orderdate"), 30), "yyyy-MM-dd'T'23:59").alias("validThrough"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("FULL_TIME"), F.lit("INTERN"))).otherwise(F.array(F.lit("CONTRACTOR"))).alias("employmentType"),
        F.struct(months.alias("monthsOfExperience")).alias("experienceRequirements"),
        F.struct(F.struct(F.col("o_orderpriority").alias("addressRegion"), F.col("o_orderstatus").alias("addressLocality")).alias("address")).alias("jobLocation"))
    ld = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    graph = F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), F.to_json(posting), F.lit("]}"))
    html = F.concat(ld(F.lit('{"@type":"WebSite"}')), F.when(F.col("o_orderstatus") == "O", ld(graph)).otherwise(ld(F.to_json(posting))))
    return linked_data_detail(o.select("o_orderkey", html.alias("html")), "2028-01-01").select(
        "o_orderkey", "title_full", "company_full", "start", "deadline", "deadline_time", "exp", "emp_type", "location", "closed")


def duty_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict over whole texts"""
    d = landed(spark, sf, "documents")
    body = F.when(F.col("lang") == "de", F.concat("text", F.lit("\n담당업무 (마감)위험물 "))).when(F.col("lang") == "es", F.concat("text", F.lit("\n아파트 건설현장 안전관리"))).otherwise(F.col("text"))
    rows = d.select("doc_id", F.when(F.col("lang") == "fr", "안전 관리자").otherwise("title").alias("title"), body.alias("body"))
    return duty_check(rows).select("doc_id", "duty", "duty_flag")


QUERIES = {f.__name__: f for f in (
    anchor_candidates, page_stats, html_text_stats, static_pages, url_canonical_key, cards_feed, script_feed, json_props, variant_feed, variant_rejects, variant_props, feed_counts, kinds_join,
    code_labels, ordered_lists, detail_join, keyword_union, registry_fill, registry_table, latest_period, source_registry, group_registry,
    unranked_groups, deadline_roundtrip, posted_roundtrip, experience_roundtrip, year_guess, compact_dates, org_names, title_features,
    size_words, detail_pages, linked_data, duty_evidence)}
