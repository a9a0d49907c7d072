"""Queries over rules, lookups, merge, duplicates, metrics, model and streams (inventory B-I, K, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands, orgs
from ..functions.links import job_id
from ..operators import dedup, groups, health, lookup, merge, rules as R, score, verify, view
from ..operators.judge import join_sources, judge
from ..plans.report import health_gate
from ..session import scratch_path
from ..sources import feeds, snapshots, state
from ..streaming import lifecycle, periods
from .postings import (
    RULES, RUN_DATE, customer_registry, day, landed, line_batch, order_candidates, order_sources, order_state, part_postings, table,
)

MERGE_DAY = "2031-07-15"


# C, D: judging ---------------------------------------------------------------

def _judged(spark: SparkSession, sf: str, parse_dropped: bool = False) -> DataFrame:
    return judge(join_sources(order_candidates(spark, sf), order_sources(spark, sf)), RULES, F.lit(RUN_DATE).cast("date"),
                 customer_registry(spark, sf), parse_dropped)


def judged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict of every candidate"""
    return _judged(spark, sf, True).select("o_orderkey", "company", "title", "track", "exp", "posted", "deadline", "size_rank", "affiliate_of",
                                     F.array_join("sec", ",").alias("sec"), "drop_reason")


def drop_reasons_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """C7, E1, E3"""
    return health.drop_histogram(_judged(spark, sf))


def source_health(spark: SparkSession, sf: str) -> DataFrame:
    """E2"""
    o = table(spark, sf, "orders")
    fetches = o.groupBy(F.col("o_orderpriority").alias("source")).agg((F.count_if(F.col("o_orderstatus") == "F") % 2 == 0).alias("ok"), (F.count(F.lit(1)) % 600).alias("text_len"))
    return health.source_health(_judged(spark, sf), fetches).select("source", "ok", "found", "kept", "suspicious")


def _doc_health(spark: SparkSession, sf: str) -> DataFrame:
    d = landed(spark, sf, "documents")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("found"), (F.count_if(F.contains("text", F.lit("tion"))) % 3 == 0).alias("ok"), F.min("n_chars").alias("text_len"),
    ).select("source", "found", "ok", (F.col("ok") & (F.col("text_len") < 20)).alias("suspicious"), F.when(F.col("source") < "src15", "api").otherwise("company").alias("type"),
             F.concat(F.lit("https://h.example/"), "source").alias("url"), F.when(~F.col("ok"), F.concat(F.lit("TIMEOUT "), "source")).alias("error"))


LIMITS = health.HealthLimits(overall=0.9, host="h.example", host_min=10, host_share=0.9, api_min=4, api_share=0.9, key_source="src7", key_found=10_000_000)


def health_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """E4, E5"""
    return health_gate(_doc_health(spark, sf), LIMITS)[0]


def failure_list(spark: SparkSession, sf: str) -> DataFrame:
    """E6"""
    return health_gate(_doc_health(spark, sf), LIMITS)[1]


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """E4"""
    return health.run_totals(_doc_health(spark, sf))


DOC_RULES = R.RuleSet(
    rule_include="tion|ung", rule_exclude="quest|schwer",
    profiles=(R.Profile("a", base_rule=True, include="ment|ing", exclude="zzz"),
              R.Profile("b", include="re", exclude="que|der ", rescue_from="que", rescue_if="TION"),
              R.Profile("c", include="th", construction="ion", construction_max_rank=2, construction_site="eaux")))


def include_exclude_sections(spark: SparkSession, sf: str) -> DataFrame:
    """C2, C3, C4"""
    d = landed(spark, sf, "documents")
    rank = F.when(F.col("source") < "src15", 1).otherwise(4)
    return d.select("doc_id", F.array_join(R.sections(DOC_RULES, "text", "source", rank), ",").alias("sec"), R.sections_loose(DOC_RULES, "text", "source").alias("loose"))


def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    """E7"""
    d = landed(spark, sf, "documents").select(F.when(F.col("lang") != "es", "open").otherwise("closed").alias("status"), R.sections(DOC_RULES, "text", "source").alias("sec"))
    return view.section_counts(d)


def rule_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """E10"""
    d = landed(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return R.confusion(d, F.col("quality") == 1, R.include_exclude("text", "source", "tion|ung|ment", "quest"))


def feed_recall(spark: SparkSession, sf: str) -> DataFrame:
    """E11"""
    j = _judged(spark, sf)
    return health.feed_recall(j, F.col("title").rlike("환경|안전"))


def longest_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Longest benchmark word inside each whole document"""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("name")).distinct()
    d = landed(spark, sf, "documents").select("doc_id", "text")
    return lookup.longest_mentions(d, "doc_id", "text", words, "name", gram=8).select("doc_id", "name")


def listed_names(spark: SparkSession, sf: str) -> DataFrame:
    """A short list as one pattern"""
    from ..functions.text import has_any_name, longest_name
    names = ["gear", "old gear", "Ring", "hot r", "anvil 9", "PLATE"]
    t = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lower("p_type"))
    return table(spark, sf, "part").select("p_partkey", longest_name(names, t).alias("name"), has_any_name(names, t).alias("any_name"))


INITIALS = [("NATION", "NT"), ("_", "-")]


def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """D3, J19"""
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("group"), F.col("n_nationkey").alias("rank"))
    from ..sources.registry import alias_table
    reg = n.withColumn("norm", orgs.normalize_org("name", "registry")).withColumn("aliases", orgs.registry_aliases("norm", INITIALS))
    seg, key = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    written = (F.when(seg == "BUILDING", F.concat(F.lit("(주) Nation_"), key)).when(seg == "MACHINERY", F.concat(F.lit("NT_"), key))
               .when(seg == "FURNITURE", F.concat(F.lit("NT-"), key)).when(seg == "HOUSEHOLD", F.concat(F.lit("nation"), key)).otherwise(F.col("c_name")))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("company"), written.alias("company_full"))
    return lookup.affiliate_group(c, alias_table(reg), ["company_full", "company"]).select("c_custkey", "group")


def tier_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """J18, J17, D15"""
    seg, bal = F.col("c_mktsegment"), F.floor(F.col("c_acctbal")).cast("int")
    company = F.when(seg == "MACHINERY", F.concat(F.lit("HR 서치 "), F.col("c_name"))).when(seg == "BUILDING", F.concat(F.col("c_name"), F.lit("공사"))).otherwise(F.col("c_name"))
    title = F.when(F.col("c_acctbal") > 5000, "대기업 EHS").when(F.col("c_acctbal") > 2000, "중견 상장").otherwise("EHS")
    group = F.when((seg == "HOUSEHOLD") & (F.col("c_nationkey") < 5), F.col("c_nationkey").cast("string"))
    emp = F.when(bal > 6000, bal / 5).when(bal > 0, bal / 20).cast("int")
    found = bands.company_tier(company, title, group, F.lit(4), F.lit("중견"), emp, F.when(bal > 3000, bal), F.when(F.col("c_nationkey") == 7, "1000대기업, 코스피"),
                               F.contains("c_name", F.lit("11")))
    return table(spark, sf, "customer").select("c_custkey", found.alias("t")).select("c_custkey", F.col("t.tier").alias("tier"), F.col("t.group").alias("group"))


def compare_bands(spark: SparkSession, sf: str) -> DataFrame:
    """J15, C18"""
    s = table(spark, sf, "supplier")
    base = s.groupBy("s_nationkey").agg(F.floor(F.avg("s_acctbal")).cast("int").alias("base"))
    j = s.join(base, "s_nationkey")
    bal = F.floor(F.col("s_acctbal")).cast("int")
    form = F.when(F.col("s_nationkey") < 8, "대기업").otherwise("중견기업")
    return j.select("s_suppkey", bands.compare_salary(bal, F.col("base")).alias("salary"),
                    bands.compare_size(bal, form, F.col("base"), F.when(F.col("s_suppkey") > 50, "대기업").otherwise("중견기업")).alias("size"),
                    bands.fit_band(F.col("s_acctbal") / 10000).alias("fit"))


def fresh_profile_join(spark: SparkSession, sf: str) -> DataFrame:
    """D8, F2, B9"""
    log = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), F.col("ts").alias("fetched"), "value", "event_type")
    c = table(spark, sf, "customer").select("c_custkey")
    out = lookup.fresh_profile(c, log, ["c_custkey"], F.lit("2024-01-31").cast("date"), "fetched", 1)
    return out.select("c_custkey", "fresh", "value", "event_type")


def best_company(spark: SparkSession, sf: str) -> DataFrame:
    """D9"""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("q"), F.col("n_name").alias("name"))
    bal = F.col("c_acctbal")
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("pos"),
        F.when(bal > 9700, F.concat(F.lit("(주)nation_"), F.col("c_nationkey").cast("string"))).when(bal > 8000, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit(" Holdings")))
        .otherwise(F.col("c_name")).alias("listed"))
    return lookup.best_company(n, c, "q", "name", "listed", "pos").select("q", "pos", "score")


def fuzzy_link(spark: SparkSession, sf: str) -> DataFrame:
    """D11, J22"""
    p = table(spark, sf, "part")
    month = F.concat(F.pmod("p_size", F.lit(12)).cast("string"), F.lit("월"))
    left = p.filter("p_size <= 25").select("p_partkey", "p_brand", F.concat("p_name", F.lit(" "), month).alias("t1"))
    right = p.filter("p_size > 25").select(F.col("p_partkey").alias("other"), "p_brand", F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("s "), month)).otherwise(F.concat("p_name", F.lit("s"))).alias("t2"))
    out = lookup.link_records(left, right, ["p_brand"], "t1", "t2", "p_partkey", "other", 0.7)
    return out.select("p_partkey", "other_match", F.round("score", 4).alias("score"))


def evidence_link(spark: SparkSession, sf: str) -> DataFrame:
    """D10, J22, J9 (detail): company agreement as a term of the score; strict: partners of agreeing companies only, loose: of others too"""
    p = table(spark, sf, "part")
    month = F.concat(F.pmod("p_size", F.lit(12)).cast("string"), F.lit("월"))
    left = p.filter("p_size <= 25").select("p_partkey", F.concat("p_name", F.lit(" "), month).alias("t1"), F.when(F.pmod("p_partkey", F.lit(7)) > 0, F.concat(F.lit("(주) "), "p_brand")).alias("c1"))
    late = F.col("p_size") > 40
    right = p.filter("p_size > 25").select(F.col("p_partkey").alias("other"), F.when(late, F.concat("p_name", F.lit("s "), month)).otherwise(F.concat("p_name", F.lit("s"))).alias("t2"),
                                           F.when(late, F.concat("p_brand", F.lit(" Works Co., Ltd."))).otherwise(F.substring("p_brand", 1, 7)).alias("c2"))
    out = [lookup.link_by_evidence(left, right, "t1", "t2", "c1", "c2", "other", accept, 0.35, malus).select(
        F.lit(kind).alias("kind"), "p_partkey", "other_match", F.round("score", 4).alias("score")) for kind, accept, malus in (("strict", 0.95, -0.5), ("loose", 0.9, 0.0))]
    return out[0].unionByName(out[1])


def import_anti(spark: SparkSession, sf: str) -> DataFrame:
    """D12"""
    p = table(spark, sf, "part")
    url = lambda n: F.concat(F.lit("https://www.saramin.co.kr/v?rec_idx="), n.cast("string"))
    known = p.filter("p_size > 35").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("company"),
                                           F.concat("p_name", F.lit(" "), F.col("p_type")).alias("title"), url(F.col("p_partkey") + 7).alias("link"))
    dump = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("company"),
                    F.concat("p_name", F.lit(" "), F.col("p_type")).alias("title"), url(F.col("p_partkey")).alias("link"))
    return lookup.import_new(dump, known).select("id", "company", "title")


def designated_flag(spark: SparkSession, sf: str) -> DataFrame:
    """D4, D13"""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return lookup.semi_flag(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "has_orders")


# E, F, G: aggregates and picks --------------------------------------------------

def total_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """E9"""
    o = table(spark, sf, "orders").withColumn("declared", F.pmod("o_orderkey", F.lit(7)))
    return feeds.reconcile(o, table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "declared")


def count_and_sum(spark: SparkSession, sf: str) -> DataFrame:
    """E13"""
    return health.count_and_sum(table(spark, sf, "lineitem"), F.col("l_linestatus") == "O")


def first_batch_wins(spark: SparkSession, sf: str) -> DataFrame:
    """F1"""
    return groups.first_by(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def feedback_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A20, F2, H15, B7"""
    e = table(spark, sf, "events")
    fb = e.select(F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("company"), (F.col("value") > 40).cast("int").alias("label"),
                  F.col("ts").cast("timestamp").alias("file_ts"), F.lit("f").alias("file_name"), F.col("event_id").alias("_row"))
    current = table(spark, sf, "customer").select(F.lit("view").alias("title"), F.col("c_custkey").cast("string").alias("company"), F.lit(1).alias("label"))
    return state.merge_feedback(current, fb)


def survivorship(spark: SparkSession, sf: str) -> DataFrame:
    """E14, F3, F4"""
    e = table(spark, sf, "events").withColumn("note", F.when(F.col("event_type") == "click", F.col("props"))).withColumn(
        "first_id", F.col("event_id")).withColumn("last_id", F.col("event_id"))
    out = groups.survivors(e.select("user_id", "event_id", "value", "note", "first_id", "last_id"), "user_id", F.struct(-F.col("value"), F.col("event_id")),
                           ["note"], ["first_id"], ["last_id"])
    return out.select("user_id", "event_id", "value", "note", "first_id", "last_id", "n_merged")


def budget_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The check budget is the feature"""
    st = order_state(spark, sf).withColumn("verify_tried_at", F.when(F.col("status") == "open", F.col("last_seen")))
    jobs = st.select("id", "link", "first_seen")
    return verify.eligible_for_check(jobs, st, "2031-07-30", RULES, [F.col("first_seen").desc(), F.col("id")]).select("id", "first_seen")


def budget_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """F6"""
    o = table(spark, sf, "orders")
    return groups.budget(o, F.col("o_orderstatus") != "P", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, ["o_custkey"]).select("o_custkey", "o_orderkey")


def outage_runs(spark: SparkSession, sf: str) -> DataFrame:
    """F8"""
    e = table(spark, sf, "events")
    return groups.outage_runs(e, "user_id", "event_id", F.col("event_type").isin("error", "signup"), F.floor(F.col("event_id") / 1000))


def view_order_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The top-k report is the feature"""
    return health.preview(order_state(spark, sf).filter("status = 'open'"), view.view_order(), 50).select("id", "size_rank", "tier", "track", "deadline")


def tab_counts(spark: SparkSession, sf: str) -> DataFrame:
    """C19, E16"""
    st = order_state(spark, sf).withColumn("mark", F.when(F.col("rel_score") > 0.8, "관심"))
    return view.tab_counts(view.with_tabs(st, "2031-01-10"))


def report_filter(spark: SparkSession, sf: str) -> DataFrame:
    """C19, G2"""
    st = order_state(spark, sf).withColumn("mark", F.when(F.col("rel_score") < 0, "패스"))
    return view.matching(st, ["신입"], "#0000001").orderBy(*view.newest_first()).select("id", "first_seen")


def token_sets(spark: SparkSession, sf: str) -> DataFrame:
    """G8, G9, I8"""
    p = table(spark, sf, "part")
    a, b = F.split("p_name", " "), F.array(F.lower("p_type"), F.substring("p_name", 1, 3), F.lit("ring"))
    from ..functions.titles import token_cover
    return p.select("p_partkey", F.arrays_overlap(a, b).alias("overlap"), token_cover(a, b).alias("covered"), F.array_join(F.array_sort(F.array_except(a, b)), " ").alias("rest"))


# H: snapshot -------------------------------------------------------------------

def snapshot_merge(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H13, F1, D5-D7, B1"""
    failed = spark.createDataFrame([("1-URGENT",)], "source string")
    out = merge.merge_snapshot(order_state(spark, sf), line_batch(spark, sf, MERGE_DAY), MERGE_DAY, failed)
    return out.select("id", "company", "title", "exp", "posted", "deadline", "link", "source", "first_seen", "last_seen", "status", "verify", "verified_at", "is_new")


def snapshot_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs written to buckets, the older and the newer read back"""
    store = snapshots.SnapshotStore(spark, scratch_path(spark, "snapshots"))
    store.start(order_state(spark, sf), "2031-07-01")
    failed = spark.createDataFrame([("1-URGENT",)], "source string")
    snapshots.merge_run(store, line_batch(spark, sf, MERGE_DAY), MERGE_DAY, failed)
    shown = ["id", "company", "exp", "deadline", "source", "first_seen", "last_seen", "status"]
    older, newer = (store.read(n).select(F.lit(n).alias("run"), *shown) for n in (1, 2))
    return older.unionByName(newer)


def stale_close(spark: SparkSession, sf: str) -> DataFrame:
    """H10, H11"""
    failed = order_sources(spark, sf).filter("type = 'api'").select(F.col("name").alias("source"))
    out = merge.close_stale(state.conform_state(order_state(spark, sf)), "2030-03-01", failed)
    return out.select("id", "status")


def canon_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one customer share a posting number"""
    st = order_state(spark, sf).withColumn("link", F.concat(F.lit("https://www.jobkorea.co.kr/Recruit/GI_Read/"), F.substring("snippet", 2, 20)))
    st = st.withColumn("company", F.when(F.col("track") == "신입", F.col("company")).otherwise(F.concat(F.lit("X"), F.col("source")))).withColumn(
        "company_full", F.when(F.col("verified_at").isNotNull(), F.concat(F.lit("(주)"), F.col("company")))).withColumn("mark", F.when(F.col("rel_score") > 0.8, "관심"))
    return merge.collapse_canon(st).select("id", "status", "verify", "first_seen", "last_seen", "company_full", "mark")


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """B2, E8, G3"""
    o = table(spark, sf, "orders")
    runs = o.groupBy(F.date_format(day("o_orderdate"), "yyyy-MM-dd'T'HH:mm").alias("run_at")).agg(
        F.count(F.lit(1)).alias("new"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.lit(3).cast("long").alias("sources_ok"), F.lit(5).cast("long").alias("sources_total"))
    again = runs.filter("new > 5").withColumn("sources_ok", F.lit(4).cast("long"))
    log = state.append_run(runs, again)
    v = o.select(F.when(F.col("o_orderstatus") == "P", F.date_format(day("o_orderdate"), "yyyy-MM-dd")).alias("first_seen"))
    return view.export_meta(v, log, "2029-01-01")


def redacted_copy(spark: SparkSession, sf: str) -> DataFrame:
    """B8"""
    return state.redact(table(spark, sf, "customer"), ("c_acctbal",), F.contains("c_name", F.lit("11"))).select("c_custkey", "c_name", "c_acctbal")


def verified_rows(spark: SparkSession, sf: str) -> DataFrame:
    """B10"""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey")
    return state.with_verification(o, c).select("o_orderkey", F.col("verified.c_mktsegment").alias("segment"), F.col("verified.c_nationkey").alias("nation"))


# C14-C20: export --------------------------------------------------------------

def export_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """C14, C15"""
    st = view.retained(state.conform_state(order_state(spark, sf)), "2028-06-01")
    return st.select("id", view.export_reason(RULES).alias("why"))


def published_rows(spark: SparkSession, sf: str) -> DataFrame:
    """C14-C18, D3, J17, J18"""
    st = state.conform_state(order_state(spark, sf))
    out = view.publish(st, RULES, customer_registry(spark, sf), "2028-06-01")
    return out.select("id", "status", "co_tier", "group", "size", "exp", "fit", "link", F.array_join("sec", ",").alias("sec"), "size_rank")


def wrong_tails(spark: SparkSession, sf: str) -> DataFrame:
    """C20"""
    p = table(spark, sf, "part")
    t = F.col("p_type")
    title = F.concat(F.when(t == "PROMO", "각 부문 상시채용").when(t == "SMALL", F.concat(F.lit("EHS "), F.col("p_name"))).otherwise(F.col("p_name")),
                     F.when(F.col("p_size") > 10, " (안전관리)").otherwise(" (기타)"))
    st = p.select("p_partkey", F.col("p_brand").alias("company"), title.alias("title"), F.when(F.col("p_size") % 2 == 0, "open").otherwise("closed").alias("status"),
                  F.when(F.col("p_size") % 4 == 0, "모음 (검색)").otherwise("전체 대조)").alias("source"))
    return view.wrong_tails(st, RULES).select("p_partkey", "title")


# I: duplicates -----------------------------------------------------------------

def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A17, H12"""
    d = landed(spark, sf, "documents").select(job_id("source", "text").alias("id"), "doc_id", "source")
    return d.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def near_dup_components(spark: SparkSession, sf: str) -> DataFrame:
    """I3-I11"""
    return dedup.duplicate_roots(part_postings(spark, sf))


def representative_view(spark: SparkSession, sf: str) -> DataFrame:
    """One row per duplicate group"""
    jobs = part_postings(spark, sf)
    roots = jobs.groupBy("company", "status").agg(F.min("id").alias("root")).join(jobs.select("id", "company", "status"), ["company", "status"]).select("id", "root")
    out = dedup.collapse(jobs, roots, "duplicate")
    return out.select("id", "company", "status", "title", "link", "first_seen", "deadline", F.array_join("sec", ",").alias("sec"), "n_merged")


def sibling_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """Final view with bundled roles"""
    v, _ = dedup.merge_duplicates(part_postings(spark, sf))
    return v.select("id", "company", "status", "title", "n_merged", F.array_join("sec", ",").alias("sec"))


def member_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Members of a group as arrays of bounded length, none lost"""
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.struct("l_orderkey", "l_linenumber").alias("item"), "l_orderkey")
    parts = groups.chunked_members(x, "k", F.col("item"), "l_orderkey", 50)
    return parts.groupBy("k").agg(F.sum(F.size("members")).alias("n"), F.sum(F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m["l_orderkey"])).alias("s"))


# K: model ------------------------------------------------------------------------

def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K3: document frequencies and weights of all terms, per block and length"""
    d = landed(spark, sf, "documents")
    counts = score.term_counts(d, "doc_id", F.col("text"), by_text=False)
    idf = score.idf_weights(counts, d.agg(F.count(F.lit(1)).alias("n")))
    return idf.groupBy("block", F.length("term").alias("len")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("sum_df"), F.round(F.sum("idf"), 2).alias("sum_idf"))


def word_weights(spark: SparkSession, sf: str) -> DataFrame:
    """K3: unit-length weights per document, word block"""
    d = landed(spark, sf, "documents")
    texts = score.sliced(d, F.col("text"), "doc_id", most=1 << 24)  # words only: a slice takes little memory
    parts = score.meeting_parts(texts)
    counts = score.term_counts(texts, "doc_id", F.col("_text"), chars=False, by_slice=True, parts=parts)
    idf = score.idf_weights(counts, texts.agg(F.count(F.lit(1)).alias("n")), parts=parts)
    w = score.tfidf(counts, idf, "doc_id", texts, (score.WORD,))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("x"), 6).alias("max_weight"))


def relevance_score(spark: SparkSession, sf: str) -> DataFrame:
    """K1-K8: trained on the labelled documents, applied to all"""
    d = landed(spark, sf, "documents")
    train = d.join(table(spark, sf, "labels"), "doc_id").select(F.col("text").alias("title"), F.col("source").alias("company"), F.col("quality").alias("label"))
    model = score.fit(train)
    rows = d.select("doc_id", "text", "source", F.lit(None).cast("string").alias("drop_reason"), F.array(F.lit("환경")).alias("sec"))
    out = score.gate(score.score(rows, model, "doc_id", "text", "source"), RULES)
    return out.select("doc_id", "rel_score", "tier", "drop_reason")


def _weight_table(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the benchmark's words with invented weights: words, and their windows of three signs."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)).alias("word"))
    grams = words.select(F.lit("c").alias("block"), F.explode(F.regexp_extract_all("word", F.lit("(?=(.{3}))"), 1)).alias("term"))
    found = words.select(F.lit("w").alias("block"), F.col("word").alias("term")).unionByName(grams).distinct()
    return found.select("block", "term", (1 + F.length("term") / 8).alias("idf"), ((F.ascii("term") % 7 - 3) / 4).alias("weight"))


def weighted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K2, K3, K6: every document scored with a given weight table, inside its row"""
    d = landed(spark, sf, "documents").select("doc_id", "text", "source")
    model = score.RelevanceModel(_weight_table(spark, sf), -0.25)
    return score.score(d, model, "doc_id", "text", "source").select("doc_id", F.round("p", 6).alias("p"))


def training_mix(spark: SparkSession, sf: str) -> DataFrame:
    """K5: base labels and user labels, the latter three times, with the weights that balance them"""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    base = d.select(F.col("doc_id").cast("string").alias("title"), F.col("source").alias("company"), F.col("quality").alias("label"))
    user = d.filter("quality <> toxic").select(F.col("doc_id").cast("string").alias("title"), F.col("lang").alias("company"), F.col("toxic").alias("label"))
    return score.training_rows(base, user).groupBy("title", "company", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def model_gate(spark: SparkSession, sf: str) -> DataFrame:
    """K7, K8, E3"""
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.floor(F.col("value")) / 512).alias("p"), F.when(F.col("event_type") == "error", "off_topic").alias("drop_reason"),
        F.when(F.col("event_type") == "click", F.array(F.lit("환경"), F.lit("안전"))).otherwise(F.array(F.lit("환경"))).alias("sec"))
    return score.gate(e, RULES).select("event_id", "rel_score", "tier", "drop_reason", F.array_join("sec", ",").alias("sec"))


# L: streams ------------------------------------------------------------------------

def lifecycle_table(spark: SparkSession, sf: str) -> DataFrame:
    """L1 on a table"""
    out = lifecycle.lifecycles(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error", "8 hours", "16 hours")
    return _shown(out)


def _shown(out: DataFrame) -> DataFrame:
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", fmt("first_seen").alias("first_seen"), fmt("last_seen").alias("last_seen"), "n_seen", fmt("closes_at").alias("closes_at"))


def outage_windows(spark: SparkSession, sf: str) -> DataFrame:
    """L3 on a table"""
    out = lifecycle.outage_windows(table(spark, sf, "events"), "user_id", "ts", F.col("event_type") == "error")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "user_id", "n_fetches", "n_failed")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def lifecycle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """L1 as a stream: periods the watermark has closed"""
    out = scratch_path(spark, "lifecycle")
    lifecycle.run_available(lifecycle.lifecycles(_stream(spark, sf), "user_id", "ts", F.col("event_type") == "error", "8 hours", "16 hours", "1 hour"), out + "/rows", out + "/checkpoint")
    return _shown(spark.read.parquet(out + "/rows"))


def closed_periods_stream(spark: SparkSession, sf: str) -> DataFrame:
    """L1 with state and timers: every closing when the watermark reaches it"""
    out = scratch_path(spark, "periods")
    closed = periods.closed_periods(_stream(spark, sf), "user_id", "ts", F.col("event_type") == "error", "8 hours", "16 hours", "1 hour")
    with periods.with_rocks(spark):
        lifecycle.run_available(closed, out + "/rows", out + "/checkpoint")
    return _shown(spark.read.parquet(out + "/rows"))


def first_sightings_stream(spark: SparkSession, sf: str) -> DataFrame:
    """L2 as a stream: repeats inside the watermark are dropped"""
    out = scratch_path(spark, "sightings")
    first = lifecycle.first_sightings(_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    lifecycle.run_available(first.select("user_id", "event_type"), out + "/rows", out + "/checkpoint")
    return spark.read.parquet(out + "/rows")


QUERIES = {f.__name__: f for f in (
    judged_orders, drop_reasons_by_source, source_health, health_thresholds, failure_list, run_totals, include_exclude_sections, section_counts,
    rule_confusion, feed_recall, longest_name_match, listed_names, alias_lookup, tier_cascade, compare_bands, fresh_profile_join, best_company,
    fuzzy_link, evidence_link, import_anti, designated_flag, total_reconcile, count_and_sum, first_batch_wins, feedback_latest, survivorship, budget_topn,
    budget_per_source, outage_runs, view_order_topk, tab_counts, report_filter, token_sets, snapshot_merge, snapshot_versions, stale_close, canon_collapse, run_log,
    redacted_copy, verified_rows, export_reasons, published_rows, wrong_tails, exact_dedup, near_dup_components, representative_view,
    sibling_bundle, member_parts, tfidf_terms, word_weights, weighted_scores, training_mix, relevance_score, model_gate, lifecycle_table, outage_windows, lifecycle_stream,
    closed_periods_stream, first_sightings_stream)}
