"""Posting-shaped rows rendered from the given tables.

The tables hold typed columns; these functions write them out as the texts,
pages and payloads a collector lands, so that operators can be checked against
the typed columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Profile, RuleSet
from ..session import spread

RUN_DATE = "2028-06-15"

RULES = RuleSet(
    candidate_pattern="환경|안전|EHS",
    rule_include="환경|EHS|안전",
    rule_exclude="대행",
    profiles=(
        Profile("환경", base_rule=True, include="환경|EHS", construction="매니저", construction_max_rank=2),
        Profile("안전", include="안전|EHS", construction="매니저", construction_max_rank=2),
    ),
    max_min_years=7,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def landed(spark: SparkSession, sf: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Table whose rows are parsed as texts: enough tasks even for a single file."""
    return spread(table(spark, sf, name), by)


def day(c: str) -> F.Column:
    """Day of a table's timestamp, thirty years on: cards name years of this century."""
    return F.add_months(F.col(c).cast("date"), 360)


def order_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Source registry: one source per order priority."""
    p = F.col("name")
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name")).distinct().select(
        "name",
        F.when(p == "1-URGENT", "portal").when(p == "5-LOW", "company").otherwise("api").alias("type"),
        F.concat(F.lit("https://"), F.lower(F.substring(p, 3, 3)), F.lit(".example/jobs")).alias("url"),
        F.when(p == "1-URGENT", "Portal Co").when(p == "5-LOW", "Low Co").alias("company"),
        F.when(p == "2-HIGH", "대기업 계열").alias("group"),
        F.when(p == "2-HIGH", "groups:x").when(p.isin("3-MEDIUM", "4-NOT SPECIFIED"), "aggregators:y").alias("adapter"),
        F.lit(False).alias("size_filter"), (p == "3-MEDIUM").alias("groups_only"),
        F.when(p == "4-NOT SPECIFIED", 4).alias("default_rank"))


def order_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a candidate card."""
    o = landed(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    years = F.pmod("o_orderkey", F.lit(12))
    work = F.when(years == 0, F.lit("신입")).otherwise(F.concat(F.lit("경력 "), years.cast("string"), F.lit("년 이상")))
    due = F.date_add(day("o_orderdate"), 45)
    return o.select(
        "o_orderkey", F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderstatus") == "F", "환경안전 담당 채용").when(F.col("o_orderstatus") == "O", "회계 담당 채용").otherwise("EHS 매니저 모집").alias("title"),
        F.concat(F.lit("https://x.example/"), F.col("o_orderkey").cast("string")).alias("href"),
        F.concat(work, F.lit(" · "), F.date_format(day("o_orderdate"), "yyyy.MM.dd"), F.lit("(월) ~ "), F.date_format(due, "yyyy.MM.dd"),
                 F.lit(" · 직무: 안전관리"), F.when(F.col("o_totalprice") > 450000, F.lit(" · 접수마감")).otherwise("")).alias("block"),
        F.col("c_name").alias("company"))


def customer_registry(spark: SparkSession, sf: str) -> DataFrame:
    """(alias, group): customers of one segment are affiliates of their nation."""
    c = table(spark, sf, "customer").filter("c_mktsegment = 'FURNITURE'")
    n = table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.lower("c_name").alias("alias"), F.col("n_name").alias("group"))


def order_state(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a stored posting."""
    o = landed(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_acctbal"), "o_custkey")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    price, key, status = F.col("o_totalprice"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("s-"), key).alias("id"), F.col("c_name").alias("company"),
        F.concat(F.when(status == "F", "환경안전 담당 채용 ").otherwise("EHS 매니저 모집 "), key).alias("title"),
        F.when(status == "P", "신입").otherwise("경력").alias("track"),
        F.concat(F.pmod("o_orderkey", F.lit(12)).cast("string"), F.lit("년 이상")).alias("exp"),
        F.when(price > 100000, iso(day("o_orderdate"))).alias("posted"),
        F.when(status == "P", F.lit("상시")).otherwise(iso(F.date_add(day("o_orderdate"), 90))).alias("deadline"),
        F.concat(F.lit("https://www.saramin.co.kr/v?rec_idx="), key).alias("link"), F.col("o_orderpriority").alias("source"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("snippet"),
        iso(day("o_orderdate")).alias("first_seen"),
        iso(F.date_add(day("o_orderdate"), F.pmod("o_orderkey", F.lit(60)).cast("int"))).alias("last_seen"),
        F.when(status == "F", "closed").otherwise("open").alias("status"),
        F.when((status == "F") & (price > 300000), F.lit("마감됨 · 원문 확인")).when(price > 400000, F.lit("원문 확인")).alias("verify"),
        F.when(price > 200000, iso(day("o_orderdate"))).alias("verified_at"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "계약직").when(F.col("c_mktsegment") == "BUILDING", "정규직·계약직").alias("emp_type"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "고용형태: 파견").alias("duty_evidence"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1).when(F.col("c_mktsegment") == "FURNITURE", 4).otherwise(2).alias("size_rank"),
        F.lit("중견").alias("size"), (F.col("c_acctbal") / 10000).alias("rel_score"),
        F.when(F.col("c_acctbal") > 5000, "추천").otherwise("검토").alias("tier"))


def line_batch(spark: SparkSession, sf: str, run: str) -> DataFrame:
    """Every order line as a posting of today's batch: known numbers and new postings."""
    x = landed(spark, sf, "lineitem", ["l_orderkey"])
    key, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    fresh = F.col("l_discount") > 0.08
    return x.select(
        F.concat(F.lit("Part "), part).alias("company"), F.lit("안전 담당").alias("title"), F.lit("경력").alias("track"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("년 이상")).alias("exp"), iso(day("l_shipdate")).alias("posted"),
        F.when(F.col("l_linenumber") > 3, iso(day("l_shipdate"))).alias("deadline"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("https://new.example/"), part))
        .otherwise(F.concat(F.lit("https://www.saramin.co.kr/r?a=1&rec_idx="), key)).alias("link"),
        F.lit("feed").alias("source"), F.lit("s").alias("snippet"), F.lit(4).alias("size_rank"), F.lit("중견").alias("size"),
        F.col("l_discount").alias("rel_score"), F.lit("검토").alias("tier"),
        F.when(fresh, F.lit(run)).alias("verified_at"), F.when(fresh, F.lit("원문 확인")).alias("verify"),
        F.when(fresh & (F.col("l_linenumber") > 5), iso(F.date_add(day("l_shipdate"), 30))).alias("v_deadline"),
        (F.col("l_tax") > 0.07).alias("closed"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("batch_pos"))


def part_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as a posting: brand as company, name and sometimes type as title."""
    key = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    return table(spark, sf, "part").select(
        F.concat(F.lit("p"), key).alias("id"), F.when(F.col("p_size") % 2 == 0, "open").otherwise("closed").alias("status"),
        F.col("p_brand").alias("company"),
        F.when(F.col("p_size") < 20, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type"))).alias("title"),
        F.when(F.col("p_size") > 40, F.concat(F.lit("https://x.example/jobs/"), key)).otherwise(F.concat(F.lit("https://x.example/list/"), F.lower("p_type"))).alias("link"),
        F.lit("feed").alias("source"), F.when(F.col("p_size") > 45, "원문 확인").alias("verify"),
        F.when(F.col("p_size") > 25, F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")).alias("deadline"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd").alias("first_seen"),
        F.array(F.when(F.col("p_size") < 30, "환경").otherwise("안전")).alias("sec"))
