"""Published view: filters, sizes, tiers, order, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bands import company_tier, fit_band, form_rank, repaired_size
from ..functions.dates import is_dated
from ..functions.experience import years_cap
from ..functions.links import web_link
from ..functions.text import alternation, matches, shorten, substitute, text_or_blank
from ..functions.titles import is_generic
from .lookup import affiliate_group
from .rules import RuleSet, not_a_posting, sections, sections_loose


def retained(state: DataFrame, run_date: str, days: int = 30) -> DataFrame:
    """Open rows and those closed less than ``days`` ago (C15); the filter reaches the scan."""
    cutoff = F.date_format(F.date_sub(F.lit(run_date).cast("date"), days), "yyyy-MM-dd")
    return state.filter((F.col("status") == "open") | (F.col("last_seen") >= cutoff))


def export_reason(rules: RuleSet, site_profile: str = fixed.SAFETY_SECTION) -> Column:
    """Why a stored posting is not published, NULL if it is (C14)."""
    verify, source, title = text_or_blank("verify"), text_or_blank("source"), text_or_blank("title")
    hidden = F.lit(False)
    for prefix in fixed.HIDDEN_PREFIXES:
        hidden = hidden | F.startswith(verify, F.lit(prefix))
    recheck = (source != fixed.LEGACY_SOURCE) & ~matches(source, r"\(API|그리팅|recruiter")
    contract = matches("emp_type", fixed.CONTRACT_TYPES) & ~F.contains(text_or_blank("emp_type"), F.lit(fixed.PERMANENT_TYPE))
    site_pattern = next((p.construction for p in rules.profiles if p.name == site_profile and p.construction), "(?!)")
    staff = matches("title", fixed.STAFF_PROFILE) & ~matches("title", fixed.STAFF_PROFILE_UNLESS)
    return (
        F.when(hidden, "hidden")
        .when(recheck & not_a_posting(title, F.col("link"), F.col("snippet")).isNotNull(), "not_posting")
        .when(contract, "contract")
        .when(matches("duty_evidence", fixed.CONTRACT_EVIDENCE), "contract_evidence")
        .when(F.contains(text_or_blank("duty_flag"), F.lit(fixed.SITE_WORK_FLAG)) & matches("company", site_pattern), "site_work")
        .when(~years_cap("exp", rules.max_min_years), "min_years")
        .when(staff, "staff_profile")
        .when(F.size(sections(rules, "title", "company", F.col("size_rank"))) == 0, "off_profile")
    )


def publish(state: DataFrame, rules: RuleSet, aliases: DataFrame, run_date: str, days: int = 30) -> DataFrame:
    """Rows of the export before duplicates are merged."""
    rows = retained(state, run_date, days).withColumn("_why", export_reason(rules)).filter("_why is null").drop("_why")
    rows = rows.withColumn("sec", sections(rules, "title", "company", F.col("size_rank")))
    rows = rows.withColumn("size_rank", form_rank(F.coalesce("size_rank", F.lit(5)), "company_form"))
    rows = rows.withColumn("size", repaired_size(F.col("size_rank"), "size", "company_form", F.col("employees")))
    rows = affiliate_group(rows, aliases, ["company_full", "company"], "_group")
    shown = F.create_map(*[F.lit(x) for kv in fixed.GROUP_DISPLAY.items() for x in kv])
    group = F.coalesce(F.try_element_at(shown, F.col("_group")), F.col("_group"))
    mids = [m for m in rules.mid_companies if len(m) >= 2]
    in_mid = F.lit(False)
    if mids:
        in_mid = F.greatest(in_mid, *[F.contains(text_or_blank("company"), F.lit(m)) for m in mids])
    rows = rows.withColumn("_tier", company_tier("company", "title", group, F.col("size_rank"), "size", F.col("employees"),
                                                 F.col("avg_salary"), "company_form", in_mid))
    size = F.when(F.col("_tier.group").isNotNull() & ~F.contains(text_or_blank("size"), F.lit("대기업")), "대기업 계열").otherwise(F.col("size"))
    score = F.coalesce("rel_score", F.lit(0.0))
    return rows.select(
        "id", "sec", "status", F.col("_tier.tier").alias("co_tier"), F.col("_tier.group").alias("group"), "company", "company_full",
        size.alias("size"), F.coalesce("track", F.lit(fixed.EXPERIENCED)).alias("track"), "title", shorten("exp").alias("exp"),
        shorten("edu").alias("edu"), shorten("emp_type", 60).alias("emp_type"), shorten("location", 80).alias("location"),
        "posted", "deadline", "deadline_time", web_link("link").alias("link"), fit_band(score).alias("fit"), "tier",
        F.concat(F.lit("모델 점수 "), F.bround(score * 100, 0).cast("int").cast("string"),
                 F.when(F.col("duty") == fixed.VERDICT_DOUBT, F.lit(" · 원문 직무 의심")).otherwise("")).alias("reason"),
        F.coalesce("verify", F.lit("원문 확인 필요")).alias("verify"), "duty",
        F.substring("duty_evidence", 1, 140).alias("duty_evidence"), F.substring("duty_flag", 1, 140).alias("duty_flag"), "source",
        F.substring("snippet", 1, 300).alias("snippet"), "avg_salary", "employees", "salary_year", "company_form",
        "first_seen", "last_seen", "size_rank", "rel_score")


def view_order() -> list[Column]:
    """Rank, recommended, experienced before new graduates, nearest deadline, undated last (G1)."""
    dated = F.when(F.col("deadline").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("deadline"))
    return [
        F.coalesce("size_rank", F.lit(5)).asc(), F.when(F.col("tier") == fixed.RECOMMENDED, 0).otherwise(1).asc(),
        F.when(F.col("track") == fixed.NEW_GRAD, 1).otherwise(0).asc(), dated.asc_nulls_last(), F.col("id").asc(),
    ]


def newest_first() -> list[Column]:
    """Newest first, id as tie-break."""
    return [F.col("first_seen").desc_nulls_last(), F.col("id").asc()]


def with_tabs(rows: DataFrame, run_date: str, new_ids: DataFrame | None = None) -> DataFrame:
    """Report tabs as flags."""
    is_open = F.col("status") == "open"
    days_left = F.datediff(F.try_to_date(F.col("deadline")), F.lit(run_date).cast("date"))
    if new_ids is not None:
        rows = rows.join(new_ids.select("id").distinct().withColumn("_new", F.lit(True)), "id", "left")
        is_new = F.coalesce("_new", F.lit(False))
    else:
        is_new = F.col("first_seen") == run_date
    mark = text_or_blank("mark") if "mark" in rows.columns else F.lit("")
    return rows.withColumns({
        "tab_new": F.coalesce(is_new, F.lit(False)) & is_open,
        "tab_due": is_open & F.coalesce(days_left <= 3, F.lit(False)) & is_dated("deadline"),
        "tab_open": is_open, "tab_starred": is_open & mark.isin("관심", "지원"), "tab_closed": F.col("status") == "closed",
    }).drop("_new")


def tab_counts(rows: DataFrame) -> DataFrame:
    """Stat tiles."""
    return rows.agg(*[F.count_if(F.col(c)).alias(c) for c in ("tab_new", "tab_due", "tab_open", "tab_starred", "tab_closed")])


def matching(rows: DataFrame, tracks: list[str], words: str = "", hide_passed: bool = True) -> DataFrame:
    """Track, search and passed filters of the report."""
    new = F.col("track") == fixed.NEW_GRAD
    keep = F.when(new, F.lit(fixed.NEW_GRAD in tracks)).otherwise(F.lit(fixed.EXPERIENCED in tracks))
    if hide_passed and "mark" in rows.columns:
        keep = keep & (text_or_blank("mark") != "패스")
    if words:
        keep = keep & F.contains(F.lower(F.concat_ws(" ", "company", "title")), F.lit(words.lower()))
    return rows.filter(keep)


def section_counts(rows: DataFrame) -> DataFrame:
    """Open postings per section, multi-label."""
    return rows.filter(F.col("status") == "open").select(F.explode("sec").alias("section")).groupBy("section").agg(
        F.count(F.lit(1)).alias("n_open"))


def export_meta(view: DataFrame, runs: DataFrame, run_date: str) -> DataFrame:
    """One row: run date from the newest first sighting, figures of the latest run."""
    figures = ("run_at", "new", "open", "sources_ok", "sources_total")
    run = F.struct(*[F.col(c) for c in figures])
    seen = view.select("first_seen")
    both = seen.unionByName(runs.select(run.alias("r")), allowMissingColumns=True)
    return both.agg(F.max("first_seen").alias("_first"), F.max_by("r", F.col("r.run_at")).alias("r")).select(
        F.coalesce("_first", F.substring("r.run_at", 1, 10), F.lit(run_date)).alias("run_date"),
        F.substring("r.run_at", 12, 5).alias("run_time"), F.col("r.run_at").alias("run_at"),
        *[F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in figures[1:]])


def wrong_tails(state: DataFrame, rules: RuleSet) -> DataFrame:
    """Open rows of aggregators whose title passes only because of its last bracket (C20)."""
    tail = r"\s*\((?:" + fixed.BLOCK_FIELD + r")\)\s*$"
    rows = state.filter((F.col("status") == "open") & (F.contains("source", F.lit("(검색)")) | F.contains("source", F.lit("대조)")))
                        & matches("title", tail, True))
    staged = rows.withColumn("_base", substitute("title", tail, "", True))
    return staged.filter(~sections_loose(rules, "_base", "company") & ~is_generic("_base", "company")).drop("_base")
