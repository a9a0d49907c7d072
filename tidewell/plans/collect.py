"""One collect run: candidates, verdicts, scores, checks, merge, metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import job_id
from ..functions.text import matches
from ..operators.groups import budget
from ..operators.health import drop_histogram, run_totals, source_health
from ..operators.judge import join_sources, judge
from ..operators.lookup import fresh_profile
from ..operators.merge import merge_snapshot
from ..operators.rules import RuleSet
from ..operators.score import RelevanceModel, feature_text, gate, score
from ..sources.feeds import feed_counts, net_filter
from ..sources.pages import is_blocked, page_candidates, page_stats
from ..functions.bands import compare_salary, compare_size
from ..functions.orgs import normalize_org
from ..session import cut_lineage


@dataclass
class Run:
    """Tables of one run."""

    judged: DataFrame
    batch: DataFrame
    state: DataFrame
    health: DataFrame
    dropped: DataFrame
    totals: DataFrame


def candidates_of(pages: DataFrame, feed_rows: DataFrame | None, rules: RuleSet,
                  landed_feeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates and fetch states of landed pages (source, url, html) and normalised feed rows.

    ``landed_feeds`` names the feeds whose payload arrived; default: those with rows.
    """
    stats = page_stats(pages, rules.block_page_pattern).groupBy("source").agg(
        F.sum("text_len").alias("text_len"), F.max("ok").alias("ok"), F.min(F.when(~F.col("ok"), F.col("error"))).alias("error"))
    usable = pages.filter(~is_blocked(F.col("html"), rules.block_page_pattern))  # row by row: pages are never shuffled
    found = page_candidates(usable, rules.candidate_pattern).select(
        "source", "title", "href", "block", F.lit(None).cast("string").alias("company"), "pos")
    if feed_rows is not None:
        found = found.unionByName(net_filter(feed_rows, rules.candidate_pattern).select(
            "source", "title", "href", "block", "company", "pos"))
        feeds = feed_counts(feed_rows if landed_feeds is None else landed_feeds, feed_rows)
        stats = stats.unionByName(feeds.select("source", "text_len", "ok", "error"))
    return found, stats


def with_profiles(batch: DataFrame, profiles: DataFrame, run_date: str, base: dict | None = None, ttl_days: int = 30) -> DataFrame:
    """Company figures and their comparison to a baseline (D8, J15); ``profiles`` is keyed by ``norm``."""
    base = base or {}
    name = F.coalesce("company_full", "company") if "company_full" in batch.columns else F.col("company")
    keyed = batch.drop("csn", "employees", "avg_salary", "salary_year").withColumn("norm", normalize_org(name, "profile"))
    found = fresh_profile(keyed, profiles, ["norm"], F.lit(run_date).cast("date"), "fetched", ttl_days)
    known = F.col("fresh") & ~F.coalesce("missing", F.lit(False))
    salary = compare_salary(F.col("avg_salary"), F.lit(base.get("avg_salary")).cast("int"))
    size = compare_size(F.col("employees"), "form", F.lit(base.get("employees")).cast("int"), F.lit(base.get("form", "")))
    return found.withColumn("company_form", F.when(known, F.col("form"))) \
        .withColumn("cmp_salary", F.when(known, salary)).withColumn("cmp_size", F.when(known, size)) \
        .drop("norm", "fresh", "missing", "fetched", "form", "salary_min", "salary_max", "salary_reliability")


def lookups_due(batch: DataFrame, profiles: DataFrame, run_date: str, cap: int, ttl_days: int = 30) -> DataFrame:
    """Companies to look up in this run: no fresh profile, within the budget."""
    names = batch.filter(matches("link", r"^https?://")).groupBy(normalize_org("company", "profile").alias("norm")).agg(
        F.min("batch_pos").alias("first_pos"))
    known = fresh_profile(names, profiles, ["norm"], F.lit(run_date).cast("date"), "fetched", ttl_days)
    return budget(known.filter(~F.col("fresh")).select("norm", "first_pos"), F.lit(True), [F.col("first_pos"), F.col("norm")], cap)


def run(candidates: DataFrame, fetches: DataFrame, sources: DataFrame, state: DataFrame, rules: RuleSet, run_date: str,
        aliases: DataFrame | None = None, model: RelevanceModel | None = None, profiles: DataFrame | None = None,
        base_company: dict | None = None, verify=None) -> Run:
    """Judge, score, enrich and merge.

    ``verify`` is an optional function over the batch (for example
    ``operators.verify.apply_details`` on landed pages).  The judged table is
    written once because verdicts feed both the merge and the metrics.
    """
    day = F.lit(run_date).cast("date")
    judged = judge(join_sources(candidates, sources), rules, day, aliases, parse_dropped=False)
    no_score = F.lit(None).cast("double").alias("p")
    if model is not None:  # only survivors are scored, and each distinct text once
        judged = cut_lineage(judged)
        alive = judged.filter("drop_reason is null").withColumn("text_id", F.md5(F.encode(feature_text("title", "company"), "UTF-8")))
        judged = cut_lineage(score(alive, model, "text_id")).drop("text_id").unionByName(
            judged.filter("drop_reason is not null").select("*", no_score))
        judged = gate(judged, rules)
    else:
        judged = cut_lineage(gate(judged.select("*", no_score), rules))
    batch = judged.filter("drop_reason is null").withColumn("batch_pos", F.struct("source", "pos", "title"))
    if verify is not None:
        batch = verify(batch.withColumn("id", job_id("company", "title"))).drop("id")
    if profiles is not None:
        batch = with_profiles(batch, profiles, run_date, base_company, rules.profile_ttl_days)
    registered = sources.select(F.col("name").alias("source"), "type", "url")
    states = registered.join(fetches, "source", "full").withColumn("ok", F.coalesce("ok", F.lit(False)))  # nothing landed: failed
    states = states.withColumn("error", F.when(~F.col("ok"), F.coalesce("error", F.lit("NOT FETCHED"))).otherwise(F.col("error")))
    health = source_health(judged, states)
    merged = merge_snapshot(state, batch, run_date, health.filter(~F.col("ok")).select("source"))
    return Run(judged, batch, merged, health, drop_histogram(judged), run_totals(health))


def run_row(result: Run, run_at: str) -> DataFrame:
    """Row of the run log."""
    postings = result.state.select(F.col("is_new"), (F.col("status") == "open").alias("is_open"))
    sources = result.health.select((F.col("ok") & ~F.col("suspicious")).alias("fine"))
    both = postings.unionByName(sources, allowMissingColumns=True)
    return both.agg(
        F.count_if("is_new").alias("new"), F.count_if("is_open").alias("open"),
        F.count_if("fine").alias("sources_ok"), F.count("fine").alias("sources_total"),
    ).select(F.lit(run_at).alias("run_at"), "new", "open", "sources_ok", "sources_total")
