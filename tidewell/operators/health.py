"""Quality metrics of runs and sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import record


def drop_histogram(judged: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source and drop reason."""
    return judged.filter(F.col("drop_reason").isNotNull()).groupBy(source, "drop_reason").agg(F.count(F.lit(1)).alias("n"))


def source_health(judged: DataFrame, fetches: DataFrame, source: str = "source", thin: int = 300) -> DataFrame:
    """found / kept / suspicious per source (E2); a thin page that loaded is suspicious."""
    counts = judged.groupBy(source).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("drop_reason").isNull()).alias("kept"))
    return (
        fetches.join(counts, source, "left")
        .withColumn("found", F.coalesce("found", F.lit(0)).cast("long"))
        .withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
        .withColumn("suspicious", F.coalesce(F.col("ok") & (F.col("text_len") < thin), F.lit(False)))
    )


def run_totals(health: DataFrame) -> DataFrame:
    """Sources that worked and all sources."""
    return health.agg(F.count_if(F.col("ok") & ~F.col("suspicious")).alias("sources_ok"), F.count(F.lit(1)).alias("sources_total"))


@dataclass(frozen=True)
class HealthLimits:
    """Thresholds of the health gate (E5)."""

    overall: float = 0.6
    host: str = ""
    host_min: int = 20
    host_share: float = 0.3
    api_min: int = 4
    api_share: float = 0.5
    key_source: str = ""
    key_found: int = 20


def health_problems(health: DataFrame, limits: HealthLimits) -> DataFrame:
    """One row per violated threshold: name, good, total (E5)."""
    on_host = F.contains(F.coalesce(F.col("url"), F.lit("")), F.lit(limits.host)) if limits.host else F.lit(False)
    is_api = F.coalesce(F.col("type") == "api", F.lit(False))
    is_key = F.contains(F.coalesce(F.col("source"), F.lit("")), F.lit(limits.key_source)) if limits.key_source else F.lit(False)
    fine = F.col("ok") & ~F.col("suspicious")
    # one named source: the first in name order speaks for it
    key_state = F.min_by(F.struct("ok", "found"), F.when(is_key, F.col("source")))
    t = health.agg(
        F.count_if(fine).alias("ok_all"), F.count(F.lit(1)).alias("n_all"),
        F.count_if(on_host & F.col("ok")).alias("ok_host"), F.count_if(on_host).alias("n_host"),
        F.count_if(is_api & F.col("ok")).alias("ok_api"), F.count_if(is_api).alias("n_api"), key_state.alias("key"))

    def problem(name: str, cond: Column, good: Column, total: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), record(
            problem=F.lit(name), good=good.cast("long"), total=total.cast("long")))

    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    key = F.col("key")
    rows = F.array_compact(F.array(
        problem("overall", share("ok_all", "n_all") < limits.overall, F.col("ok_all"), F.col("n_all")),
        problem("host", (F.col("n_host") >= limits.host_min) & (share("ok_host", "n_host") < limits.host_share),
                F.col("ok_host"), F.col("n_host")),
        problem("key_source", key.isNotNull() & (~key["ok"] | (key["found"] < limits.key_found)), key["found"], F.lit(limits.key_found)),
        problem("api", (F.col("n_api") >= limits.api_min) & (share("ok_api", "n_api") < limits.api_share),
                F.col("ok_api"), F.col("n_api")),
    ))
    return t.select(F.explode(rows).alias("p")).select("p.*")


def failures(health: DataFrame, skip: str = "disabled") -> DataFrame:
    """All failed sources with their whole error, in name order."""
    error = F.coalesce(F.col("error"), F.lit(""))
    return (health.filter(~F.col("ok") & ~F.contains(error, F.lit(skip)))
            .select("source", error.alias("error")).orderBy("source"))


def feed_recall(judged: DataFrame, wide: Column, feed: str = "source") -> DataFrame:
    """Per feed: all rows, rows with a wide-net hit, hits kept and dropped."""
    kept = F.col("drop_reason").isNull()
    return judged.groupBy(feed).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(wide).alias("n_hits"),
        F.count_if(wide & kept).alias("n_kept"), F.count_if(wide & ~kept).alias("n_dropped"))


def dropped_hits(judged: DataFrame, wide: Column) -> DataFrame:
    """Listing of wide-net hits that were dropped, with the reason."""
    return judged.filter(wide & F.col("drop_reason").isNotNull())


def count_and_sum(rows: DataFrame, cond: Column) -> DataFrame:
    """Count and conditional count."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(cond).alias("n_true"))


def preview(new_rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First rows of what is new for a message."""
    return new_rows.orderBy(*order).limit(n)
