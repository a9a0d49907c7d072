"""Report payload of a run and the health gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.health import HealthLimits, failures, health_problems
from ..operators.view import newest_first, tab_counts, view_order, with_tabs


def report(state: DataFrame, new_ids: DataFrame, health: DataFrame, sources: DataFrame, run_date: str) -> dict[str, DataFrame]:
    """Rows newest first with tab flags, stat tiles, health rows and shortcuts."""
    rows = with_tabs(state, run_date, new_ids)
    return {
        "jobs": rows.orderBy(*newest_first()), "ranked": rows.orderBy(*view_order()), "tiles": tab_counts(rows), "health": health,
        "shortcuts": sources.filter(F.col("type").isin("portal", "search")).select("name", "url", "type"),
    }


def health_gate(health: DataFrame, limits: HealthLimits) -> tuple[DataFrame, DataFrame]:
    """Violated thresholds and the capped failure list; a run fails if the first is not empty."""
    return health_problems(health, limits), failures(health)
