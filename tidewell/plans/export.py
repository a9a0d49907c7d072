"""Export: rules of today, tiers, duplicates, siblings, order, meta."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.dedup import merge_duplicates, nest_members
from ..operators.rules import RuleSet
from ..operators.view import export_meta, publish, section_counts, view_order


def export(state: DataFrame, rules: RuleSet, aliases: DataFrame, runs: DataFrame, run_date: str) -> dict[str, DataFrame]:
    """Tables of the published view: jobs, members (bounded arrays), meta, counts."""
    rows = publish(state, rules, aliases, run_date)
    order = [p.name for p in rules.profiles] or [rules.default_section]
    jobs, members = merge_duplicates(rows, order)
    return {
        "jobs": jobs.drop("pos").orderBy(*view_order()),
        "members": members,
        "nested_members": nest_members(members),
        "meta": export_meta(jobs, runs, run_date),
        "counts": section_counts(jobs),
    }
