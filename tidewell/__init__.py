"""Posting analytics on Spark: collect, judge, score, merge, deduplicate, publish."""

from .operators.rules import Profile, RuleSet
from .session import cut_lineage, local_session

__all__ = ["Profile", "RuleSet", "cut_lineage", "local_session"]
