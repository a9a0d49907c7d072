"""Field-of-work rules as data.

A ``RuleSet`` is read from the user's settings document (the keys a posting
collector's settings already have); operators turn it into column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.links import host_of
from ..functions.text import (
    ColumnLike, all_matches, has_any_name, longest_name, matches, substitute, text_or_blank,
)


@dataclass(frozen=True)
class Profile:
    """One field of work: patterns and, for building firms, a rank gate."""

    name: str
    base_rule: bool = False
    include: str | None = None
    exclude: str | None = None
    rescue_from: str | None = None
    rescue_if: str | None = None
    construction: str | None = None
    construction_max_rank: int = 2
    construction_site: str | None = None


@dataclass(frozen=True)
class RuleSet:
    candidate_pattern: str = "."
    rule_include: str = "."
    rule_exclude: str = "(?!)"
    block_page_pattern: str | None = None
    profiles: tuple[Profile, ...] = ()
    large_companies: tuple[str, ...] = ()
    mid_companies: tuple[str, ...] = ()
    max_min_years: int = 7
    keep_threshold: float = 0.10
    recommend_threshold: float = 0.30
    verify_recheck_days: int = 3
    verify_retry_days: int = 7
    verify_cap: int = 120
    profile_ttl_days: int = 30
    default_section: str = fixed.SECTION_ORDER[0]
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_settings(cls, s: dict) -> RuleSet:
        """Rule set of a settings document; non-mapping profile entries are notes."""
        known = {"base_rule", "include", "exclude", "rescue_from", "rescue_if", "construction",
                 "construction_max_rank", "construction_site"}
        profiles = tuple(
            Profile(name=n, **{k: v for k, v in p.items() if k in known})
            for n, p in (s.get("profiles") or {}).items() if isinstance(p, dict))
        ml, verify = s.get("ml", {}), s.get("verify", {})
        return cls(
            candidate_pattern=s.get("candidate_pattern", "."),
            rule_include=s.get("rule_v2_include", s.get("rule_include", ".")),
            rule_exclude=s.get("rule_v2_exclude", s.get("rule_exclude", "(?!)")),
            block_page_pattern=s.get("block_page_pattern"),
            profiles=profiles,
            large_companies=tuple(s.get("large_companies", ())),
            mid_companies=tuple(s.get("mid_companies", ())),
            max_min_years=int(s.get("max_min_years", 7)),
            keep_threshold=float(ml.get("keep_threshold", 0.10)),
            recommend_threshold=float(ml.get("recommend_threshold", 0.30)),
            verify_recheck_days=int(verify.get("recheck_days", 3)),
            verify_retry_days=int(verify.get("retry_failed_days", 7)),
            verify_cap=int(verify.get("max_per_run", 120)),
        )


def with_company(title: ColumnLike, company: ColumnLike) -> Column:
    return F.concat(text_or_blank(title), F.lit(" "), text_or_blank(company))


def include_exclude(title: ColumnLike, company: ColumnLike, include: str, exclude: str) -> Column:
    """Include on the title, exclude on title and company."""
    return matches(title, include, True) & ~matches(with_company(title, company), exclude, True)


def profile_passes(p: Profile, rules: RuleSet, title: ColumnLike, company: ColumnLike,
                   rank: Column | None = None) -> Column:
    """Profile predicate with rescue and building-firm gate (C3); no rank means unknown."""
    both = with_company(title, company)
    ok = include_exclude(title, company, rules.rule_include, rules.rule_exclude) if p.base_rule else F.lit(True)
    if p.include:
        ok = ok & matches(title, p.include, True)
    if p.exclude:
        judged = both
        if p.rescue_from and p.rescue_if:
            judged = F.when(matches(title, p.rescue_if, True), substitute(both, p.rescue_from, " ", True)).otherwise(both)
        ok = ok & ~matches(judged, p.exclude, True)
    if p.construction:
        gate = matches(both, p.construction, True)
        blocked = F.lit(False)
        if rank is not None:
            blocked = F.coalesce(rank > p.construction_max_rank, F.lit(False))
        if p.construction_site:
            blocked = blocked | matches(title, p.construction_site, True)
        ok = ok & ~(gate & blocked)
    return ok


def sections(rules: RuleSet, title: ColumnLike, company: ColumnLike, rank: Column | None = None) -> Column:
    """Names of the profiles a posting passes, in rule order (C4)."""
    if not rules.profiles:
        hit = include_exclude(title, company, rules.rule_include, rules.rule_exclude)
        return F.array_compact(F.array(F.when(hit, rules.default_section)))
    return F.array_compact(F.array(*[
        F.when(profile_passes(p, rules, title, company, rank), p.name) for p in rules.profiles]))


def sections_loose(rules: RuleSet, title: ColumnLike, company: ColumnLike) -> Column:
    """Some profile may pass while the company size is unknown."""
    if not rules.profiles:
        return include_exclude(title, company, rules.rule_include, rules.rule_exclude)
    out = F.lit(False)
    for p in rules.profiles:
        out = out | profile_passes(p, rules, title, company)
    return out


def not_a_posting(title: ColumnLike, href: ColumnLike, block: ColumnLike,
                  markers: list[tuple[str, str]] | None = None) -> Column:
    """Reason why a candidate is no posting, NULL for a posting.

    Links of known sites need the site's posting marker; everything else needs a
    hiring word in the title or a block with at least two card words.
    """
    host = host_of(href)
    known, marked = F.lit(False), F.lit(False)
    for part, marker in markers or fixed.POSTING_LINK_MARKERS:
        here = F.contains(host, F.lit(part)) & ~known
        marked = marked | (here & matches(href, marker))
        known = known | here
    block, title = text_or_blank(block), text_or_blank(title)
    words = F.array_distinct(F.transform(all_matches(block, fixed.CARD_WORD), lambda w: F.replace(w, F.lit(" "), F.lit(""))))
    card = (F.length(block) >= F.length(title) + 40) & (F.size(words) >= 2)
    recruit = matches(title, fixed.RECRUIT_WORD, True)
    return (
        F.when(known & marked, F.lit(None).cast("string"))
        .when(known, "not_posting_link")
        .when(~recruit & ~card, "not_posting_text")
    )


def find_company(rules: RuleSet, text: ColumnLike) -> Column:
    """Longest listed company in the text once vendor phrases are gone."""
    names = [*rules.large_companies, *rules.mid_companies]
    return longest_name(names, substitute(text_or_blank(text), fixed.VENDOR_CONTEXT, " "))


def named_large(rules: RuleSet, company: ColumnLike) -> Column:
    return has_any_name(rules.large_companies, company)


def named_mid(rules: RuleSet, company: ColumnLike) -> Column:
    return has_any_name(rules.mid_companies, company)


def confusion(predicted: DataFrame, keep: Column, got: Column) -> DataFrame:
    """Counts of a rule against human labels; any miss fails."""
    return predicted.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("n_keep"),
        F.count_if(got & ~keep).alias("false_admits"), F.count_if(keep & ~got).alias("misses"),
        F.count_if(keep & got).alias("hits"),
    ).withColumn("failed", F.col("misses") > 0)
