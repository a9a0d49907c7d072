"""Ordered judging of candidates: the first failing rule names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bands import size_label, size_rank
from ..functions.dates import deadline_text, parse_deadline, parse_posted
from ..functions.experience import parse_exp
from ..functions.orgs import normalize_org
from ..functions.text import blank_to_null, first_match, matches, normalize_title, substitute, text_or_blank
from .lookup import spread_join
from .rules import RuleSet, find_company, named_large, named_mid, not_a_posting, sections, sections_loose

SOURCE_COLUMNS = {
    "name": "string", "type": "string", "url": "string", "company": "string", "group": "string",
    "adapter": "string", "size_filter": "boolean", "groups_only": "boolean", "default_rank": "int",
}

ALIAS_SALTS = 16
"""Tasks that the candidates of one company meet the affiliates in; the narrow table of affiliates is repeated as often."""


def join_sources(candidates: DataFrame, sources: DataFrame, on: str = "source") -> DataFrame:
    """Candidate rows with the attributes of their source as ``src``."""
    present = {c: (F.col(c) if c in sources.columns else F.lit(None)).cast(t) for c, t in SOURCE_COLUMNS.items()}
    dim = sources.select(F.col("name").alias(on), F.struct(*[v.alias(k) for k, v in present.items()]).alias("src"))
    return candidates.join(dim, on)


def augmented_title(rules: RuleSet, title: Column, block: Column, src: Column) -> Column:
    """Group feeds: field of work named only in the block goes behind the title.

    Aggregators are left out and search tags are removed first: the word that was
    searched for is not the work of the posting.
    """
    feed = (src["type"] == "api") & ~F.startswith(text_or_blank(src["adapter"]), F.lit("aggregators:"))
    hit = first_match(substitute(block, fixed.SEARCH_TAG, " "), fixed.BLOCK_FIELD)
    wanted = feed & ~sections_loose(rules, title, src["company"]) & hit.isNotNull()
    return F.when(wanted, F.concat(title, F.lit(" ("), hit, F.lit(")"))).otherwise(title)


def judge(candidates: DataFrame, rules: RuleSet, run_date: Column, aliases: DataFrame | None = None,
          parse_dropped: bool = True) -> DataFrame:
    """Verdict per candidate: posting columns and ``drop_reason`` (NULL = kept).

    Input: ``title, href, block, company`` and the struct ``src``.  ``aliases``
    is the (alias, group) table of registered affiliates (D3, D4).  Cheap rules
    come first.  With ``parse_dropped=False`` the dear parsers run only on rows
    those leave alive and the columns of early dropped rows are NULL; the
    verdicts are the same.  Apart from the equality join with the affiliates the
    judge is one narrow pass; rows that need no lookup get keys of their own and
    do not pile up on one, and those of a source with one company are dealt over
    ``ALIAS_SALTS`` tasks.
    """
    src = F.col("src")
    title, block, href = text_or_blank("title"), text_or_blank("block"), text_or_blank("href")
    is_api, is_search = src["type"] == "api", src["type"] == "search"
    every = F.lit(parse_dropped)

    named = (
        candidates
        .withColumn("_title", augmented_title(rules, title, block, src))
        .withColumn("_loose", sections_loose(rules, F.col("_title"), src["company"]))
        .withColumn("_first", F.when(~F.col("_loose"), "off_topic").otherwise(
            F.when(~is_api, not_a_posting(F.col("_title"), href, block))))
        .withColumn("_found", F.when(is_search & (F.col("_first").isNull() | every), find_company(rules, block)))
        .withColumn("company", F.when(is_search, F.col("_found"))
                    .when(is_api, F.coalesce(blank_to_null("company"), src["company"]))
                    .otherwise(src["company"]))
    )
    if aliases is not None:
        no_key = F.concat(F.lit("\u0000"), F.hash("title", "href", "block").cast("string"))
        wanted = (F.col("_first").isNull() | every) & F.col("company").isNotNull()
        keyed = named.withColumn("_alias", F.when(wanted, normalize_org("company", "affiliate")).otherwise(no_key))
        groups = aliases.select(F.col("alias").alias("_alias"), F.col("group").alias("affiliate_of"))
        named = spread_join(keyed, groups, ["_alias"], "left", ALIAS_SALTS).drop("_alias")
    else:
        named = named.withColumn("affiliate_of", F.lit(None).cast("string"))

    company = F.col("company")
    large = named_large(rules, company) | F.col("affiliate_of").isNotNull()
    groups_only = is_api & F.coalesce(src["groups_only"], F.lit(False))
    headhunted = matches(F.concat_ws(" ", company, F.col("_title")), fixed.HEADHUNT_BIG, True)
    size_filter = is_api & F.coalesce(src["size_filter"], F.lit(False))
    staged = named.withColumn("_large", F.when(F.col("_first").isNull() | every, large)).withColumn(
        "_early", F.when(F.col("_first").isNotNull(), F.col("_first"))
        .when(is_search & F.col("_found").isNull(), "unlisted_company")
        .when(size_filter & ~F.col("_large") & find_company(rules, company).isNull(), "unlisted_company")
        .when(groups_only & F.col("affiliate_of").isNull() & ~headhunted, "not_group_affiliate"))
    alive = F.col("_early").isNull() | every
    staged = (
        staged
        .withColumn("_exp", F.when(alive, parse_exp(block)))
        .withColumn("_deadline", F.when(alive, parse_deadline(block, run_date)))
        .withColumn("size_rank", F.when(alive, size_rank(
            src["type"] == "portal", F.col("_large"), F.coalesce(src["group"] == "대기업 계열", F.lit(False)),
            named_mid(rules, company), src["default_rank"], company)))
        .withColumn("sec", F.when(alive, sections(rules, F.col("_title"), company, F.col("size_rank"))))
    )
    exp, deadline = F.col("_exp"), F.col("_deadline")
    closed = matches(block, fixed.CLOSED_WORDING, True) & ~matches(block, fixed.CLOSING_DATE_WORDING)
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.coalesce(exp["min_years"] > rules.max_min_years, F.lit(False)), "min_years")
        .when(exp["new_grad_only"] & ~F.col("_large"), "new_grad_small")
        .when(F.coalesce(deadline["date"] < run_date, F.lit(False)), "past_deadline")
        .when(closed, "closed_wording")
        .when(F.size("sec") == 0, "off_profile")
    )
    norm_own = normalize_org(src["company"], "posting")
    doubt = ((src["type"] == "company") & matches(src["url"], fixed.COMPANY_SEARCH_URL)
             & ~F.contains(normalize_org(F.concat(block, F.col("_title")), "posting"), norm_own))
    keep = [c for c in candidates.columns if c not in ("title", "block", "href", "company", "src")]
    return staged.select(
        *keep, company, normalize_title("_title").alias("title"),
        F.when(exp["new_grad_only"], fixed.NEW_GRAD).when(alive, fixed.EXPERIENCED).alias("track"),
        exp["label"].alias("exp"), exp["min_years"].alias("min_years"),
        F.when(alive, F.date_format(parse_posted(block, run_date), "yyyy-MM-dd")).alias("posted"),
        deadline_text(deadline).alias("deadline"),
        F.coalesce(blank_to_null(href), src["url"]).alias("link"),
        block.alias("snippet"),
        "size_rank", size_label(F.col("size_rank")).alias("size"), "affiliate_of", "sec",
        F.when(alive, doubt).alias("check_company"), reason.alias("drop_reason"),
    )


def drop_label(reason: Column, min_years: Column) -> Column:
    """Wording of a drop reason as run reports show it."""
    table = F.create_map(*[F.lit(x) for kv in fixed.DROP_LABELS.items() for x in kv])
    return F.when(reason == "min_years", F.concat(F.lit(fixed.DROP_LABELS["min_years"] + " "), min_years.cast("string"), F.lit("년"))) \
        .otherwise(F.try_element_at(table, reason))
