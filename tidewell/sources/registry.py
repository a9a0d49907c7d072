"""Registry of business groups from landed registry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.orgs import normalize_org, registry_aliases
from ..functions.text import strip_tags, to_int
from ..operators.groups import forward_fill


def table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Cells of every table row of a landed page, in order."""
    keep = [c for c in pages.columns if c != html]
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(F.regexp_extract_all(F.col("_tr"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), strip_tags)
    return pages.select(*keep, F.posexplode(rows).alias("row", "_tr")).select(*keep, "row", cells.alias("cells"))


def affiliates(rows: DataFrame, page: list[str], width: int = 18, chunk: Column | None = None) -> DataFrame:
    """Affiliate rows with the group name carried down over row-spanned cells."""
    chunk = chunk if chunk is not None else F.floor(F.col("row") / 100_000)
    n = F.size("cells")
    full, spanned = n == width, n == width - 1
    named = rows.withColumn("group", F.when(full, F.get("cells", F.lit(0))))
    filled = forward_fill(named, page, "row", "group", chunk)
    at = lambda i: F.get("cells", F.when(full, F.lit(i + 1)).otherwise(F.lit(i)))
    return filled.filter((full | spanned) & F.col("group").isNotNull()).select(
        *page, "row", "group", at(0).alias("name"), at(5).alias("industry"), to_int(at(6)).alias("employees"))


def ranking(rows: DataFrame, page: list[str]) -> DataFrame:
    """Ranked groups: rows of at least six cells that start with a number."""
    at = lambda i: F.get("cells", F.lit(i))
    return rows.filter((F.size("cells") >= 6) & to_int(at(0)).isNotNull()).select(
        *page, to_int(at(0)).alias("rank"), at(1).alias("group"), at(2).alias("owner"),
        to_int(at(3)).alias("affiliate_count"), F.regexp_replace(at(4), ",", "").try_cast("long").alias("assets_100m_krw"),
        at(5).alias("public_corp"))


def latest_period(rows: DataFrame, period: str) -> DataFrame:
    """Rows of the newest period that has any."""
    newest = rows.agg(F.max(period).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(period) == F.col("_newest")).drop("_newest")  # one row


def build_registry(ranked: DataFrame, members: DataFrame, designated: DataFrame) -> DataFrame:
    """One row per (group, affiliate) with type, aliases and counts."""
    flag = designated.select("group").distinct().withColumn("_designated", F.lit(True))
    counts = members.groupBy("group").agg(F.count(F.lit(1)).alias("listed_affiliates"))
    groups = (
        ranked.join(flag, "group", "left").join(counts, "group", "left")
        .withColumn("designated", F.coalesce("_designated", F.lit(False))).drop("_designated")
        .withColumn("group_aliases", registry_aliases(normalize_org("group", "registry")))
        .withColumn("listed_affiliates", F.coalesce("listed_affiliates", F.lit(0)).cast("long"))
    )
    detail = members.select("group", "name", "industry", "employees",
                            normalize_org("name", "registry").alias("norm"))
    return groups.join(detail, "group", "left").withColumn("aliases", registry_aliases("norm"))


def registry_counts(ranked: DataFrame, members: DataFrame, designated: DataFrame) -> DataFrame:
    """Totals of the registry document."""
    in_ranking = members.join(ranked.select("group"), "group", "left_semi")
    tagged = (
        ranked.select(F.lit("group_count").alias("what"), F.col("group").alias("x"))
        .unionByName(designated.select("group").distinct().select(F.lit("designated_count").alias("what"), F.col("group").alias("x")))
        .unionByName(in_ranking.select(F.lit("affiliate_count").alias("what"), F.col("name").alias("x")))
    )
    return tagged.agg(*[F.count_if(F.col("what") == w).alias(w)
                        for w in ("group_count", "designated_count", "affiliate_count")])


def unranked_groups(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with affiliates that the ranking lacks."""
    return members.select("group").distinct().join(ranked.select("group"), "group", "left_anti")


def alias_table(registry: DataFrame) -> DataFrame:
    """(alias, group) for equality lookup; a later group wins like a dictionary update (D3)."""
    names = F.array_compact(F.concat(F.array("name", "norm"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = registry.select("group", "rank", F.explode(names).alias("_n")).select(
        normalize_org("_n", "affiliate").alias("alias"), "group", "rank").filter("alias <> ''")
    return rows.groupBy("alias").agg(F.max_by("group", F.struct("rank", "group")).alias("group"))
