"""Connected components by joins (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, gathered


def _both(one: tuple[str, str], two: tuple[str, str]) -> Column:
    """Two edges out of a row, in one reading of it."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (one, two)]))


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with the least node ``m`` among each ``u`` and its neighbours: an aggregate with map-side combine and one join."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return edges.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """A large and a small star of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).

    The edges are re-pointed and never collected per node.  Neither star makes
    edges more than it gets, so equal ones are left out once, at the end.
    """
    large = _with_least(edges.select(_both(("u", "v"), ("v", "u")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    small = _with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return small.select(_both(("v", "m"), ("u", "m"))).filter("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Every node points at one root and no root points anywhere: one aggregate over both ends of all edges."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("root")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("root")))))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("root").alias("root")).filter("n + root > 1").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge list; root is the least node of its component.

    Runs until the edges form stars.  Each round is written out with a reliable
    checkpoint, so a lost executor costs one round at most.  No round makes the
    edges more, so their first number tells how many tasks they are worth.
    """
    current = cut_lineage(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v").distinct())
    number = current.count()
    current = gathered(current, number)
    while True:  # every round joins trees, so this ends; no round limit
        current = cut_lineage(gathered(_round(current), number))
        if _is_stars(current):
            break
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def group_by_links(nodes: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """Nodes with the root of their component; nodes without an edge are their own root."""
    roots = connected_components(edges).withColumnRenamed("node", id_col)
    return nodes.join(roots, id_col, "left").withColumn("root", F.coalesce("root", F.col(id_col)))
