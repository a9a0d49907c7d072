"""Mixing sources to target weights with Efraimidis-Spirakis sampling; DataFrame functions only.

Every source gets a share of the mix by its weight, at most a fixed number of
times its own size.  Complete epochs come first; the rest of a source's budget
is filled by the documents with the least exponential keys -ln(u) / weight (u:
a hash of the id), sorted inside the source and prefix-summed up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .batches import running_sum

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_weight(text: Column, size: Column) -> Column:
    """A document's quality weight: 1 for a mean word length (with its space) of 6, less the farther it is from that."""
    return 1 / (1 + F.abs(F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1)) - 6))


def unit_key(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from the md5 of seed and id, the same in every run."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """(source, source_size, target, epochs, budget, base) from (source, source_size).

    Sources in order of their names, null last, take the weights in turn.  The
    shares cut off at ``most_epochs`` times the source's size are dealt out again by weight:
    the sources with the least size per weight are cut first, so a running sum
    in that order finds the common level of the others.
    """
    named = sizes.withColumn("_none", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long"))
    listed = running_sum(named, [F.col("_none"), F.col("source")], ["_one", "source_size"])
    turn = (F.col("_one_before") % len(weights)).cast("int")
    weighed = listed.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumnRenamed("source_size_before", "base")
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(most_epochs).cast("long"))
    ranked = running_sum(weighed, [F.col("_cap") / F.col("_w"), F.col("_none"), F.col("source")], ["_cap", "_w"])
    ranked = cut_lineage(ranked)
    totals = ranked.agg(F.sum("source_size").alias("words"), F.sum("_w").alias("weights")).first()
    level = (F.lit((totals["words"] or 0) * share) - F.col("_cap_before")) / (F.lit(totals["weights"] or 0.0) - F.col("_w_before"))
    free = F.when(F.col("_cap") / F.col("_w") > level, F.struct(F.col("_cap") / F.col("_w"), F.col("_none"), F.col("source")))
    common = ranked.agg(F.min_by(level, free).alias("level")).first()["level"]
    target = F.col("_cap").cast("double") if common is None else F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(common))
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return ranked.select("source", "source_size", target.alias("target"), epochs.alias("epochs"),
                      (target - epochs * F.col("source_size")).alias("budget"), "base")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None,
        weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, seed: str = "mix", extra: list[Column] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, copies[, extra]) for every row.

    ``copies`` says how often the mix holds the document, ``taken`` how many
    words that is.  Null and empty texts have size 0 and are taken as often as
    their source is complete; a null source is a source of its own, the last
    one.  A null or non-positive quality weight counts as the least one, 1e-6.
    Rows with equal ids get equal keys and are taken in order of their sizes;
    other columns are not read, but for ``extra``.  An empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    size = word_count(text)
    quality = prose_weight(text, size) if weight is None else weight
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
                       F.greatest(F.coalesce(quality.cast("double"), F.lit(1e-6)), F.lit(1e-6)).alias("_q"), *extra)
    kept = [c for c in rows.columns if c not in ("_id", "source", "size", "_q")]
    rows = cut_lineage(rows.withColumn("_key", -F.log(unit_key(F.col("_id"), seed)) / F.col("_q")).drop("_q"))
    sources = cut_lineage(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_epochs))
    none = F.col("source").isNull()
    summed = running_sum(rows, [none, F.col("source"), F.col("_key"), F.col("_id"), F.col("size"), *[F.col(c) for c in kept]], ["size"])
    joined = summed.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    start = F.col("size_before") - F.col("base")
    last = F.when(start + F.col("size") / 2 < F.col("budget"), 1).otherwise(0)
    copies = F.least(F.col("epochs") + last, F.lit(most_epochs).cast("long"))
    return joined.select(F.col("_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                         copies.alias("copies"), *kept)
