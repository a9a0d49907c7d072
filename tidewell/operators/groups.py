"""Group-wise picks that never bring a whole group into one task.

Every operator here is an aggregate with map-side combine or a scan split into
bounded chunks, so one key may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: Column | str, latest: bool = False) -> DataFrame:
    """One whole row per key: least (or greatest) ``order``.

    ``order`` should be total; add an id to it to make ties explicit.
    """
    order = F.struct(F.col(order) if isinstance(order, str) else order)  # never NULL: every row competes
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if latest else F.min_by)(F.struct(*rest), order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def survivors(df: DataFrame, key: str, order: Column, fill: list[str], earliest: list[str] = (),
              latest: list[str] = ()) -> DataFrame:
    """Best row per key with blanks filled by priority.

    ``fill`` columns take the first non-empty value in ``order``; ``earliest``
    and ``latest`` columns take the minimum and maximum over the group.
    """
    plain = [c for c in df.columns if c not in (key, *fill, *earliest, *latest)]
    aggs = [F.min_by(F.struct(*plain), F.col("_order")).alias("_best")]
    for c in fill:
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c))
    aggs += [F.min(c).alias(c) for c in earliest] + [F.max(c).alias(c) for c in latest]
    aggs.append(F.count(F.lit(1)).alias("n_merged"))
    out = df.withColumn("_order", order).groupBy(key).agg(*aggs)
    return out.select(key, "_best.*", *fill, *earliest, *latest, "n_merged")


FAN = 1000
"""Chunks that make a chunk of the next level."""


def _number(df: DataFrame, chunk: Column) -> Column:
    """The chunk as a whole number: days of a date, seconds of a time."""
    kind = df.select(chunk.alias("c")).schema["c"].dataType.typeName()
    return (F.unix_date(chunk) if kind == "date" else F.floor(chunk) if kind not in ("timestamp", "timestamp_ntz") else F.unix_seconds(chunk.cast("timestamp"))).cast("long")


def _before(totals: DataFrame, keys: list[str], levels: int, fan: int, scan: Callable[[Column], Column],
            fold: Callable[[Column, Column], Column], add: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, _chunk, _carried): what the chunks of a key before each one come to.

    Chunks are gathered into chunks of ``fan`` and so on for ``levels`` levels,
    each scanned inside the next larger one only.  ``scan`` folds values in a
    window, ``fold`` those of a group by their place, ``add`` a value further back with a nearer one.
    """
    if not levels:
        ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumn("_carried", scan(F.col("_in_chunk")).over(ahead)).drop("_in_chunk")
    raised = totals.withColumn("_up", F.floor(F.col("_chunk") / fan).cast("long"))
    upper = raised.groupBy(*keys, "_up").agg(fold(F.col("_in_chunk"), F.col("_chunk")).alias("_in_chunk")).withColumnRenamed("_up", "_chunk")
    above = _before(upper, keys, levels - 1, fan, scan, fold, add).withColumnRenamed("_chunk", "_up")
    ahead = Window.partitionBy(*keys, "_up").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = raised.withColumn("_near", scan(F.col("_in_chunk")).over(ahead))
    met = _join_null_safe(inside, above, [*keys, "_up"])
    return met.withColumn("_carried", add(F.col("_carried"), F.col("_near"))).select(*keys, "_chunk", "_carried")


def forward_fill(df: DataFrame, keys: list[str], order: str, value: str, chunk: Column,
                 out: str | None = None, levels: int = 1, fan: int = FAN) -> DataFrame:
    """Carry the last non-null value forward.

    ``chunk`` is any non-decreasing number, date or time derived from ``order``
    (a day, a block number).  Rows are scanned chunk by chunk, chunks in chunks
    of ``fan``, for ``levels`` levels: no task holds all rows or all chunks of a
    hot key, only its rows divided by those of a chunk and ``fan ** levels``.
    """
    staged = df.withColumn("_chunk", _number(df, chunk))
    newest = lambda v, at: F.max_by(v, F.when(v.isNotNull(), at))
    totals = staged.groupBy(*keys, "_chunk").agg(newest(F.col(value), F.col(order)).alias("_in_chunk"))
    carried = _before(totals, keys, levels, fan, lambda v: F.last(v, ignorenulls=True), newest, lambda far, near: F.coalesce(near, far))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    joined = _join_null_safe(local, carried, [*keys, "_chunk"])
    return joined.withColumn(out or value, F.coalesce("_local", "_carried")).drop("_chunk", "_local", "_carried")


def running_count(df: DataFrame, keys: list[str], order: str, flag: Column, chunk: Column, out: str, levels: int = 1,
                  fan: int = FAN) -> DataFrame:
    """Number of flagged rows up to and including this one, chunked like ``forward_fill``."""
    staged = df.withColumn("_chunk", _number(df, chunk)).withColumn("_flag", F.coalesce(flag.cast("long"), F.lit(0)))
    totals = staged.groupBy(*keys, "_chunk").agg(F.sum("_flag").alias("_in_chunk"))
    none = F.lit(0).cast("long")
    carried = _before(totals, keys, levels, fan, F.sum, lambda v, _: F.sum(v), lambda far, near: F.coalesce(far, none) + F.coalesce(near, none))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("_local", F.sum("_flag").over(inside))
    joined = _join_null_safe(local, carried, [*keys, "_chunk"])
    return joined.withColumn(out, F.col("_local") + F.coalesce("_carried", none)).drop("_chunk", "_local", "_carried", "_flag")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_carried")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def outage_runs(log: DataFrame, key: str, order: str, failed: Column, chunk: Column) -> DataFrame:
    """Runs of consecutive failures per key: start, end, length (F8)."""
    marked = running_count(log, [key], order, ~failed, chunk, "_resets")
    return (
        marked.filter(failed).groupBy(key, "_resets")
        .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length"))
        .drop("_resets")
    )


def budget(df: DataFrame, eligible: Column, order: list[Column], cap: int, per: list[str] | None = None) -> DataFrame:
    """First ``cap`` eligible rows in order, over all rows or per key.

    Over all rows this is a top-k (per-task heaps, then one merge); per key
    Spark plans a group limit before the shuffle, so a hot key sends ``cap``
    rows per task.
    """
    kept = df.filter(eligible)
    if not per:
        return kept.orderBy(*order).limit(cap)
    w = Window.partitionBy(*per).orderBy(*order)
    return kept.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= cap).drop("_rank")


def chunked_members(df: DataFrame, key: str, item: Column, id_col: str, max_len: int = 1000) -> DataFrame:
    """Members of each group as arrays of about ``max_len``: ``(key, part, members)``.

    All members are kept; a large group simply has several parts.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(max_len)).cast("int")
    spread = df.join(sizes, key).withColumn("part", F.pmod(F.hash(F.col(id_col)), parts))
    return spread.groupBy(key, "part").agg(F.array_sort(F.collect_list(item)).alias("members"))
