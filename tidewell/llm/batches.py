"""Small helpers shared by the operators: byte-balanced batches, folds, running sums over sorted data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def text_or_empty(name: str = "text") -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string")) % folds).cast("int")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from.  A null id has no fold: not held out, but never learned from either."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def by_bytes(sizes: list[int] | np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` bytes; one larger text is a slice of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_batches(texts: pa.Array, most: int = 1 << 20, most_rows: int | None = None) -> Iterator[list[str]]:
    """The texts of an Arrow column as lists of about ``most`` bytes, and of ``most_rows`` texts at most, in order."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0)) if len(texts) else []
    for part in by_bytes(sizes, most):
        step = most_rows or max(part.stop - part.start, 1)
        for start in range(part.start, part.stop, step):
            yield [t or "" for t in texts.slice(start, min(step, part.stop - start)).to_pylist()]


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one record batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def shuffle_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """Exclusive running sums ``<value>_before`` over the whole table in a given order, without a one-task window.

    The rows are range-partitioned by ``order`` (hot values of the first column
    are split by the later ones) and written to a reliable checkpoint, so that a
    recomputed task cannot deal them out anew.  Every partition sums its own
    rows, and one row per partition carries the totals before it.
    Equal rows are taken in any order; an empty table stays empty.
    """
    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    dealt = keyed.repartitionByRange(shuffle_count(df), *names).sortWithinPartitions(*names)
    fixed = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    totals = fixed.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    local = fixed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_l_{v}") for v in values])
    joined = local.join(offsets, "_part")
    return joined.select(*df.columns, *[(F.col(f"_l_{v}") + F.col(f"_o_{v}")).alias(f"{v}_before") for v in values])


def numbered(df: DataFrame, order: list[Column] | None = None, name: str = "_row") -> DataFrame:
    """Consecutive numbers from 0 in ``name``, in the given order or in that of the partitions, without a one-task window.

    The rows are range-partitioned and sorted, and written to a reliable
    checkpoint together with their places, so that a recomputed task cannot
    number them anew.  Only one row per partition meets in a window, and that
    many rows are broadcast.  Equal rows are taken in any order; put a unique
    column last where many are expected, or they share a partition.
    """
    dealt = df if order is None else df.repartitionByRange(shuffle_count(df), *order).sortWithinPartitions(*order)
    fixed = cut_lineage(dealt.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    placed = fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_o") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(name))
