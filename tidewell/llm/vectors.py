"""Vector tables: which rows take part, bounded samples, and query groups met with data blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: Column, zero_counts: bool) -> Column:
    """A vector that is not null or empty and holds no null, NaN or infinite component (nor, unless ``zero_counts``, only zeros)."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = x.isNotNull() & (F.size(x) > 0) & ~bad
    return ok if zero_counts else ok & F.exists(x, lambda v: v != 0)


def vectors_of(df: DataFrame, id_col: str, vector_col: str, zero_counts: bool) -> tuple[DataFrame, int, int]:
    """(vec_id, x) of the rows that take part, their number and dimension.

    Rows without an id take no part, nor do vectors of another length than the
    most frequent one (the shorter on a tie).  Of rows with the same id the
    least vector counts; operators drop the others inside their blocks.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("x"), zero_counts))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    if top is None:
        return rows, 0, 0
    return rows.filter(F.size("x") == top["d"]), top["n"], top["d"]


def sample_matrix(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, the same ones in every run, as a matrix on the driver; of rows with one id the least vector."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(most).select("vec_id", "x").toArrow()
    if not found.num_rows:
        return np.zeros((0, 0))
    ids = np.asarray(found.column("vec_id"), np.int64)
    return matrix(found.column("x"))[np.concatenate(([True], ids[1:] != ids[:-1]))]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def distinct_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block; of rows with one id the least vector, ids ascending."""
    ids, x = np.asarray(table.column("vec_id"), np.int64), matrix(table.column("x"))
    order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    keep = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return ids[keep], x[keep]


def search_cells(rows: DataFrame, n_rows: int, is_query: Column, n_queries: int, block_rows: int, group_rows: int,
                 search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
                 ) -> DataFrame:
    """Search every group of queries in every block of rows.

    ``search(query ids, queries, ids, rows)`` returns arrays (place of the query,
    place of the row, score) for what a block offers.  Rows are dealt to blocks
    by a hash of the id, so a frequent vector is spread evenly; a task holds one
    block and one group, both of bounded size.
    """
    blocks, groups = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // group_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    data = rows.select("vec_id", "x", block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    queries = rows.filter(is_query).select("vec_id", "x", group.alias("_group"),
                                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q = distinct_rows(left)
        ids, x = distinct_rows(right)
        if len(q_ids) and len(ids):
            a, b, score = search(q_ids, q, ids, x)
            found = q_ids[a], ids[b], score
        else:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    return queries.groupBy("_block", "_group").cogroup(data.groupBy("_block", "_group")).applyInArrow(cell, CELL_SCHEMA)


def k_least(cost: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least costs, ties to the smaller id, in that order."""
    if len(cost) > k:
        at = np.flatnonzero(cost <= np.partition(cost, k - 1)[k - 1])
    else:
        at = np.arange(len(cost))
    return at[np.lexsort((ids[at], cost[at]))[:k]]
