"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and rows are indexed alike.  A node of a cover tree has a centre and a
covering radius; the children of a node at scale s are centres at least s/2
apart that cover its points within s/2.  For a query node (centre p, radius a) and a row
node (centre c, radius b) no product exceeds p.c + a|c| + b|p| + ab; the pair is
pruned if that is below the worst kth score of the query node's queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import sample_matrix, search_cells, vectors_of


@dataclass
class Node:
    center: np.ndarray
    radius: float
    points: np.ndarray
    """Places of all points below."""
    children: list["Node"] = field(default_factory=list)


def build(x: np.ndarray, points: np.ndarray, leaf: int = 256, fan: int = 48) -> Node:
    """Cover tree of some rows of ``x``.

    A node of at most ``leaf`` points stays whole.  One that would need more
    than ``fan`` children at half its radius has ``fan`` of them, at the smaller
    step their centres reach.  A leaf's products are one matrix product.
    """
    center = x[points[0]]
    away = np.sqrt(((x[points] - center) ** 2).sum(axis=1))
    node = Node(center, float(away.max()), points)
    if len(points) <= leaf or node.radius == 0:
        return node
    nearest, owner, last = away, np.zeros(len(points), np.int64), 0
    while nearest.max() > node.radius / 2:  # farthest point first: centres stay half a radius apart
        if last + 1 >= fan:
            break
        last += 1
        distance = np.sqrt(((x[points] - x[points[int(nearest.argmax())]]) ** 2).sum(axis=1))
        owner = np.where(distance < nearest, last, owner)
        nearest = np.minimum(nearest, distance)
    for c in range(last + 1):
        own = np.flatnonzero(owner == c)
        node.children.append(build(x, points[own[np.argsort(nearest[own], kind="stable")]], leaf, fan))
    return node


def dual_search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray):
    """(query place, row place, score) of every pair that may be among a query's ``k`` best: a superset cut to k per query.

    ``floor`` holds for each query a score that its kth best surely reaches.
    """
    norm = np.sqrt((x ** 2).sum(axis=1))
    bound = floor.copy()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    trees = build(q, np.arange(len(q))), build(x, np.arange(len(x)))

    def most(a: Node, b: Node) -> float:
        p, c = float(np.sqrt(a.center @ a.center)), float(np.sqrt(b.center @ b.center))
        limit = float(a.center @ b.center) + a.radius * c + b.radius * p + a.radius * b.radius
        return limit + 1e-9 * (1 + abs(limit) + (p + a.radius) * (c + b.radius))  # room for rounding

    def leaves(a: Node, b: Node) -> None:
        for start in range(0, len(b.points), 8192):
            rows = b.points[start:start + 8192]
            for s in range(0, len(a.points), 512):
                asked = a.points[s:s + 512]
                scores = q[asked] @ x[rows].T
                scores[q_ids[asked][:, None] == ids[rows][None]] = -np.inf
                at, place = np.nonzero((scores >= bound[asked][:, None]) & (scores > -np.inf))
                width = min(k, scores.shape[1])
                if len(at) > 4 * width * len(asked):  # the bounds leave much: the kth best of these rows cut further
                    kth = np.partition(scores, scores.shape[1] - width, axis=1)[:, scores.shape[1] - width]
                    on = scores[at, place] >= kth[at]
                    at, place = at[on], place[on]
                if not len(at):
                    continue
                cut = np.flatnonzero(np.diff(at, prepend=-1))
                for lo, hi in zip(cut, np.append(cut[1:], len(at))):
                    i = asked[at[lo]]
                    old_score, old_id, old_row = kept[i]
                    row = rows[place[lo:hi]]
                    score = np.concatenate((old_score, scores[at[lo], place[lo:hi]]))
                    own, row = np.concatenate((old_id, ids[row])), np.concatenate((old_row, row))
                    best = np.lexsort((own, -score))[:k]
                    kept[i] = score[best], own[best], row[best]
                    if len(best) == k:
                        bound[i] = max(bound[i], kept[i][0][-1])

    waiting = [(most(*trees), 0, *trees)]
    while waiting:
        limit, _, a, b = waiting.pop()
        if limit < bound[a.points].min():  # worst kth score of the group
            continue
        if not a.children and not b.children:
            leaves(a, b)
            continue
        wide = b.children and (not a.children or b.radius >= a.radius)
        pairs = [(a, c) for c in b.children] if wide else [(c, b) for c in a.children]
        found = sorted(((most(p, c), i, p, c) for i, (p, c) in enumerate(pairs)), key=lambda t: t[:2])
        waiting += found  # the most promising pair is taken first
    at = [(np.full(len(s), i), r, s) for i, (s, _, r) in enumerate(kept)]
    return tuple(np.concatenate(c) for c in zip(*at))


def to_integers(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), exact in double precision."""
    return F.transform(vector.cast("array<double>"), lambda v: F.floor(v * scale).cast("double"))


def top_products(df: DataFrame, is_query: Column | None = None, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding", sample_rows: int = 2048, block_rows: int = 8192, group_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` greatest inner products of each query row with all other rows.

    Vectors are integers floor(scale * x); scores are exact while they stay
    below 2**53.  Each query's kth best score among at most ``sample_rows`` rows
    is where its pruning starts in every block.  A zero vector takes part; null
    or non-finite ones do not (null ids, repeated ids, odd lengths: see
    :func:`tidewell.llm.vectors.vectors_of`).  An empty table gives no rows; ties go to the smaller id.
    """
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    rows, n, _ = vectors_of(df, id_col, vector_col, zero_counts=True)
    if n < 2:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.select("vec_id", to_integers(F.col("x"), scale).alias("x"))
    sample = np.unique(sample_matrix(rows, sample_rows), axis=0)

    def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray):
        # distinct sample vectors stand for at least one row each; k + 1 of them leave k besides the query's own
        floor = np.full(len(q), -np.inf)
        if len(sample) > k:
            for s in range(0, len(q), 512):
                floor[s:s + 512] = np.partition(q[s:s + 512] @ sample.T, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
        return dual_search(q_ids, q, ids, x, k, floor)

    found = search_cells(rows, n, is_query, rows.filter(is_query).count(), block_rows, group_rows, search)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
