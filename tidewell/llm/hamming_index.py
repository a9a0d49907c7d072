"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation) turns vectors
into binary codes.  A code is split into substrings and each substring has its
own index.  If two codes differ in at most r bits, they differ in at most
r // m bits in one of m substrings (pigeonhole), so probing every index value
that near retrieves every code within r; those are checked on the whole code
and reranked by the distance of the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import k_least, sample_matrix, search_cells, vectors_of

_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


class BinaryCodes:
    """Centre, rotation and search radius, learned on a sample."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 40, covered: float = 0.99):
        n, d = sample.shape
        self.center = sample.mean(axis=0)
        x = sample - self.center
        width = min(d, 64)
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]
        projected = x @ axes
        turn = np.linalg.qr(np.random.default_rng(7).normal(size=(width, width)))[0]
        for _ in range(rounds):  # alternate: nearest corners of the cube, then the best rotation onto them
            u, _, v = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (u @ v).T
        self.axes = axes @ turn
        self.width = width
        self.parts = [slice(i, min(i + 16, width)) for i in range(0, width, 16)]
        self.radius = self._radius(sample, k, covered)

    def _radius(self, sample: np.ndarray, k: int, covered: float) -> int:
        """Least radius that holds ``covered`` of the sample's true neighbours within the sample.

        In the whole table neighbours are nearer, so the radius holds more of them.
        """
        asked = sample[:256]
        distance = (asked ** 2).sum(1)[:, None] - 2 * asked @ sample.T + (sample ** 2).sum(1)[None]
        np.fill_diagonal(distance, np.inf)
        k = min(k, len(sample) - 1)
        if k < 1:
            return self.width
        near = np.argpartition(distance, k - 1, axis=1)[:, :k]
        codes = self.encode(sample)
        apart = self.differing(codes[:len(asked), None, :], codes[near])
        return int(np.quantile(apart, covered))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """One row of 16-bit substrings per vector."""
        bits = (x - self.center) @ self.axes > 0
        return np.stack([bits[:, p] @ (1 << np.arange(p.stop - p.start)) for p in self.parts], axis=1).astype(np.uint16)

    @staticmethod
    def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _BITS[a ^ b].sum(axis=-1, dtype=np.int64)


def _probe(codes: BinaryCodes, k: int):
    def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray):
        data, asked = codes.encode(x), codes.encode(q)
        m = data.shape[1]
        index = []  # per substring: its values, and the rows of each value
        for j in range(m):
            order = np.argsort(data[:, j], kind="stable")
            values, first = np.unique(data[order, j], return_index=True)
            index.append((values, order, np.append(first, len(order))))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            radius = codes.radius
            while True:
                near = np.zeros(len(ids), bool)
                for j, (values, order, first) in enumerate(index):
                    hit = np.flatnonzero(_BITS[values ^ asked[i, j]] <= radius // m)
                    spans = first[hit + 1] - first[hit]
                    rows = np.repeat(first[hit] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                    near[order[rows]] = True
                near[ids == q_ids[i]] = False
                rows = np.flatnonzero(near)
                rows = rows[codes.differing(data[rows], asked[i]) <= radius]
                if len(rows) >= k or radius >= codes.width:
                    break
                radius = min(codes.width, radius + m)  # too few in this block: probe further
            gap = x[rows] - q[i]
            cost = np.einsum("ij,ij->i", gap, gap)
            best = k_least(cost, ids[rows], k)
            out.append((np.full(len(best), i), rows[best], np.sqrt(cost[best])))
        return tuple(np.concatenate(c) for c in zip(*out))

    return search


def nearest(df: DataFrame, is_query: Column | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            fit_rows: int = 4096, block_rows: int = 8192, group_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query row, by Euclidean distance.

    ``is_query`` is a condition on ``vec_id``; default: divisible by 100.  The
    rotation and the radius are fitted on at most ``fit_rows`` rows; every row is
    indexed.  A block with fewer than k codes in reach is probed further, so all
    rows are returned if there are fewer than k.  Null, zero or non-finite
    vectors take no part (see :func:`tidewell.llm.vectors.vectors_of` for
    null ids, repeated ids and odd lengths); an empty table gives no rows.  Ties go to the smaller id.
    """
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    rows, n, _ = vectors_of(df, id_col, vector_col, zero_counts=False)
    schema = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    codes = BinaryCodes(sample_matrix(rows, fit_rows), k)
    found = search_cells(rows, n, is_query, rows.filter(is_query).count(), block_rows, group_rows, _probe(codes, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
