"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import cover_tree, hamming_index
from tidewell.llm.queries import op1_hamming_index, op7_cover_tree

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, score string"


def _rows(spark, extra=()):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(8, 12))
    x = [(i, (centers[i % 8] + 0.2 * rnd.normal(size=12)).astype(np.float32).tolist()) for i in range(400)]
    x[17] = (17, x[16][1])  # a tie
    return x, spark.createDataFrame([(i, v, "clash") for i, v in x + list(extra)], SCHEMA)


BAD = [(500, None), (600, [float("nan")] * 12), (700, [float("inf")] + [0.0] * 11), (800, [None] + [1.0] * 11), (None, [1.0] * 12), (900, [1.0] * 5), (1000, [])]


def _brute(x, step, k, cost):
    out = {}
    for q, v in x:
        if q % step == 0:
            out[q] = sorted((cost(np.array(v, float), np.array(w, float)), i) for i, w in x if i != q)[:k]
    return out


def test_products_are_exact(spark):
    x, df = _rows(spark, BAD + [(1100, [0.0] * 12), (3, [9.0] * 12)])  # a repeated id: the least vector counts
    x.append((1100, [0.0] * 12))
    whole = [(i, np.floor(256 * np.array(v, float))) for i, v in x]
    want = _brute(whole, 50, 5, lambda a, b: -int(a @ b))
    got = cover_tree.top_products(df, block_rows=64, group_rows=4).orderBy("query_id", "rank").collect()
    assert [(g.query_id, g.rank, g.vec_id, g.score) for g in got] == [
        (q, r + 1, i, -c) for q in sorted(want) for r, (c, i) in enumerate(want[q])]


def test_trees_prune_and_cover():
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(c, 0.01, size=(300, 3)) for c in ((0, 0, 9), (9, 0, 0), (0, 9, 0))])
    tree = cover_tree.build(x, np.arange(len(x)), leaf=16)
    nodes, waiting = [], [tree]
    while waiting:
        node = waiting.pop()
        nodes.append(node)
        waiting += node.children
        assert np.sqrt(((x[node.points] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-12
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
    assert len(nodes) > 3


def test_trees_of_equally_far_points():
    """Where a node has more than ``fan`` children at half its radius there is a tree all the same, and the search stays exact."""
    x = np.floor(256 * np.random.default_rng(2).normal(size=(2000, 64)))
    tree = cover_tree.build(x, np.arange(len(x)))
    leaves, waiting = [], [tree]
    while waiting:
        node = waiting.pop()
        waiting += node.children
        assert np.sqrt(((x[node.points] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-9
        if not node.children:
            leaves.append(node.points)
    assert len(leaves) > 8 and max(map(len, leaves)) <= 256 and sorted(np.concatenate(leaves)) == list(range(2000))
    q = x[:40]
    at, row, score = cover_tree.dual_search(np.arange(40), q, np.arange(2000), x, 5, np.full(40, -np.inf))
    want = q @ x.T
    want[np.arange(40), np.arange(40)] = -np.inf
    assert all(sorted(score[at == i]) == sorted(want[i])[-5:] for i in range(40))


def test_nearest_within_reach(spark):
    x, df = _rows(spark, BAD + [(1200, [0.0] * 12)])
    want = _brute(x, 100, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
    got = hamming_index.nearest(df, block_rows=100, fit_rows=200).collect()
    hits = sum(g.vec_id in {i for _, i in want[g.query_id]} for g in got)
    assert len(got) == 40 and hits >= 36
    exact = {(q, i): c for q in want for c, i in want[q]}
    assert all(abs(g.score - exact.get((g.query_id, g.vec_id), g.score)) < 1e-12 for g in got)
    few = hamming_index.nearest(df.filter("vec_id in (100, 101, 102)")).orderBy("rank").collect()
    assert [g.rank for g in few] == [1, 2] and {g.vec_id for g in few} == {101, 102}
    assert hamming_index.nearest(df.limit(0)).count() == 0 and cover_tree.top_products(df.limit(0)).count() == 0


def test_pigeonhole_finds_every_code_in_the_radius():
    rnd = np.random.default_rng(9)
    codes = hamming_index.BinaryCodes(rnd.normal(size=(300, 64)), 5, rounds=3)
    a, b = codes.encode(rnd.normal(size=(50, 64))), codes.encode(rnd.normal(size=(50, 64)))
    parts = hamming_index._BITS[a[:, None] ^ b[None]]
    near = codes.differing(a[:, None], b[None]) <= codes.radius
    assert (parts[near].min(axis=-1) <= codes.radius // a.shape[1]).all()


def test_queries_on_given_vectors(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = [(r.vec_id, r.embedding) for r in t]
    want = _brute(x, 100, 10, lambda a, b: float(((a - b) ** 2).sum()))
    got = op1_hamming_index(spark, SF).collect()
    assert sum(g.vec_id in {i for _, i in want[g.query_id]} for g in got) >= 0.9 * sum(map(len, want.values()))
    whole = [(i, np.floor(256 * np.array(v, float))) for i, v in x]
    want = _brute(whole, 50, 5, lambda a, b: -int(a @ b))
    assert sorted((g.query_id, g.rank, g.vec_id, g.score) for g in op7_cover_tree(spark, SF).collect()) == sorted(
        (q, r + 1, i, -c) for q in want for r, (c, i) in enumerate(want[q]))
