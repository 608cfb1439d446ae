from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwake.llm import topk


def brute(rows, every, k):
    vectors: dict = {}
    for vec_id, v in rows:
        if vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * x) for x in v]
        vectors[vec_id] = min(whole, vectors.get(vec_id, whole))
    found = []
    for q, a in vectors.items():
        if q % every == 0:
            scores = sorted(
                (-sum(x * y for x, y in zip(a, b)), c)
                for c, b in vectors.items()
                if c != q and len(a) == len(b)
            )[:k]
            found += [(q, r + 1, c, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, c) in enumerate(scores)]
    return sorted(found)


def check(spark, rows, every=5, k=5, kind="double", **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    frame = frame.selectExpr("*", "1 AS score", "2 AS v", "3 AS shard").repartition(3)
    got = topk.inner_product_topk(frame, F.col("vec_id") % every == 0, k=k, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every, k)


def cloud(seed: int, n: int, width: int, spread: float = 1.0) -> list[tuple]:
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [
        (i, [c + spread * draw.gauss(0, 0.3) for c in draw.choice(centers)]) for i in range(n)
    ]


@pytest.mark.parametrize("shard_rows, group", [(40, 2), (10_000, 8)])
def test_clouds(spark, shard_rows, group):
    rows = cloud(1, 400, 6)
    check(spark, rows, shard_rows=shard_rows, group_shards=group, query_rows=30)


def test_ties_copies_and_bad_vectors(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(40)] + [(100 + i, [0.0, 0.0, 0.0]) for i in range(10)]
    rows += [
        (5, same),
        (5, [9.0, 9.0, 9.0]),
        (200, None),
        (201, []),
        (202, [1.0, None, 0.0]),
        (203, [float("nan"), 0.0, 0.0]),
        (204, [float("inf"), 0.0, 0.0]),
        (None, same),
        (205, [-1e-20, 0.1, 0.2]),
        (206, [1.0, 2.0]),
        (210, [1.0, 2.0]),
        (300, [4.0]),
    ]
    check(spark, rows)
    check(spark, [(0, same)])
    check(spark, [(1, same), (2, same)])


def test_large_numbers_are_exact(spark):
    rows = [(i, [1e12 + i, -1e13, 3.5e9 * i]) for i in range(20)]
    rows += [(50, [1e6, 1e6, 1e6]), (55, [2.0**60, 1.0, 0.0]), (60, [2.0**60, 0.0, 0.0])]
    check(spark, rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.inner_product_topk(frame, F.col("vec_id") % 5 == 0).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8)) * 200
    vectors = np.floor(np.repeat(centers, 200, axis=0) + rng.normal(size=(4000, 8)) * 3)
    ids = np.arange(len(vectors))
    tree = topk.BallTree(ids, vectors, leaf_rows=50)
    queries = vectors[::400]
    norms = np.linalg.norm(queries, axis=1)
    leaves, nodes = [], [tree.root]
    while nodes:
        node = nodes.pop()
        own = tree.vectors[node.first : node.last]
        assert (node.bounds(queries, norms) >= (queries @ own.T).max(axis=1)).all()
        if node.left is None:
            leaves.append(node)
        else:
            nodes += [node.left, node.right]
    assert sorted(i for n in leaves for i in range(n.first, n.last)) == list(range(4000))
    best = topk.Best(ids[::400], queries, 5)
    opened = []
    offer = best.offer
    best.offer = lambda rows, *rest: (opened.append(len(rows)), offer(rows, *rest))
    best.search(tree)
    assert sum(opened) < 0.5 * len(leaves) * len(queries)
