"""Exact inner-product top-k by branch and bound over ball trees.

Vectors are dealt into shards of bounded size, each with a ball tree. A block of
queries walks the trees of a group of shards one after the other, nodes with the
largest upper bound of the inner product first, and carries its k-th best scores
from node to node and shard to shard: a node is opened only for the queries whose
k-th score its bound reaches.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 4096
LEAF_ROWS = 128
QUERY_ROWS = 8192
GROUP_SHARDS = 16
SCALE = 256
#: Products of numbers up to this are exact in a float's 53 bits for any usual width.
_FLOAT_SAFE = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)
_LARGEST = 10**37


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a double; null where one is not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    usable = F.forall(
        scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    # Beyond 53 bits a double is whole, and floor() would clip it to a long.
    floored = lambda x: F.when(
        F.abs(x) < _FLOAT_SAFE, F.floor(x).cast("double")
    ).otherwise(x)
    return F.when(usable, F.transform(scaled, floored))


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers held as floats, never rounded.

    Where a float could round they are added up as Python integers.
    """
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)))
    peak = np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1]
    if peak < _FLOAT_SAFE:
        return queries @ vectors.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(queries) @ whole(vectors).T, -_LARGEST, _LARGEST)


class Node:
    """A ball around rows first..last of its tree, with two children or none."""

    __slots__ = ("center", "first", "last", "left", "radius", "right")

    def __init__(self, vectors: np.ndarray, first: int, last: int):
        own = vectors[first:last]
        self.first, self.last, self.left, self.right = first, last, None, None
        self.center = own.mean(axis=0)
        self.radius = float(np.sqrt(((own - self.center) ** 2).sum(axis=1).max()))

    def bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """At least the inner product of each query with any row, rounding included."""
        bound = queries @ self.center + norms * self.radius
        slack = norms * (np.linalg.norm(self.center) + self.radius)
        return np.nan_to_num(bound + slack * 1e-9 + 1e-6, nan=np.inf, posinf=np.inf)


def _narrowest(whole: np.ndarray) -> np.ndarray:
    """The same whole numbers in half or a quarter of the bytes where they fit."""
    peak = np.abs(whole).max(initial=0)
    for kind in (np.int16, np.int32):
        if peak <= np.iinfo(kind).max:
            return whole.astype(kind)
    return whole


class BallTree:
    """Splits rows at the median between two far ends until a leaf holds few."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.root = self._grow(vectors, order, 0, len(ids), leaf_rows)
        self.ids, self.vectors = ids[order], _narrowest(vectors[order])

    def _grow(
        self, vectors: np.ndarray, order: np.ndarray, first: int, last: int, leaf_rows: int
    ) -> Node:
        rows = vectors[order[first:last]]
        node = Node(rows, 0, len(rows))
        node.first, node.last = first, last
        if last - first <= leaf_rows or node.radius == 0:
            return node
        far = rows[((rows - node.center) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
        along = rows @ (other - far)
        middle = (last - first) // 2
        order[first:last] = order[first:last][np.argpartition(along, middle)]
        node.left = self._grow(vectors, order, first, first + middle, leaf_rows)
        node.right = self._grow(vectors, order, first + middle, last, leaf_rows)
        return node


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.linalg.norm(vectors, axis=1)
        self.found: list[list[tuple]] = [[] for _ in ids]
        self.kth = np.full(len(ids), -np.inf)

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = exact_products(self.vectors[rows], vectors)
        scores_f = scores.astype(float)
        scores_f[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        hits = (scores_f >= self.kth[rows][:, None]) & (scores_f > -np.inf)
        for at in np.flatnonzero(hits.any(axis=1)):
            row, near = rows[at], np.flatnonzero(hits[at])
            merged = self.found[row] + [(-int(scores[at, j]), int(ids[j])) for j in near]
            merged.sort()
            self.found[row] = merged[: self.k]
            if len(merged) >= self.k:
                # Rounded down a little, so that large equal scores still tie.
                worst = float(-self.found[row][-1][0])
                safe = abs(worst) < _FLOAT_SAFE
                self.kth[row] = worst if safe else worst - abs(worst) * 1e-15

    def search(self, tree: BallTree) -> None:
        """Open nodes in the order of their largest bound, for the queries they may serve."""
        bounds = tree.root.bounds(self.vectors, self.norms)
        turn = 0
        heap = [(-bounds.max(initial=-np.inf), turn, tree.root, np.arange(len(self.ids)), bounds)]
        while heap:
            _, _, node, rows, bounds = heapq.heappop(heap)
            open_ = bounds >= self.kth[rows]
            rows = rows[open_]
            if not len(rows):
                continue
            if node.left is None:
                own = slice(node.first, node.last)
                self.offer(rows, tree.ids[own], tree.vectors[own].astype(float))
                continue
            for child in (node.left, node.right):
                near = child.bounds(self.vectors[rows], self.norms[rows])
                turn += 1
                heapq.heappush(heap, (-near.max(), turn, child, rows, near))


def _table(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["vec_id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()).astype(float)


def inner_product_topk(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    group_shards: int = GROUP_SHARDS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products.

    Components become floor(scale * x). Ties go to the smaller id; a query is no
    candidate of its own. Vectors that are null, empty, or hold a component that
    is null or not finite take no part; vectors of another width than the
    query's are no candidates. Of rows that share an id the smallest vector
    counts, so repeated rows count once; rows with a null id take no part. Scores
    beyond a long are compared exactly, up to 37 digits, and returned as the
    nearest long.

    Shards and blocks of queries are dealt by hash and have about `shard_rows` and
    `query_rows` rows at any size of the table; a task holds one block and at most
    `group_shards` trees. A tree is sent once per block, a query once per group of
    shards, so larger blocks and groups move less and hold more.
    """
    usable = (
        vectors.select(F.col(id).cast("long").alias("vec_id"), quantized(F.col(vector), scale).alias("v"))
        .where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .withColumn("width", F.size("v"))
    )
    chosen = vectors.where(is_query).select(F.col(id).cast("long").alias("_query")).distinct()
    asked = usable.join(chosen, F.col("vec_id") == F.col("_query"), "left_semi")
    n_shards = -(-usable.count() // shard_rows) or 1
    n_blocks = -(-asked.count() // query_rows) or 1
    # Fewer shards to a task where tasks would be fewer than the session asks for.
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_groups = min(n_shards, max(-(-n_shards // group_shards), width // n_blocks))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(*_table(rows))
        return pd.DataFrame(
            {"width": [rows["width"].iloc[0]], "shard": [rows["shard"].iloc[0]], "tree": [pickle.dumps(tree)]}
        )

    trees = (
        usable.withColumn("shard", deal("shard", n_shards))
        .groupBy("width", "shard")
        .applyInPandas(plant, "width int, shard int, tree binary")
        .withColumn("part", F.pmod("shard", F.lit(n_groups)).cast("int"))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_trees = trees.withColumn("block", every(n_blocks))
    dealt_queries = asked.withColumn("block", deal("block", n_blocks)).withColumn(
        "part", every(n_groups)
    )

    def walk(queries: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        answers: list[tuple] = []
        if len(queries) and len(forest):
            best = Best(*_table(queries), k)
            for tree in forest.sort_values("shard")["tree"]:
                best.search(pickle.loads(tree))
            for query, found in zip(best.ids, best.found, strict=True):
                answers += [(int(query), other, str(-score)) for score, other in found]
        return pd.DataFrame(answers, columns=["query_id", "vec_id", "exact"])

    keys = ("width", "block", "part")
    found = (
        dealt_queries.groupBy(*keys)
        .cogroup(dealt_trees.groupBy(*keys))
        .applyInPandas(walk, "query_id long, vec_id long, exact string")
    )
    exact = F.col("exact").cast("decimal(38,0)")
    best_first = Window.partitionBy("query_id").orderBy(exact.desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    low, high = (F.lit(str(n)).cast("decimal(38,0)") for n in _LONG)
    return ranked.select(
        "query_id", "rank", "vec_id", F.greatest(low, F.least(high, exact)).cast("long").alias("score")
    )
