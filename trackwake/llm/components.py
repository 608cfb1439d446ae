"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackwake.llm.common import checkpointed, spread_join


def _star(links: DataFrame, *, large: bool) -> DataFrame:
    """Hang neighbours of every node on the smallest node among them and it.

    The large star moves a node's larger neighbours, the small star the node
    and its smaller ones. Both keep what is connected connected.
    """
    a, b = F.col("a"), F.col("b")
    if large:
        around = links.union(links.select(b.alias("a"), a.alias("b")))
    else:
        around = links.select(
            F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
        )
    smallest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = spread_join(around, smallest, "a", F.col("b"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            smallest.select("a", F.col("m").alias("b"))
        )
    return moved.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b: longs), root the smallest.

    Each round is written to the checkpoint folder, so a lost executor costs one
    round at most; the driver sees two numbers a round. Links to itself and
    repeated links do no harm. Empty links give no rows.
    """

    def state(frame: DataFrame) -> tuple:
        mixed = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))
        return tuple(frame.agg(F.count("*"), F.sum(mixed)).first())

    edges = checkpointed(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = state(edges)
    while seen[0]:
        edges = checkpointed(_star(_star(edges, large=True), large=False))
        now = state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b"))).distinct()
