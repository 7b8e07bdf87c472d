"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round re-hangs every node on the least node of its neighbourhood.  Both steps are a grouped
minimum (with map-side combine) joined back to the edges, so a node with very many edges costs one
skewed join side, which adaptive execution splits.  No edge, label or component leaves the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Edges that a file of a round holds at least.
ROWS = 20_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) pairs of longs -> (node, component), the component being its least node.

    Self loops are ignored, so a node that has no other edge is not returned.
    """
    few = lambda df, n: df.coalesce(max(1, -(-n // ROWS)))
    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, n = None, now.count()
    for _ in range(rounds):
        # a round leaves no more edges than there were, so their number says how many files it needs
        now = checkpointed(few(_small_star(_large_star(now)), n))
        # a is unique and b its root as soon as the edges are stars: rows and sums then stand still
        found = now.agg(F.count("*").alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found.n, found.b, found.h) == mark:
            break
        mark, n = (found.n, found.b, found.h), found.n
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
