"""Connected components of a distributed edge list: alternating large and small stars, no link leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the smallest of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type to (node, root): root is the smallest node reachable.

    Isolated nodes, and loops, do not appear. Each round is written to the shared folder. Joins on a hot node can be
    split by adaptive execution, and every aggregate combines before it shuffles.
    """
    now = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == before or not state.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
