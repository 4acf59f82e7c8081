"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, hot: float = 1e-3) -> DataFrame:
    """node and component (its smallest node) for the nodes of edges (a, b; long).

    Alternating large-star and small-star steps: each is a grouped minimum and a join, and halves the depth of what is left,
    so that the rounds grow with the logarithm of the longest path; they end when a round changes nothing. No step gathers
    a node's neighbours. The edges of a node that has more than the share `hot` of all meet a broadcast row (there are at
    most 2 / hot such nodes), the others are joined. Each round is written to the shared folder; the driver sees a count and
    two sums a round. Self-loops make a node of its own; no edges, no rows.
    """
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def met(e: DataFrame, least: DataFrame, total: int) -> DataFrame:
        """e with m, the least node that least (a, m, n) has for its a."""
        most = max(1, int(total * hot))
        few = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
        return e.join(few, "a").unionByName(e.join(few.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a"))

    def stars(e: DataFrame, total: int, large: bool) -> DataFrame:
        if large:  # every larger neighbour goes to the smallest of the neighbourhood
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
            return met(both.where("b > a"), least, total).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # here b < a: all smaller neighbours and the node itself
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = met(e, least, total)
        return moved.select("a", F.col("m").alias("b")).unionByName(moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()

    nodes = edges.select(F.col("a").alias("n")).unionByName(edges.select(F.col("b").alias("n"))).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sums(now)
    while before[0]:
        large = written(stars(now, before[0], True), before[0])
        now = written(stars(large, before[0], False), before[0])
        after = sums(now)
        if after == before:
            break
        before = after
    return nodes.join(now, F.col("n") == F.col("a"), "left").select(F.col("n").alias("node"), F.coalesce("b", "n").alias("component"))
