"""Skew statistics, hotspots and offers over partition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The monitor's constants.
ENTRY_BYTES = 2080
SPLIT_SLACK = 1500
MOVE_SLACK = 1000
HOT, DONOR, OFFER = 0.85, 0.35, 0.30
LEAST_MEMORY = 0.1


def stats(routed: DataFrame) -> DataFrame:
    """part, cnt, and on each row total and non_empty."""
    counts = routed.groupBy("part").agg(F.count(F.lit(1)).alias("cnt"))
    sums = counts.agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("non_empty"))
    return counts.join(F.broadcast(sums))  # one row


def node_stats(routed: DataFrame, placed: DataFrame) -> DataFrame:
    """node, part, cnt, and on each row the node's total and non_empty; rows of partitions without a node are left out.

    Counts are summed by partition before they meet the placement (part, node), which has 20,000 partitions at most.
    """
    counts = routed.groupBy("part").agg(F.count(F.lit(1)).alias("cnt")).join(placed.where("node is not null"), "part")
    per = counts.groupBy("node").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("non_empty"))
    return counts.join(per, "node").select("node", "part", "cnt", "total", "non_empty")


def of_group(nodes: DataFrame, group) -> DataFrame:
    """The nodes with an attribute grp of this value."""
    return nodes.where(F.col("grp") == F.lit(group))


def without_ghosts(counts: DataFrame, ghosts: DataFrame) -> DataFrame:
    """counts (part, cnt) less what ghosts (part, cnt) are only copies of."""
    g = ghosts.select(F.col("part").alias("_p"), F.col("cnt").alias("_g"))
    return counts.join(g, F.col("part") == F.col("_p"), "left").select("part", (F.col("cnt") - F.coalesce("_g", F.lit(0))).alias("cnt")).where("cnt > 0")


def memory_mb(counts: DataFrame, region_mb: float) -> DataFrame:
    """part, cnt, mb and the share of the node's region."""
    mb = F.col("cnt") * ENTRY_BYTES / F.lit(1048576.0)
    return counts.select("part", "cnt", mb.alias("mb"), (mb / F.lit(region_mb)).alias("usage"))


def top_fifth(counts: DataFrame) -> DataFrame:
    """The ceil(n / 5) largest partitions, by count, then number. A map has 20,000 partitions at most."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cnt").desc(), "part")))
    n = counts.agg(F.ceil(F.count(F.lit(1)) / 5).alias("k"))
    return ranked.join(F.broadcast(n)).where("rank <= k").select("part", "cnt", "rank")


def power_law(counts: DataFrame, region_mb: float | None = None) -> DataFrame:
    """One row: total, top (what the largest fifth holds) and skewed (nearly four fifths or more). With region_mb, the node's
    memory, a node that uses less than a tenth of it is never skewed."""
    total = counts.agg(F.sum("cnt").alias("total"))
    top = top_fifth(counts).agg(F.sum("cnt").alias("top"))
    skewed = F.floor(F.col("total") * 4 / 5) - F.col("top") <= SPLIT_SLACK
    if region_mb is not None:
        skewed &= F.col("total") * ENTRY_BYTES / F.lit(1048576.0) / F.lit(region_mb) >= LEAST_MEMORY
    return total.join(top).select("total", "top", skewed.alias("skewed"))


def hot_node(nodes: DataFrame) -> DataFrame:
    """One row from nodes (node, mem, cpu): the node to relieve, the cause (CM both, M memory, C cpu), and whether it is hot."""
    best = nodes.agg(F.max_by("node", F.struct("mem", "node")).alias("mem_node"), F.max("mem").alias("mem"), F.max_by("node", F.struct("cpu", "node")).alias("cpu_node"), F.max("cpu").alias("cpu"))
    cause = F.when(F.col("mem_node") == F.col("cpu_node"), "CM").when(F.col("cpu") > F.col("mem"), "C").otherwise("M")
    return best.select(F.when(cause == "C", F.col("cpu_node")).otherwise(F.col("mem_node")).alias("node"), cause.alias("cause"), ((F.col("mem") > HOT) | (F.col("cpu") > HOT)).alias("hot"))


def offers(nodes: DataFrame) -> DataFrame:
    """grp, node, mem, capacity: each group's node with the least memory in use."""
    least = F.min_by(F.struct("node", "mem", "capacity"), F.struct("mem", "node"))
    return nodes.groupBy("grp").agg(least.alias("o")).select("grp", "o.node", "o.mem", "o.capacity")


def best_offer(found: DataFrame) -> DataFrame:
    """The offer with the least usage, then the most capacity, if its usage is low enough."""
    return found.orderBy("mem", F.col("capacity").desc(), "grp").limit(1).where(F.col("mem") < OFFER)


def donor(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("mem", "node").limit(1).where((F.col("mem") < DONOR) & (F.col("cpu") < DONOR))


def to_move(counts: dict[int, int]) -> list[int]:
    """Partitions to move off a node: the largest, then outwards the right neighbour if there is one, else the left, until
    less than MOVE_SLACK is missing of two thirds, which is looked at after each step, or either side leaves the range.
    Sequential by nature, over 20,000 counts at most."""
    goal = sum(counts.values()) * 2 // 3
    if goal <= MOVE_SLACK:
        return []
    start = min(counts, key=lambda p: (-counts[p], p))
    low, high, left, done = min(counts), max(counts), goal - counts[start], [start]
    step = 1
    while low <= start - step and start + step <= high:
        at = start + step if start + step in counts else start - step
        if at in counts:
            done.append(at)
            left -= counts[at]
        if left < MOVE_SLACK:
            break
        step += 1
    return done
