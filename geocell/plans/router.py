"""The adaptive cell map: routing of geohashes to partitions, splits and placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geohash import ALPHABET

MAX_PARTITIONS = 20_000
CHILDREN = len(ALPHABET) ** 2


def base_map(spark: SparkSession) -> DataFrame:
    """prefix, part: the 1,024 two-letter prefixes, numbered in order."""
    letter = lambda c: F.substring(F.lit(ALPHABET), (c + 1).cast("int"), F.lit(1))
    n = len(ALPHABET)
    return spark.range(CHILDREN).select(F.concat(letter(F.floor(F.col("id") / n)), letter(F.col("id") % n)).alias("prefix"), F.col("id").cast("int").alias("part"))


def split(cells: DataFrame, hot: list[str]) -> DataFrame:
    """The map with each hot prefix replaced by its 1,024 children two letters longer; ids go on after the largest."""
    last, size = cells.agg(F.max("part"), F.count(F.lit(1))).first()
    present = {r[0] for r in cells.where(F.col("prefix").isin(hot)).select("prefix").collect()} if hot else set()
    chosen = [h for h in dict.fromkeys(hot) if h in present]
    if last + len(chosen) * CHILDREN >= MAX_PARTITIONS:
        raise ValueError(f"{len(chosen)} splits need more than {MAX_PARTITIONS} partitions")
    out = cells.where(~F.col("prefix").isin(chosen)) if chosen else cells
    for k, h in enumerate(chosen):
        children = base_map(cells.sparkSession).select(F.concat(F.lit(h), "prefix").alias("prefix"), (F.col("part") + last + 1 + k * CHILDREN).cast("int").alias("part"))
        out = out.unionByName(children)
    return out


def route(points: DataFrame, cells: DataFrame, geohash: str = "geohash") -> DataFrame:
    """points with `part`: that of the shortest prefix in the map, -1 without one.

    The map goes to all executors: it has MAX_PARTITIONS rows at most, which is checked.
    """
    if cells.limit(MAX_PARTITIONS + 1).count() > MAX_PARTITIONS:
        raise ValueError("the cell map is too large")
    lengths = sorted(r[0] for r in cells.select(F.length("prefix")).distinct().collect())
    out = points
    for k in lengths:
        own = cells.where(F.length("prefix") == k).select(F.col("prefix").alias(f"_prefix{k}"), F.col("part").alias(f"_part{k}"))
        out = out.join(F.broadcast(own), F.substring(F.col(geohash), 1, k) == F.col(f"_prefix{k}"), "left")
    part = F.coalesce(*[F.col(f"_part{k}") for k in lengths], F.lit(-1)).alias("part")
    return out.select(*[F.col(f"`{c}`") for c in points.columns], part)


def contiguous(part: Column, nodes: int, parts: int) -> Column:
    """The node (from 0) of a partition when nodes hold runs of partitions; null for what is left over at the end."""
    if nodes == 1:
        return F.lit(0)
    first = -(-CHILDREN // nodes)
    node = F.when(part < CHILDREN, F.floor(part / first)).otherwise(F.floor(part / F.lit(max(1, parts // nodes))))
    return F.when(node < nodes, node.cast("int"))


def donated(placed: DataFrame, moves: DataFrame) -> DataFrame:
    """placed (part, node) with the partitions of moves (part, node) at their new node; a repeated move counts once."""
    to = moves.groupBy("part").agg(F.min("node").alias("_to"))
    return placed.join(to, "part", "left").select("part", F.coalesce("_to", "node").alias("node"))


def split_override(placed: DataFrame, start: int, end: int, node: int) -> DataFrame:
    return placed.withColumn("node", F.when(F.col("part").between(start, end), F.lit(node)).otherwise(F.col("node")))


def prefixes_of(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """part, prefix of the map's cells in the partitions of parts (part); a partition may have several."""
    return cells.join(F.broadcast(parts.select("part").distinct()), "part", "left_semi").select("part", "prefix")


def keep_previous(placed: DataFrame, before: DataFrame) -> DataFrame:
    """placed (part, node) where a node has left: partitions that had a node keep it, others get the new one."""
    old = before.groupBy("part").agg(F.min("node").alias("_before"))
    return placed.join(old, "part", "left").select("part", F.coalesce("_before", "node").alias("node"))


def moved(routed: DataFrame, before: DataFrame, after: DataFrame, geohash: str = "geohash") -> DataFrame:
    """The rows of routed (geohash, part, ...) whose partition is another one in the map `after` than in `before`, with
    part and new_part. Only partitions whose prefixes went from the map are read, and only those rows are rewritten."""
    gone = before.join(after.select("prefix"), "prefix", "left_anti").select("part").distinct()
    affected = routed.join(F.broadcast(gone), "part", "left_semi").withColumnRenamed("part", "_old")  # a map has 20,000 cells at most
    again = route(affected, after, geohash).withColumnsRenamed({"part": "new_part", "_old": "part"})
    return again.where("part <> new_part")


def semi_filter(points: DataFrame, valid: list[str], precision: int, geohash: str = "geohash") -> DataFrame:
    """The rows of points (geohash of `precision` letters) that share area with one of the valid cells: equal on the shorter
    one's letters, so one equality join for each length of the valid ones."""
    spark, out, met = points.sparkSession, points, F.lit(False)
    for n in sorted({min(len(v), precision) for v in valid}):
        keys = sorted({v[:n] for v in valid if min(len(v), precision) == n})
        own = spark.createDataFrame([(k,) for k in keys], f"_key{n} string")
        out = out.join(own, F.substring(F.col(geohash), 1, n) == F.col(f"_key{n}"), "left")
        met = met | F.col(f"_key{n}").isNotNull()
    return out.where(met).select(*[F.col(f"`{c}`") for c in points.columns])


def save(cells: DataFrame, folder: str) -> None:
    """A new version of the map beside the old ones; readers see it once it is whole."""
    spark = cells.sparkSession
    if cells.limit(MAX_PARTITIONS + 1).count() > MAX_PARTITIONS:
        raise ValueError("the cell map is too large")
    version = max(_versions(spark, folder), default=-1) + 1
    cells.coalesce(1).write.parquet(f"{folder}/map-{version:06d}")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The last whole version; an error where there is none, as an empty map would answer every query with nothing."""
    versions = _versions(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no cell map in {folder}")
    return spark.read.schema("prefix string, part int").parquet(f"{folder}/map-{max(versions):06d}")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path)]
    whole = [f.getName() for f in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return [int(n[4:]) for n in whole if n.startswith("map-") and n[4:].isdigit()]
