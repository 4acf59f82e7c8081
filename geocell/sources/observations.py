"""Observation sources and the upsert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geohash import encode


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """parse() of all files below a folder, with the file each row is from."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse(lines)


def parse(lines: DataFrame) -> DataFrame:
    """lat, lon, ts_raw, raw, good and the other columns of lines (value, ...); header lines begin with LAT. Rows whose
    numbers do not parse keep nulls and good = false, so that they can be counted."""
    f = F.split("value", ",")
    rest = [F.col(f"`{c}`") for c in lines.columns if c != "value"]
    rows = lines.where(~F.startswith("value", F.lit("LAT"))).select(F.get(f, F.lit(0)).try_cast("double").alias("lat"), F.get(f, F.lit(1)).try_cast("double").alias("lon"), F.get(f, F.lit(2)).alias("ts_raw"), F.col("value").alias("raw"), *rest)
    return rows.withColumn("good", F.col("lat").isNotNull() & F.col("lon").isNotNull())


def read_labelled(spark: SparkSession, path: str, features: int, label: int = 0, sep: str = ",") -> DataFrame:
    """label, features (array of doubles) and good of separated text with `features` + 1 fields a line, the label in field
    `label`. Lines with other fields or numbers that do not parse have good = false."""
    f = F.split("value", f"\\Q{sep}\\E", -1)
    numbers = F.array(*[F.trim(F.get(f, F.lit(k))).try_cast("double") for k in range(features + 1) if k != label])
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.get(f, F.lit(label))).alias("label"), numbers.alias("features"), F.size(f).alias("fields"))
    return rows.select("label", "features", ((F.col("fields") == features + 1) & ~F.exists("features", lambda x: x.isNull())).alias("good"))


def keyed(rows: DataFrame, upper_range: int = 12) -> DataFrame:
    """rows with geohash and sub_geohash."""
    return rows.withColumn("geohash", encode(F.col("lat"), F.col("lon"))).withColumn("sub_geohash", F.substring("geohash", 1, upper_range))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what a store of puts would hold."""
    last = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def points_of_events(events: DataFrame) -> DataFrame:
    """Synthetic points from events: near uniform, by integer arithmetic."""
    lat = ((F.col("event_id") * 7919 + F.col("user_id") * 104729) % 180001 - 90000).cast("double") / 1000.0
    lon = ((F.col("event_id") * 15485863 + F.col("user_id") * 1299709) % 360001 - 180000).cast("double") / 1000.0
    return events.select("event_id", "user_id", "ts", lat.alias("lat"), lon.alias("lon"))


def write_points(points: DataFrame, path: str) -> None:
    """A table partitioned by the map's partition (part), sorted by geohash, so that a scan of one partition reads its files
    only. Rows are dealt by part and a hash of the rest, so that a hot partition is written by several tasks."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64("geohash"), F.lit(max(1, n // 64)))
    points.repartition(n, "part", slot).sortWithinPartitions("part", "geohash").write.mode("overwrite").partitionBy("part").parquet(path)


def read_points(spark: SparkSession, path: str, part: int | None = None) -> DataFrame:
    """The table, or one partition of it."""
    rows = spark.read.parquet(path)
    return rows if part is None else rows.where(F.col("part") == part)


def lookup(rows: DataFrame, key: dict) -> DataFrame:
    """The rows with this key."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def put(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with those of new, which replace rows of the same key. new has one row a key, as latest() gives."""
    return rows.join(new.select(*key), key, "left_anti").unionByName(new)


def remove(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows without those whose key is in keys."""
    return rows.join(keys, keys.columns, "left_anti")


def clear(rows: DataFrame) -> DataFrame:
    """The table without rows."""
    return rows.where(F.lit(False))
