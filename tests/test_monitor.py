"""The skew monitor as a stream, labelled files, and what the flank and orientation functions do at the borders."""

import pytest
from pyspark.sql import functions as F

from geocell.functions import geohash as G
from geocell.functions import polygon as P
from geocell.functions import temporal
from geocell.plans import polygon_query
from geocell.sources import observations as obs
from geocell.streaming.monitor import monitor


def test_monitor_reports_skewed_batches(spark, tmp_path):
    source = f"file://{tmp_path}/rows"
    even = spark.range(4000).select((F.col("id") % 20).cast("int").alias("part"))
    skewed = spark.range(4000).select(F.when(F.col("id") % 100 < 79, F.col("id") % 4).otherwise(4 + F.col("id") % 16).cast("int").alias("part"))
    seen = {}
    even.write.mode("append").parquet(source)
    stream = monitor(spark.readStream.schema("part int").parquet(source), lambda stats, batch: seen.update({batch: stats.first()}), f"file://{tmp_path}/state", "1 second")
    try:
        stream.processAllAvailable()
        assert not seen
        skewed.write.mode("append").parquet(source)
        stream.processAllAvailable()
        assert len(seen) == 1
    finally:
        stream.stop()


def test_labelled_files(spark, tmp_path):
    (tmp_path / "flowers.txt").write_text("1.5,2,a\n\n3,x,b\n4,5\n6,7.25, c\n")
    rows = obs.read_labelled(spark, f"file://{tmp_path}/flowers.txt", 2, label=2).collect()
    assert [(r.label, r.features) for r in rows if r.good] == [("a", [1.5, 2.0]), ("c", [6.0, 7.25])]
    assert sum(not r.good for r in rows) == 2


def test_orientation_round_the_globe(spark):
    pairs = [("9x", "9x"), ("9x", "9x0"), ("8", "x"), ("x", "8"), ("9", "s"), ("b", "8"), ("80p", "xb"), ("8", "xzz")]
    for a, b in pairs:
        one = spark.createDataFrame([(a, b)], "a string, b string").select(G.orientation(F.col("a"), F.col("b"), len(a), len(b)).alias("o")).first().o
        (s, n, w, e), (t, m, v, f) = P.decode(a), P.decode(b)
        rows = "" if s >= t and n <= m or t >= s and m <= n else "n" if s == m or s == -90 and m == 90 else "s" if n == t or n == 90 and t == -90 else None
        columns = "" if w >= v and e <= f or v >= w and f <= e else "e" if w == f or w == -180 and f == 180 else "w" if e == v or e == 180 and v == -180 else None
        assert one == ("ignore" if rows is None or columns is None else rows + columns or "full"), (a, b)


def test_combined_orientation(spark):
    rows = spark.createDataFrame([("n", "up"), ("ignore", "full"), ("full", "ignore")], "s string, t string")
    assert [r[0] for r in rows.select(temporal.combined(F.col("s"), F.col("t"))).collect()] == ["n-up", "ignore-full", "ignore-ignore"]


def test_too_many_cells_meet_the_polygon(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    with pytest.raises(ValueError, match="fewer letters"):
        polygon_query.valid_neighbours(points, P.CONTINENT, 2, 3, most=10)
