"""Files: CSV folders, the table partitioned by the map, saved maps."""

import pytest
from pyspark.sql import functions as F

from geocell.functions import geohash as G
from geocell.functions import polygon as P
from geocell.operators import skew
from geocell.plans import router
from geocell.sources import observations as obs


def test_csv_of_nested_folders(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "one.csv").write_text("LAT,LON,TS\n1.5,2.5,t1,x\nbad,3,t2\n")
    (tmp_path / "a/b/two.csv").write_text("-10,20,t3\n\n7\n")
    rows = obs.read_csv(spark, f"file://{tmp_path}").collect()
    assert sorted((r.lat, r.lon, r.ts_raw) for r in rows if r.good) == [(-10.0, 20.0, "t3"), (1.5, 2.5, "t1")]
    assert sorted(r.raw for r in rows if not r.good) == ["", "7", "bad,3,t2"]
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {"one.csv", "two.csv"}
    keyed = obs.keyed(obs.read_csv(spark, f"file://{tmp_path}").where("good"), 3).collect()
    assert all(len(r.geohash) == 12 and r.sub_geohash == r.geohash[:3] for r in keyed)


def test_scan_of_one_partition_reads_its_files_only(spark, tmp_path):
    points = spark.range(500).select((F.col("id") % 170 - 85).cast("double").alias("lat"), (F.col("id") * 7 % 350 - 175).cast("double").alias("lon"))
    routed = router.route(obs.keyed(points), router.base_map(spark))
    obs.write_points(routed, f"file://{tmp_path}/points")
    part = routed.first().part
    one = obs.read_points(spark, f"file://{tmp_path}/points", part)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    assert one.count() == routed.where(F.col("part") == part).count() > 0
    assert obs.read_points(spark, f"file://{tmp_path}/points").count() == 500


def test_maps_are_saved_in_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/map"
    with pytest.raises(FileNotFoundError):
        router.load(spark, folder)
    cells = router.base_map(spark)
    router.save(cells, folder)
    router.save(router.split(cells, ["9x"]), folder)
    assert router.load(spark, folder).count() == 2047
    (tmp_path / "map/map-000002").mkdir()  # a version that was not finished
    assert router.load(spark, folder).count() == 2047


def test_put_remove_lookup_clear(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (9, "z")], "k int, v string")
    assert sorted(map(tuple, obs.put(rows, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c"), (9, "z")]
    assert [tuple(r) for r in obs.remove(rows, new.select("k")).orderBy("k").collect()] == [(1, "a"), (3, "c")]
    assert [tuple(r) for r in obs.lookup(rows, {"k": 3}).collect()] == [(3, "c")] and obs.clear(rows).count() == 0


def test_decode_of_any_length(spark):
    hashes = ["9", "9x", "9xn", "s00000000000", "zzzz", "7ZzZ"]
    rows = spark.createDataFrame([(h,) for h in hashes], "h string").select("h", G.decode(F.col("h")).alias("b")).collect()
    for r in rows:
        assert [float(x) for x in P.decode(r.h)] == [r.b.lat_lo, r.b.lat_hi, r.b.lon_lo, r.b.lon_hi]


def test_neighbours_of_odd_cells(spark):
    df = spark.createDataFrame([("zz",)], "h string")
    assert df.select(G.neighbour(F.col("h"), "up", 2).alias("n")).first().n == ""
    east = df.select(G.neighbour(F.col("h"), "e", 2).alias("n")).first().n
    assert P.decode(east)[2] == -180 and P.decode(east)[0] == P.decode("zz")[0]
    with pytest.raises(Exception, match="blank"):
        spark.createDataFrame([(" ",)], "h string").select(G.neighbour(F.col("h"), "n", 2)).collect()


def test_polygon_pairs():
    square = lambda a, b, n: [(a, b), (a + n, b), (a + n, b + n), (a, b + n)]
    hook = [(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (0, 1)]
    assert P.intersects(square(0, 0, 2), square(1, 1, 2)) and P.shared_area(square(0, 0, 2), square(1, 1, 2)) == 1
    assert not P.intersects(square(0, 0, 1), square(1, 0, 1))  # a common edge
    assert P.encloses(square(0, 0, 4), square(1, 1, 2)) and not P.encloses(square(1, 1, 2), square(0, 0, 4))
    assert not P.intersects(hook, square(1, 2, 1)) and P.intersects(hook, square(2.5, 0.5, 1)) and P.encloses(square(0, 0, 4), hook)
    assert P.shared_area(hook, square(0, 0, 4)) == 7 and P.shared_area(hook[::-1], square(0, 0, 4)) == 7
    # a concave polygon whose middle is outside: the search from the centre finds nothing
    frame = [(0, 0), (40, 0), (40, 40), (38, 40), (38, 2), (0, 2)]
    assert P.cover_from_center(frame, 3) == [] and P.cover(frame, 3)
    assert P.cover_from_center(P.TRIANGLE, 3) == P.cover(P.TRIANGLE, 3)


def test_to_move_looks_after_each_step():
    assert skew.to_move({1: 100, 2: 9000, 3: 100}) == [2, 3]
    assert skew.to_move({2: 9000, 3: 100}) == [2]  # nothing on the left
    assert skew.to_move({0: 500, 5: 4000, 7: 3000, 9: 2000, 12: 1}) == [5, 7]  # nothing is one step away; the second step is enough
