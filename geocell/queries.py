"""The grid operators as queries over the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geohash as G
from .functions import polygon as P
from .functions import temporal
from .operators import knn, skew
from .plans import polygon_query, router
from .sources import observations as obs
from .sources.observations import latest, points_of_events

A = G.ALPHABET
PTS = """pts AS (SELECT event_id, user_id, ts,
  CAST((event_id * 7919 + user_id * 104729) % 180001 - 90000 AS DOUBLE) / 1000.0 AS lat,
  CAST((event_id * 15485863 + user_id * 1299709) % 360001 - 180000 AS DOUBLE) / 1000.0 AS lon FROM events)"""
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def points(spark, d):
    return points_of_events(spark.read.parquet(f"{d}/events.parquet"))


def hashed(spark, d, p=12):
    return points(spark, d).withColumn("geohash", G.encode(F.col("lat"), F.col("lon"), p))


# ---- SQL pieces ----------------------------------------------------------------------------------------------------


def sql_index(v, low, span, n, tie="high"):
    x = f"({v} + {-low}) / {span}.0 * {float(1 << n)}"
    at = f"floor({x})" if tie == "high" else f"ceil({x}) - 1"
    return f"least(greatest(CAST({at} AS BIGINT), 0), {(1 << n) - 1})"


def sql_letters(p, x="ix", y="iy"):
    nx, ny = G.bits(p)
    out = []
    for c in range(p):
        terms = [f"((({y if j % 2 else x} >> {(ny if j % 2 else nx) - 1 - j // 2}) & 1) << {5 * c + 4 - j})" for j in range(5 * c, 5 * c + 5)]
        out.append(f"substr('{A}', CAST({' + '.join(terms)} AS INT) + 1, 1)")
    return " || ".join(out)


def sql_hash(p, tie="high", lat="lat", lon="lon", source="pts", cols="event_id", name="geohash"):
    nx, ny = G.bits(p)
    return f"SELECT {cols}, {sql_letters(p)} AS {name} FROM (SELECT *, {sql_index(lon, -180, 360, nx, tie)} AS ix, {sql_index(lat, -90, 180, ny, tie)} AS iy FROM {source})"


def sql_box(p, h="geohash"):
    nx, ny = G.bits(p)
    code = lambda j: f"((instr('{A}', substr({h}, {j // 5 + 1}, 1)) - 1) >> {4 - j % 5} & 1)"
    x = " + ".join(f"({code(j)} << {nx - 1 - j // 2})" for j in range(0, 5 * p, 2))
    y = " + ".join(f"({code(j)} << {ny - 1 - j // 2})" for j in range(1, 5 * p, 2))
    return f"-90 + ({y}) * 180.0 / {1 << ny}::DOUBLE AS lat_lo, -90 + (({y}) + 1) * 180.0 / {1 << ny}::DOUBLE AS lat_hi, -180 + ({x}) * 360.0 / {1 << nx}::DOUBLE AS lon_lo, -180 + (({x}) + 1) * 360.0 / {1 << nx}::DOUBLE AS lon_hi"


def sql_inside(ring):
    terms = [f"CASE WHEN lat > {min(a, b)} AND lat <= {max(a, b)} AND lon < {x}::DOUBLE + (lat - {a}::DOUBLE) * ({y - x!r})::DOUBLE / ({b - a!r})::DOUBLE THEN 1 ELSE 0 END" for (a, x), (b, y) in P.edges(ring) if a != b]
    return f"({' + '.join(terms)}) % 2 = 1"


def sql_polygon(ring, select):
    return f"WITH {PTS} SELECT {select} FROM pts WHERE {sql_inside(ring)}"


MAP = f"SELECT substr('{A}', CAST(i // 32 AS INT) + 1, 1) || substr('{A}', CAST(i % 32 AS INT) + 1, 1) AS prefix, CAST(i AS INT) AS part FROM range(1024) t(i)"
HOT = "9x"
SPLIT = f"SELECT * FROM ({MAP}) WHERE prefix <> '{HOT}' UNION ALL SELECT '{HOT}' || prefix, CAST(part + 1024 AS INT) FROM ({MAP})"
ROUTED = f"r AS (SELECT h.event_id, h.geohash, coalesce(a.part, b.part, -1) AS part FROM h LEFT JOIN m a ON substr(h.geohash, 1, 2) = a.prefix LEFT JOIN m b ON substr(h.geohash, 1, 4) = b.prefix)"

# ---- grid ----------------------------------------------------------------------------------------------------------

for _p, _tie in ((2, "high"), (4, "high"), (6, "high"), (12, "high"), (6, "low")):

    @query(f"geohash_encode_p{_p}" if _tie == "high" else "geohash_encode_tie_low", f"WITH {PTS} {sql_hash(_p, _tie)}")
    def _encode(spark, d, p=_p, tie=_tie):
        return points(spark, d).select("event_id", G.encode(F.col("lat"), F.col("lon"), p, tie).alias("geohash"))


@query("geohash_decode_box", f"WITH {PTS}, h AS ({sql_hash(6)}) SELECT event_id, {sql_box(6)} FROM h")
def decode_box(spark, d):
    return hashed(spark, d, 6).select("event_id", G.decode(F.col("geohash"), 6).alias("b")).select("event_id", "b.*")


@query("geohash_to_long", f"WITH {PTS}, h AS ({sql_hash(12)}) SELECT event_id, " + " + ".join(f"(CAST(instr('{A}', substr(geohash, {k + 1}, 1)) - 1 AS BIGINT) << {55 - 5 * k})" for k in range(12)) + " AS code FROM h")
def to_long(spark, d):
    return hashed(spark, d).select("event_id", G.to_long(F.col("geohash")).alias("code"))


@query("box_center", f"WITH {PTS}, h AS ({sql_hash(5)}), b AS (SELECT event_id, {sql_box(5)} FROM h) SELECT event_id, (lat_lo + lat_hi) / 2 AS lat, (lon_lo + lon_hi) / 2 AS lon FROM b")
def box_center(spark, d):
    return hashed(spark, d, 5).select("event_id", G.center(G.decode(F.col("geohash"))).alias("c")).select("event_id", "c.*")


@query("cell_corners", f"WITH {PTS}, h AS ({sql_hash(4)}), b AS (SELECT event_id, {sql_box(4)} FROM h) SELECT event_id, 0 AS pos, lat_lo AS lat, lon_lo AS lon FROM b UNION ALL SELECT event_id, 1, lat_hi, lon_lo FROM b UNION ALL SELECT event_id, 2, lat_hi, lon_hi FROM b UNION ALL SELECT event_id, 3, lat_lo, lon_hi FROM b")
def cell_corners(spark, d):
    boxes = hashed(spark, d, 4).select("event_id", G.decode(F.col("geohash"), 4).alias("b"))
    return boxes.select("event_id", F.posexplode(G.corners(F.col("b")))).select("event_id", "pos", "col.*")


_moves = " UNION ALL ".join(f"SELECT event_id, {k} AS pos, (lat_lo + lat_hi) / 2 + {('n' in v) - ('s' in v)} * (lat_hi - lat_lo) AS la, (lon_lo + lon_hi) / 2 + {('e' in v) - ('w' in v)} * (lon_hi - lon_lo) AS lo FROM b" for k, v in enumerate(G.DIRECTIONS))


@query("geohash_neighbours", f"WITH {PTS}, h AS ({sql_hash(4)}), b AS (SELECT event_id, {sql_box(4)} FROM h), n AS ({_moves}), w AS (SELECT event_id, pos, CASE WHEN la > 90 THEN la - 180 WHEN la < -90 THEN la + 180 ELSE la END AS lat, CASE WHEN lo > 180 THEN lo - 360 WHEN lo < -180 THEN lo + 360 ELSE lo END AS lon FROM n) {sql_hash(4, source='w', cols='event_id, pos', name='neighbour')}")
def neighbours(spark, d):
    return G.with_neighbours(hashed(spark, d, 4).select("event_id", "geohash"), "geohash", 4).drop("geohash")


@query("grid_xy_compat", f"WITH {PTS} SELECT event_id, CAST(trunc((CAST(lon AS FLOAT) + 180::FLOAT) * 1073741824::FLOAT / 360::FLOAT) AS INT) AS x, CAST(trunc((90::FLOAT - CAST(lat AS FLOAT)) * 1073741824::FLOAT / 180::FLOAT) AS INT) AS y FROM pts")
def grid_xy(spark, d):
    return points(spark, d).select("event_id", G.grid_xy(F.col("lat"), F.col("lon")).alias("g")).select("event_id", "g.*")


@query("xy_roundtrip", f"WITH {PTS}, g AS (SELECT event_id, CAST(trunc((CAST(lon AS FLOAT) + 180::FLOAT) * 1073741824::FLOAT / 360::FLOAT) AS INT) AS x, CAST(trunc((90::FLOAT - CAST(lat AS FLOAT)) * 1073741824::FLOAT / 180::FLOAT) AS INT) AS y FROM pts) SELECT event_id, 90 - y * 180.0::DOUBLE / 1073741824 AS lat, x * 360.0::DOUBLE / 1073741824 - 180 AS lon FROM g")
def xy_roundtrip(spark, d):
    return points(spark, d).select("event_id", G.grid_xy(F.col("lat"), F.col("lon")).alias("g")).select("event_id", G.from_grid(F.col("g.x"), F.col("g.y")).alias("p")).select("event_id", "p.*")


@query("hash_prefix_range", f"WITH {PTS}, h AS ({sql_hash(3)}) SELECT event_id, rpad(geohash, 12, '0') AS lo, rpad(geohash, 12, 'z') AS hi FROM h")
def prefix_range(spark, d):
    return hashed(spark, d, 3).select("event_id", G.prefix_range(F.col("geohash"), 12).alias("r")).select("event_id", "r.*")


@query("validate_coordinates", f"WITH {PTS} SELECT event_id, CASE WHEN abs(lon) <= 90 THEN lon ELSE lat END AS lat, CASE WHEN abs(lon) <= 90 THEN lat ELSE lon END AS lon FROM pts")
def validate(spark, d):
    return points(spark, d).select("event_id", G.validated(F.col("lon"), F.col("lat")).alias("p")).select("event_id", "p.*")


# ---- polygons ------------------------------------------------------------------------------------------------------


def in_polygon(spark, d, ring):
    cells = router.base_map(spark)
    return polygon_query.inside(router.route(hashed(spark, d, 2), cells), cells, ring)


@query("polygon_count", sql_polygon(P.BOX_US, "CAST(count(*) AS BIGINT) AS n"))
def polygon_count(spark, d):
    return in_polygon(spark, d, P.BOX_US).agg(F.count(F.lit(1)).alias("n"))


@query("polygon_rows", sql_polygon(P.CONTINENT, "event_id, lat, lon"))
def polygon_rows(spark, d):
    return in_polygon(spark, d, P.CONTINENT).select("event_id", "lat", "lon")


@query("polygon_triangle", sql_polygon(P.TRIANGLE, "event_id"))
def polygon_triangle(spark, d):
    return in_polygon(spark, d, P.TRIANGLE).select("event_id")


_cover_ix, _cover_iy = G.bits(3)


@query("polygon_cover_p3", f"WITH c AS (SELECT x.ix, y.iy, -180 + x.ix * 360.0::DOUBLE / 256 AS lo, -90 + y.iy * 180.0::DOUBLE / 128 AS la FROM range(256) x(ix), range(128) y(iy)), k AS (SELECT *, CASE WHEN lo >= -112.06 AND lo + 1.40625 <= -101.05 AND la >= 34.08 AND la + 1.40625 <= 44.06 THEN 0 ELSE 1 END AS cls FROM c WHERE lo < -101.05 AND lo + 1.40625 > -112.06 AND la < 44.06 AND la + 1.40625 > 34.08) SELECT {sql_letters(3)} AS cell, cls FROM k")
def cover_p3(spark, d):
    return spark.createDataFrame(P.cover(P.BOX_US, 3), "cell string, cls int")


def sql_cells(p, ring):
    """cell, cls of the cells of p letters that a convex polygon meets: no side of either parts them."""
    nx, ny = G.bits(p)
    points = [a for a, _ in P.edges(ring)]
    if sum(a[1] * b[0] - b[1] * a[0] for a, b in P.edges(ring)) < 0:
        points.reverse()  # counter-clockwise, as (lon, lat)
    lats, lons = zip(*points, strict=True)
    inner, outer = [], [f"lo < {max(lons)} AND lo + {360 / (1 << nx)} > {min(lons)} AND la < {max(lats)} AND la + {180 / (1 << ny)} > {min(lats)}"]
    for (a, x), (b, y) in zip(points, points[1:] + points[:1], strict=True):
        side = [f"({y - x!r}::DOUBLE * (la + {i * 180 / (1 << ny)} - {a}) - {b - a!r}::DOUBLE * (lo + {j * 360 / (1 << nx)} - {x}))" for i in (0, 1) for j in (0, 1)]
        outer.append(f"greatest({', '.join(side)}) > 0")
        inner.append(f"least({', '.join(side)}) >= 0")
    grid = f"SELECT ix, iy, -180 + ix * 360.0::DOUBLE / {1 << nx} AS lo, -90 + iy * 180.0::DOUBLE / {1 << ny} AS la FROM range({1 << nx}) x(ix), range({1 << ny}) y(iy)"
    return f"SELECT {sql_letters(p)} AS cell, CASE WHEN {' AND '.join(inner)} THEN 0 ELSE 1 END AS cls FROM ({grid}) WHERE {' AND '.join(outer)}"


@query("polygon_cover_adaptive", f"WITH a AS ({sql_cells(1, P.CONTINENT)}), b AS ({sql_cells(2, P.CONTINENT)}), c AS ({sql_cells(3, P.CONTINENT)}) SELECT * FROM a WHERE cls = 0 UNION ALL SELECT b.* FROM b JOIN a ON a.cell = substr(b.cell, 1, 1) WHERE b.cls = 0 AND a.cls = 1 UNION ALL SELECT c.* FROM c JOIN b ON b.cell = substr(c.cell, 1, 2) WHERE b.cls = 1")
def cover_adaptive(spark, d):
    return spark.createDataFrame(P.cover(P.CONTINENT, 3, adaptive=True), "cell string, cls int")


@query("polygon_cover_from_center", f"WITH c AS ({sql_cells(3, P.TRIANGLE)}) SELECT * FROM c")
def cover_center(spark, d):
    return spark.createDataFrame(P.cover_from_center(P.TRIANGLE, 3), "cell string, cls int")


@query("cell_relation", f"WITH m AS ({MAP}), b AS (SELECT prefix, {sql_box(2, 'prefix')} FROM m) SELECT prefix, CASE WHEN lat_lo >= 44.06 OR lat_hi <= 34.08 OR lon_lo >= -101.05 OR lon_hi <= -112.06 THEN -1 WHEN lat_lo >= 34.08 AND lat_hi <= 44.06 AND lon_lo >= -112.06 AND lon_hi <= -101.05 THEN 0 ELSE 1 END AS cls FROM b")
def cell_relation(spark, d):
    cells = router.base_map(spark)
    met = polygon_query.classified(cells, P.BOX_US).select("prefix", "cls")
    return cells.join(F.broadcast(met), "prefix", "left").select("prefix", F.coalesce("cls", F.lit(P.DISJOINT)).alias("cls"))


@query("polygon_mbr", f"WITH {PTS} SELECT min(lat) AS lat_lo, max(lat) AS lat_hi, min(lon) AS lon_lo, max(lon) AS lon_hi FROM pts WHERE {sql_inside(P.CONTINENT)}")
def polygon_mbr(spark, d):
    inside = in_polygon(spark, d, P.CONTINENT)
    return inside.agg(F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"), F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"))


@query("bbox_filter", f"WITH {PTS} SELECT event_id, lat, lon FROM pts WHERE lat BETWEEN 34.08 AND 44.06 AND lon BETWEEN -112.06 AND -101.05")
def bbox_filter(spark, d):
    south, north, west, east = P.mbr(P.BOX_US)
    return points(spark, d).where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("event_id", "lat", "lon")


_VALID = ["c2", "c8", "9r", "9x", "9q", "9w"]


@query("hash_semi_filter", f"WITH {PTS}, h AS ({sql_hash(4)}) SELECT event_id, geohash FROM h WHERE EXISTS (SELECT 1 FROM (VALUES {', '.join(f'({v!r})' for v in _VALID)}) v(g) WHERE starts_with(h.geohash, v.g) OR starts_with(v.g, h.geohash))")
def hash_semi_filter(spark, d):
    return router.semi_filter(hashed(spark, d, 4), _VALID, 4).select("event_id", "geohash")


@query("geohash_encode_wrap", f"WITH {PTS}, o AS (SELECT event_id, lat * 1.25 AS la, lon * 1.25 AS lo FROM pts), w AS (SELECT event_id, CASE WHEN la > 90 THEN la - 180 WHEN la < -90 THEN la + 180 ELSE la END AS lat, CASE WHEN lo > 180 THEN lo - 360 WHEN lo < -180 THEN lo + 360 ELSE lo END AS lon FROM o) {sql_hash(6, 'low', source='w')}")
def encode_wrap(spark, d):
    return points(spark, d).select("event_id", G.encode_wrapped(F.col("lat") * 1.25, F.col("lon") * 1.25, 6).alias("geohash"))


@query("geohash_encode_center", f"WITH {PTS}, h AS ({sql_hash(3)}), b AS (SELECT event_id, {sql_box(3)} FROM h), c AS (SELECT event_id, (lat_lo + lat_hi) / 2 AS lat, (lon_lo + lon_hi) / 2 AS lon FROM b) {sql_hash(5, source='c')}")
def encode_center(spark, d):
    return hashed(spark, d, 3).select("event_id", G.encode_center(G.decode(F.col("geohash"), 3), 5).alias("geohash"))


@query("box_bounds", f"WITH {PTS}, h AS ({sql_hash(4)}), b AS (SELECT event_id, {sql_box(4)} FROM h) SELECT event_id, 'bounds' AS kind, 0 AS pos, lat_hi AS lat, lon_lo AS lon FROM b UNION ALL SELECT event_id, 'bounds', 1, lat_hi, lon_hi FROM b UNION ALL SELECT event_id, 'bounds', 2, lat_lo, lon_hi FROM b UNION ALL SELECT event_id, 'bounds', 3, lat_lo, lon_lo FROM b UNION ALL SELECT event_id, '2d', 0, lat_hi, lon_lo FROM b UNION ALL SELECT event_id, '2d', 1, lat_lo, lon_hi FROM b")
def box_bounds(spark, d):
    boxes = hashed(spark, d, 4).select("event_id", G.decode(F.col("geohash"), 4).alias("b"))
    kinds = [boxes.select("event_id", F.lit(k).alias("kind"), F.posexplode(f(F.col("b")))) for k, f in (("bounds", G.bounds), ("2d", G.bounds_2d))]
    return kinds[0].unionByName(kinds[1]).select("event_id", "kind", "pos", "col.*")


_BITS = " || ".join(f"CAST(((instr('{A}', substr(geohash, {k // 5 + 1}, 1)) - 1) >> {4 - k % 5}) & 1 AS VARCHAR)" for k in range(20))


@query("geohash_bits", f"WITH {PTS}, h AS ({sql_hash(4)}) SELECT event_id, {_BITS} AS bits, 20 AS n_bits FROM h")
def geohash_bits(spark, d):
    return hashed(spark, d, 4).select("event_id", G.bit_string(F.col("geohash"), 4).alias("bits")).withColumn("n_bits", F.length("bits"))


@query("hash_encloses", f"WITH {PTS}, h AS ({sql_hash(4)}) SELECT event_id, starts_with(geohash, '9x') AS inside FROM h")
def hash_encloses(spark, d):
    return hashed(spark, d, 4).select("event_id", G.encloses(F.lit("9x"), F.col("geohash")).alias("inside"))


_cells = f"c AS (SELECT DISTINCT ix, iy, {sql_letters(3)} AS geohash FROM (SELECT {sql_index('lon', -180, 360, 8)} AS ix, {sql_index('lat', -90, 180, 7)} AS iy FROM pts))"
_inner = f"k AS (SELECT geohash, a, b, {sql_letters(4)} AS cell FROM (SELECT geohash, a, b, c.ix * 4 + a AS ix, c.iy * 8 + b AS iy FROM c, range(4) x(a), range(8) y(b)))"
_sides = " UNION ALL ".join(f"SELECT geohash, '{d}' AS side, CAST({at} AS INT) AS pos, cell FROM k WHERE {where}" for d, at, where in (("n", "a", "b = 7"), ("s", "a", "b = 0"), ("w", "b", "a = 0"), ("e", "b", "a = 3")))


def cells_met(spark, d, p=3):
    return hashed(spark, d, p).select("geohash").distinct()


@query("geohash_borders", f"WITH {PTS}, {_cells}, {_inner} {_sides}")
def geohash_borders(spark, d):
    return cells_met(spark, d).select("geohash", F.inline(G.borders(F.col("geohash"), 3, 4)))


@query("geohash_corner_cells", f"WITH {PTS}, {_cells}, {_inner} SELECT geohash, CASE WHEN b = 7 THEN 'n' ELSE 's' END || CASE WHEN a = 3 THEN 'e' ELSE 'w' END AS side, cell FROM k WHERE a IN (0, 3) AND b IN (0, 7)")
def geohash_corner_cells(spark, d):
    return cells_met(spark, d).select("geohash", F.inline(G.borders(F.col("geohash"), 3, 4, ("nw", "ne", "sw", "se")))).drop("pos")


_ring = "w AS (SELECT geohash, -180 + ((ix + 255) % 256) * 360.0::DOUBLE / 256 AS x0, -180 + ((ix + 1) % 256 + 1) * 360.0::DOUBLE / 256 AS x1, -90 + ((iy + 127) % 128) * 180.0::DOUBLE / 128 AS y0, -90 + ((iy + 1) % 128 + 1) * 180.0::DOUBLE / 128 AS y1 FROM c)"


@query("geohash_outline", f"WITH {PTS}, {_cells}, {_ring} " + " UNION ALL ".join(f"SELECT geohash, {k} AS pos, {y} AS lat, {x} AS lon FROM w" for k, (y, x) in enumerate((("y0", "x0"), ("y1", "x0"), ("y1", "x1"), ("y0", "x1")))))
def geohash_outline(spark, d):
    boxes = cells_met(spark, d).select("geohash", G.outline_box(F.col("geohash"), 3).alias("b"))
    return boxes.select("geohash", F.posexplode(G.corners(F.col("b")))).select("geohash", "pos", "col.*")


_h3, _w3 = 180 / (1 << 10), 360 / (1 << 10)
_bands = {"n": (f"lat_hi - {_h3}", "lat_hi"), "s": ("lat_lo", f"lat_lo + {_h3}"), "": ("lat_lo", "lat_hi"), "w": ("lon_lo", f"lon_lo + {_w3}"), "e": (f"lon_hi - {_w3}", "lon_hi")}


def sql_flank(side):
    if side == "inner":
        return f"lat_lo + {_h3} AS y0, lat_hi - {_h3} AS y1, lon_lo + {_w3} AS x0, lon_hi - {_w3} AS x1"
    (a, b) = _bands["n" if "n" in side else "s" if "s" in side else ""]
    (x, y) = _bands["w" if "w" in side else "e"] if side not in "ns" else ("lon_lo", "lon_hi")
    return f"{a} AS y0, {b} AS y1, {x} AS x0, {y} AS x1"


_flanks = " UNION ALL ".join(f"SELECT geohash, '{side}' AS side, {sql_flank(side)} FROM b" for side in (*G.DIRECTIONS, "inner"))


@query("geohash_inner_flanks", f"WITH {PTS}, {_cells}, b AS (SELECT geohash, {sql_box(3)} FROM c), f AS ({_flanks}) " + " UNION ALL ".join(f"SELECT geohash, side, {k} AS pos, {y} AS lat, {x} AS lon FROM f" for k, (y, x) in enumerate((("y1", "x0"), ("y1", "x1"), ("y0", "x1"), ("y0", "x0")))))
def geohash_inner_flanks(spark, d):
    flanks = cells_met(spark, d).select("geohash", G.decode(F.col("geohash"), 3).alias("b")).select("geohash", F.inline(G.inner_flanks(F.col("b"), 4)))
    return flanks.select("geohash", "side", F.posexplode("ring")).select("geohash", "side", "pos", "col.*")


_near = ["9x", "c8", "dj", "zz", "80"]
_NEAR = ", ".join(f"('{v}')" for v in _near)
# boxes touch where an end of one is an end of the other, round the globe; the directions are those of the first from the second
_touch = """CASE WHEN a.lat_lo >= b.lat_lo AND a.lat_hi <= b.lat_hi OR b.lat_lo >= a.lat_lo AND b.lat_hi <= a.lat_hi THEN ''
  WHEN a.lat_lo = b.lat_hi OR a.lat_lo = -90 AND b.lat_hi = 90 THEN 'n' WHEN a.lat_hi = b.lat_lo OR a.lat_hi = 90 AND b.lat_lo = -90 THEN 's' END
  || CASE WHEN a.lon_lo >= b.lon_lo AND a.lon_hi <= b.lon_hi OR b.lon_lo >= a.lon_lo AND b.lon_hi <= a.lon_hi THEN ''
  WHEN a.lon_lo = b.lon_hi OR a.lon_lo = -180 AND b.lon_hi = 180 THEN 'e' WHEN a.lon_hi = b.lon_lo OR a.lon_hi = 180 AND b.lon_lo = -180 THEN 'w' END"""


_sides_of = f"""s AS (SELECT geohash, {sql_box(3)} FROM c), g AS (SELECT geohash, {sql_box(2)} FROM (VALUES {_NEAR}) v(geohash)),
t AS (SELECT s.geohash, g.geohash AS other, {_touch.replace('a.', 's.').replace('b.', 'g.')} AS ahead, {_touch.replace('a.', 'g.').replace('b.', 's.')} AS back FROM s, g)"""
_named = "coalesce(CASE WHEN {0} = '' THEN 'full' ELSE {0} END, 'ignore')"


@query("spatial_orientation", f"WITH {PTS}, {_cells}, {_sides_of} SELECT geohash, other, {_named.format('ahead')} AS ahead, {_named.format('back')} AS back FROM t")
def spatial_orientation(spark, d):
    place = lambda c, p: [v.alias(f"{c}_{k}") for k, v in zip("xy", G.cell(F.col(c), p), strict=True)]
    cells = cells_met(spark, d).select("geohash", *place("geohash", 3))
    pairs = cells.select("*", F.explode(F.array(*map(F.lit, _near))).alias("other")).select("*", *place("other", 2))
    a, b = ((F.col(f"{c}_x"), F.col(f"{c}_y")) for c in ("geohash", "other"))
    return pairs.select("geohash", "other", G.relative(a, b, 3, 2).alias("ahead"), G.relative(b, a, 2, 3).alias("back"))


_parent = "p AS (SELECT geohash AS fine, ix // 8 AS px, iy // 4 AS py, ix % 8 AS a, iy % 4 AS b FROM c), o AS (SELECT *, " + sql_letters(2, "px", "py") + " AS geohash FROM p)"
_place = "CASE WHEN b = 3 THEN 'n' WHEN b = 0 THEN 's' ELSE '' END || CASE WHEN a = 0 THEN 'w' WHEN a = 7 THEN 'e' ELSE '' END"
_strips = " UNION ".join(f"SELECT geohash, '{d}' AS side FROM z WHERE " + " AND ".join({"n": "b = 3", "s": "b = 0", "w": "a = 0", "e": "a = 7"}[x] for x in d) for d in G.DIRECTIONS)
_met = f"z AS (SELECT substr(cell, 1, 2) AS geohash, ix % 8 AS a, iy % 4 AS b FROM (SELECT k.cell, u.ix, u.iy FROM ({sql_cells(3, P.CONTINENT)}) k JOIN (SELECT ix, iy, {sql_letters(3)} AS name FROM range(256) x(ix), range(128) y(iy)) u ON u.name = k.cell)), m AS ({_strips})"
_step = "(px + 32 + CASE WHEN contains(side, 'e') THEN 1 WHEN contains(side, 'w') THEN -1 ELSE 0 END) % 32 AS qx, (py + 32 + CASE WHEN contains(side, 'n') THEN 1 WHEN contains(side, 's') THEN -1 ELSE 0 END) % 32 AS qy"


@query("neighbour_validity", f"WITH {PTS}, {_cells}, {_parent}, {_met}, e AS (SELECT DISTINCT geohash, px, py, {_place} AS side FROM o), v AS (SELECT geohash, side, {_step} FROM e JOIN m USING (geohash, side)) SELECT geohash, side, {sql_letters(2, 'qx', 'qy')} AS neighbour FROM v UNION ALL SELECT DISTINCT geohash, '', geohash FROM o")
def neighbour_validity(spark, d):
    return polygon_query.valid_neighbours(points(spark, d), P.CONTINENT, 2, 3)


_BOX_RING = "SELECT prefix, lat_lo < 44.06 AND lat_hi > 34.08 AND lon_lo < -101.05 AND lon_hi > -112.06 AS meets, lat_lo <= 34.08 AND lat_hi >= 44.06 AND lon_lo <= -112.06 AND lon_hi >= -101.05 AS holds, lat_lo >= 34.08 AND lat_hi <= 44.06 AND lon_lo >= -112.06 AND lon_hi <= -101.05 AS held FROM b"


@query("polygon_pairs", f"WITH m AS (SELECT DISTINCT substr(prefix, 1, 1) AS prefix FROM ({MAP}) UNION ALL SELECT '9x' || substr('{A}', CAST(i AS INT) + 1, 1) FROM range(32) t(i)), l AS (SELECT * FROM m WHERE length(prefix) = 1), s AS (SELECT * FROM m WHERE length(prefix) = 3), b AS (SELECT prefix, {sql_box(1, 'prefix')} FROM l UNION ALL SELECT prefix, {sql_box(3, 'prefix')} FROM s) {_BOX_RING}")
def polygon_pairs(spark, d):
    found = []
    for cell in [*A, *("9x" + c for c in A)]:
        south, north, west, east = P.decode(cell)
        ring = [(south, west), (north, west), (north, east), (south, east)]
        found.append((cell, P.intersects(ring, P.BOX_US), P.encloses(ring, P.BOX_US), P.encloses(P.BOX_US, ring)))
    return spark.createDataFrame(found, "prefix string, meets boolean, holds boolean, held boolean")


# ---- sources -------------------------------------------------------------------------------------------------------

LINES = f"""{PTS}, l AS (SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 'LAT,LON,TS' WHEN event_id % 37 = 0 THEN 'n/a,' || event_id
  ELSE CAST(event_id % 180 - 90 AS VARCHAR) || '.5,' || CAST(event_id * 7 % 360 - 180 AS VARCHAR) || '.25,t' || event_id || ',payload' END AS value FROM pts)"""


def csv_lines(spark, d):
    e = F.col("event_id")
    text = F.concat((e % 180 - 90).cast("string"), F.lit(".5,"), (e * 7 % 360 - 180).cast("string"), F.lit(".25,t"), e, F.lit(",payload"))
    return points(spark, d).select("event_id", F.when(e % 100 == 0, "LAT,LON,TS").when(e % 37 == 0, F.concat(F.lit("n/a,"), e)).otherwise(text).alias("value"))


_parsed = f"{LINES}, f AS (SELECT event_id, string_split(value, ',') AS f FROM l WHERE NOT starts_with(value, 'LAT')), v AS (SELECT event_id, TRY_CAST(f[1] AS DOUBLE) AS lat, TRY_CAST(f[2] AS DOUBLE) AS lon, f[3] AS ts_raw FROM f)"


@query("csv_scan", f"WITH {_parsed} SELECT event_id, lat, lon, ts_raw, lat IS NOT NULL AND lon IS NOT NULL AS good FROM v")
def csv_scan(spark, d):
    return obs.parse(csv_lines(spark, d)).select("event_id", "lat", "lon", "ts_raw", "good")


@query("csv_bad_rows", f"WITH {_parsed} SELECT CAST(count(*) AS BIGINT) AS bad FROM v WHERE lat IS NULL OR lon IS NULL")
def csv_bad_rows(spark, d):
    return obs.parse(csv_lines(spark, d)).where("not good").agg(F.count(F.lit(1)).alias("bad"))


@query("csv_keys", f"WITH {_parsed}, h AS ({sql_hash(12, source='v', cols='event_id, ts_raw, lat')}) SELECT event_id, geohash, substr(geohash, 1, 5) AS sub_geohash, ts_raw FROM h WHERE lat IS NOT NULL")
def csv_keys(spark, d):
    return obs.keyed(obs.parse(csv_lines(spark, d)).where("good"), 5).select("event_id", "geohash", "sub_geohash", "ts_raw")


@query("point_lookup", f"WITH {PTS}, h AS ({sql_hash(4)}) SELECT event_id, geohash FROM h WHERE event_id = 77")
def point_lookup(spark, d):
    return obs.lookup(hashed(spark, d, 4).select("event_id", "geohash"), {"event_id": 77})


@query("put_rows", f"WITH {PTS}, h AS ({sql_hash(4)}) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'new' ELSE geohash END AS geohash FROM h UNION ALL SELECT -1, 'new'")
def put_rows(spark, d):
    rows = hashed(spark, d, 4).select("event_id", "geohash")
    new = rows.where("event_id % 5 = 0").select("event_id", F.lit("new").alias("geohash")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("new").alias("geohash")))
    return obs.put(rows, new, ["event_id"])


@query("remove_rows", f"WITH {PTS}, h AS ({sql_hash(2)}) SELECT event_id, geohash FROM h WHERE event_id % 3 <> 0")
def remove_rows(spark, d):
    rows = hashed(spark, d, 2).select("event_id", "geohash")
    return obs.remove(rows, rows.where("event_id % 3 = 0").select("event_id"))


@query("clear_rows", f"WITH {PTS} SELECT event_id, lat FROM pts WHERE false")
def clear_rows(spark, d):
    return obs.clear(points(spark, d).select("event_id", "lat"))


# ---- routing -------------------------------------------------------------------------------------------------------


def routed(spark, d, hot=()):
    cells = router.base_map(spark)
    return router.route(hashed(spark, d, 6), router.split(cells, list(hot)) if hot else cells)


@query("route_base", f"WITH {PTS}, h AS ({sql_hash(6)}), m AS ({MAP}), {ROUTED} SELECT event_id, part FROM r")
def route_base(spark, d):
    return routed(spark, d).select("event_id", "part")


@query("route_split", f"WITH {PTS}, h AS ({sql_hash(6)}), m AS ({SPLIT}), {ROUTED} SELECT event_id, part FROM r")
def route_split(spark, d):
    return routed(spark, d, [HOT]).select("event_id", "part")


@query("single_partition_scan", f"WITH {PTS}, h AS ({sql_hash(6)}), m AS ({MAP}), {ROUTED} SELECT event_id, geohash FROM r WHERE part = 301")
def single_partition(spark, d):
    return routed(spark, d).where("part = 301").select("event_id", "geohash")


@query("partition_prefixes", f"WITH m AS ({SPLIT}) SELECT part, prefix FROM m WHERE part IN (0, 301, 1023, 1024, 2047)")
def partition_prefixes(spark, d):
    wanted = spark.createDataFrame([(p,) for p in (0, 301, 301, 1023, 1024, 2047, 9999)], "part int")
    return router.prefixes_of(router.split(router.base_map(spark), [HOT]), wanted)


@query("split_movement", f"WITH {PTS}, h AS ({sql_hash(6)}), o AS ({MAP}), m AS ({SPLIT}), {ROUTED} SELECT r.event_id, o.part, r.part AS new_part FROM r JOIN o ON substr(r.geohash, 1, 2) = o.prefix WHERE r.part <> o.part")
def split_movement(spark, d):
    before = router.base_map(spark)
    return router.moved(routed(spark, d), before, router.split(before, [HOT])).select("event_id", "part", "new_part")


@query("route_counts", f"WITH {PTS}, h AS ({sql_hash(6)}), m AS ({MAP}), {ROUTED} SELECT part, CAST(count(*) AS BIGINT) AS cnt FROM r GROUP BY part")
def route_counts(spark, d):
    return routed(spark, d).groupBy("part").agg(F.count(F.lit(1)).alias("cnt"))


@query("cell_map_split", SPLIT)
def cell_map_split(spark, d):
    return router.split(router.base_map(spark), [HOT])


PLACED = "SELECT CAST(i AS INT) AS part, CASE WHEN n < 7 THEN n END AS node FROM (SELECT i, CAST(CASE WHEN i < 1024 THEN i // 147 ELSE i // 2857 END AS INT) AS n FROM range(20000) t(i))"


def placed(spark):
    return spark.range(router.MAX_PARTITIONS).select(F.col("id").cast("int").alias("part")).withColumn("node", router.contiguous(F.col("part"), 7, router.MAX_PARTITIONS))


@query("placement_contiguous", PLACED)
def placement_contiguous(spark, d):
    return placed(spark)


@query("placement_donated", f"SELECT part, CASE WHEN part IN (300, 301, 777) THEN 9 ELSE node END AS node FROM ({PLACED})")
def placement_donated(spark, d):
    return router.donated(placed(spark), spark.createDataFrame([(300, 9), (301, 9), (777, 9), (777, 9)], "part int, node int"))


@query("placement_keep_previous", f"WITH p AS ({PLACED}) SELECT part, CASE WHEN part % 4 = 0 THEN CAST(part % 5 AS INT) ELSE node END AS node FROM p")
def placement_keep(spark, d):
    new = placed(spark)
    return router.keep_previous(new, new.where("part % 4 = 0").select("part", (F.col("part") % 5).cast("int").alias("node")))


@query("placement_split", f"SELECT part, CASE WHEN part BETWEEN 1024 AND 2047 THEN 3 ELSE node END AS node FROM ({PLACED})")
def placement_split(spark, d):
    return router.split_override(placed(spark), 1024, 2047, 3)


@query("ingest_upsert_latest", f"WITH {PTS}, h AS ({sql_hash(2, cols='event_id, user_id')}) SELECT event_id, user_id, geohash FROM (SELECT *, row_number() OVER (PARTITION BY geohash, user_id ORDER BY event_id DESC) AS n FROM h) WHERE n = 1")
def upsert_latest(spark, d):
    return latest(hashed(spark, d, 2).select("event_id", "user_id", "geohash"), ["geohash", "user_id"], ["event_id"])


# ---- skew ----------------------------------------------------------------------------------------------------------

COUNTS = f"WITH {PTS}, h AS ({sql_hash(6)}), m AS ({MAP}), {ROUTED}, c AS (SELECT part, CAST(count(*) AS BIGINT) AS cnt FROM r GROUP BY part)"
TOP = "t AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY cnt DESC, part) AS INT) AS rank FROM c) WHERE rank <= (SELECT ceil(count(*) / 5.0) FROM c))"


@query("skew_partition_stats", f"{COUNTS} SELECT part, cnt, CAST(sum(cnt) OVER () AS BIGINT) AS total, CAST(count(*) OVER () AS BIGINT) AS non_empty FROM c")
def partition_stats(spark, d):
    return skew.stats(routed(spark, d))


@query("skew_80_20", f"{COUNTS}, {TOP} SELECT s.total, t.top, floor(s.total * 4 / 5) - t.top <= 1500 AS skewed FROM (SELECT CAST(sum(cnt) AS BIGINT) AS total FROM c) s, (SELECT CAST(sum(cnt) AS BIGINT) AS top FROM t) t")
def skew_80_20(spark, d):
    return skew.power_law(route_counts(spark, d))


@query("skew_80_20_memory", f"{COUNTS}, {TOP} SELECT s.total, t.top, floor(s.total * 4 / 5) - t.top <= 1500 AND s.total * 2080 / 1048576.0::DOUBLE / 100.0::DOUBLE >= 0.1 AS skewed FROM (SELECT CAST(sum(cnt) AS BIGINT) AS total FROM c) s, (SELECT CAST(sum(cnt) AS BIGINT) AS top FROM t) t")
def skew_memory(spark, d):
    return skew.power_law(route_counts(spark, d), 100.0)


@query("node_partition_counts", f"{COUNTS}, p AS ({PLACED}), n AS (SELECT node, part, cnt FROM c JOIN p USING (part) WHERE node IS NOT NULL) SELECT node, part, cnt, CAST(sum(cnt) OVER (PARTITION BY node) AS BIGINT) AS total, CAST(count(*) OVER (PARTITION BY node) AS BIGINT) AS non_empty FROM n")
def node_counts(spark, d):
    return skew.node_stats(routed(spark, d), placed(spark))


@query("hot_partitions_topk", f"{COUNTS}, {TOP} SELECT part, cnt, rank FROM t")
def hot_partitions(spark, d):
    return skew.top_fifth(route_counts(spark, d))


@query("memory_estimate", f"{COUNTS} SELECT part, cnt, cnt * 2080 / 1048576.0::DOUBLE AS mb, cnt * 2080 / 1048576.0::DOUBLE / 49152.0::DOUBLE AS usage FROM c")
def memory_estimate(spark, d):
    return skew.memory_mb(route_counts(spark, d), 49152.0)


@query("ghost_correction", f"{COUNTS} SELECT part, cnt - CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS cnt FROM c WHERE cnt - CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END > 0")
def ghost_correction(spark, d):
    counts = route_counts(spark, d)
    return skew.without_ghosts(counts, counts.where("part % 3 = 0").select("part", F.lit(1).cast("long").alias("cnt")))


NODES = "n AS (SELECT CAST(s_suppkey AS VARCHAR) AS node, CAST(s_nationkey % 3 AS INT) AS grp, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS mem, (s_suppkey * 53 % 97) / 97.0::DOUBLE AS cpu, s_suppkey * 11 % 13 AS capacity FROM supplier)"


def nodes(spark, d):
    s = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(s.cast("string").alias("node"), (F.col("s_nationkey") % 3).cast("int").alias("grp"), (s * 37 % 101 / 101.0).alias("mem"), (s * 53 % 97 / 97.0).alias("cpu"), (s * 11 % 13).alias("capacity"))


@query("hot_node_cause", f"WITH {NODES}, a AS (SELECT (SELECT node FROM n ORDER BY mem DESC, node DESC LIMIT 1) AS mn, max(mem) AS mem, (SELECT node FROM n ORDER BY cpu DESC, node DESC LIMIT 1) AS cn, max(cpu) AS cpu FROM n), k AS (SELECT *, CASE WHEN mn = cn THEN 'CM' WHEN cpu > mem THEN 'C' ELSE 'M' END AS cause FROM a) SELECT CASE WHEN cause = 'C' THEN cn ELSE mn END AS node, cause, mem > 0.85 OR cpu > 0.85 AS hot FROM k")
def hot_node_cause(spark, d):
    return skew.hot_node(nodes(spark, d))


_offers = "o AS (SELECT grp, node, mem, capacity FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY mem, node) AS r FROM n) WHERE r = 1)"


@query("nodes_of_group", f"WITH {NODES} SELECT * FROM n WHERE grp = 1")
def nodes_of_group(spark, d):
    return skew.of_group(nodes(spark, d), 1)


@query("group_offers", f"WITH {NODES}, {_offers} SELECT * FROM o")
def group_offers(spark, d):
    return skew.offers(nodes(spark, d))


@query("offer_selection", f"WITH {NODES}, {_offers} SELECT * FROM (SELECT * FROM o ORDER BY mem, capacity DESC, grp LIMIT 1) WHERE mem < 0.30")
def offer_selection(spark, d):
    return skew.best_offer(skew.offers(nodes(spark, d)))


@query("local_donor", f"WITH {NODES} SELECT * FROM (SELECT * FROM n ORDER BY mem, node LIMIT 1) WHERE mem < 0.35 AND cpu < 0.35")
def local_donor(spark, d):
    return skew.donor(nodes(spark, d))


_MOVE = f"""WITH RECURSIVE {COUNTS.removeprefix('WITH ')},
g AS (SELECT CAST(sum(cnt) AS BIGINT) * 2 // 3 AS goal, min(part) AS low, max(part) AS high, arg_min(part, (-cnt, part)) AS start FROM c),
w(step, part, missing) AS (
  SELECT 0, start, goal - c.cnt FROM g JOIN c ON c.part = g.start WHERE goal > 1000
  UNION ALL
  SELECT w.step + 1, coalesce(r.part, l.part), w.missing - coalesce(r.cnt, l.cnt, 0)
  FROM w CROSS JOIN g LEFT JOIN c r ON r.part = g.start + w.step + 1 LEFT JOIN c l ON l.part = g.start - w.step - 1
  WHERE g.start + w.step + 1 <= g.high AND g.start - w.step - 1 >= g.low AND (w.step = 0 OR w.missing >= 1000))
SELECT CAST(row_number() OVER (ORDER BY step) - 1 AS INT) AS step, CAST(part AS INT) AS part FROM w WHERE part IS NOT NULL"""


@query("partitions_to_move", _MOVE)
def partitions_to_move(spark, d):
    counts = {r["part"]: r["cnt"] for r in route_counts(spark, d).collect()}  # at most 20,000 partitions
    return spark.createDataFrame([(k, p) for k, p in enumerate(skew.to_move(counts))], "step int, part int")


# ---- the rest ------------------------------------------------------------------------------------------------------


@query("char_count", "SELECT CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS chars FROM documents")
def char_count(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").agg(F.sum(F.length(F.translate("text", " ", ""))).cast("long").alias("chars"))


_KNN = """
WITH t AS (SELECT * FROM embeddings WHERE vec_id % 10 < 7), q AS (SELECT * FROM embeddings WHERE vec_id % 10 >= 7),
n AS (SELECT q.vec_id, q.label, t.label AS tl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])), t.vec_id) AS r FROM q, t),
v AS (SELECT vec_id, label, tl, count(*) AS n, min(r) AS r FROM n WHERE r <= 2 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, r, tl) AS k FROM v)"""


def voted(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return knn.classify(rows.where("vec_id % 10 < 7"), rows.where("vec_id % 10 >= 7"))


@query("knn_confusion", f"{_KNN} SELECT label, tl AS predicted, CAST(count(*) AS BIGINT) AS n FROM b WHERE k = 1 GROUP BY ALL")
def knn_confusion(spark, d):
    return knn.confusion(voted(spark, d))


@query("knn_by_label", f"""{_KNN}, p AS (SELECT label, tl FROM b WHERE k = 1), o AS (SELECT label, count(*) AS own, count(*) FILTER (tl = label) AS hits FROM p GROUP BY label), c AS (SELECT tl AS label, count(*) AS called FROM p GROUP BY tl)
SELECT label, coalesce(hits, 0)::DOUBLE / called AS precision, hits::DOUBLE / own AS recall, 2.0::DOUBLE * coalesce(hits, 0) / (coalesce(own, 0) + coalesce(called, 0)) AS f FROM o FULL JOIN c USING (label)""")
def knn_by_label(spark, d):
    return knn.by_label(voted(spark, d))


@query("key_range_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 9")
def key_range(spark, d):
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("geocell_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber FROM geocell_lineitem WHERE l_orderkey < 9")


@query("even_value_filter", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey % 2 = 0")
def even_value(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where(F.col("o_custkey") % 2 == 0).agg(F.count(F.lit(1)).alias("n"))


for _unit in ("hour", "day", "month", "year"):

    @query(f"period_of_{_unit}", f"SELECT event_id, epoch_ms(date_trunc('{_unit}', ts)) AS start_ms, epoch_ms(date_trunc('{_unit}', ts) + INTERVAL 1 {_unit.upper()}) - 1 AS end_ms FROM events")
    def period_of(spark, d, unit=_unit):
        rows = spark.read.parquet(f"{d}/events.parquet")
        return rows.select("event_id", temporal.period(F.col("ts"), unit).alias("p")).select("event_id", "p.*")


_JAN_2 = "epoch_ms(TIMESTAMP '2024-01-02 00:00:00')"


@query("temporal_orientation", f"WITH p AS (SELECT event_id, epoch_ms(date_trunc('day', ts)) AS a, epoch_ms(date_trunc('day', ts)) + 86399999 AS b FROM events), d AS (SELECT *, {_JAN_2} AS x, {_JAN_2} + 86399999 AS y FROM p) SELECT event_id, CASE WHEN a >= x AND b <= y THEN 'full' WHEN a = y + 1 THEN 'up' WHEN b = x - 1 THEN 'down' ELSE 'ignore' END AS orientation FROM d")
def temporal_orientation(spark, d):
    day = temporal.period(F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), "day")
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", temporal.orientation(day, temporal.period(F.col("ts"), "day")).alias("orientation"))


_day = "CASE WHEN a >= x AND b <= y THEN 'full' WHEN a = y + 1 THEN 'up' WHEN b = x - 1 THEN 'down' ELSE 'ignore' END"


@query("combined_orientation", f"WITH {PTS}, h AS ({sql_hash(1, cols='event_id, ts')}), d AS (SELECT *, epoch_ms(date_trunc('day', ts)) AS a, epoch_ms(date_trunc('day', ts)) + 86399999 AS b, {_JAN_2} AS x, {_JAN_2} + 86399999 AS y FROM h), e AS (SELECT event_id, {_day} AS t, coalesce(CASE geohash WHEN '9' THEN 'full' WHEN 'c' THEN 's' WHEN 'f' THEN 'sw' WHEN 'd' THEN 'w' WHEN '6' THEN 'nw' WHEN '3' THEN 'n' WHEN '2' THEN 'ne' WHEN '8' THEN 'e' WHEN 'b' THEN 'se' END, 'ignore') AS s FROM d) SELECT event_id, CASE WHEN t = 'ignore' THEN 'ignore-ignore' ELSE s || '-' || t END AS orientation FROM e")
def combined_orientation(spark, d):
    day = temporal.period(F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), "day")
    rows = hashed(spark, d, 1)
    spatial = G.orientation(F.lit("9"), F.col("geohash"), 1, 1)
    return rows.select("event_id", temporal.combined(spatial, temporal.orientation(day, temporal.period(F.col("ts"), "day"))).alias("orientation"))
