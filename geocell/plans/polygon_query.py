"""Polygon queries: classify cells, prune, test points only where a cell is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geohash as G
from ..functions import polygon as P


def classified(cells: DataFrame, ring: P.Ring) -> DataFrame:
    """prefix, part, cls of the map's cells that a polygon meets. A map has 20,000 cells at most: clipping is the driver's."""
    rows = [(r["prefix"], r["part"], c) for r in cells.collect() if (c := P.relation(ring, r["prefix"])) != P.DISJOINT]
    return cells.sparkSession.createDataFrame(rows, "prefix string, part int, cls int")


def valid_neighbours(points: DataFrame, ring: P.Ring, precision: int, to: int, most: int = 20_000) -> DataFrame:
    """geohash, side and neighbour: which neighbours of the cells (of `precision` letters) of points (lat, lon) a search for a
    polygon goes on with, beside the cells themselves (side ''). The strip or corner of cells of `to` letters on that side
    meets the polygon, and some point lies there; of a side the points in its corners do not count.

    What a cell of `to` letters is to the larger one depends on its last letters. The cells that meet the polygon are `most`
    at most, checked, and broadcast; points shrink to different cells before anything is joined.
    """
    corner = {s: d for d in ("nw", "ne", "sw", "se") for s in G.border_suffixes(precision, to, d)}
    strips = [(s, d) for d in ("n", "s", "w", "e") for s in G.border_suffixes(precision, to, d)]
    holds = {**{s: d for s, d in strips}, **corner}  # the part that a point in this cell fills
    cover = P.cover(ring, to)
    if len(cover) > most:
        raise ValueError(f"{len(cover)} cells meet the polygon, more than {most}: use fewer letters")
    flanks = [*strips, *corner.items()]
    met = sorted({(c[:precision], d) for c, _ in cover for s, d in flanks if c.endswith(s)})
    met = points.sparkSession.createDataFrame(met, "geohash string, side string")
    fine = points.select(G.encode(F.col("lat"), F.col("lon"), to).alias("fine")).distinct()
    cells = fine.select(F.substring("fine", 1, precision).alias("geohash"), F.substring("fine", precision + 1, to).alias("rest"))
    names = F.create_map(*[F.lit(x) for pair in holds.items() for x in pair])
    filled = cells.select("geohash", F.try_element_at(names, F.col("rest")).alias("side")).where("side is not null").distinct()
    valid = filled.join(F.broadcast(met), ["geohash", "side"])
    step = lambda plus, minus: F.contains("side", F.lit(plus)).cast("long") - F.contains("side", F.lit(minus)).cast("long")
    ways = G.moved(F.col("geohash"), step("n", "s"), step("e", "w"), precision)
    own = cells.select("geohash").distinct()
    return valid.select("geohash", "side", ways.alias("neighbour")).unionByName(own.select("geohash", F.lit("").alias("side"), F.col("geohash").alias("neighbour")))


def inside(points: DataFrame, cells: DataFrame, ring: P.Ring) -> DataFrame:
    """The rows of points (lat, lon, part) inside a polygon: all of an enclosed cell, those that pass the point test of a cut
    one. The few cells met are broadcast, which prunes partitions of a table partitioned by part; a box on lat and lon
    reaches the scan."""
    south, north, west, east = P.mbr(ring)
    near = points.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    joined = near.join(F.broadcast(classified(cells, ring).select("part", "cls")), "part")
    return joined.where((F.col("cls") == P.ENCLOSED) | ((F.col("cls") == P.INTERSECTING) & P.contains(ring, F.col("lat"), F.col("lon"))))
