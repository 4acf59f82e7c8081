"""Polygons: the point test as a column, cell relations by exact clipping on the driver."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geohash import ALPHABET

Ring = list[tuple[float, float]]  # (lat, lon); closed or open

BOX_US: Ring = [(44.06, -101.05), (44.06, -112.06), (34.08, -112.06), (34.08, -101.05)]
CONTINENT: Ring = [(25.0079, -118.3065), (51.4554, -64.0780), (63.0361, -135.7088)]
TRIANGLE: Ring = [(50.18, -103.29), (36.78, -117.88), (36.85, -97.21)]
DISJOINT, ENCLOSED, INTERSECTING = -1, 0, 1


def edges(ring: Ring) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    points = ring[:-1] if ring[0] == ring[-1] else ring
    return list(zip(points, points[1:] + points[:1], strict=True))


def mbr(ring: Ring) -> tuple[float, float, float, float]:
    """lat_lo, lat_hi, lon_lo, lon_hi."""
    lats, lons = zip(*ring, strict=True)
    return min(lats), max(lats), min(lons), max(lons)


def contains(ring: Ring, lat: Column, lon: Column) -> Column:
    """Even-odd crossings; west and north edges are inside, east and south ones outside."""
    count = F.lit(0)
    for (a, x), (b, y) in edges(ring):
        if a != b:
            crossing = F.lit(x) + (lat - F.lit(a)) * F.lit(y - x) / F.lit(b - a)
            count = count + F.when((lat > min(a, b)) & (lat <= max(a, b)) & (lon < crossing), 1).otherwise(0)
    return count % 2 == 1


def decode(geohash: str) -> tuple[Fraction, Fraction, Fraction, Fraction]:
    """lat_lo, lat_hi, lon_lo, lon_hi, exactly."""
    code = "".join(f"{ALPHABET.index(c):05b}" for c in geohash.lower())
    x, y = code[::2], code[1::2]
    wide, high = Fraction(360, 1 << len(x)), Fraction(180, 1 << len(y))
    west, south = int(x, 2) * wide - 180, int(y or "0", 2) * high - 90
    return south, south + high, west, west + wide


def _clipped(ring: list, axis: int, bound: Fraction, keep_above: bool) -> list:
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b = ((v[axis] - bound if keep_above else bound - v[axis]) for v in (p, q))
        if a >= 0:
            out.append(p)
        if (a > 0 > b) or (a < 0 < b):
            t = a / (a - b)
            out.append(tuple(p[k] + t * (q[k] - p[k]) for k in (0, 1)))
    return out


def overlap(ring: Ring, box: tuple) -> Fraction:
    """Exact area that a simple polygon shares with a box."""
    points = [(Fraction(a), Fraction(b)) for (a, b), _ in edges(ring)]
    for axis, bound, above in ((0, box[0], True), (0, box[1], False), (1, box[2], True), (1, box[3], False)):
        points = _clipped(points, axis, Fraction(bound), above) if points else points
    return abs(sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)), Fraction(0))) / 2


def _area(points: list) -> Fraction:
    return sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)), Fraction(0)) / 2


def _triangles(ring: Ring) -> list[list]:
    """Of a simple polygon, ear by ear, each counter-clockwise."""
    points = [(Fraction(a), Fraction(b)) for (a, b), _ in edges(ring)]
    if _area(points) < 0:
        points.reverse()
    out = []
    while len(points) > 2:
        for k in range(len(points)):
            ear = [points[k - 1], points[k], points[(k + 1) % len(points)]]
            area = _area(ear)
            rest = [p for p in points if p not in ear]
            if area == 0 or area > 0 and not any(all(_area([ear[i], ear[(i + 1) % 3], p]) >= 0 for i in range(3)) for p in rest):
                out += [ear] * (area > 0)
                del points[k]
                break
        else:
            raise ValueError("the polygon crosses itself")
    return out


def shared_area(ring: Ring, other: Ring) -> Fraction:
    """Exact area that two simple polygons share: one's triangles, cut at the other's edges by half-planes."""
    total = Fraction(0)
    for first in _triangles(ring):
        for second in _triangles(other):
            points = first
            for p, q in zip(second, second[1:] + second[:1], strict=True):
                side = [(q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0]) for v in points]
                out = []
                for k, (v, d) in enumerate(zip(points, side, strict=True)):
                    w, e = points[(k + 1) % len(points)], side[(k + 1) % len(points)]
                    if d >= 0:
                        out.append(v)
                    if d * e < 0:
                        t = d / (d - e)
                        out.append((v[0] + t * (w[0] - v[0]), v[1] + t * (w[1] - v[1])))
                points = out
                if not points:
                    break
            total += _area(points) if points else 0
    return total


def intersects(ring: Ring, other: Ring) -> bool:
    """Whether two simple polygons share area; a common edge or corner is none."""
    return shared_area(ring, other) > 0


def encloses(ring: Ring, other: Ring) -> bool:
    """Whether the first holds all of the second's area."""
    return shared_area(ring, other) == abs(_area([(Fraction(a), Fraction(b)) for (a, b), _ in edges(other)]))


def relation(ring: Ring, geohash: str) -> int:
    """-1 no area in common, 0 the cell lies inside, 1 part of it does."""
    box = decode(geohash)
    lo_lat, hi_lat, lo_lon, hi_lon = mbr(ring)
    if box[1] <= lo_lat or box[0] >= hi_lat or box[3] <= lo_lon or box[2] >= hi_lon:
        return DISJOINT
    area = overlap(ring, box)
    return DISJOINT if not area else ENCLOSED if area == (box[1] - box[0]) * (box[3] - box[2]) else INTERSECTING


def cover(ring: Ring, precision: int, adaptive: bool = False) -> list[tuple[str, int]]:
    """(geohash, relation) of the cells that a polygon meets. Cells that it misses are not refined; with `adaptive`, cells
    inside it neither."""
    level, done = [""], []
    for k in range(1, precision + 1):
        found = [(c, relation(ring, c)) for g in level for c in (g + a for a in ALPHABET)]
        met = [(c, r) for c, r in found if r != DISJOINT]
        if adaptive or k == precision:
            done += [(c, r) for c, r in met if r == ENCLOSED or k == precision]
        level = [c for c, r in met if not (adaptive and r == ENCLOSED)]
    return sorted(done)


def cell_of(lat: float, lon: float, precision: int) -> str:
    """The geohash of a point."""
    total = 5 * precision
    nx, ny = (total + 1) // 2, total // 2
    x = min(int((Fraction(lon) + 180) * (1 << nx) / 360), (1 << nx) - 1)
    y = min(int((Fraction(lat) + 90) * (1 << ny) / 180), (1 << ny) - 1)
    code = "".join(str((y >> (ny - 1 - k // 2)) & 1 if k % 2 else (x >> (nx - 1 - k // 2)) & 1) for k in range(total))
    return "".join(ALPHABET[int(code[k : k + 5], 2)] for k in range(0, total, 5))


def cover_from_center(ring: Ring, precision: int) -> list[tuple[str, int]]:
    """cover() for a search that begins at the centre of the polygon's box: nothing where that cell misses a concave polygon."""
    lo_lat, hi_lat, lo_lon, hi_lon = mbr(ring)
    seed = cell_of((lo_lat + hi_lat) / 2, (lo_lon + hi_lon) / 2, precision)
    return [] if relation(ring, seed) == DISJOINT else cover(ring, precision)
