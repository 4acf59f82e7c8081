"""Geohash and grid functions as plain column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
DIRECTIONS = ("nw", "n", "ne", "w", "e", "sw", "s", "se")
WIDTH = 1 << 30


def bits(precision: int) -> tuple[int, int]:
    """Longitude and latitude bits of a geohash."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def cell_index(value: Column, low: float, span: float, n_bits: int, tie: str = "high") -> Column:
    """Place among 2 ** n_bits equal cells. An edge belongs to the cell above it, or below with tie='low'."""
    scaled = (value - F.lit(low)) / F.lit(span) * F.lit(float(1 << n_bits))
    at = F.floor(scaled) if tie == "high" else F.ceil(scaled) - 1
    return F.least(F.greatest(at.cast("long"), F.lit(0).cast("long")), F.lit((1 << n_bits) - 1).cast("long"))


def encode(lat: Column, lon: Column, precision: int = 12, tie: str = "high") -> Column:
    nx, ny = bits(precision)
    x, y = cell_index(lon, -180.0, 360.0, nx, tie), cell_index(lat, -90.0, 180.0, ny, tie)
    return encode_index(x, y, precision)


def encode_index(x: Column, y: Column, precision: int) -> Column:
    """The geohash of a cell, bits interleaved longitude first."""
    nx, ny = bits(precision)
    letters = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5 * c, 5 * c + 5):
            source, at = (y, ny - 1 - j // 2) if j % 2 else (x, nx - 1 - j // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def _letter(geohash: Column, k: int) -> Column:
    """Value of the letter at place k (from 0); -1 beyond the end, and for what is no letter of a geohash."""
    letter = F.substring(F.lower(geohash), k + 1, 1)
    return F.when(letter == "", -1).otherwise(F.instr(F.lit(ALPHABET), letter) - 1)


def to_long(geohash: Column) -> Column:
    """Five bits a letter; letters beyond the twelfth do not count, nor do characters that are no letters of a geohash."""
    value = F.lit(0).cast("long")
    for k in range(12):
        v = _letter(geohash, k)
        value = value * F.when(v >= 0, 32).otherwise(1) + F.greatest(v, F.lit(0))  # each step holds the one before once only
    return value


def cell(geohash: Column, precision: int = 12) -> tuple[Column, Column]:
    """(x, y) of the cell among those of `precision` letters; of a shorter geohash, its south-western one."""
    x = y = F.lit(0).cast("long")
    for k in range(precision):
        v = F.greatest(_letter(geohash, k), F.lit(0)).cast("long")
        bit = lambda j: F.shiftright(v, 4 - j).bitwiseAND(F.lit(1))  # noqa: B023, E731
        first, second = (bit(0) * 4 + bit(2) * 2 + bit(4), 3), (bit(1) * 2 + bit(3), 2)
        (to_x, nx), (to_y, ny) = (first, second) if k % 2 == 0 else (second, first)
        x, y = F.shiftleft(x, nx) + to_x, F.shiftleft(y, ny) + to_y
    return x, y


def decode(geohash: Column, precision: int | None = None) -> Column:
    """struct(lat_lo, lat_hi, lon_lo, lon_hi) of a geohash of `precision` letters, or of any number up to 12 where none is
    given. Plain shifts over its letters: places among the cells of that size, exact in doubles."""
    n = precision or 12
    nx, ny = bits(n)
    x, y = cell(geohash, n)
    wide = high = F.lit(1).cast("long")
    if precision is None:  # a shorter geohash is as large as all that begin with it
        total = F.least(F.length(geohash), F.lit(12)) * 5
        one = F.lit(1).cast("long")
        wide, high = F.call_function("shiftleft", one, (nx - F.floor((total + 1) / 2)).cast("int")), F.call_function("shiftleft", one, (ny - F.floor(total / 2)).cast("int"))
    lat, lon = (lambda v: -90 + v * 180.0 / F.lit(float(1 << ny))), (lambda v: -180 + v * 360.0 / F.lit(float(1 << nx)))
    return F.struct(lat(y).alias("lat_lo"), lat(y + high).alias("lat_hi"), lon(x).alias("lon_lo"), lon(x + wide).alias("lon_hi"))


def bit_string(geohash: Column, precision: int) -> Column:
    """The geohash as binary digits, five a letter."""
    return F.concat(*[F.lpad(F.bin(_letter(geohash, k)), 5, "0") for k in range(precision)])


def center(box: Column) -> Column:
    return F.struct(((box["lat_lo"] + box["lat_hi"]) / 2).alias("lat"), ((box["lon_lo"] + box["lon_hi"]) / 2).alias("lon"))


def corner(box: Column, direction: str) -> Column:
    """The corner point in direction nw, ne, sw or se; null for any other."""
    if direction not in ("nw", "ne", "sw", "se"):
        return F.lit(None).cast("struct<lat:double,lon:double>")
    return F.struct(box["lat_hi" if direction[0] == "n" else "lat_lo"].alias("lat"), box["lon_lo" if direction[1] == "w" else "lon_hi"].alias("lon"))


def corners(box: Column) -> Column:
    """South-west, north-west, north-east, south-east."""
    return F.array(*[corner(box, d) for d in ("sw", "nw", "ne", "se")])


def bounds(box: Column) -> Column:
    """North-west, north-east, south-east, south-west."""
    return F.array(*[corner(box, d) for d in ("nw", "ne", "se", "sw")])


def bounds_2d(box: Column) -> Column:
    """North-west and south-east."""
    return F.array(corner(box, "nw"), corner(box, "se"))


def wrap(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Longitudes go round. Latitudes beyond a pole come out at the other one: that is how the rule is, right or not."""
    lat = F.when(lat > 90, lat - 180).when(lat < -90, lat + 180).otherwise(lat)
    return lat, F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def encode_wrapped(lat: Column, lon: Column, precision: int) -> Column:
    """Of a point beyond the borders: wrapped first; an edge belongs to the cell below it. In doubles: up to six letters these
    are the cells that single precision gives."""
    return encode(*wrap(lat, lon), precision, "low")


def encode_center(box: Column, precision: int) -> Column:
    c = center(box)
    return encode(c["lat"], c["lon"], precision)


def moved(geohash: Column, up: Column, right: Column, precision: int) -> Column:
    """The cell so many rows up and columns to the right of one of `precision` letters; both go round."""
    nx, ny = bits(precision)
    x, y = cell(geohash, precision)
    around = lambda v, n: v.bitwiseAND(F.lit((1 << n) - 1))
    return encode_index(around(x + right, nx), around(y + up, ny), precision)


def neighbour(geohash: Column, direction: str, precision: int) -> Column:
    """The cell of the same size next to one of `precision` letters; '' for an unknown direction, an error for a blank
    geohash. Rows and columns of cells go round, as wrap() has it."""
    if direction not in DIRECTIONS:
        return F.lit("")
    up, right = ("n" in direction) - ("s" in direction), ("e" in direction) - ("w" in direction)
    found = moved(geohash, F.lit(up), F.lit(right), precision)
    return F.when(F.trim(geohash) == "", F.raise_error(F.lit("blank geohash")).cast("string")).otherwise(found)


def neighbours(geohash: Column, precision: int) -> Column:
    """The eight neighbours: nw, n, ne, w, e, sw, s, se."""
    return F.array(*[neighbour(geohash, d, precision) for d in DIRECTIONS])


def with_neighbours(rows: DataFrame, geohash: str, precision: int) -> DataFrame:
    """rows with pos and neighbour: a row for each of neighbours(), which are computed after the rows are multiplied, from the
    cell's place. Of many rows this is far less work than exploding the array. Names that begin with __ are its own."""
    nx, ny = bits(precision)
    x, y = cell(F.col(geohash), precision)
    steps = [F.struct(F.lit(k).alias("pos"), F.lit(("n" in d) - ("s" in d)).alias("__up"), F.lit(("e" in d) - ("w" in d)).alias("__right")) for k, d in enumerate(DIRECTIONS)]
    wide = rows.withColumns({"__x": x, "__y": y}).select("*", F.inline(F.array(*steps)))
    around = lambda at, step, n: (F.col(at) + F.col(step)).bitwiseAND(F.lit((1 << n) - 1))
    wide = wide.withColumns({"__x": around("__x", "__right", nx), "__y": around("__y", "__up", ny)})
    found = encode_index(F.col("__x"), F.col("__y"), precision)
    blank = F.when(F.trim(geohash) == "", F.raise_error(F.lit("blank geohash")).cast("string")).otherwise(found)
    return wide.withColumn("neighbour", blank).drop("__x", "__y", "__up", "__right")


def border_suffixes(precision: int, to: int, side: str) -> list[str]:
    """What the cells of `to` letters along a side (n, s, w or e; nw, ne, sw or se: the one in that corner) of a cell of
    `precision` letters add to its geohash, from west to east or south to north. They depend on the two lengths only."""
    (nx, ny), (mx, my) = bits(precision), bits(to)
    columns, rows = range(1 << (mx - nx)), range(1 << (my - ny))
    columns = columns[-1:] if "e" in side else columns[:1] if "w" in side else columns
    rows = rows[-1:] if "n" in side else rows[:1] if "s" in side else rows
    out = []
    for x, y in ((x, y) for y in rows for x in columns):
        code = [(y >> (my - 1 - j // 2)) & 1 if j % 2 else (x >> (mx - 1 - j // 2)) & 1 for j in range(5 * precision, 5 * to)]
        out.append("".join(ALPHABET[int("".join(map(str, code[k : k + 5])), 2)] for k in range(0, len(code), 5)))
    return out


def borders(geohash: Column, precision: int, to: int, sides: tuple[str, ...] = ("n", "s", "w", "e")) -> Column:
    """array of struct(side, pos, cell): the cells of `to` letters along the sides (or in the corners) of a cell of
    `precision` letters. Only letters are added; there are about 2 ** (2.5 * (to - precision)) on a side."""
    if to <= precision:
        raise ValueError("cells on a border are smaller than the cell")
    return F.array(*[F.struct(F.lit(d).alias("side"), F.lit(k).alias("pos"), F.concat(geohash, F.lit(s)).alias("cell")) for d in sides for k, s in enumerate(border_suffixes(precision, to, d))])


def outline(geohash: Column, precision: int) -> Column:
    """The outer corners of a cell with its eight neighbours: south-west, north-west, north-east, south-east."""
    return corners(outline_box(geohash, precision))


def outline_box(geohash: Column, precision: int) -> Column:
    """struct(lat_lo, lat_hi, lon_lo, lon_hi) of a cell with its eight neighbours. Rows and columns of cells go round. Explode
    its corners() in a later select: in one with it, the cell's place is computed for each."""
    nx, ny = bits(precision)
    x, y = cell(geohash, precision)
    first = lambda v, n: (v - 1).bitwiseAND(F.lit((1 << n) - 1))
    end = lambda v, n: (v + 1).bitwiseAND(F.lit((1 << n) - 1)) + 1
    lat, lon = (lambda v: -90 + v * 180.0 / F.lit(float(1 << ny))), (lambda v: -180 + v * 360.0 / F.lit(float(1 << nx)))
    return F.struct(lat(first(y, ny)).alias("lat_lo"), lat(end(y, ny)).alias("lat_hi"), lon(first(x, nx)).alias("lon_lo"), lon(end(x, nx)).alias("lon_hi"))


def inner_flanks(box: Column, to: int) -> Column:
    """array of struct(side, ring) for a cell's box: the boxes that its cells of `to` letters along each side and in each
    corner make up, and what lies within them (inner); nw, n, ne, w, inner, e, sw, s, se. A side's box holds its
    corners. ring: north-west, north-east, south-east, south-west."""
    mx, my = bits(to)
    high, wide = F.lit(180.0 / (1 << my)), F.lit(360.0 / (1 << mx))
    lo, hi, west, east = (box[c] for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi"))
    rows = {"n": (hi - high, hi), "s": (lo, lo + high), "": (lo, hi), "inner": (lo + high, hi - high)}
    columns = {"w": (west, west + wide), "e": (east - wide, east), "": (west, east), "inner": (west + wide, east - wide)}

    def flank(side: str) -> Column:
        (a, b), (x, y) = (rows["inner"], columns["inner"]) if side == "inner" else (rows[side.strip("we")], columns[side.strip("ns")])
        ring = bounds(F.struct(a.alias("lat_lo"), b.alias("lat_hi"), x.alias("lon_lo"), y.alias("lon_hi")))
        return F.struct(F.lit(side).alias("side"), ring.alias("ring"))

    return F.array(*[flank(d) for d in (*DIRECTIONS[:4], "inner", *DIRECTIONS[4:])])


def orientation(a: Column, b: Column, precision_a: int, precision_b: int) -> Column:
    """relative() of two geohashes of precision_a and precision_b letters."""
    return relative(cell(a, precision_a), cell(b, precision_b), precision_a, precision_b)


def relative(a: tuple[Column, Column], b: tuple[Column, Column], precision_a: int, precision_b: int) -> Column:
    """On which side of cell b cell a lies, if they touch (nw, n, ne, w, e, sw, s, se); full where one holds the other, else
    ignore. a and b are places as cell() gives them, best from an earlier select; rows and columns go round, as for
    neighbours."""
    turned = precision_a > precision_b  # seen from the larger cell
    large, small, n, m = (b, a, precision_b, precision_a) if turned else (a, b, precision_a, precision_b)

    def side(k: int, before: str, behind: str) -> Column:
        wide, most = bits(m)[k] - bits(n)[k], (1 << bits(m)[k]) - 1
        first = F.shiftleft(large[k], wide)
        last = first + ((1 << wide) - 1)
        before, behind = (behind, before) if turned else (before, behind)
        # where the small cell lies before the large one, the large one lies behind it
        near = F.when(small[k] == (first - 1).bitwiseAND(F.lit(most)), behind).when(small[k] == (last + 1).bitwiseAND(F.lit(most)), before)
        return F.when(small[k].between(first, last), "").otherwise(near)

    where = F.concat(side(1, "s", "n"), side(0, "w", "e"))
    return F.when(where == "", "full").otherwise(F.coalesce(where, F.lit("ignore")))


def grid_xy(lat: Column, lon: Column) -> Column:
    """struct(x, y) on the 2**30 integer grid, y to the south, in 32-bit float steps."""
    f = lambda c: c.cast("float")
    x = f(f(f(f(lon) + f(F.lit(180.0))) * f(F.lit(float(WIDTH)))) / f(F.lit(360.0)))
    y = f(f(f(f(F.lit(90.0)) - f(lat)) * f(F.lit(float(WIDTH)))) / f(F.lit(180.0)))
    most = F.lit(2147483647.0)
    return F.struct(F.least(x.cast("double"), most).cast("int").alias("x"), F.least(y.cast("double"), most).cast("int").alias("y"))


def from_grid(x: Column, y: Column) -> Column:
    return F.struct((90 - y * 180.0 / WIDTH).alias("lat"), (x * 360.0 / WIDTH - 180).alias("lon"))


def prefix_range(prefix: Column, precision: int) -> Column:
    """struct(lo, hi): the smallest and largest geohash of `precision` letters with a prefix."""
    return F.struct(F.rpad(prefix, precision, ALPHABET[0]).alias("lo"), F.rpad(prefix, precision, ALPHABET[-1]).alias("hi"))


def validated(lat: Column, lon: Column) -> Column:
    """struct(lat, lon): swapped where only the swap is valid, an error where neither is."""
    inside = lambda a, b: (F.abs(a) <= 90) & (F.abs(b) <= 180)
    pair = lambda a, b: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon"))
    return F.when(inside(lat, lon), pair(lat, lon)).when(inside(lon, lat), pair(lon, lat)).otherwise(F.raise_error(F.lit("not a coordinate")).cast("struct<lat:double,lon:double>"))


def encloses(outer: Column, inner: Column) -> Column:
    return F.startswith(inner, outer)


def intersects(a: Column, b: Column) -> Column:
    """Two cells share area if one's geohash begins with the other's."""
    return F.startswith(a, b) | F.startswith(b, a)
