"""Distances, boxes and tiles as Column expressions. Coordinates are degrees unless named e6 (microdegrees)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METERS_A_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance with the first point's parallel."""
    x = (lon2 - lon1) * F.cos(F.radians(lat1))
    return METERS_A_DEGREE * F.sqrt(x * x + (lat2 - lat1) * (lat2 - lat1))


def segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment in one plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def walk_minutes(meters: Column, detour: float = 1.3, meters_a_minute: float = 75.0) -> Column:
    return F.ceil(meters * detour / meters_a_minute)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 360 * 2**zoom), F.lit(0)), F.lit(2**zoom - 1))


def tile_y(lat: Column, zoom: int) -> Column:
    """Web Mercator row, the latitude clamped to the square map."""
    edge = math.degrees(2 * math.atan(math.exp(math.pi)) - math.pi / 2)
    r = F.radians(F.least(F.greatest(lat, F.lit(-edge)), F.lit(edge)))
    y = (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2
    return F.least(F.greatest(F.floor(y * 2**zoom), F.lit(0)), F.lit(2**zoom - 1))


def tile_id(x: Column, y: Column, zoom: int) -> Column:
    """Number of a tile: those of all lower zooms first, then along the Hilbert curve of its own."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, bit: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        rx, ry = (s.x.bitwiseAND(side) > 0).cast("long"), (s.y.bitwiseAND(side) > 0).cast("long")
        fx = F.when((ry == 0) & (rx == 1), side - 1 - s.x.bitwiseAND(side - 1)).otherwise(s.x.bitwiseAND(side - 1))
        fy = F.when((ry == 0) & (rx == 1), side - 1 - s.y.bitwiseAND(side - 1)).otherwise(s.y.bitwiseAND(side - 1))
        d = s.d + side * side * ((3 * rx).bitwiseXOR(ry))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    bits = F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)) if zoom else F.array().cast("array<int>")
    return F.aggregate(bits, start, step, lambda s: s.d) + (4**zoom - 1) // 3


def tile_of(tile: Column, most_zoom: int = 26) -> Column:
    """struct<z, x, y> of a tile's number: the inverse of tile_id."""
    firsts = F.array(*(F.lit((4**z - 1) // 3).cast("long") for z in range(most_zoom + 1)))
    z = F.size(F.filter(firsts, lambda f: f <= tile)) - 1
    start = F.struct((tile - F.get(firsts, z)).alias("d"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(s: Column, bit: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        rx = F.floor(s.d / 2) % 2
        ry = (s.d % 2).bitwiseXOR(rx)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - s.x).otherwise(s.x), F.when(flip, side - 1 - s.y).otherwise(s.y)
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct(F.floor(s.d / 4).alias("d"), (x + side * rx).alias("x"), (y + side * ry).alias("y"))

    bits = F.filter(F.sequence(F.lit(0), F.lit(most_zoom)), lambda b: b < z)
    return F.aggregate(bits, start, step, lambda s: F.struct(z.alias("z"), s.x.alias("x"), s.y.alias("y")))


def boxes_meet(a_west: Column, a_south: Column, a_east: Column, a_north: Column, b_west: Column, b_south: Column, b_east: Column, b_north: Column) -> Column:
    """Whether two boxes meet; one whose west is east of its east spans the antimeridian."""
    plain = (a_west <= b_east) & (b_west <= a_east)
    over_a, over_b = a_west > a_east, b_west > b_east
    lon = F.when(over_a & over_b, True).when(over_a | over_b, (a_west <= b_east) | (b_west <= a_east)).otherwise(plain)
    return lon & (a_south <= b_north) & (b_south <= a_north)


def box_distance_m(lat: Column, lon: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """0 inside the box, else the planar distance to it."""
    return planar_m(lat, lon, F.least(F.greatest(lat, south), north), F.least(F.greatest(lon, west), east))


def clip_ring(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """A ring (array of struct<lat,lon>) cut at a line of latitude or longitude: what is above it, or what is below.

    Each side of the ring gives its end if that is inside, and the crossing before it if the side crosses the line.
    """
    inside = lambda p: p[axis] >= bound if above else p[axis] <= bound
    other = "lon" if axis == "lat" else "lat"

    def side(p: Column, q: Column) -> Column:
        at = p[other] + (q[other] - p[other]) * (bound - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))
        place = {axis: bound, other: at}
        crossing = F.when(inside(p) != inside(q), F.struct(place["lat"].alias("lat"), place["lon"].alias("lon")))
        return F.array_compact(F.array(crossing, F.when(inside(q), F.struct(q.lat.alias("lat"), q.lon.alias("lon")))))

    ends = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.flatten(F.zip_with(ring, ends, side))


def _bound_once(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """clip_ring of a ring that is computed once, though it is used three times."""
    return F.get(F.transform(F.array(ring), lambda r: clip_ring(r, axis, bound, above)), F.lit(0))


def clip_to_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The part of a ring inside a box, half-plane by half-plane; empty if nothing is."""
    for axis, bound, above in (("lon", west, True), ("lat", south, True), ("lon", east, False), ("lat", north, False)):
        ring = _bound_once(ring, axis, bound, above)
    return ring


def ring_area(ring: Column) -> Column:
    """Unsigned area in square degrees. Corners count from the first one, so that a small ring far from 0, 0 keeps its digits."""
    first = F.get(ring, F.lit(0))
    near = F.transform(ring, lambda p: F.struct((p.lat - first.lat).alias("lat"), (p.lon - first.lon).alias("lon")))
    parts = F.zip_with(near, F.concat(F.slice(near, 2, F.size(near)), F.slice(near, 1, 1)), lambda p, q: p.lon * q.lat - q.lon * p.lat)
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2
