"""Spatial joins by grid cells: equi-joins on cells, so that no join pairs all rows with all."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekmill.functions.geo import METERS_A_DEGREE, box_distance_m, haversine_m, planar_m, segment_m
from trekmill.operators.lineage import written
from trekmill.operators.regions import points_in, touched


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _around(df: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    near = lambda v: F.sequence(_cell(F.col(v), size) - 1, _cell(F.col(v), size) + 1)
    return df.withColumn("_cy", F.explode(near(lat))).withColumn("_cx", F.explode(near(lon)))


def _globe_cell(row: Column, lon: Column, step: float) -> tuple[Column, Column]:
    """(number of cells around the globe in a row of latitude, cell of lon in it).

    Rows are `step` degrees high; cells are at least as wide as a distance of one step is in the row and in those beside it. Around a
    pole there is one cell.
    """
    steepest = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * step + step, F.lit(90.0))
    cells = F.greatest(F.floor(F.cos(F.radians(steepest)) * (360 / step) - 1e-6), F.lit(1)).cast("long")
    return cells, F.floor(F.pmod((lon + 180) / 360, F.lit(1.0)) * cells).cast("long")


def _on_globe(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    row = F.floor(F.col(lat) / step)
    return df.withColumns({"_cy": row, "_cx": _globe_cell(row, F.col(lon), step)[1]})


def _around_on_globe(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    """df in its own cell and the eight around it, past 180 degrees too."""
    row = F.floor(F.col(lat) / step)
    rows = df.withColumn("_cy", F.explode(F.sequence(row - 1, row + 1)))
    cells, own = _globe_cell(F.col("_cy"), F.col(lon), step)
    return rows.withColumn("_cx", F.explode(F.array_distinct(F.array(*(F.pmod(own + k, cells) for k in (-1, 0, 1))))))


def within_distance(a: DataFrame, b: DataFrame, meters: float) -> DataFrame:
    """Pairs of rows of a (lat, lon, ...) and b (b_lat, b_lon, ...) at most so many meters apart, with `meters`.

    An equi-join on cells of the globe; b is dealt to the nine cells around its own, a to its own. Pairs on both sides of
    180 degrees and near the poles meet like others. Rows without a place pair with none.
    """
    step = meters / METERS_A_DEGREE * 1.01
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(n, "_cy", "_cx")  # noqa: E731  # small inputs make many pairs: no tasks are to be joined into one
    pairs = dealt(_on_globe(a, "lat", "lon", step)).join(dealt(_around_on_globe(b, "b_lat", "b_lon", step)), ["_cy", "_cx"])
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    return pairs.withColumn("meters", far).where(F.col("meters") <= meters).drop("_cy", "_cx")


def drop_near(a: DataFrame, b: DataFrame, meters: float, same: list[str]) -> DataFrame:
    """Rows of a without a row of b (b_lat, b_lon) in reach that has equal `same` columns."""
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    step = meters / METERS_A_DEGREE * 1.01
    left = _on_globe(a, "lat", "lon", step)
    right = _around_on_globe(b.select("b_lat", "b_lon", *same), "b_lat", "b_lon", step)
    turn = F.round((F.col("a.lon") - F.col("b.b_lon")) / 360) * 360  # past 180 degrees
    near = planar_m(F.col("a.lat"), F.col("a.lon"), F.col("b.b_lat"), F.col("b.b_lon") + turn) <= meters
    on = (F.col("a._cy") == F.col("b._cy")) & (F.col("a._cx") == F.col("b._cx")) & near
    for k in keys:
        on &= k
    return left.alias("a").join(right.alias("b"), on, "left_anti").drop("_cy", "_cx")


def _least(pairs: DataFrame, key: str, far: str, name: str) -> DataFrame:
    """(key, name, far): the least pair of each key, ties to the lesser name. Pairs are made twice: that is cheaper than a sort of them."""
    best = pairs.groupBy(key).agg(F.min(far).alias("_best"))
    return pairs.select(key, name, far).join(best, key).where(F.col(far) == F.col("_best")).groupBy(key).agg(F.min(name).alias(name), F.first(far).alias(far))


def _halvings(b: DataFrame, cy: Column, cx: Column, most: int = 12) -> int:
    """How often a cell's side is to be halved so that a row of b shares its cell with two others or so, where rows are as dense as around most."""
    dense = b.groupBy(cy, cx).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 1.0  # one row
    return min(most, max(0, math.ceil(math.log(dense / 3, 4))))


def _in_widening_reach(a: DataFrame, key: str, find: Callable[[DataFrame, float], DataFrame], reach: float, halvings: int, least: float, far: str) -> DataFrame:
    """find(a, reach), by way of small reaches: rows of a that find something leave, the others ask again in twice the reach.

    What is found nearer than the reach by `least`, the distance's rounding, is what the whole reach would give, ties included.
    """
    parts, left = [], a
    for n in range(halvings, 0, -1):
        within = reach / 2**n
        parts.append(written(find(left, within).where(F.col(far) < within - least)))
        left = left.join(parts[-1].select(key), key, "left_anti")
    return reduce(DataFrame.unionByName, [*parts, find(left, reach)])


def nearest(a: DataFrame, b: DataFrame, key: str, b_key: str, meters: float) -> DataFrame:
    """For each row of a the nearest row of b in reach, ties to the lesser b_key; (key, b_key, meters).

    key tells the rows of a apart. Where rows of b are dense, small reaches are tried first.
    """

    def find(some: DataFrame, reach: float) -> DataFrame:
        return _least(within_distance(some, b, reach).withColumn("meters", F.round("meters", 3)), key, "meters", b_key)

    step = meters / METERS_A_DEGREE
    return _in_widening_reach(a, key, find, meters, _halvings(b, _cell(F.col("b_lat"), step), _cell(F.col("b_lon"), step)), 0.002, "meters")


def nearest_box(points: DataFrame, boxes: DataFrame, name: str) -> DataFrame:
    """points (lat, lon, ...) with `name` of the nearest box (name, west, south, east, north); of equal ones, in whole meters, the least.

    For a few boxes, such as networks: they are gathered in one row that goes to every task, so points aren't paired in a join.
    Boxes with a null bound count for nothing; without boxes the name is null.
    """
    few = boxes.where("west is not null and south is not null and east is not null and north is not null").agg(F.collect_list(F.struct(name, "west", "south", "east", "north")).alias("_boxes"))
    far = lambda b: F.struct(F.round(box_distance_m(F.col("lat"), F.col("lon"), b.west, b.south, b.east, b.north)).alias("m"), b[name].alias("name"))
    return points.join(F.broadcast(few)).withColumn(name, F.array_min(F.transform("_boxes", far))["name"]).drop("_boxes")


def nearest_segment(points: DataFrame, segments: DataFrame, reach: float, key: str, name: str) -> DataFrame:
    """(key, name, distance): the nearest segment (ax, ay, bx, by) of each point (x, y) in reach, in plane units.

    A segment is dealt to the cells that it touches, a point to its own and those around it. Where segments are dense, small
    reaches are tried first. name tells segments apart, key points.
    """
    edges = segments.select(name, F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))

    def find(some: DataFrame, within: float) -> DataFrame:
        parts = touched(edges, name, within).withColumnsRenamed({"cy": "_cy", "cx": "_cx"})
        pairs = _around(some, "y", "x", within).join(parts, ["_cy", "_cx"])
        far = segment_m(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
        pairs = pairs.withColumn("distance", F.round(far, 6)).where(F.col("distance") <= within)
        return _least(pairs, key, "distance", name)

    return _in_widening_reach(points, key, find, reach, _halvings(segments, _cell(F.col("ay"), reach), _cell(F.col("ax"), reach)) + 2, 2e-6, "distance")


def ring_edges(polygons: DataFrame, polygon: str) -> DataFrame:
    """(polygon, x1, y1, x2, y2) from (polygon, ring: array of struct<lat,lon>)."""
    ring = F.col("ring")
    sides = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.lon.alias("x1"), p.lat.alias("y1"), q.lon.alias("x2"), q.lat.alias("y2")))
    return polygons.select(polygon, F.inline(sides))


def inside(points: DataFrame, polygons: DataFrame, key: str, polygon: str, cell: float = 0.25) -> DataFrame:
    """(key, polygon) of points (lat, lon) in polygons (one row for each, `ring`: array of struct<lat,lon>, holes by even-odd).

    A polygon is dealt to the cells that it reaches: a point in a cell that is inside as a whole is in, at the boundary the edges
    of its row of cells are asked.
    """
    return points_in(points, ring_edges(polygons, polygon), key, polygon, cell)


def grid_representatives(points: DataFrame, key: str, cell: Column, by: list[str] | None = None) -> DataFrame:
    """The row with the least key of each cell."""
    chosen = points.withColumn("_cell", cell)
    return chosen.join(chosen.groupBy(*(by or []), "_cell").agg(F.min(key).alias(key)).select(key), key, "left_semi").drop("_cell")


def smallest_radius(points: DataFrame, lat: float, lon: float, radii: tuple[int, ...], enough: int, limit: int) -> DataFrame:
    """The nearest rows within the least radius that holds enough of them (else the greatest), limit at most."""
    far = points.withColumn("meters", planar_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("meters") <= max(radii))
    counts = far.agg(*(F.sum((F.col("meters") <= r).cast("long")).alias(f"n{r}") for r in radii)).first()  # one row
    radius = next((r for r in sorted(radii) if (counts[f"n{r}"] or 0) >= enough), max(radii))
    return far.where(F.col("meters") <= radius).orderBy("meters", points.columns[0]).limit(limit)


def quadtree(points: DataFrame, x: str, y: str, zoom: int, weight: str, cap: int) -> DataFrame:
    """(z, x, y, weight): the largest tiles whose summed weight is cap at most, or those of `zoom`; empty ones are left out.

    Weights are summed at `zoom` once and rolled up; a tile is kept if it fits and no ancestor does.
    """
    finest = points.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(weight).alias("weight"))
    levels = finest.select(F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("z"), "x", "y", "weight")
    rolled = levels.groupBy("z", F.expr(f"shiftright(x, {zoom} - z)").alias("x"), F.expr(f"shiftright(y, {zoom} - z)").alias("y")).agg(F.sum("weight").alias("weight"))
    fits = rolled.where((F.col("weight") <= cap) | (F.col("z") == zoom))
    above = fits.select(F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    parents = fits.withColumn("_z", F.explode(F.expr("filter(sequence(0, z), a -> a < z)"))).withColumn("_x", F.expr("shiftright(x, z - _z)")).withColumn("_y", F.expr("shiftright(y, z - _z)"))
    covered = parents.join(above, ["_z", "_x", "_y"], "left_semi").select("z", "x", "y").distinct()
    return fits.join(covered, ["z", "x", "y"], "left_anti")


def covering(cells: DataFrame, others: DataFrame) -> DataFrame:
    """cells (z, x, y) that equal, contain or lie in one of others."""
    ups = lambda df: df.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.col("z"))).alias("_z")).withColumns({"_x": F.expr("shiftright(x, z - _z)"), "_y": F.expr("shiftright(y, z - _z)")})
    same = [F.col("_z") == F.col("oz"), F.col("_x") == F.col("ox"), F.col("_y") == F.col("oy")]
    below = ups(cells).join(others.select(F.col("z").alias("oz"), F.col("x").alias("ox"), F.col("y").alias("oy")), same, "left_semi").select("z", "x", "y")
    over = ups(others).select(F.col("_z").alias("z"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    return cells.join(below.unionByName(over).distinct(), ["z", "x", "y"], "left_semi")


def circular_envelope(points: DataFrame, by: str) -> DataFrame:
    """(by, west, east, south, north): the box that leaves out the widest gap of longitude, so that it may pass 180 degrees."""
    lons = points.select(by, "lon").distinct()
    w = Window.partitionBy(by).orderBy("lon")
    ring = Window.partitionBy(by)
    gaps = lons.withColumns({"next": F.lead("lon").over(w), "low": F.min("lon").over(ring)})
    gaps = gaps.withColumn("gap", F.coalesce(F.col("next"), F.col("low") + 360) - F.col("lon"))
    widest = gaps.groupBy(by).agg(F.max(F.struct("gap", (-F.col("lon")).alias("first"), F.coalesce("next", "low").alias("west"))).alias("g"))
    lats = points.groupBy(by).agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    return widest.select(by, "g.west", (-F.col("g.first")).alias("east")).join(lats, by)


def upper_median(rows: DataFrame, by: list[str], axis: str, name: str, bins: int = 1024) -> DataFrame:
    """(by, name): of each group element n // 2 in order of axis. No group is sorted as a whole.

    Rows are counted in bins between the group's bounds; of the bin that holds the element only its distinct values, with their
    counts, are put in order.
    """
    bounds = rows.groupBy(*by).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"), F.floor(F.count(axis) / 2).alias("_at"))
    share = (F.col(axis) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    binned = rows.select(*by, axis).where(F.col(axis).isNotNull()).join(bounds, by).withColumn("_bin", F.least(F.coalesce(F.floor(share * bins), F.lit(0)), F.lit(bins - 1)))
    upto = lambda order: F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counts = binned.groupBy(*by, "_bin", "_at").agg(F.count("*").alias("_n")).withColumn("_upto", upto("_bin"))
    chosen = counts.where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at"))).select(*by, "_bin", (F.col("_at") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    values = binned.join(chosen, [*by, "_bin"]).groupBy(*by, axis, "_left").agg(F.count("*").alias("_n")).withColumn("_upto", upto(axis))
    return values.where(F.col("_upto") > F.col("_left")).groupBy(*by).agg(F.min(axis).alias(name))


def upper_median_point(points: DataFrame, by: list[str], key: str) -> DataFrame:
    """Of each group the actual point nearest to the per-axis upper median (element n // 2 in order)."""
    both = points.join(upper_median(points, by, "lat", "m_lat"), by).join(upper_median(points, by, "lon", "m_lon"), by)
    far = F.pow(F.col("lat") - F.col("m_lat"), 2) + F.pow(F.col("lon") - F.col("m_lon"), 2)
    return both.groupBy(*by).agg(F.min_by(key, F.struct(F.round(far, 12), F.col(key))).alias(key))


def spread(boxes: DataFrame, count: str) -> DataFrame:
    """(x, y, share): the count of each box (x0, x1, y0, y1: whole cells, ends included) in equal parts over its cells."""
    parts = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    rows = boxes.select("y0", "y1", (F.col(count) / parts).alias("share"), F.explode(F.sequence("x0", "x1")).alias("x"))
    return rows.select("x", F.explode(F.sequence("y0", "y1")).alias("y"), "share")
