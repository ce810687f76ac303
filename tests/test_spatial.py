import math
import random

from trekmill.operators import spatial


def haversine(a, b):
    (la, lo), (lb, mo) = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def test_pairs_across_180_degrees_and_near_the_poles(spark):
    rng = random.Random(1)
    at = [(0.0, 179.99), (0.0, -179.99), (85.0, 10.0), (85.05, 10.5), (89.99, 0.0), (89.98, 180.0), (90.0, -77.0), (-90.0, 5.0), (-89.97, 120.0), (45.0, 180.0), (45.01, -180.0)]
    at += [(rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), rng.uniform(179.8, 180), rng.uniform(-180, -179.8)])) for _ in range(400)]
    at += [(rng.choice([1, -1]) * rng.uniform(84, 90), rng.uniform(-180, 180)) for _ in range(300)]
    rows = list(enumerate(at))
    a = spark.createDataFrame([(i, *p) for i, p in rows] + [(9999, None, None)], "id int, lat double, lon double")
    b = a.selectExpr("id as b_id", "lat as b_lat", "lon as b_lon")
    got = [(r.id, r.b_id) for r in spatial.within_distance(a, b, 10_000).select("id", "b_id").collect()]
    want = {(i, j) for i, p in rows for j, q in rows if haversine(p, q) <= 10_000}
    assert len(got) == len(set(got)) and set(got) == want and (0, 1) in want and (4, 5) in want
    left = {r.id for r in spatial.drop_near(a.where("id = 0"), b.where("b_id = 1"), 10_000, []).collect()}
    assert not left


def test_points_in_polygons(spark):
    rng = random.Random(2)
    rings = [[(y + math.sin(t) * rng.uniform(0.2, 3), x + math.cos(t) * rng.uniform(0.2, 3)) for t in [k * 0.7 for k in range(9)]] for y, x in [(rng.uniform(-20, 20), rng.uniform(-30, 30)) for _ in range(12)]]
    points = [(rng.uniform(-22, 22), rng.uniform(-32, 32)) for _ in range(500)] + [(sum(y for y, _ in r) / 9, sum(x for _, x in r) / 9) for r in rings]

    def holds(ring, lat, lon):
        n = 0
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        return n % 2 == 1

    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, lat double, lon double")
    q = spark.createDataFrame(list(enumerate(rings)), "ring_id int, ring array<struct<lat:double,lon:double>>")
    got = {(r.id, r.ring_id) for r in spatial.inside(p, q, "id", "ring_id").collect()}
    assert got == {(i, k) for i, (y, x) in enumerate(points) for k, r in enumerate(rings) if holds(r, y, x)} and got


def test_upper_median_of_ties_and_spread(spark):
    rng = random.Random(3)
    groups = {"ties": [1.5] * 40, "one": [7.0], "two": [2.0, 1.0], "mixed": [0.0] * 5 + [rng.gauss(0, 9) for _ in range(500)] + [1e6], "near": [5 + k * 1e-9 for k in range(50)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("ties", None), ("none", None)]
    got = {r.g: r.m for r in spatial.upper_median(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", "m").collect()}
    assert got == {g: sorted(xs)[len(xs) // 2] for g, xs in groups.items()}


def test_nearest_box(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 9.0)], "id int, lat double, lon double")
    boxes = spark.createDataFrame([("b", -1.0, -1.0, 1.0, 1.0), ("a", -2.0, -2.0, 2.0, 2.0), ("c", 8.0, -1.0, 10.0, 1.0), ("d", None, 0.0, 9.0, 9.0)], "net string, west double, south double, east double, north double")
    assert {r.id: r.net for r in spatial.nearest_box(points, boxes, "net").collect()} == {1: "a", 2: "c"}
    assert {r.net for r in spatial.nearest_box(points, boxes.limit(0), "net").collect()} == {None}
