"""Round 4: what failed at size, by plans and by rows against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from trekmill.operators import matching, regions, similarity


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j16_points_by_cover", "j16_polygons_touching_boxes"])
def test_cells_of_polygons_are_never_broadcast(spark, name):
    """a table's size, which doesn't see that rows are multiplied, made Spark send all cells through the driver."""
    from trekmill.plans import QUERIES

    plan = _planned(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == plan.count("BroadcastNestedLoopJoin")  # of the levels alone


def test_many_edges_in_a_cell(spark, monkeypatch):
    """cells with more edges than are asked as columns, and boxes and points with nulls."""
    monkeypatch.setattr(regions, "SLOTS", 1)
    rng = random.Random(3)
    comb = [(x / 10, rng.uniform(0, 0.4) + (0.6 if x % 2 else 0)) for x in range(12)] + [(1.1, -0.5), (0.0, -0.5)]
    edges = [(1, *a, *b) for a, b in zip(comb, comb[1:] + comb[:1], strict=True)]
    points = [(i, rng.uniform(-0.6, 1.1), rng.uniform(-0.2, 1.3)) for i in range(300)] + [(900, None, 0.5), (901, 0.1, None)]
    holds = lambda y, x: sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for _, a, b, c, d in edges) % 2 == 1
    df = spark.createDataFrame(edges, "k int, x1 double, y1 double, x2 double, y2 double")
    at = spark.createDataFrame(points, "p int, lat double, lon double")
    want = {p for p, y, x in points[:300] if holds(y, x)}
    assert {r.p for r in regions.points_in(at, df, "p", "k", 0.5).collect()} == want and len(want) > 20
    boxes = at.select("p", F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north"))
    assert {r.p for r in regions.boxes_touching(boxes, df, "p", "k", 0.5).collect()} == want


@pytest.mark.parametrize("block", [7, 20_000])
def test_embassies_take_as_many_rounds_as_blocks(spark, monkeypatch, block):
    """interwoven lists took a round for each place that others send on; now only blocks of places are rounds."""
    rng = random.Random(9)
    monkeypatch.setattr(matching, "BLOCK_PLACES", block)
    kind = lambda: rng.choice(["embassy", "consulate", None])
    phone = lambda: rng.choice([None, *(f"06 {n:07d}" for n in range(9))])
    name = lambda: rng.choice(["Embassy of Peru", "Peru", "Embassy of New Peru", "Consulate of Peru"])
    p = spark.createDataFrame([(f"p{i:04d}", h, kind(), phone(), name()) for i in range(400) for h in [rng.choice([1, 2])]], "poi_id string, host int, kind string, phone string, name string")
    m = spark.createDataFrame([(i, rng.choice([1, 2, 3, None]), kind(), phone(), name()) for i in range(90)], "mission_id long, host int, kind string, phone string, name string")
    tables, write = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: tables.append(out := write(df)) or out)
    got = {tuple(r) for r in matching.embassy_pairs(p, m, ["host"]).collect()}
    assert len(tables) <= (7 if block > 400 else 7 + 400 // block)
    assert got == {tuple(r) for r in matching.greedy_pairs(matching.embassy_candidates(p, m, ["host"]), ["host"]).select("host", "poi_id", "mission_id").collect()} and len(got) > 30
    assert matching.embassy_pairs(p.limit(0), m, ["host"]).count() == 0


def test_signatures_of_one_set_go_before_sketches_are_joined(spark, monkeypatch):
    """every signature was shuffled with a sketch, though most are of one set alone; keys may be the same in two groups."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(25)]
    edited = lambda w: [x if rng.random() > 0.06 else f"x{rng.randrange(900)}" for x in w]
    rows = [(lang, i, edited(base[i % 25])) for lang in ("a", "b", None) for i in range(75)] + [("a", 900, []), ("a", 901, ["solo"])]
    tables, write = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df: tables.append(out := write(df)) or out)
    df = spark.createDataFrame(rows, "lang string, id int, w array<string>")
    near = lambda a, b: bool(a & b) and 5 * len(a & b) >= 4 * len(a | b)
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] is not None and x[1] < y[1] and near(set(x[2]), set(y[2]))}
    assert {(r.lang, r.left_key, r.right_key) for r in similarity.similar_pairs(df, None, ["lang"], "id", "w").collect()} == want and len(want) > 40
    heads, kept = (next(t for t in tables if c in t.columns) for c in ("own", "mark"))
    made = heads.agg(F.sum(F.size("own") + F.size("more"))).first()[0]
    assert kept.columns == ["sig", "key", "mark"] and kept.count() < made
    first = {(x[0], x[1], min(y[1] for y in rows if x[0] == y[0] and y[1] % 2 == 0 and near(set(x[2]), set(y[2])))) for x in rows if x[0] and x[1] % 2 and any(x[0] == y[0] and y[1] % 2 == 0 and near(set(x[2]), set(y[2])) for y in rows)}
    found = similarity.first_similar(df.where("id % 2 = 1"), df.where("id % 2 = 0"), ["lang"], "id", "w")
    assert {tuple(r) for r in found.select("lang", "left_key", "right_key").collect()} == first and first
