"""Round 3, what was slow at size: the ways that take fewer pairs give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from trekmill.operators import matching, poi, regions, spatial
from trekmill.sources import feeds


def test_points_in_any_polygon_are_those_of_points_in(spark):
    rng = random.Random(4)
    rings = [(i, [(y + rng.uniform(0.2, 2), x), (y, x + rng.uniform(0.2, 2)), (y - 1.0, x - 1.0)]) for i in range(30) for y, x in [(rng.uniform(-5, 5), rng.uniform(-5, 5))]]
    edges = spatial.ring_edges(spark.createDataFrame(rings, "k int, ring array<struct<lat:double,lon:double>>"), "k")
    points = spark.createDataFrame([(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(400)], "p int, lat double, lon double")
    got = [r.p for r in regions.points_in_any(points, edges, "p", "k", 0.3).collect()]
    want = {r.p for r in regions.points_in(points, edges, "p", "k", 0.3).collect()}
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 400


def test_nearest_with_small_reaches_first(spark):
    rng = random.Random(5)
    b = [(i, 45 + rng.gauss(0, 0.02), 9 + rng.gauss(0, 0.02)) for i in range(600)] + [(1000 + i, 45.0, 9.0) for i in range(3)] + [(2000, 45.6, 9.0)]
    a = [(i, 45 + rng.gauss(0, 0.1), 9 + rng.gauss(0, 0.1)) for i in range(150)] + [(900, 45.0, 9.0), (901, 46.0, 9.0), (902, 60.0, 9.0)]
    left, right = spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "stop int, b_lat double, b_lon double")
    assert spatial._halvings(right, spatial._cell(F.col("b_lat"), 0.5), spatial._cell(F.col("b_lon"), 0.5)) > 2
    pairs = spatial.within_distance(left, right, 60_000).groupBy("id").agg(F.min(F.struct(F.round("meters", 3), "stop")).alias("m"))
    want = {(r.id, r.m.stop) for r in pairs.collect()}
    got = spatial.nearest(left, right, "id", "stop", 60_000).collect()
    assert {(r.id, r.stop) for r in got} == want and len(got) == len(want) and (901, 2000) in want and (900, 1000) in want


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_along_lists_are_the_greedy_pairs(spark, seed):
    rng = random.Random(seed)
    lands = ["Peru", "Chile", "New Peru"]
    name = lambda: rng.choice(["Embassy of ", "Consulate of ", ""]) + rng.choice(lands)
    kind = lambda: rng.choice(["embassy", "consulate", None])
    phone = lambda: rng.choice([None, *(f"06 {n:07d}" for n in range(12))])
    p = spark.createDataFrame([(i, rng.choice([1, 2, None]), kind(), phone(), name()) for i in range(150)], "poi_id long, host int, kind string, phone string, name string")
    m = spark.createDataFrame([(i, rng.choice([1, 2, None]), kind(), phone(), name()) for i in range(60)], "mission_id long, host int, kind string, phone string, name string")
    got = {tuple(r) for r in matching.embassy_pairs(p, m, ["host"]).collect()}
    assert got == {tuple(r) for r in matching.greedy_pairs(matching.embassy_candidates(p, m, ["host"]), ["host"]).select("host", "poi_id", "mission_id").collect()} and len(got) > 20


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_worked_out_once(spark):
    """filters on the place don't repeat the rules."""
    found = poi.published(spark.createDataFrame([(1, {"amenity": "cafe", "name": "n"}), (2, {"amenity": "bench"}), (3, {"x": "y"}), (4, None)], "id int, tags map<string,string>"))
    assert _optimized(found.groupBy("poi.package").count()).count("map_keys(") == 1
    assert [(r.id, r.poi.label, r.poi.package) for r in found.collect()] == [(1, "food", "base")]
    assert {r.id for r in poi.places(spark.createDataFrame([(1, {"amenity": "cafe"}), (2, {"amenity": "bench"}), (3, {"x": "y"}), (4, None)], "id int, tags map<string,string>")).collect()} == {1, 2}


def test_warning_messages_are_parsed_once(spark):
    """one parse gives all parts, missing and empty ones too; the first of several counts."""
    body = "<a xmlns='u'><identifier>{}</identifier><status>{}</status><msgType>{}</msgType><sent>2024-01-01T00:00:00Z</sent><info><event>e &amp; f</event><severity/></info><info><event>g</event></info></a>"
    rows = [(body.format(*v),) for v in (("m1", "Actual", "Alert"), ("m2", "Test", "Alert"), ("m3", "Actual", "Cancel"), ("", "Actual", ""))] + [(None,)]
    found = feeds.cap_alerts(spark.createDataFrame(rows, "body string"))
    assert _optimized(found).count(".evaluate(") == 1
    got = found.select("id", "event", "severity", F.unix_timestamp("starts"), "ends").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("m1", "e & f", None, 1704067200, None), (None, "e & f", None, 1704067200, None)], key=str)


def test_name_clusters_link_places_not_stops(spark, monkeypatch):
    """stops of one name, network and place form no pairs with those of another, yet are in their cluster."""
    rows = [(i, i % 2, "A", 42.0, 9.0) for i in range(10, 210)] + [(300 + i, 0, "A", 43.0, 9.0) for i in range(3)] + [(400, 2, "A", 42.0005, 9.0), (5, 0, "B", 42.0, 9.0), (500, None, "A", 42.0, 9.0), (501, 0, None, 42.0, 9.0)]
    sizes, cut = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    got = dict(map(tuple, matching.name_clusters(spark.createDataFrame(rows, "stop_id long, network int, name string, lat double, lon double")).collect()))
    assert got == {i: 10 if 10 <= i < 210 or i == 400 else i for i, *_ in rows}
    assert max(sizes) <= len(rows)


def test_footpaths_hold_no_pairs(spark, tmp_path):
    """near pairs and those of a station are told apart in the join, so no task gathers pairs; a dense cell isn't one task's with others."""
    from trekmill.plans import QUERIES

    spark.range(300).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["j11_footpaths"](spark, str(tmp_path))
    plan = _optimized(found)
    assert "Aggregate" not in plan and "RepartitionByExpression" in plan
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and (1, 3) in rows and (0, 2) not in rows and {(b, a) for a, b in rows} == set(rows)


def test_pages_reach_python_in_small_batches(spark, tmp_path):
    """a worker held up to 10,000 pages at once."""
    from trekmill.functions import markup
    from trekmill.plans import QUERIES

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    spark.range(3).selectExpr("id page_id", "'u' url", "'<p>a</p><p>b' html").write.parquet(f"{tmp_path}/pages.parquet")
    try:
        found = QUERIES["s11_html_text"](spark, str(tmp_path))
        assert [int(spark.conf.get(n)) for n in names] == [markup.BATCH_ROWS, markup.BATCH_BYTES]
        assert {r.text for r in found.collect()} == {"a\nb"} and found.count() == 3
        spark.conf.set(names[0], "7")
        markup.paged(found)
        assert spark.conf.get(names[0]) == "7"
    finally:
        for n in names:
            spark.conf.unset(n)


def test_live_events_read_lines_once(spark, monkeypatch):
    """the calls were grouped out of the lines again for every join of the feed and of the matching."""
    from trekmill.operators import live
    from trekmill.plans import QUERIES

    d, plans, write = "/root/testdata/sf0.001", [], live.written
    monkeypatch.setattr(live, "written", lambda df: plans.append(_optimized(df)) or write(df))
    plans.append(_optimized(QUERIES["q1_realtime"](spark, d)))
    assert len(plans) == 3 and not any("l_orderkey" in p for p in plans)
