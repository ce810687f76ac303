"""Readers, writers and markup on small fixtures."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from trekmill.functions import markup
from trekmill.functions import text as T
from trekmill.sources import feeds, packages, realtime


def test_feed_csv_and_zip(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes('﻿stop_id,stop_name,extra\n1,"Main, ""Old""\nSquare", x\n2, North\n'.encode())
    rows = feeds.csv_table(spark, str(tmp_path / "stops.txt"), ["stop_id", "stop_name", "stop_code"]).orderBy("stop_id").collect()
    assert [(r.stop_id, r.stop_name, r.stop_code) for r in rows] == [("1", 'Main, "Old"\nSquare', ""), ("2", "North", "")]
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("inner/stops.txt", "a,b\n1,2\n")
        z.writestr("trips.txt", "x\n")
    found = feeds.zip_entries(spark, str(tmp_path / "feed.zip"), "stops.txt").collect()
    assert [r.content for r in found] == ["a,b\n1,2\n"]


def test_tables_points_and_json(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# head\nIT\t112\n# more\nFR\t15\n")
    assert {tuple(r) for r in feeds.tsv_dimension(spark, str(tmp_path / "d.tsv"), "code string, n int").collect()} == {("IT", 112), ("FR", 15)}
    (tmp_path / "p.tsv").write_text("45.1\t9.1\t3\n50\t9.1\t4\tosm\tVia\tRoma\n45.2\t9.2\t5\tosm\n")
    assert {(r.number, r.dataset) for r in feeds.points(spark, str(tmp_path / "p.tsv"), 9, 45, 10, 46).collect()} == {("3", None), ("5", "osm")}
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n{"a": 3}\n')
    assert sorted(r.a for r in feeds.json_lines(spark, str(tmp_path / "j.jsonl"), "a long").collect()) == [1, 3]
    spark.createDataFrame([(1, 45.0, 9.0, "osm", "free"), (2, 45.0, 9.0, "osm", "closed"), (3, 60.0, 9.0, "osm", "free")], "id long, lat double, lon double, dataset string, licence string").write.parquet(str(tmp_path / "o"))
    assert [r.id for r in feeds.open_places(spark, str(tmp_path / "o"), 8, 44, 10, 46, [("osm", "free")]).collect()] == [1]


def test_map_files(spark, tmp_path):
    (tmp_path / "m.osm").write_text("""<osm><node id="1" lat="45.0" lon="9.0"><tag k="amenity" v="cafe"/></node><node id="2" lat="1" lon="2"/>
<way id="7"><center lat="45.5" lon="9.5"/><tag k="tourism" v="museum"/><tag k="name" v="M"/></way></osm>""")
    rows = {(r.type, r.id, r.lat, r.lon, r.tags.get("name")) for r in feeds.map_elements(spark, str(tmp_path / "m.osm")).collect()}
    assert rows == {("node", 1, 45.0, 9.0, None), ("way", 7, 45.5, 9.5, "M")}
    point = {"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Point", "coordinates": [9.0, 45.0]}}
    (tmp_path / "g.seq").write_text("\x1e" + json.dumps(point) + "\n" + json.dumps(point | {"geometry": {"type": "LineString", "coordinates": []}}) + "\n")
    assert [(r.properties["name"], r.lon, r.lat) for r in feeds.geojson_lines(spark, str(tmp_path / "g.seq")).collect()] == [("A", 9.0, 45.0)]
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>Rome</title><ns>0</ns><revision><text bytes='4'>text</text></revision></page><page><title>Talk</title><ns>1</ns><revision><text bytes='1'>x</text></revision></page></mediawiki>")
    found = feeds.wiki_pages(spark, str(tmp_path / "w.xml"), spark.createDataFrame([("Rome",), ("Talk",)], "title string")).collect()
    assert [(r.title, r.text) for r in found] == [("Rome", "text")]


def test_broken_alert_feed_is_an_error(spark):
    with pytest.raises(Exception, match="not a feature collection"):
        feeds.quake_alerts(spark.createDataFrame([("{}",)], "body string")).collect()
    empty = '{"type": "FeatureCollection", "features": []}'
    assert feeds.quake_alerts(spark.createDataFrame([(empty,)], "body string")).count() == 0


def _varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def test_live_feed(spark):
    stop = _field(1, 4) + _field(4, b"S9") + _field(3, _field(1, -60) + _field(2, 1_700_000_000))
    trip = _field(1, b"T1") + _field(3, b"20240110") + _field(5, b"R")
    feed = _field(1, _field(3, 1_699_999_999)) + _field(2, _field(1, b"e") + _field(3, _field(1, trip) + _field(2, stop))) + _field(2, _field(3, _field(1, _field(1, b"T2") + _field(4, 3))))
    got = realtime.decode(spark.createDataFrame([("a", bytearray(feed)), ("bad", bytearray(feed[:-3])), ("none", bytearray())], "snapshot string, content binary")).orderBy("trip_id").collect()
    assert [(r.snapshot, r.stamp, r.trip_id, r.start_date, r.stop_sequence, r.stop_id, r.delay, r.time, r.relationship) for r in got] == [
        ("a", 1_699_999_999, "T1", "20240110", 4, "S9", -60, 1_700_000_000, 0), ("a", 1_699_999_999, "T2", None, None, None, None, None, 3)
    ]


def test_packages(spark, tmp_path):
    rows = [("Via A", "Roma", "1", 41.0, 12.0), ("Via A", "Roma", "1", 41.0, 12.0), ("Via A", None, "2B", 41.5, 12.5), ("Via A", None, "2b", 41.5, 12.5)]
    packages.write_addresses(spark.createDataFrame(rows, "street string, city string, number string, lat double, lon double"), str(tmp_path / "addr"))
    got = {(r.street, r.city, r.number.lower(), r.lat, r.lon) for r in packages.read_addresses(spark, str(tmp_path / "addr")).collect()}
    assert got == {("Via A", "Roma", "1", 41.0, 12.0), ("Via A", None, "2b", 41.5, 12.5)}
    path = str(tmp_path / "regions")
    packages.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v long, region string"), path, ["region"])
    packages.replace_partitions(spark.createDataFrame([(3, "b")], "v long, region string"), path, ["region"])
    assert {(r.v, r.region) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}
    packages.write_table(spark.range(3).toDF("v"), str(tmp_path / "t"), ["v"])
    packages.write_table(spark.range(2).toDF("v"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_markup():
    assert markup.html_text("<h1>A</h1><h2>Empty</h2><h2>B</h2><p>one <b>two</b></p><ul><li>x<li>y</ul><script>no()</script>") == "▸ B\none two\n• x\n• y"
    assert markup.wiki_text("== H ==\n'''bold''' [[a|b]] {{t|{{u}}}}\n* [http://x.org label]\n== Last ==\n") == "▸ H\nbold b\n• label"
    assert markup.opening_ranges("Mo-Fr 09:00-18:00; Sa 10:00-14:00") == "Mo-Fr 09:00-18:00; Sa 10:00-14:00; Su closed"
    assert markup.opening_ranges("sunrise-sunset") == "" and markup.opening_days("24/7") == ["00:00-24:00"] * 7
    for values in ([], [0], [5, 3, 300, -7, 1 << 40]):
        assert markup.unpack_deltas(markup.pack_deltas(values)) == values


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.paragraphs(F.lit("aa\nbb\n\ncccc\nd"), 4)) == ["aa\nbb", "cccc", "d"]
    assert one(T.relevant_paragraphs(F.lit("one two\nthe three\nfour five six seven eight"), F.array(F.lit("the")), F.lit(20))) == "one two\nthe three"
    assert one(T.cut_at_sentence(F.lit("First one. Second two three"), 20)) == "First one. Second"
    assert one(T.cut_at_sentence(F.lit("First one is. Second two three"), 20)) == "First one is."
    assert one(T.intent(F.lit("Where are hotels?"), {"sleep": ["hotel"], "eat": ["food"]})) == ["sleep"]
    assert one(T.in_language(F.from_json(F.lit('[{"lang":"fr","text":"b"}]'), "array<struct<lang:string,text:string>>"), "it")) is None
    assert one(T.house_number(F.lit("Via Roma 12b"))) == "12b" and one(T.house_number(F.lit("Via Roma"))) == ""


def test_snapshots_beyond_the_bounds_are_left_out_whole(monkeypatch):
    trip = b"\x1a\x02\x0a\x00"  # an entity with an empty trip update
    snapshot = b"".join(b"\x12" + bytes([len(trip)]) + trip for _ in range(3))
    assert len(list(realtime.trip_updates(snapshot))) == 3
    monkeypatch.setattr(realtime, "MOST_ENTITIES", 2)
    with pytest.raises(ValueError, match="too many"):
        list(realtime.trip_updates(snapshot))
