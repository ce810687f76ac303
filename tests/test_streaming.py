"""Streams over small files, run until all input is read."""

import datetime as dt

from pyspark.sql import functions as F

from trekmill.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _run(stream, tmp_path, name, mode, sink=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
    query.awaitTermination()
    return None if sink else stream.sparkSession.table(name)


def test_notices_once(spark, tmp_path):
    path, schema = str(tmp_path / "n"), "key string, stamp timestamp"
    _write(spark, path, [("a", T0), ("b", T0), ("a", T0 + dt.timedelta(minutes=5))], schema)
    got = _run(feeds.once(spark.readStream.schema(schema).parquet(path), ["key"]), tmp_path, "once_out", "append")
    assert sorted(r.key for r in got.collect()) == ["a", "b"]


def test_windows_match_batch(spark, tmp_path):
    path, schema = str(tmp_path / "w"), "kind string, stamp timestamp"
    rows = [("k" + str(i % 2), T0 + dt.timedelta(minutes=i)) for i in range(60)]
    _write(spark, path, rows, schema)
    got = _run(feeds.counts_by_window(spark.readStream.schema(schema).parquet(path), "stamp", ["kind"], "10 minutes"), tmp_path, "win_out", "complete")
    want = feeds.counts_by_window(spark.read.parquet(path), "stamp", ["kind"], "10 minutes")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 12


def test_latest_is_kept_and_repeats_change_nothing(spark, tmp_path):
    path, schema, out = str(tmp_path / "l"), "key string, at long, v string", str(tmp_path / "out")
    keep = feeds.keep_latest(out, ["key"], "at")
    _write(spark, path, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema)
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    _run(stream(), tmp_path, "l", "append", keep)
    _write(spark, path, [("a", 3, "w"), ("b", 0, "old")], schema)
    _run(stream(), tmp_path, "l", "append", keep)
    keep(spark.createDataFrame([("a", 3, "w"), ("b", 0, "old")], schema), 1)
    got = {(r.key, r.v) for r in feeds.latest(spark, out).collect()}
    assert got == {("a", "w"), ("b", "z")}


def test_refresh_interval():
    assert [feeds.refresh_seconds(n, False) for n in (0, 10_000_000, 1 << 40)] == [60, 200, 420] and feeds.refresh_seconds(0, True) == 120


def test_late_snapshots(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "id long, stamp timestamp"
    count = lambda: feeds.valid_snapshots(spark.readStream.schema(schema).parquet(path)).groupBy(F.window("stamp", "5 minutes")).count()
    _write(spark, path, [(1, T0 + dt.timedelta(hours=2))], schema)
    seen = []
    keep = lambda batch, _: seen.extend(r["count"] for r in batch.collect())
    _run(count(), tmp_path, "late", "append", keep)
    for i, minutes in ((2, 10), (3, 180)):  # the first is nearly two hours late, the second moves the watermark on
        _write(spark, path, [(i, T0 + dt.timedelta(minutes=minutes))], schema)
        _run(count(), tmp_path, "late", "append", keep)
    assert seen == [1]
