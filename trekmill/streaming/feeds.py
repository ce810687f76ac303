"""Snapshots, notices and positions as streams; each function takes a streaming DataFrame and works on a batch one too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timely(updates: DataFrame, received: str = "received", time: str = "stamp", minutes: int = 10) -> DataFrame:
    """Updates of snapshots that were at most so many minutes old when they came in; older ones, and those without a stamp, go."""
    return updates.where(F.col(received).cast("timestamp") <= F.col(time) + F.make_interval(mins=F.lit(minutes)))


def valid_snapshots(updates: DataFrame, time: str = "stamp", minutes: int = 10) -> DataFrame:
    """Live updates; what comes more than ten minutes after a newer one is late and left out of windows and joins."""
    return updates.withWatermark(time, f"{minutes} minutes")


def once(notices: DataFrame, key: list[str], time: str = "stamp", remembered: str = "1 day") -> DataFrame:
    """Each notice once, as long as its key is remembered."""
    return notices.withWatermark(time, remembered).dropDuplicatesWithinWatermark(key)


def counts_by_window(rows: DataFrame, time: str, by: list[str], width: str, late: str = "10 minutes") -> DataFrame:
    """Rows in tumbling windows; a window is final once the watermark has passed it. An extra of this library."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def refresh_seconds(size: int, metered: bool, least: int = 60, most: int = 420, bytes_a_second: int = 50_000) -> int:
    """Polling interval of a feed: in proportion to its size, between one and seven minutes, twice that where data are metered."""
    return min(max(size // bytes_a_second, least), most) * (2 if metered else 1)


def keep_latest(path: str, key: list[str], order: str):
    """A foreachBatch function that keeps the latest row of each key in a Parquet table; a repeated batch changes nothing.

    Each batch writes a version of its own from the one before it and then removes older ones, so that readers of
    `latest` never meet half a table and a batch that runs again after a failure starts from the same version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from trekmill.operators.relational import latest_by

        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        old = spark.read.parquet(_version(path, before[-1])) if before else batch.limit(0)
        latest_by(old.unionByName(batch), key, [order]).write.mode("overwrite").parquet(_version(path, batch_id))
        for gone in before[:-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(_version(path, gone))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return write


def _version(path: str, number: int) -> str:
    return f"{path}/version={number:012d}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions in a folder, in order."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that keep_latest has written last."""
    return spark.read.parquet(_version(path, _versions(spark, path)[-1]))
