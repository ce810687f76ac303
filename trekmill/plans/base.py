"""The registry, and stand-ins for the product's tables made from the driver's with whole-number arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PLACE = """place AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, c_nationkey AS nation, c_acctbal AS worth,
  40000000 + (c_custkey * 7919) % 5000000 AS lat_e6, 5000000 + (c_custkey * 104729) % 9000000 AS lon_e6 FROM customer)"""
STOP = """stop AS (SELECT s_suppkey AS stop_id, s_name AS stop_name, s_nationkey AS nation,
  40000000 + (s_suppkey * 611953) % 5000000 AS lat_e6, 5000000 + (s_suppkey * 999983) % 9000000 AS lon_e6 FROM supplier)"""
EVENT = """event AS (SELECT event_id, user_id, event_type, value, props, CAST(ts AS DATE) AS day,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + CAST(second(ts) AS BIGINT) AS sec FROM events)"""
#: The planar distance in metres of (lat, lon) pairs, in SQL.
PLANAR = "(111320.0 * sqrt(pow(({lon2} - {lon1}) * cos(radians({lat1})), 2) + pow({lat2} - {lat1}, 2)))"
HAVERSINE = "(2 * 6371000.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def plan(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def degrees(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.col("lat_e6") / 1e6, "lon": F.col("lon_e6") / 1e6})


def places(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("worth"), (40_000_000 + key * 7919 % 5_000_000).alias("lat_e6"), (5_000_000 + key * 104_729 % 9_000_000).alias("lon_e6"))


def stops(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(key.alias("stop_id"), F.col("s_name").alias("stop_name"), F.col("s_nationkey").alias("nation"), (40_000_000 + key * 611_953 % 5_000_000).alias("lat_e6"), (5_000_000 + key * 999_983 % 9_000_000).alias("lon_e6"))


def seconds(ts: Column) -> Column:
    """Whole seconds since 2024-01-01 without a time zone."""
    return (F.datediff(F.to_date(ts), F.lit("2024-01-01")) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.to_date("ts").alias("day"), seconds(F.col("ts")).alias("sec"))
