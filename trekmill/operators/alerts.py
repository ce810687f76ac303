"""Selecting and merging hazard alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekmill.functions.geo import boxes_meet
from trekmill.operators.temporal import drop_close

#: Least magnitude of a quake that is told, in countries with and without many quakes.
MAGNITUDE, MAGNITUDE_SEISMIC = 4.5, 5.0


def relevant_quake(magnitude: Column, felt: Column, impact: Column, seismic: Column) -> Column:
    """Strong enough for the country, or felt by a hundred or more, or with an impact reported."""
    return (magnitude >= F.when(seismic, MAGNITUDE_SEISMIC).otherwise(MAGNITUDE)) | (F.coalesce(felt, F.lit(0)) >= 100) | impact.isNotNull()


def active(alerts: DataFrame, now: Column) -> DataFrame:
    """Alerts without an end, or whose end is to come."""
    return alerts.where(F.col("ends").isNull() | (F.col("ends") > now))


def in_area(alerts: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Alerts (west, south, east, north; null for no area) that meet a box or have no area; without a box only the latter."""
    none = F.col("west").isNull()
    if box is None:
        return alerts.where(none)
    return alerts.where(none | boxes_meet(F.col("west"), F.col("south"), F.col("east"), F.col("north"), *(F.lit(v) for v in box)))


def drop_doubles(alerts: DataFrame, weaker: str, stronger: str, kind: str, seconds: int = 3600) -> DataFrame:
    """alerts without those of a weaker source that have one of a stronger within an hour (`sec`, whole seconds)."""
    a = alerts.where((F.col("source") == weaker) & (F.col("kind") == kind))
    rest = alerts.where(~((F.col("source") == weaker) & (F.col("kind") == kind)))
    kept = drop_close(a, alerts.where((F.col("source") == stronger) & (F.col("kind") == kind)), ["kind"], "sec", seconds)
    return rest.unionByName(kept.select(rest.columns))


def merge_zones(alerts: DataFrame, by: list[str], zone: str, width: int = 160) -> DataFrame:
    """Copies for several zones as one: least start, no end if any has none, else the greatest; zones once, shortened."""
    ends = F.when(F.count("*") == F.count("ends"), F.max("ends"))
    return alerts.groupBy(*by).agg(F.min("starts").alias("starts"), ends.alias("ends"), F.left(F.array_join(F.sort_array(F.collect_set(zone)), ", "), F.lit(width)).alias("zones"))


def ranked(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("level"), F.desc("starts"), "id")
