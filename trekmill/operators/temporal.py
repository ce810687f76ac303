"""Joins and windows over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with the value of right's last row at or before its time (of equal times the greatest value), null if none.

    Both sides are unioned and carried forward in one sort by key and time: one shuffle, and no pairs.
    """
    a = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_side": F.lit(1)})
    b = right.select(*keys, time, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*keys).orderBy(time, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(order))
    return seen.where("_side = 1").select(*left.columns, value)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs with equal keys and start <= at <= end, all whole numbers; intervals are dealt to bins of `width`."""
    points = left.withColumn("_bin", F.floor(F.col(at) / width))
    spans = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.join(spans, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def drop_close(left: DataFrame, right: DataFrame, keys: list[str], at: str, reach: int) -> DataFrame:
    """Rows of left without a row of right with equal keys at most `reach` away in `at` (whole numbers)."""
    a = left.withColumn("_bin", F.floor(F.col(at) / reach))
    b = right.select(*keys, F.col(at).alias("_at")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_at") / reach) - 1, F.floor(F.col("_at") / reach) + 1)))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_bin"]]
    on = F.abs(F.col(f"a.{at}") - F.col("b._at")) <= reach
    for s in same:
        on = s & on
    return a.alias("a").join(b.alias("b"), on, "left_anti").drop("_bin")


def islands(df: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """df with `island`: a number that rises by one wherever `same` (this row goes on from the one before) isn't true."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def fill_times(df: DataFrame, keys: list[str], order: str, time: str, step: str) -> DataFrame:
    """df with missing times between known ones set in proportion to the running sum of step; none beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, forth = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    run = df.withColumn("_d", F.sum(step).over(back))
    known = F.when(F.col(time).isNotNull(), F.struct(F.col(time).alias("t"), F.col("_d").alias("d")))
    run = run.withColumns({"_a": F.last(known, True).over(back), "_b": F.first(known, True).over(forth)})
    share = (F.col("_d") - F.col("_a.d")) / F.nullif(F.col("_b.d") - F.col("_a.d"), F.lit(0))
    filled = F.coalesce(F.col(time).cast("double"), F.col("_a.t") + (F.col("_b.t") - F.col("_a.t")) * F.coalesce(share, F.lit(0.0)))
    return run.withColumn(time, filled).drop("_d", "_a", "_b")


def next_per_group(df: DataFrame, group: list[str], order: list, keep: int = 3) -> DataFrame:
    """The first `keep` rows of each group, with `nth` from 1."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= keep)
