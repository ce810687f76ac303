"""Requirement rules: levels, precedence and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from the strongest.
LEVELS = ("required", "recommended", "consider", "none")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in LEVELS)), level)


def strongest(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, vaccine, level): the strongest level of each vaccine."""
    return items.groupBy(*by, "vaccine").agg(F.min_by("level", level_rank(F.col("level"))).alias("level"))


def summary(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): "level: a, b; level: c", levels from the strongest, vaccines by name."""
    grouped = items.groupBy(*by, "level").agg(F.array_join(F.sort_array(F.collect_set("vaccine")), ", ").alias("names"))
    line = F.struct(level_rank(F.col("level")).alias("rank"), F.concat_ws(": ", "level", "names").alias("line"))
    return grouped.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.line), "; ").alias("text"))
