"""Catalogs of published packages: cells, fragments and carried-over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekmill.operators.relational import upsert


def merge_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells (z, x, y, version) with new ones in place of old; a cell that holds another goes, so that none overlap."""
    both = upsert(old, new, ["z", "x", "y"])
    above = both.select(F.explode(F.expr("filter(sequence(0, z), a -> a < z)")).alias("pz"), "z", "x", "y")
    holds = above.select(F.col("pz").alias("z"), F.expr("shiftright(x, z - pz)").alias("x"), F.expr("shiftright(y, z - pz)").alias("y")).distinct()
    return both.join(holds, ["z", "x", "y"], "left_anti")


def uncovered(seeds: DataFrame, published: DataFrame) -> DataFrame:
    """Seed cells that neither equal, hold nor lie in a published cell."""
    from trekmill.operators.spatial import covering

    return seeds.join(covering(seeds, published).select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")


def carry_over(old: DataFrame, new: DataFrame, key: str, today, days: int = 7) -> DataFrame:
    """new pages, and old ones (key, fetched date) whose key is missing if they are at most so many days old."""
    fresh = old.join(new.select(key), key, "left_anti").where(F.datediff(F.lit(today).cast("date"), F.col("fetched")) <= days)
    return new.unionByName(fresh)


def overlay(sections: DataFrame, translations: DataFrame, group: list[str]) -> DataFrame:
    """sections (group, position, text) with `translated`: text by the SHA-1 of its paragraph, for whole groups or not at all.

    A paragraph whose numbers differ from its translation's counts as missing.
    """
    from trekmill.functions.text import numbers_in

    keyed = sections.withColumn("key", F.sha1("text")).join(translations.select("key", F.col("text").alias("other")), "key", "left")
    fits = F.col("other").isNotNull() & (F.sort_array(numbers_in(F.col("text"))) == F.sort_array(numbers_in(F.col("other"))))
    whole = keyed.withColumn("fits", F.coalesce(fits, F.lit(False))).groupBy(*group).agg(F.min("fits").alias("whole"))
    return keyed.join(whole, group).select(*group, "position", "text", F.when(F.col("whole"), F.col("other")).alias("translated"))
