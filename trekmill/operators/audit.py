"""Audits of question-and-answer data: drop reasons, leaks, paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in rules))


def limit_repeats(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def in_few_groups(rows: DataFrame, item: str, group: str, most: int) -> DataFrame:
    """Rows whose item stands in `most` distinct groups or fewer."""
    frequent = rows.groupBy(item).agg(F.countDistinct(group).alias("_n")).where(F.col("_n") > most).select(item)
    return rows.join(frequent, item, "left_anti")


def stratified(rows: DataFrame, stratum: str, key: list[str], quota: int, seed: int = 7) -> DataFrame:
    """Up to quota rows of each stratum in order of a seeded hash; the same rows at every run."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *key)), *key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def holm(tests: DataFrame, by: list[str], p: str, key: str) -> DataFrame:
    """tests with `adjusted`: step-down p-values within each family."""
    w = Window.partitionBy(*by)
    step = (F.count("*").over(w) - F.row_number().over(w.orderBy(p, key)) + 1) * F.col(p)
    running = F.max("_s").over(w.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_s", F.least(F.lit(1.0), step)).withColumn("adjusted", running).drop("_s")


def discordant(a: DataFrame, b: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """One row: pairs that only a, and that only b, got right."""
    both = a.select(*keys, F.col(ok).alias("_a")).join(b.select(*keys, F.col(ok).alias("_b")), keys)
    return both.agg(F.count_if(F.col("_a") & ~F.col("_b")).alias("only_a"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_b"))
