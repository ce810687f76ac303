"""Scores and intervals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bm25(tf: Column, df: Column, length: Column, docs: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Contribution of one term in one field; df and mean_length count as 1 at least."""
    d = F.greatest(df, F.lit(1))
    idf = F.log(1 + (docs - d + 0.5) / (d + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(mean_length, F.lit(1.0))))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share's interval; null without trials."""
    p = hits / F.nullif(n, F.lit(0))
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p of b against c discordant pairs: the binomial tail as a sum of running products in logarithms."""
    n, k = b + c, F.least(b, c)
    start = F.struct((n * F.log(F.lit(0.5))).alias("log"), F.exp(n * F.log(F.lit(0.5))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s.log + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, step, lambda s: s["sum"])).otherwise(F.exp(n * F.log(F.lit(0.5))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def log_odds_z(a: Column, n_a: Column, b: Column, n_b: Column, prior: Column, n_prior: Column) -> Column:
    """z-score of the weighted log-odds ratio of a term with an informative prior."""
    odds = lambda x, n: F.log((x + prior) / (n + n_prior - x - prior))
    return (odds(a, n_a) - odds(b, n_b)) / F.sqrt(1 / (a + prior) + 1 / (b + prior))
