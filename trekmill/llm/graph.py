"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekmill.llm.common import cut, splittable


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (hi, lo), any comparable type, hi > lo. Returns (node, root), root the least node that
    node is connected with; roots themselves are not listed.

    Both stars are a pre-aggregated minimum and a join that adaptive execution can split, so that a node with
    very many neighbours never meets in one task. Every round is checkpointed. No edges: no rows. Duplicates are
    harmless.
    """
    edges = cut(edges.distinct())
    before = _signature(edges)
    for _ in range(max_rounds):
        least = (
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
            .union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            .groupBy("u")
            .agg(F.min("v").alias("v"))
            .select("u", F.least("u", "v").alias("m"))
        )
        large = edges.join(splittable(least), F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct()
        lowest = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = (
            large.join(splittable(lowest), F.col("hi") == F.col("u"))
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        edges = cut(small)
        now = _signature(edges)
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
