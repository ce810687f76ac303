"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekmill.llm.common import cut, n_words

#: Rates are rounded to millionths, so that the running sums that round them into copies are whole numbers.
UNIT = 1_000_000
#: Rows of a class of equal source and size that are put in order together.
BUCKET = 4096
#: Up to so many sources their multipliers (some 100 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """docs with `size`, the number of words of `text` (null: 0), and `tie`, which orders rows of one doc_id."""
    return docs.withColumns({"size": n_words(F.col("text")), "tie": F.xxhash64("text")})


def source_targets(sources: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """sources (source, source_size: one row each) with `target`.

    Sources by code point, null last, take `weights` in turn and share `share` times the total by weight. A target
    stops at cap times its source's size; what is over goes to the others by weight until none is above. That is
    the water level m at which the sum of min(cap * size, m * weight) is the total to share. share must not exceed cap.
    The ordering is over sources, not documents: one row for each source.
    """
    if share > cap:
        raise ValueError("share must not exceed cap")
    everyone = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    ranked = sources.select("source", "source_size", F.array(*(F.lit(float(w)) for w in weights))[turn].alias("weight"), (F.col("source_size") * cap).alias("most"))
    by_ratio = everyone.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weights = F.sum("source_size").over(everyone) * share, F.sum("weight").over(everyone)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.select("*", F.row_number().over(by_ratio).alias("rank"), level.alias("level"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most") * (1 + 1e-12), F.struct("rank", "level"))
    water = F.min(fits).over(everyone).level
    return levels.select("source", "source_size", F.least("most", F.coalesce(water * F.col("weight"), F.col("most"))).alias("target"))


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    """The tilted rate cap / (1 + (cap - 1) exp(-lam x)), x the size over the mean size: 1 at lam = 0, below cap."""
    return F.lit(cap) / (1 + (cap - 1) * F.exp(-F.greatest(F.least(lam * size / mean, F.lit(700.0)), F.lit(-700.0))))


def balance(classes: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 60, within: float = 1e-9) -> DataFrame:
    """(key, lam) that solve sum(n * size * rate(lam, size)) = target for every source.

    classes: (key, size, n); targets: (key, source_size, docs, target), 0 < target < cap * source_size.
    Of all rates below cap the solution has least relative entropy to taking each document once, given the words
    to take. Its dual is convex with one multiplier for each source. A round is one distributed sum of the dual's
    gradient and curvature over the classes and a Newton step for all sources at once, halved between the bounds
    found so far where the step leaves them.
    """
    state = cut(targets.select("key", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("off")))
    few = state.count() <= BROADCAST_SOURCES
    for _ in range(rounds):
        rate, words = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap), F.col("n") * F.col("size")
        sums = classes.join(F.broadcast(state) if few else state, "key").groupBy("key", "target", "mean", "lam", "lo", "hi")
        sums = sums.agg((F.sum(words * rate) - F.first("target")).alias("g"), F.sum(words * F.col("size") / F.col("mean") * rate * (1 - rate / cap)).alias("h"))
        lo, hi = F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo")), F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi"))
        sums = sums.select("key", "target", "mean", "lam", "g", "h", lo.alias("lo"), hi.alias("hi"))
        newton = F.when(F.col("h") > 0, F.col("lam") - F.col("g") / F.col("h"))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        middle = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        far = F.abs(newton - F.col("lam")) > 8 * (1 + F.abs("lam"))  # a step out of a flat part of the curve
        step = F.when(inside & ~far, newton).otherwise(middle)
        off = F.abs("g") / F.col("target")
        state = cut(sums.select("key", "target", "mean", F.when(off <= within, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", off.alias("off")))
        if (state.agg(F.max("off")).first()[0] or 0.0) <= within:
            break
    else:
        if (state.agg(F.max("off")).first()[0] or 0.0) > 1e-4:
            raise RuntimeError(f"multipliers have not settled after {rounds} rounds")
    return state.select("key", "mean", "lam")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """sized(docs) with source_size (long), target (double), copies (long): how often the mix takes each row.

    docs: doc_id, source, size, tie and any other columns. Rates from `balance` are rounded to copies by systematic
    sampling: along a source's documents in order of size, each has the whole part of its rate, and one more
    wherever the running sum of the fractions passes a whole number; a source's words so miss its target by about
    the size of one document. Rows of one source and size have one rate. Such a class is dealt into buckets
    by a hash of doc_id and the running sum is carried over classes and buckets, so that no task orders a hot source or
    a large group of copies alone. Null sources are a source of their own. Rows with null doc_id come last in
    their bucket; repeated rows each count. Sources without words have target 0 and each row once; the words taken are
    0 as well. Empty tables stay empty. The result doesn't depend on partitioning.
    """
    docs = docs.withColumn("_key", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")))
    buckets = max(1, docs.count() // BUCKET)
    docs = docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    counted = cut(docs.groupBy(F.col("_key").alias("key"), "source", "size", F.col("_bucket").alias("bucket")).agg(F.count("*").alias("n")))
    classes = cut(counted.groupBy("key", "size").agg(F.sum("n").alias("n")))
    sources = counted.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    targets = cut(sources.join(source_targets(sources.select("source", "source_size"), share, weights, cap).select(F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("key"), "target"), "key"))
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-9)
    solved = balance(classes, targets.where((F.col("target") > 0) & ~full), cap)
    plan = targets.join(solved, "key", "left")
    rate = F.when(full & (F.col("source_size") > 0), F.lit(cap)).when(F.col("source_size") == 0, 1.0).otherwise(F.coalesce(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap), F.lit(0.0)))
    rated = classes.join(plan, "key").select("key", "size", "n", "source_size", "target", F.round(rate * UNIT).cast("long").alias("rate"))
    rated = rated.withColumns({"whole": F.floor(F.col("rate") / UNIT), "part": F.col("rate") % UNIT})
    run = F.sum(F.col("n") * F.col("part")).over(Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    rated = rated.select("key", "size", "source_size", "target", "whole", "part", F.coalesce(run, F.lit(0)).alias("run"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select("key", "size", "bucket", within.alias("within")).join(rated, ["key", "size"])
    starts = starts.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"), "source_size", "target", F.col("whole").alias("_whole"), F.col("part").alias("_part"), (F.col("run") + F.col("within") * F.col("part") + UNIT // 2).alias("_start"))
    docs = docs.drop("source_size", "target", "copies").withColumnRenamed("size", "_size")
    mixed = docs.join(starts, ["_key", "_size", "_bucket"])
    nth = F.row_number().over(Window.partitionBy("_key", "_size", "_bucket").orderBy(F.col("doc_id").asc_nulls_last(), "tie"))
    mixed = mixed.withColumn("_nth", nth)
    upto = lambda n: F.floor((F.col("_start") + n * F.col("_part")) / UNIT)
    copies = F.col("_whole") + upto(F.col("_nth")) - upto(F.col("_nth") - 1)
    return mixed.withColumn("copies", copies.cast("long")).withColumnRenamed("_size", "size").drop("_key", "_bucket", "_whole", "_part", "_start", "_nth")


def take(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of docs as often as `mix` takes it, with the columns of docs."""
    rows = sized(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))).drop("text")
    mixed = mix(rows, share, weights, cap).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
