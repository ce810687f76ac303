"""Secret scans by fixed patterns and character Markov models, in DataFrame operations only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: Least length of an assigned value.
ASSIGNED = 6
#: What the models judge: maximal runs of key characters of this length or more.
LEAST = 16
#: Different characters that it must have; rulers and padding are neither random nor ordinary.
DISTINCT = 8
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Parts of such a run between its marks, so that a long name before a secret doesn't hide it.
PART = rf"[A-Za-z0-9+]{{{LEAST},}}"
ALPHABET = 67
CODES = 128
#: Matches whose places are summed together.
BLOCK = 256


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end>> of a pattern's matches, in code points. What lies between matches gives their places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    lengths = F.filter(lengths, lambda x: x.hit.isNotNull())
    none = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int>>))")

    def step(state: Column, x: Column) -> Column:
        start, end = state.at + x.gap, state.at + x.gap + x.hit
        return F.struct(end.alias("at"), F.concat(state.out, F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    # Blocks of matches first and the blocks' offsets then, as each step copies what it has so far.
    begins = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(begins, lambda b: F.aggregate(F.slice(lengths, b, BLOCK), none, step))
    upto = lambda state, x: F.struct((state.at + x.at).alias("at"), F.concat(state.out, F.array(state.at)).alias("out"))
    offsets = F.aggregate(blocks, F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))"), upto, lambda state: state.out)
    spans = F.flatten(F.zip_with(blocks, offsets, lambda x, o: F.transform(x.out, lambda s: F.struct((s.start + o).alias("start"), (s.end + o).alias("end")))))
    return F.when(text.rlike(pattern), spans).otherwise(none.out)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s.end.alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind its array<struct<start,kind,end>>."""
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)
    kept = F.filter(F.zip_with(_spans(text, ASSIGN), values, lambda s, n: F.struct(s.start.alias("start"), s.end.alias("end"), n.alias("n"))), lambda x: x.n >= ASSIGNED)
    assign = F.when(text.rlike(ASSIGN), kept).otherwise(F.filter(kept, lambda x: F.lit(False)))
    return {"assign": _kind(assign, "assign"), "access": _kind(_spans(text, ACCESS), "access"), "hex": _kind(_spans(text, HEX), "hex")}


def threshold(wanted: int, total: int) -> int:
    """The greatest 63-bit hash of a share of wanted / total; at any total about as many are wanted."""
    return (1 << 63) - 1 if wanted >= total else ((1 << 63) - 1) * wanted // total


def labelled_samples(docs: DataFrame, docs_bound: int = 2000, strings: int = 2000) -> DataFrame:
    """(token, random): labelled training rows for the two models.

    Random: strings random, times four alphabets (hex, base64, upper-case and mixed alphanumeric), derived from
    SHA-512 of running numbers, so that every run has the same. Ordinary: the identifiers of about docs_bound
    documents (by hash of their id and text; all if there are fewer) outside of base spans, alone and joined to their
    neighbour by an underscore.
    """
    spark, total = docs.sparkSession, docs.count()
    digest = spark.range(strings).select(F.sha2(F.col("id").cast("string"), 512).alias("d"))
    b64 = F.base64(F.unhex("d"))
    random = digest.select(F.explode(F.array(F.substring("d", 1, 40), F.substring(b64, 1, 40), F.substring(F.regexp_replace(F.upper(b64), "[^A-Z0-9]", ""), 1, 24), F.substring(F.regexp_replace(b64, "[^A-Za-z0-9]", ""), 1, 32))).alias("token"), F.lit(True).alias("random"))
    part = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= threshold(docs_bound, total)
    bare = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        bare = F.regexp_replace(bare, pattern, " ")
    words = F.regexp_extract_all(bare, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws("_", a, b))
    ordinary = docs.where(part & F.col("text").isNotNull()).select(words.alias("words"), pairs.alias("pairs"))
    ordinary = ordinary.select(F.explode(F.concat("words", "pairs")).alias("token"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at a * 128 + b, from (token, random) rows.

    Transitions are counted in Spark; what comes to the driver is at most 128 * 128 counts for each label. Null and
    one-letter tokens have no transition. No rows at all: the ratios are 0.
    """
    chars = F.filter(F.transform(F.split("token", ""), F.ascii), lambda c: (c > 0) & (c < CODES))
    steps = samples.select("random", chars.alias("c")).select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * CODES + b)).alias("step"))
    steps = steps.where("step is not null")
    counts = {(r.random, r.step): r["count"] for r in steps.groupBy("random", "step").count().collect()}
    total: dict[tuple[bool, int], int] = {}
    for (label, step), n in counts.items():
        total[label, step // CODES] = total.get((label, step // CODES), 0) + n

    def log(label: bool, step: int) -> float:
        return math.log((counts.get((label, step), 0) + smooth) / (total.get((label, step // CODES), 0) + smooth * ALPHABET))

    return [round(log(True, s) - log(False, s), 6) for s in range(CODES * CODES)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Sum over the token's transitions; each character is met once."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(state: Column, c: Column) -> Column:
        add = F.when((state.before > 0) & (c < CODES), F.get(table, state.before * CODES + c)).otherwise(0.0)
        return F.struct(c.alias("before"), (state["sum"] + add).alias("sum"))

    return F.aggregate(F.transform(F.split(token, ""), F.ascii), start, step, lambda state: state["sum"])


def scan(docs: DataFrame, model: list[float], least_mean: float = 0.5) -> DataFrame:
    """docs with `base` and `found`: arrays of struct<start, kind (index in KINDS), end> ordered by start, then kind.

    found holds all base spans and the candidates whose log-likelihood ratio is least_mean or more a transition, unless
    they touch a base span. Candidates are runs of key characters of LEAST or more with DISTINCT different ones or more, and where
    a run as a whole isn't likely, such parts of it between its marks. Places are code points, end exclusive. Null text is as empty: no spans. Columns of docs
    with these names are replaced; rows are neither dropped nor merged.
    """
    text = F.coalesce("text", F.lit(""))
    by_kind = base_spans(text)
    base = docs.withColumn("base", F.array_sort(F.concat(*by_kind.values())))
    none = F.filter("base", lambda b: F.lit(False))

    def likely(pattern: str) -> Column:
        tokens = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.when(F.size(F.array_distinct(F.split(t, ""))) >= DISTINCT, log_ratio(t, model)))
        judged = F.zip_with(_spans(text, pattern), tokens, lambda s, r: F.struct(s.start.alias("start"), s.end.alias("end"), r.alias("r")))
        return F.when(text.rlike(pattern), _kind(F.filter(judged, lambda x: x.r >= least_mean * (x.end - x.start - 1)), "random")).otherwise(none)

    def apart(spans: str, others: str) -> Column:
        return F.filter(spans, lambda x: ~F.exists(others, lambda b: (b.start < x.end) & (x.start < b.end)))

    names = {"runs": likely(CANDIDATE), "parts": likely(PART)}
    judged = base.withColumn("_likely", F.struct(*(e.alias(c) for c, e in names.items())))
    judged = judged.withColumn("_likely", F.struct(apart("_likely.runs", "base").alias("runs"), apart("_likely.parts", "base").alias("parts")))
    more = F.concat("_likely.runs", apart("_likely.parts", "_likely.runs"))
    return judged.withColumn("found", F.array_sort(F.concat("base", more))).drop("_likely")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")

