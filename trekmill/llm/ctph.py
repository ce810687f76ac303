"""Context-triggered piecewise hashing: signatures of content-defined chunks, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

#: Symbols of a signature at most, bytes of the rolling window, and symbols in a row that two signatures must share.
SYMBOLS, WINDOW, SHARED = 64, 7, 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Odd multipliers of the rolling and of the chunk hash, and the latter's inverse modulo 2**64.
_ROLL, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_BASE, _LAST = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Rows in each range of documents that is read in order.
RANGE_ROWS = 4096
MOST_RANGES = 50_000

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def _signature(ends: np.ndarray, prefix: np.ndarray, up: np.ndarray) -> str:
    sums = np.diff(prefix[ends], prepend=np.uint64(0))
    mixed = sums * up[ends]
    mixed ^= mixed >> np.uint64(29)
    return ALPHABET[(mixed * _LAST) >> np.uint64(58)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """exponent:signature:signature at twice the block size. Null and empty text: "0::".

    A chunk ends at a byte whose hash of the last seven bytes ends in as many one bits as the exponent, and at the end of
    the text. The exponent is the least that gives 64 chunks or fewer. The whole text counts, whatever its length.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return "0::"
    wide = np.zeros(n + WINDOW - 1, np.uint32)
    wide[WINDOW - 1 :] = data
    wide[WINDOW - 1 :] += 1
    roll = wide[:n].copy()
    for k in range(1, WINDOW):
        roll *= _ROLL
        roll += wide[k : k + n]
    roll *= _MIX
    roll ^= roll >> np.uint32(15)
    ones = np.bitwise_count(roll & ~(roll + np.uint32(1)))  # low one bits in a row
    many = np.bincount(ones, minlength=33)[::-1].cumsum()[::-1]
    exponent = int(np.argmax(many < SYMBOLS))
    up, down = _power_tables(n)
    prefix = (data.astype(np.uint64) + np.uint64(1)) * down[:n]
    np.cumsum(prefix, out=prefix)
    out = []
    for e in (exponent, exponent + 1):
        ends = np.flatnonzero(ones >= e)
        if not len(ends) or ends[-1] != n - 1:
            ends = np.append(ends, n - 1)
        out.append(_signature(ends, prefix, up))
    return f"{exponent}:{out[0]}:{out[1]}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as the bits of an integer."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        match = where.get(c, 0)
        level = match | down
        cross = (((match & up) + up) ^ up) | match
        rise, fall = down | (full & ~(cross | up)), up & cross
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(level | rise)) & full, rise & level & full
    return score


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else the best of 1 - distance / longer length over signatures of one block size.

    Signatures that share no three symbols in a row (all, if one is shorter) count as unlike, and so do those of
    block sizes that differ more than twofold.
    """
    if a == b:
        return 1.0
    best = 0.0
    (ea, *sa), (eb, *sb) = a.split(":"), b.split(":")
    for i, x in enumerate(sa):
        j = int(ea) + i - int(eb)
        if j in (0, 1) and x and (y := sb[j]):
            run = min(SHARED, len(x), len(y))
            grams = {x[k : k + run] for k in range(len(x) - run + 1)}
            if any(y[k : k + run] in grams for k in range(len(y) - run + 1)):
                best = max(best, 1 - edit_distance(x, y) / max(len(x), len(y)))
    return best


@pandas_udf(StringType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function of `fingerprint`."""
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype=object)


@pandas_udf(DoubleType())
def likenesses(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Column function of `likeness`; null if either is null."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, extra) in ranges of descending doc_id, each in one partition and in order, with the first row of the next.

    The ranges are cut at quantiles of doc_id, so that a range's number follows from doc_id alone and a repeated task
    meets the same rows. Of each range the driver learns which row comes first: a row for each range.
    """
    n = docs.count()
    ranges = min(max(1, n // RANGE_ROWS), MOST_RANGES)
    at = (-F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))).alias("at")
    keyed = docs.select("doc_id", "text", at, F.xxhash64("text").alias("tie"))
    cuts = keyed.where("doc_id is not null").approxQuantile("at", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)) if ranges > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="at", outputCol="slot").transform(keyed).withColumn("slot", F.col("slot").cast("int"))
    else:
        keyed = keyed.withColumn("slot", F.lit(0))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not("doc_id").alias("back"), "tie")  # falls as doc_id rises
    firsts = keyed.groupBy("slot").agg(F.min(order).alias("first")).orderBy("slot").collect()
    if not firsts:
        return keyed.select(F.col("doc_id").cast("string"), "text", F.lit(False).alias("extra"))
    goes_to = {r.slot: firsts[i - 1].slot for i, r in enumerate(firsts)}
    known = docs.sparkSession.createDataFrame([(r.slot, goes_to[r.slot], r.first.no_id, r.first.back, r.first.tie) for r in firsts], "slot int, goes_to int, no_id boolean, back long, first_tie long")
    known = F.broadcast(known)  # a row for each range, MOST_RANGES at most
    is_first = (F.col("doc_id").isNull() == F.col("no_id")) & F.bitwise_not("doc_id").eqNullSafe(F.col("back")) & (F.col("tie") == F.col("first_tie"))
    places = F.when(is_first, F.array(F.struct(F.col("slot").alias("to"), F.lit(False).alias("extra")), F.struct(F.col("goes_to").alias("to"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("slot").alias("to"), F.lit(False).alias("extra"))))
    rows = keyed.join(known, "slot").select("doc_id", "text", "tie", F.explode(places).alias("p")).select("doc_id", "text", "tie", "p.to", "p.extra")
    dealt = rows.repartitionById(len(splits) - 1, F.col("to"))
    return dealt.sortWithinPartitions("to", "extra", F.col("doc_id").desc_nulls_last(), "tie").select(F.col("doc_id").cast("string"), "text", "extra")


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before = None  # the row that waits for its next: doc_id, text, fingerprint, extra
    for batch in batches:
        out = []
        for doc_id, text, extra in zip(batch.doc_id.tolist(), batch.text.tolist(), batch.extra.tolist(), strict=True):
            if before and before[3] and extra:
                continue  # the next range begins with equal rows
            text = text or ""
            own = fingerprint(text)
            if before and not before[3]:
                cut = len(before[1]) // 2
                edited = before[1][: len(before[1]) - cut] + text[:cut]
                changed = fingerprint(edited)
                out.append((before[0], len(before[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), before[2], changed, likeness(before[2], changed), likeness(before[2], own)))
            before = (doc_id, text, own, extra)
        yield pd.DataFrame(out, columns=_COLUMNS)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint and that of its edited text, and how like they and the next row's are.

    The next row is that of the next lower doc_id, after the last the first; rows of one doc_id follow in order of a
    hash of the text, rows without doc_id come last. The edited text has the last half of the code points (rounded down)
    replaced by the first as many, or all, of the next row's. A single row is its own next. Null text is as empty. Other
    columns are ignored. Texts are shuffled once; a task reads one range of rows in order and holds one batch.
    """
    rows = _ordered(docs.select("doc_id", "text"))
    found = rows.mapInPandas(_compared, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


