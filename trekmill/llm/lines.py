"""Line deduplication by winnowing over line hashes.

Where a text's line feeds are doesn't say where its repeated passages begin. So the lines that are hashed and winnowed here
are rolling ones: LINE words from each word on, whatever the white space between them. Tasks hash words in numpy; Spark
counts, joins and groups. (The same in array functions needs several times the CPU seconds that there are: see the README.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from trekmill.llm.common import cut, small_batches, splittable
from trekmill.llm.hashing import chunks, doubled, joined_words, mixed, word_places
from trekmill.operators.relational import numbered

#: Words of a rolling line.
LINE = 8
#: Places are compared with null doc_id last.
_ROW = ["no_id", "doc_id", "text_hash"]
_KEY = "no_id boolean, doc_id long, text_hash long"
_RANGES = ArrayType(StructType([StructField("at", IntegerType()), StructField("to", IntegerType())]))
#: As many words as a string of Spark's can have: two gigabytes with a letter and a space each.
MOST_WORDS = 1 << 30


def window_hashes(texts: list[str | None], min_words: int) -> tuple[np.ndarray, ...]:
    """Hashes of all lines and of all windows of min_words words of the joined texts; the text of each word; each text's first word."""
    words, text, firsts = joined_words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    if len(words) < min_words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), text, firsts
    line = min(LINE, min_words)
    lines = doubled(words, 1, line)
    return lines, doubled(lines, line, min_words), text, firsts


def winnow(texts: list[str | None], min_words: int) -> tuple[np.ndarray, ...]:
    """text (its index), g, at, n, h of the guaranteed fingerprints of some texts.

    The least line hash g, the first of equals, of a window of min_words words is that of the n windows from word `at` on, n at
    most min_words; every window has one, which depends on its words alone. h is a hash of all words of these windows.
    Where a text has the same windows before, neighbours are one row with -n, as these repeat whatever other texts hold.
    """
    lines, windows, text, firsts = window_hashes(texts, min_words)
    if not len(windows):
        return (windows.view(np.int64),) * 5
    least, place, done, width = lines, np.arange(len(lines)), 1, min_words - min(LINE, min_words) + 1
    while done < width:
        step = min(done, width - done)
        right = least[step:] < least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        done += step
    inside = np.flatnonzero(text[: len(windows)] == text[min_words - 1 :])  # windows within one text
    turns = np.flatnonzero(np.concatenate(([True], place[inside][1:] != place[inside][:-1]))) if len(inside) else inside
    at, n = inside[turns], np.diff(np.append(turns, len(inside)))
    h, text = mixed(windows[at], windows[at + n - 1]), text[at]
    new = np.zeros(len(at), bool)
    new[np.unique(mixed(h, text.astype(np.uint64)), return_index=True)[1]] = True
    goes_on = ~new[1:] & ~new[:-1] & (text[1:] == text[:-1])
    row = np.flatnonzero(np.concatenate(([True], ~goes_on))[: len(at)])
    n = np.add.reduceat(n, row) if len(row) else n
    at, text = at[row], text[row]
    return text, least[at].view(np.int64), at - firsts[text], np.where(new[row], n, -n), h[row].view(np.int64)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs' texts with the key by which places are ordered."""
    return docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", *more)


def _fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.text.tolist()
            for first, upto in chunks(texts):
                text, g, at, n, h = winnow(texts[first:upto], min_words)
                yield batch[_ROW].take(first + text).assign(g=g, at=at, n=n, h=h)

    return _keyed(docs).mapInPandas(run, f"{_KEY}, g long, at int, n int, h long")


def _place(at: str | Column) -> Column:
    return F.struct(*_ROW, (F.col(at) if isinstance(at, str) else at).alias("at"))


def _met(docs: DataFrame, min_words: int) -> DataFrame:
    """The fingerprints that stand at two places or more. Hashing texts twice is cheaper than keeping all fingerprints."""
    found = _fingerprints(docs, min_words)
    often = found.groupBy("g").agg(F.count("*").alias("k"), F.min("n").alias("n")).where("k > 1 or n < 0").select("g")
    return found.join(splittable(often), "g", "left_semi")


def _windows(texts: DataFrame, min_words: int) -> DataFrame:
    """A row (place, h) for each window of the fingerprints in `edges`; place is id * MOST_WORDS + first word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, edges, ids = batch.text.tolist(), batch.edges.tolist(), batch.id.to_numpy()
            for first, upto in chunks(texts):
                _, windows, _, firsts = window_hashes(texts[first:upto], min_words)
                at = [np.concatenate([np.arange(e["at"], e["at"] + e["n"]) for e in some]) for some in edges[first:upto]]
                of = np.repeat(np.arange(len(at)), list(map(len, at)))
                at = np.concatenate(at)
                yield pd.DataFrame({"place": ids[first + of] * MOST_WORDS + at, "h": windows[firsts[of] + at].view(np.int64)})

    return texts.select("id", "text", "edges").mapInPandas(run, "place long, h long")


@pandas_udf(_RANGES)
def _runs(starts: pd.Series) -> pd.Series:
    """The runs of neighbours in each set of whole numbers, as ranges [at, to)."""

    def of(some: np.ndarray) -> list[tuple[int, int]]:
        s = np.sort(some)
        ends = np.flatnonzero(np.append(np.diff(s) > 1, True))
        return list(zip(s[np.append(0, ends[:-1] + 1)].tolist(), (s[ends] + 1).tolist(), strict=True))

    return pd.Series([of(some) for some in starts], dtype=object)


def _later_windows(docs: DataFrame, met: DataFrame, min_words: int) -> DataFrame:
    """(no_id, doc_id, text_hash, later): repeated windows at other places than their first; they start at words [at, to).

    Fingerprints whose windows all agree are one class, of which only the first place is spared. Where a fingerprint has other
    classes too, runs of words begin or end within its windows: the first of each class has its windows compared one by one.
    Texts with such edges get numbers in order of place, so that a window is two numbers.
    """
    local = met.where("n < 0").select(*_ROW, "at", (F.col("at") - F.col("n")).alias("to"))
    met = met.where("n > 0")
    classes = met.groupBy("g", "h", "n").agg(F.min(_place("at")).alias("first"), F.count("*").alias("k"))
    again = classes.where("k > 1").select("g", "h", "n", "first")
    whole = met.join(splittable(again), ["g", "h", "n"]).where(_place("at") > F.col("first")).select(*_ROW, "at", (F.col("at") + F.col("n")).alias("to"))
    mixed = classes.groupBy("g").agg(F.count("*").alias("classes")).where("classes > 1").select("g")
    edges = classes.join(splittable(mixed), "g", "left_semi").select("first.*", "n")
    edges = numbered(edges.groupBy(*_ROW).agg(F.collect_list(F.struct("at", "n")).alias("edges")), _ROW, "id")
    windows = _windows(_keyed(docs).join(splittable(edges), _ROW), min_words)
    firsts = windows.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("k")).where("k > 1").select("h", "first")
    parts = windows.join(splittable(firsts), "h").where("place > first").select(F.expr(f"place div {MOST_WORDS}").alias("id"), (F.col("place") % MOST_WORDS).cast("int").alias("at"))
    parts = parts.groupBy("id").agg(F.collect_set("at").alias("at")).select("id", _runs("at").alias("later")).join(splittable(edges.select("id", *_ROW)), "id")  # of one text, so bounded by it
    ranges = whole.unionByName(local).groupBy(*_ROW).agg(F.collect_set(F.struct("at", "to")).alias("later"))
    return ranges.unionByName(parts.select(*_ROW, "later")).groupBy(*_ROW).agg(F.flatten(F.collect_list("later")).alias("later"))


def repeated_windows(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(no_id, doc_id, text_hash, later): the ranges [at, to) of words at which later repeated windows of each text start.

    A window is min_words words in a row, whatever white space is between them; it is repeated if it also stands at an
    earlier place (by doc_id, text hash and word). Equal windows have equal winnowed fingerprints: so those that stand
    at two places or more are joined with their places, and matches are extended both ways, over windows that agree as
    a whole first and then word by word. Equal 64-bit hashes count as equal words.
    """
    return _later_windows(docs, cut(_met(docs, min_words)), min_words)


def _without(text: str, later: list, min_words: int) -> tuple[str, int]:
    """text without the words of the windows in `later` and the white space before each, and how many words went.

    What stays first keeps the text's own beginning. If no word stays: the empty text.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_places(data)
    change = np.zeros(len(starts) + 1, np.int64)
    for x in later:
        change[x["at"]] += 1
        change[x["to"] + min_words - 1] -= 1
    gone = change.cumsum()[:-1] > 0
    if gone.all():
        return "", len(gone)
    keep = np.ones(len(data), bool)
    spaced = np.diff(np.concatenate(([0], ends)))  # bytes of each word and of the white space before it
    keep[: ends[-1]] = np.repeat(~gone, spaced)
    if gone[0]:
        first = int(np.argmin(gone))
        keep[ends[first - 1] : starts[first]] = False
        keep[: starts[0]] = True
    return data[keep].tobytes().decode("utf-8", "surrogatepass"), int(gone.sum())


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later repeated runs of words taken out of `text`, and a column n_removed (words; long).

    A run is min_words words or more that also stand in a row at an earlier place; a passage that repeats within a text loses
    all but its first period likewise. All rows and columns stay (a column of docs named n_removed is replaced). Null text stays
    null; a text that loses every word becomes empty. Rows without a doc_id come after all others. Rows that repeat both
    doc_id and text are one place, so they lose the same words. An empty table stays empty.
    """

    small_batches(docs)

    @pandas_udf("text string, n_removed long")
    def left(text: pd.Series, later: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else _without(t, x, min_words) for t, x in zip(text, later, strict=True)], columns=["text", "n_removed"])

    names = [c for c in docs.columns if c != "n_removed"]
    rest = [c for c in names if c not in ("doc_id", "text")]
    found = _keyed(docs, *[F.struct(*rest).alias("rest")] * bool(rest)).join(splittable(repeated_windows(docs, min_words)), _ROW, "left")
    touched = F.col("later").isNotNull()
    found = found.withColumn("left", left(F.when(touched, F.col("text")), "later"))  # other texts aren't sent to Python
    of = {"doc_id": F.when(~F.col("no_id"), F.col("doc_id")).cast(docs.schema["doc_id"].dataType), "text": F.when(touched, F.col("left.text")).otherwise(F.col("text"))}
    return found.select(*((of[c] if c in of else F.col("rest").getField(c)).alias(c) for c in names), F.coalesce("left.n_removed", F.lit(0)).cast("long").alias("n_removed"))
