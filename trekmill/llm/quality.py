"""Quality rules: base counts, and Jensen-Shannon distance of a text's histograms from language references."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from trekmill.llm.common import LOWER, cut, small_batches
from trekmill.llm.hashing import chunks

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other_letter", "digit", "space", "white", "stop", "emphasis", "symbol", "ascii", "rest")

#: Parameters of the verdict.
COMMON_WORDS = 64
LEAST_CHARS = 200
#: Steps in which a class's share of a text is told.
BINS = 1000
LEAST_WORDS = 100
CHAR_DISTANCE = 0.15
#: A text of n characters may be this over the square root of n further off, as short texts vary more.
CHAR_SLACK = 1.0
WORD_DISTANCE = 0.40

#: bytes.translate table: A-Z to lower case, other ASCII that is neither letter nor digit to space.
_WORDS = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_BASE = StructType([StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [StructField("char_distance", DoubleType()), StructField("word_distance", DoubleType()), StructField("nearest", StringType())])


@cache
def _class_table() -> np.ndarray:
    """Class number of every code point."""
    table = np.full(0x110000, CLASSES.index("rest"), np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = CLASSES.index("other_letter")
    for c in range(128):
        x = chr(c)
        kind = "lower" if x.islower() else "upper" if x.isupper() else "digit" if x.isdigit() else "space" if x == " " else "white" if x in WHITE else "stop" if x in ".,;:" else "emphasis" if x in "!?" else "symbol" if x in SYMBOLS else "ascii"
        table[c] = CLASSES.index(kind)
    return table


def char_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_class_table()[points], minlength=len(CLASSES))


def lexical(text: str) -> list[bytes]:
    """Words for the common-word histogram: lower case, split at ASCII punctuation too."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1].astype(np.int64)
    _, group, n = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[group] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each language in some texts of a batch: word counts, and how many texts have each share of each class."""
    for batch in batches:
        for lang, texts in batch.groupby("lang").text:
            texts = texts.tolist()
            for first, upto in chunks(texts):  # so that a worker never holds the words of a whole batch
                words: Counter[bytes] = Counter()
                shares: Counter[str] = Counter()
                for t in texts[first:upto]:
                    words.update(lexical(t))
                    if len(t) >= LEAST_CHARS:
                        bins = (char_counts(t) * BINS + len(t) // 2) // len(t)
                        shares.update(f" {c}:{b}" for c, b in enumerate(bins.tolist()))
                names = [w.decode("utf-8", "replace") for w in words] + list(shares)
                yield pd.DataFrame({"lang": lang, "word": names, "n": [*words.values(), *shares.values()]})


def references(docs: DataFrame, common: int = COMMON_WORDS, least_docs: int = 20) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """For each `lang` of least_docs documents or more: class shares, its `common` most frequent words, and their
    shares of its words with the rest as the last.

    Counted over all documents with text and lang. A class's share is the median of its shares in the texts of 200
    characters or more, scaled to sum to 1, so that junk texts don't bend it. What comes to the driver is `common`
    rows and at most 11 * 1001 bins for a language, of which there are no more than languages. Ties of words go to
    the lesser by code point. No such language: {}.
    """
    small_batches(docs)
    used = docs.select("lang", "text").where("lang is not null and text is not null and text <> ''")
    langs = used.groupBy("lang").count().where(F.col("count") >= least_docs).select("lang")
    counts = used.mapInPandas(_tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts.join(langs, "lang"))
    is_class = F.col("word").startswith(" ")
    # The most frequent words of a language by buckets first, so that no task orders a whole vocabulary.
    bucket = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(64))).orderBy(F.desc("n"), "word")
    best = counts.where(~is_class).withColumn("r", F.row_number().over(bucket)).where(F.col("r") <= common)
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= common).select("lang", "word", "n", "r")
    totals = {r.lang: r.n for r in counts.where(~is_class).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    found: dict[str, tuple[np.ndarray, list]] = {}
    for r in counts.where(is_class).select("lang", "word", "n").collect():
        kind, at = map(int, r.word.split(":"))
        found.setdefault(r.lang, (np.zeros((len(CLASSES), BINS + 1)), []))[0][kind, at] = r.n
    for r in top.orderBy("lang", "r").collect():
        if r.lang in found:
            found[r.lang][1].append((r.word, r.n))
    out = {}
    for lang in sorted(found):
        chars, words = found[lang]
        run = chars.cumsum(axis=1)
        c = np.array([np.searchsorted(row, row[-1] / 2) for row in run], float)
        w = np.array([n for _, n in words] + [totals.get(lang, 0) - sum(n for _, n in words)], float)
        out[lang] = (c / max(c.sum(), 1), [x for x, _ in words], w / max(w.sum(), 1))
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint distributions."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(d / 2, 0)))


def _measure(refs: dict[str, tuple[np.ndarray, list[str], np.ndarray]]):
    index = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, (_, words, _) in refs.items()}
    every = set().union(*index.values()) if index else set()

    def one(text: str | None) -> tuple:
        counts = base_counts(text)
        n_chars = len(text or "")
        if not refs or n_chars < LEAST_CHARS:
            return (*counts, None, None, None)
        chars, words = char_counts(text) / n_chars, lexical(text)
        common = Counter(w for w in words if w in every)
        best = None
        for lang, (c, _, w) in refs.items():
            share = np.zeros(len(w))
            for x, n in common.items():
                if x in index[lang]:
                    share[index[lang][x]] = n
            share[-1] = len(words) - share.sum()
            by_word = js_distance(share / len(words), w) if len(words) >= LEAST_WORDS else None
            found = (js_distance(chars, c), by_word, lang)
            if best is None or found[0] + (found[1] or 0) < best[0] + (best[1] or 0):
                best = found
        return (*counts, *best)

    @pandas_udf(_BASE)
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=_BASE.names)

    return measure


def rate(docs: DataFrame, char_distance: float = CHAR_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """docs with the base counts, char_distance, word_distance, nearest (language), base_failed and kept.

    The distances are to the nearest language reference, whatever lang the row itself has; they reject nothing if
    that lang is null or has no reference, as they then measure against other languages only. A text of fewer than 200
    characters has neither distance, one of fewer than 100 words no word distance; a distance that is missing
    rejects nothing. Null text counts as empty and fails the base rules. Columns of docs with these names are
    replaced; rows are neither dropped nor merged. An empty table, or one without lang, has no reference.
    """
    refs = references(docs)
    found = docs.withColumn("_m", _measure(refs)(F.col("text"))).withColumns({n: F.col(f"_m.{n}") for n in _BASE.names}).drop("_m")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce(F.col("char_distance") - CHAR_SLACK / F.sqrt(F.length("text")), F.lit(0.0)) <= char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= word_distance)
    known = F.coalesce(F.col("lang").isin(sorted(refs)), F.lit(False))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (~known | near))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that `rate` keeps, with their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", "text")
    return rate(rows).where("kept").select("row.*")
