"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

UNKNOWN = "und"
#: Hash buckets (a power of two), their embeddings' length, and the lengths of the subwords.
BUCKETS, DIM, GRAMS = 1 << 13, 16, (1, 2, 3)
#: Labelled documents to learn from for each language, about; the only bound on what is learned from.
LEARN_PER_LANG = 400
#: Share of correctly labelled calibration texts that rejection may turn away.
REJECTED = 0.01

_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every subword of the whole lower-cased text. Runs of what isn't a letter count as one space; no letters: none."""
    low = "".join(c if c.isalpha() else " " for c in text.lower()) if text and not text.isascii() else _ascii_letters(text or "")
    words = " ".join(low.split())
    if not words:
        return np.zeros(0, np.int64)
    p = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = p * _A
    two = (one[:-1] ^ (one[:-1] >> np.uint32(13))) + p[1:] * _B
    three = (two[:-1] ^ (two[:-1] >> np.uint32(11))) * _C + p[2:] * _A
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate([((x ^ (x >> np.uint32(15))) * _C) >> shift for x in (one[1:-1], two, three)]).astype(np.int64)


_LETTERS = "".join(chr(c).lower() if chr(c).isalpha() else " " for c in range(128))


def _ascii_letters(text: str) -> str:
    return text.translate(_LETTERS)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the buckets that it has and their shares: averaging embeddings is multiplying by these."""
    out = []
    for t in texts:
        b, n = np.unique(buckets(t), return_counts=True)
        out.append((b.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Some rows of features as a matrix; never all of them, so that its size has a bound."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for row, (at, share) in zip(out, rows, strict=True):
        row[at] = share
    return out


@dataclass
class Model:
    """langs, and table[bucket] = embedding @ weights, so that a text's logits are the mean of its buckets' rows plus bias."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        b = buckets(text)
        if not len(b) or not self.langs:
            return UNKNOWN, 0.0, True
        p = softmax((self.table[b].mean(axis=0) + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 30, rate: float = 0.5, batch: int = 32, seed: int = 1) -> Model:
    """Stochastic gradient descent on four texts of five; the fifth sets temperature and the score of rejection.

    Each text is learned from as a whole and as a passage of 200 characters, so that short texts are known too. The same
    texts in the same order give the same model. No texts: a model that answers `und`.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4
    passages = [t[(at := int(rng.integers(0, max(1, len(t) - 200)))) : at + 200] for t in texts]
    x = [(at, share * 100) for at, share in features(texts) + features(passages)]  # shares are small; a matter of scale of the embeddings alone
    y = np.array([names.index(v) for v in langs] * 2)
    held = np.concatenate([held, held]) if (~held).any() and held.any() else np.zeros(len(y), bool)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    learn = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        for at in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)):
            xb = dense([x[i] for i in at])
            h = xb @ emb
            g = softmax(h @ out + bias)
            g[np.arange(len(at)), y[at]] -= 1
            g /= len(at)
            back = g @ out.T
            out -= step * np.clip(h.T @ g, -1, 1)
            bias -= step * g.sum(axis=0)
            emb -= step * (xb.T @ back)
    check = np.flatnonzero(held) if held.any() else learn
    z = np.concatenate([dense([x[i] for i in check[a : a + 256]]) @ emb @ out + bias for a in range(0, len(check), 256)])
    losses = [(-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean(), t) for t in np.geomspace(0.05, 5, 40)]
    temperature = float(min(losses)[1])
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    return Model(names, (100 * emb @ out).astype(np.float64), bias.astype(np.float64), temperature, float(np.quantile(right, REJECTED)) if len(right) else 0.0)


def learnable(docs: DataFrame, per_lang: int = LEARN_PER_LANG) -> DataFrame:
    """(lang, text) of about per_lang documents of each language, chosen by a hash of id and text; all if there are fewer."""
    rows = docs.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count()
    chance = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count"))
    picked = rows.join(counts, "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).cast("double") <= chance * 2.0**63)
    return picked.select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))


def train(docs: DataFrame, per_lang: int = LEARN_PER_LANG) -> Model:
    """A model of the labelled rows of docs (doc_id, text, lang). The driver gets about per_lang texts for each language."""
    rows = sorted(learnable(docs, per_lang).collect(), key=lambda r: (r.order, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (calibrated probability) and rejected, from `text` alone.

    The whole text counts. Null text or text without letters: `und`, score 0, rejected. Otherwise lang_pred is a learned
    language even if rejected. Columns with these names are replaced; rows are neither dropped nor merged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8192 rows of as many numbers as languages

    @pandas_udf(_RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=_RESULT.names)

    return docs.withColumn("_p", run(F.col("text"))).withColumns({n: F.col(f"_p.{n}") for n in _RESULT.names}).drop("_p")
