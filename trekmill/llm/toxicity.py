"""Toxicity: a linear classifier over the subwords of sentences, kept from judging by the groups that a sentence names.

A text is as toxic as its worst sentence, so a word in a long text isn't thinned out. Labels are of whole documents; the
sentences to learn from are found in rounds: of a toxic document the worst one under the model so far, of a clean one the
worst ones and some others. The first model is the subwords' log-odds between toxic and clean documents, as far as these are sure;
they also scale what is learned later, so that subwords which stand in either class by chance don't count.

Counterfactuals: in labelled sentences the terms that name groups of people are swapped for others of their kind, and the loss
punishes every change of the score by that. Sentences without such a term get one, in some of the cases, so that terms which the
labels never show are held at nothing too.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trekmill.llm.common import cut

#: Hash buckets (a power of two), lengths of subwords with their word's edges, words of a sentence at most.
BUCKETS, GRAMS, SENTENCE_WORDS = 1 << 18, (3, 4, 5, 6), 32
#: Labelled documents of each class to learn from, about; the only bound on what is learned from.
LEARN_PER_CLASS = 3000
#: Sentences of a clean document to learn from: the worst ones, and others. Characters of a sentence that is learned from.
WORST, OTHERS, SENTENCE_CHARS = 3, 2, 2000
#: Weight of a changed score in the loss, counterfactuals of a sentence, share of sentences without a term that get one.
PENALTY, SWAPS, ADDED = 1.0, 2, 0.25
#: Characters of a text that are looked at together.
BLOCK = 1 << 19

#: Terms that name groups of people, by language and kind; one stands for another of its row.
IDENTITY_TERMS = (
    "christians muslims jews hindus buddhists atheists catholics sikhs",
    "christian muslim jewish hindu buddhist atheist catholic",
    "africans asians europeans americans arabs immigrants refugees foreigners",
    "african asian european american arab black white latino",
    "women men girls boys",
    "gay lesbian bisexual transgender queer heterosexual",
    "blind deaf disabled autistic",
    "christen muslime juden hindus buddhisten atheisten katholiken",
    "afrikaner asiaten europäer amerikaner araber einwanderer flüchtlinge ausländer",
    "frauen männer mädchen jungen",
    "schwule lesben bisexuelle heterosexuelle",
    "blinde gehörlose behinderte autisten",
    "chrétiens musulmans juifs hindous bouddhistes athées catholiques",
    "africains asiatiques européens américains arabes immigrés réfugiés étrangers",
    "femmes hommes filles garçons",
    "gays lesbiennes bisexuels hétérosexuels",
    "aveugles sourds handicapés autistes",
    "cristianos musulmanes judíos hindúes budistas ateos católicos",
    "africanos asiáticos europeos americanos árabes inmigrantes refugiados extranjeros",
    "mujeres hombres chicas chicos",
    "homosexuales lesbianas bisexuales heterosexuales",
    "ciegos sordos discapacitados autistas",
)
_ENDS = ".!?\n…。！？।"
_A, _B, _C = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TOP = 0x110000


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 if words are made of it (letters, marks, digits), 2 if it ends a sentence, else 0."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(_TOP)), np.uint8, _TOP)
    out[[ord(c) for c in _ENDS]] = 2
    return out


@dataclass
class Sentences:
    """Subword buckets and the sentence that each stands in, and where the sentences are in `text` (lower case)."""

    text: str
    grams: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=weights[self.grams], minlength=len(self.starts))

    def sentence(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def sentences(text: str) -> Sentences:
    """Sentences end at end marks and line feeds, and after SENTENCE_WORDS words; those without words don't count.

    A word that stands more than once in a sentence counts once.
    """
    low = text.lower()
    p = np.frombuffer(f" {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[p]
    word = kind == 1
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    if not len(starts):
        return Sentences(low, *(np.zeros(0, np.int64) for _ in range(4)))
    run = np.cumsum(kind == 2)[starts]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    nth = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    begins = nth % SENTENCE_WORDS == 0
    number = np.cumsum(begins) - 1
    begin = np.flatnonzero(begins)
    size = ends - starts
    letters = np.arange(size.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    each = (p[letters].astype(np.uint64) + (letters - np.repeat(starts, size)).astype(np.uint64) * _P) * _Q
    spelt = np.add.reduceat((each ^ (each >> np.uint64(29))) * _P, np.cumsum(size) - size)  # a word's hash, by letters and places
    _, news = np.unique((spelt ^ (spelt >> np.uint64(31))) * _Q + number.astype(np.uint64) * _P, return_index=True)
    new = np.zeros(len(starts), bool)
    new[news] = True
    kept = np.zeros(len(p), bool)
    kept[letters] = np.repeat(new, size)
    kept[starts[new] - 1] = True
    kept[-1] = True
    q = np.where(word[kept], p[kept], np.uint32(32))
    spaces = np.cumsum(q == 32)
    grams, at = [], []
    h = q * _A
    for n in range(2, max(GRAMS) + 1):
        if len(q) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * _B + q[n - 1 :] * _C
        if n in GRAMS:
            own = np.flatnonzero(spaces[n - 2 : len(q) - 1] == spaces[: len(q) - n + 1])  # no space but at the edges
            mixed = (h[own] ^ (h[own] >> np.uint32(15))) * _A
            grams.append((mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
            at.append(number[new][spaces[own + 1] - 1])
    return Sentences(low, np.concatenate(grams), np.concatenate(at), starts[begin] - 1, ends[np.append(begin[1:], len(starts)) - 1] - 1)


def blocks(text: str | None) -> Iterator[str]:
    """Whole text in blocks, cut at a line feed or space where there is one, so that memory doesn't follow a text's length."""
    text, at = text or "", 0
    while len(text) - at > BLOCK:
        end = max(text.rfind("\n", at + 1, at + BLOCK), text.rfind(" ", at + 1, at + BLOCK))
        end = end if end > at else at + BLOCK
        yield text[at:end]
        at = end
    yield text[at:]


@dataclass
class Model:
    """Logit of a sentence: sum of its subwords' weights; score of a text: sigmoid(slope * worst + shift). No weights: `share`."""

    weights: np.ndarray | None
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.0

    def worst(self, text: str | None) -> float:
        """The greatest logit of a sentence; 0, that of a sentence without words, if there is none."""
        return max((float(z.max()) for b in blocks(text) if len(z := sentences(b).logits(self.weights))), default=0.0)

    def predict(self, text: str | None) -> float:
        return self.share if self.weights is None else float(_sigmoid(self.slope * self.worst(text) + self.shift))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Terms:
    """Swaps of identity terms; rows: space-separated terms that stand for each other."""

    rows: tuple[str, ...] = IDENTITY_TERMS

    def __post_init__(self):
        self.kinds = [r.split() for r in self.rows]
        self.kind = {t: k for k in self.kinds for t in k}
        self.found = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, self.kind), key=len, reverse=True))})\b" if self.kind else r"(?!)")

    def swapped(self, sentence: str, rng: np.random.Generator) -> list[str]:
        """Counterfactuals of a sentence in lower case: every term for another of its kind, or a term added."""
        if self.found.search(sentence):
            return [self.found.sub(lambda m: self._other(m[0], rng), sentence) for _ in range(SWAPS)]
        if not self.kinds or rng.random() >= ADDED:
            return []
        kind = self.kinds[rng.integers(len(self.kinds))]
        return [f"{sentence} {kind[rng.integers(len(kind))]}"]

    def _other(self, term: str, rng: np.random.Generator) -> str:
        others = [t for t in self.kind[term] if t != term] or [term]
        return others[rng.integers(len(others))]


def _stacked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of each text as one sentence, one text after the other, and where each begins."""
    own = [sentences(t).grams for t in texts]
    return np.concatenate([*own, np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum([len(g) for g in own]))).astype(np.int64)


def _rows(grams: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of the texts `which`, and for each the place of its text in `which`."""
    size = first[which + 1] - first[which]
    begin = np.concatenate(([0], np.cumsum(size)[:-1])) if len(which) else size
    at = np.arange(size.sum()) + np.repeat(first[which] - begin, size)
    return grams[at], np.repeat(np.arange(len(which)), size)


def fit(texts: list[str], toxic: list[int], scale: np.ndarray, terms: Terms, epochs: int = 12, rate: float = 0.1, batch: int = 512, decay: float = 1e-4, seed: int = 1) -> np.ndarray:
    """Weights, each a multiple of its `scale`, by stochastic gradient descent (steps scaled by past gradients) on sentences and their counterfactuals.

    Loss: log loss, both classes weighing alike, plus PENALTY times the squared change of the logit for every counterfactual.
    The same sentences in the same order give the same weights.
    """
    rng = np.random.default_rng(seed)
    y = np.array(toxic, float)
    share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    weigh = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    pairs = [(i, s) for i, t in enumerate(texts) for s in terms.swapped(t, rng)]
    (grams, first), (other, other_first) = _stacked(texts), _stacked([s for _, s in pairs])
    partner = np.array([i for i, _ in pairs], np.int64)
    pair_first = np.searchsorted(partner, np.arange(len(texts) + 1))  # partner is ascending
    v, past = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    (grams, first), (other, other_first) = (_where(scale[g] > 0, g, a) for g, a in ((grams, first), (other, other_first)))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            swaps = np.concatenate([np.arange(pair_first[i], pair_first[i + 1]) for i in own])
            f, row = _rows(grams, first, own)
            g, swap_row = _rows(other, other_first, swaps)
            z = np.bincount(row, weights=(scale * v)[f], minlength=len(own))
            z_swap = np.bincount(swap_row, weights=(scale * v)[g], minlength=len(swaps))
            place = np.empty(len(texts), np.int64)
            place[own] = np.arange(len(own))
            of = place[partner[swaps]]
            change = 2 * PENALTY * (z[of] - z_swap)
            d = weigh[own] * (_sigmoid(z) - y[own]) + np.bincount(of, weights=change, minlength=len(own))
            grad = scale * np.bincount(np.concatenate([f, g]), weights=np.concatenate([d[row], -change[swap_row]]) / len(own), minlength=BUCKETS) + decay * v
            past += grad * grad
            v -= rate * grad / np.sqrt(past)
    return scale * v


def _where(kept: np.ndarray, grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grams[kept], np.concatenate(([0], np.cumsum(kept)))[first]


def calibrate(worst: np.ndarray, toxic: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (worst sentence, label), weighted; labels a little softened; slope above 0."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    t = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, spread = float(np.mean(worst)), float(np.std(worst)) or 1.0
    x = np.stack([(worst - mid) / spread, np.ones(len(worst))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(x @ beta)
        grad = x.T @ (weigh * (p - t)) + 1e-3 * beta
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(float(beta[0]), 1e-3) / spread
    return slope, float(beta[1]) - slope * mid


def learnable(docs: DataFrame, labels: DataFrame, per_class: int = LEARN_PER_CLASS) -> DataFrame:
    """(text, toxic, checks) of about per_class labelled documents of each class; checks: one of five, not fitted to.

    docs: doc_id, text; labels: doc_id, toxic. Labels other than 0 and 1, and ids labelled both ways, don't count. Equal rows
    are one. Ids are chosen by hash from the labels, whose number so has a bound; only these are sent to the documents. Where an
    id has many texts, rows are chosen by hash once more.
    """
    chosen = lambda key, n: F.shiftrightunsigned(key, 1).cast("double") <= F.least(F.lit(1.0), F.lit(float(per_class)) / n) * 2.0**63
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sizes = own.groupBy("toxic").agg(F.count("*").alias("n"))
    ids = own.join(F.broadcast(sizes), "toxic").where(chosen(F.xxhash64("doc_id"), F.col("n"))).select("doc_id", "toxic", "n")
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").distinct())
    found = rows.groupBy("toxic").agg(F.count("*").alias("m"))
    key = F.xxhash64("doc_id", "text")
    return rows.join(F.broadcast(found), "toxic").where(chosen(key, F.col("m"))).select("text", "toxic", (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("checks"), F.col("n"), key.alias("key"))


def _log_odds(rows: DataFrame) -> np.ndarray:
    """Of each bucket the log-odds between toxic and clean documents, at that end of their 95% interval which is nearer 0; else 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen = [np.unique(sentences(b).grams) for b in blocks(text)]
                held[toxic, np.unique(np.concatenate(seen))] += 1
        at = np.flatnonzero(held.any(axis=0))
        yield pd.DataFrame({"bucket": at, "clean": held[0, at], "toxic": held[1, at]})

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = rows.select("text", "toxic").mapInPandas(run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, clean, toxic = (counts[c].to_numpy().astype(float) for c in ("bucket", "clean", "toxic"))
    odds = np.log((toxic + 0.5) / (n.get(1, 0) + 1)) - np.log((clean + 0.5) / (n.get(0, 0) + 1))
    out = np.zeros(BUCKETS)
    out[at.astype(np.int64)] = np.sign(odds) * np.maximum(np.abs(odds) - 1.96 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0)
    return out


def _mined(rows: DataFrame, weights: np.ndarray) -> pd.DataFrame:
    """(toxic, sentence) to learn from under these weights, in an order of their own."""
    shared = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic, key in zip(batch["text"], batch["toxic"], batch["key"], strict=True):
                best: list[tuple[float, str]] = []
                others: list[tuple[int, str]] = []
                rng = np.random.default_rng(key & (1 << 63) - 1)
                for block in blocks(text):
                    s = sentences(block)
                    z, any_order = s.logits(shared.value), rng.random(len(s.starts))
                    best = sorted([*best, *((float(z[i]), s.sentence(i)[:SENTENCE_CHARS]) for i in np.argsort(-z, kind="stable")[:WORST])], key=lambda x: -x[0])[:WORST]
                    others = sorted([*others, *((any_order[i], s.sentence(i)[:SENTENCE_CHARS]) for i in np.argsort(any_order)[:OTHERS])])[:OTHERS]
                picked = best[:1] if toxic else [*best, *others]
                out += [(int(toxic), t) for t in dict.fromkeys(t for _, t in picked)]
            yield pd.DataFrame(out, columns=["toxic", "sentence"])

    return rows.select("text", "toxic", "key").mapInPandas(run, "toxic int, sentence string").distinct().toArrow().to_pandas().sort_values(["sentence", "toxic"], ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, per_class: int = LEARN_PER_CLASS, terms: Terms | None = None, rounds: int = 3) -> Model:
    """A model of the labelled documents (as `learnable` picks them).

    The driver gets counts by bucket, some sentences a picked document, and a number for each document that checks. Without
    labels, or with labels of one class alone, there is nothing to tell apart: every score is then the share of toxic labels.
    """
    rows = cut(learnable(docs, labels, per_class))
    sizes = {(r.toxic, r.checks): (r.m, r.n) for r in rows.groupBy("toxic", "checks").agg(F.count("*").alias("m"), F.first("n").alias("n")).collect()}
    n = [sum(m for (toxic, _), (m, _) in sizes.items() if toxic == c) for c in (0, 1)]
    if not all(n):
        return Model(None, share=n[1] / max(sum(n), 1))
    learn = rows.where("not checks") if all((c, False) in sizes for c in (0, 1)) else rows
    odds, mined, terms = _log_odds(learn), [], terms or Terms()
    weights = np.maximum(odds, 0)
    for _ in range(rounds):
        found = _mined(learn, weights)
        mined = [x[x["toxic"] == 0] for x in mined] + [found]  # of a toxic document the worst sentence is chosen anew
        both = pd.concat(mined).drop_duplicates(ignore_index=True)
        weights = fit(both["sentence"].tolist(), both["toxic"].tolist(), np.abs(odds), terms)
    check = rows.where("checks") if all((c, True) in sizes for c in (0, 1)) else rows
    model = Model(weights.astype(np.float32))
    told = _worst(check, model).toArrow().to_pandas()
    y, worst = told["toxic"].to_numpy(), told["worst"].to_numpy()
    all_of = [next(v for (c, _), (_, v) in sizes.items() if c == k) for k in (0, 1)]
    weigh = np.where(y == 1, all_of[1] / max(y.sum(), 1), all_of[0] / max((1 - y).sum(), 1))
    model.slope, model.shift = calibrate(worst, y, weigh / weigh.mean())
    return model


def _worst(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.worst(t) for t in batch], dtype=float)

    return rows.select("toxic", run("text").alias("worst"), "key").orderBy("key").drop("key")


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0), from whole texts alone.

    Null and empty texts, and texts without words, score as a sentence without words. Columns with these names are replaced;
    rows are neither dropped nor merged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket

    @pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.predict(t) for t in batch], dtype=float)

    return docs.withColumn("score", run(F.col(text_col))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
