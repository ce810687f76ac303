"""Scoring by an interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

The arrays are files in the shared folder, written by the tasks that counted them and memory-mapped by the workers that
score. What tasks hand each other are packed arrays, a row for each chunk of tokens and shard, so that Spark deals out few
and even rows while numpy counts.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekmill.llm.common import shared_dir, words_of

#: No word holds a line feed, so this is no word's hash but by chance.
END = xxhash.xxh64_intdigest(b"\n")
#: Tokens that a worker counts or scores at once; training tokens for each shard of pairs; ids in each block of arrays.
CHUNK, SHARD_TOKENS, BLOCK = 1 << 20, 2_000_000, 1 << 15
#: Documents for each shard of the vocabulary.
SHARD_DOCS = 10_000
_KNOWN = 1 << 20
_known: dict[bytes, int] = {}


def mounted(folder: str) -> str:
    """The path of the shared folder as a file system has it; memory mapping needs one."""
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError(f"n-gram arrays are memory-mapped; mount the shared folder and name it as file:/...: {folder}")
    return at.path


def _hash(word: bytes) -> int:
    h = _known.get(word)
    if h is None:
        if len(_known) >= _KNOWN:
            _known.clear()
        h = _known[word] = xxhash.xxh64_intdigest(word)
    return h


def tokens(text: str | None) -> list[int]:
    """Hashes of the words, A-Z in lower case, and of the end."""
    known = _known.get
    return [known(w) or _hash(w) for w in words_of(text)] + [END]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, token hashes, tokens of each text) for texts of about CHUNK tokens together."""
    first, held, sizes, total = 0, [], [], 0
    for i, text in enumerate(texts):
        t = np.array(tokens(text), np.uint64)
        held.append(t)
        sizes.append(len(t))
        total += len(t)
        if total >= CHUNK or i == len(texts) - 1:
            yield first, np.concatenate(held), np.array(sizes)
            first, held, sizes, total = i + 1, [], [], 0


def _pack(a: np.ndarray) -> bytes:
    """64-bit integers by byte planes, which compress well in a shuffle."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(parts) -> np.ndarray:
    arrays = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view("<i8").ravel() for p in parts]
    return np.concatenate(arrays) if arrays else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[at], *(np.add.reduceat(v[order], at) if len(keys) else v for v in values))


def _save(folder: str, name: str, a: np.ndarray) -> None:
    """All or nothing, so that a task that runs again does no harm."""
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.npy"
    np.save(temporary, a)
    os.replace(temporary, f"{folder}/{name}.npy")


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Range of the hash space, 0 to slots - 1, in order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def _by_slot(slots: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    cuts = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1]))) if len(slots) else []
    for a, b in zip(cuts, [*cuts[1:], len(slots)], strict=True):
        yield int(slots[a]), tuple(x[order[a:b]] for x in arrays)


@dataclass
class Model:
    """Where the arrays are and what is known of them; the arrays themselves are opened by workers."""

    folder: str
    slots: int = 1
    offsets: list[int] = field(default_factory=lambda: [0])  # first id of each vocabulary shard, and their total
    train_tokens: int = 0
    docs: int = 0
    shards: int = 1
    discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    pairs: int = 0
    low_mass: float = 1.0

    @property
    def words(self) -> int:
        return self.offsets[-1]

    def remove(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class _Arrays:
    """Memory-mapped arrays of a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.hashes = [self._load(f"hash-{s}") for s in range(model.slots)]
        self.counts = [self._load(f"count-{s}") for s in range(model.slots)]
        self.begin, self.unknown = model.words, model.words + 1  # ids of what starts a text and of other words

    def _load(self, name: str) -> np.ndarray | None:
        path = f"{self.model.folder}/{name}.npy"
        return np.load(path, mmap_mode="r") if os.path.exists(path) else None

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and training count of each token; unknown: the id after the last two, count 0."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), self.unknown, np.int64), np.zeros(len(distinct), np.int64)
        slots = _slots(distinct, self.model.slots)
        cuts = np.searchsorted(slots, np.arange(self.model.slots + 1))
        for s in np.unique(slots).tolist():
            if (known := self.hashes[s]) is None:
                continue
            q = distinct[cuts[s] : cuts[s + 1]]
            at = np.searchsorted(known, q)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == q[hit]
            ids[cuts[s] : cuts[s + 1]][hit] = at[hit] + self.model.offsets[s]
            counts[cuts[s] : cuts[s + 1]][hit] = self.counts[s][at[hit]]
        return ids[back], counts[back]

    def shard(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Shard of each pair: by its context, and for frequent contexts by its word too, so that none is too large."""
        spread = np.where(count * 4 * self.model.shards > self.model.train_tokens, word + 1, 0).astype(np.uint64)
        mixed = (context.astype(np.uint64) + spread * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.model.shards)).astype(np.int64)

    def pairs(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context id, word id, training counts of context and word, for each token."""
        word, count = self.ids(hashes)
        context, before = np.empty_like(word), np.empty_like(count)
        context[1:], before[1:] = word[:-1], count[:-1]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        context[first], before[first] = self.begin, self.model.docs
        return context, word, before, count

    @lru_cache(maxsize=4096)  # noqa: B019
    def of_shard(self, shard: int) -> tuple[np.ndarray | None, ...]:
        return tuple(self._load(f"{name}-{shard}") for name in ("once", "twice", "more", "more_n"))

    @lru_cache(maxsize=4096)  # noqa: B019
    def block(self, number: int) -> np.ndarray | None:
        return self._load(f"stats-{number}")

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """(words after it once, twice, more often; distinct contexts) of each id, by rows."""
        out = np.zeros((len(ids), 4), np.int64)
        for number, (at,) in _by_slot(ids // BLOCK, np.arange(len(ids))):
            if (block := self.block(number)) is not None:
                out[at] = block[ids[at] % BLOCK]
        return out

    def pair_counts(self, context: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        keys = context * (self.model.words + 2) + word
        out = np.zeros(len(keys), np.int64)
        for shard, (at,) in _by_slot(self.shard(context, word, before), np.arange(len(keys))):
            once, twice, more, n = self.of_shard(shard)
            for known, value in ((once, 1), (twice, 2), (more, n)):
                if known is not None and len(known):
                    place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
                    hit = known[place] == keys[at]
                    out[at[hit]] = value if isinstance(value, int) else value[place[hit]]
        return out

    def log10(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability, and training count, of each token."""
        m = self.model
        context, word, before, count = self.pairs(hashes, sizes)
        distinct, at, back = np.unique(context * (m.words + 2) + word, return_index=True, return_inverse=True)
        context, word, before = context[at], word[at], before[at]
        low = self.stats(word)[:, 3]
        d = np.array([0.0, *m.low_discounts])[np.minimum(low, 3)]
        p = np.maximum(low - d, 0) / max(m.pairs, 1) + m.low_mass / (m.words + 1)
        after = self.stats(context)[:, :3] @ np.array(m.discounts)
        seen = self.pair_counts(context, word, before)
        d = np.array([0.0, *m.discounts])[np.minimum(seen, 3)]
        total = np.maximum(before, 1)
        p = np.where(before > 0, np.maximum(seen - d, 0) / total + after / total * p, p)
        return np.log10(p)[back], count


_open: dict[str, _Arrays] = {}


def _arrays(model: Model) -> _Arrays:
    """The arrays of a model, opened once by a worker; those of the model before are let go."""
    key = repr(model)
    if key not in _open:
        _open.clear()
        _open[key] = _Arrays(model)
    return _open[key]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from how many events have counts 1 to 4; within 0 and the count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.5 for i in (1, 2, 3))


def train(docs: DataFrame) -> Model:
    """A model of all rows of docs (text). Null text is as empty: one token, the end. No rows: every word is unknown."""
    spark = docs.sparkSession
    folder = f"{mounted(shared_dir(spark))}/ngram-{uuid.uuid4().hex}"
    os.makedirs(folder)
    n_docs = docs.count()
    model = Model(folder, slots=max(1, n_docs // SHARD_DOCS), docs=n_docs)
    docs = docs.select("text")
    _count_words(docs, model)
    model.shards = max(1, -(-model.train_tokens // SHARD_TOKENS))
    if model.words >= 3_000_000_000:
        raise ValueError("pair keys of so many distinct words exceed 64 bits")
    _count_pairs(docs, model)
    return model


def _count_words(docs: DataFrame, model: Model) -> None:
    slots, folder = model.slots, model.folder

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, hashes, _ in _chunks(batch.text.tolist()):
                distinct, n = np.unique(hashes, return_counts=True)
                rows = [(s, _pack(h.view(np.int64)), _pack(c)) for s, (h, c) in _by_slot(_slots(distinct, slots), distinct, n)]
                yield pd.DataFrame(rows, columns=["slot", "hashes", "n"])

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, n = _summed(_unpack(rows.hashes).view(np.uint64), _unpack(rows.n))
        _save(folder, f"hash-{key[0]}", hashes)
        _save(folder, f"count-{key[0]}", n)
        return pd.DataFrame({"slot": [key[0]], "words": [len(hashes)], "tokens": [int(n.sum())]})

    packed = docs.mapInPandas(count, "slot long, hashes binary, n binary")
    made = packed.groupBy("slot").applyInPandas(write, "slot long, words long, tokens long").collect()  # a row for each shard
    sizes = {r.slot: r.words for r in made}
    model.offsets = [0, *np.cumsum([sizes.get(s, 0) for s in range(slots)]).tolist()]
    model.train_tokens = sum(r.tokens for r in made)


def _count_pairs(docs: DataFrame, model: Model) -> None:
    folder, base = model.folder, model.words + 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = _arrays(model)
        for batch in batches:
            for _, hashes, sizes in _chunks(batch.text.tolist()):
                context, word, before, _ = arrays.pairs(hashes, sizes)
                keys, at, n = np.unique(context * base + word, return_index=True, return_counts=True)
                shards = arrays.shard(context[at], word[at], before[at])
                rows = [(s, _pack(np.diff(k, prepend=0)), _pack(c)) for s, (k, c) in _by_slot(shards, keys, n)]
                yield pd.DataFrame(rows, columns=["shard", "keys", "n"])

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Saves a shard's pairs and returns what it has for each block of contexts and of words."""
        keys, n = _summed(np.concatenate([_unpack([k]).cumsum() for k in rows["keys"]]), _unpack(rows.n))
        once, twice = n == 1, n == 2
        for name, a in (("once", keys[once]), ("twice", keys[twice]), ("more", keys[n > 2]), ("more_n", n[n > 2])):
            _save(folder, f"{name}-{key[0]}", a)
        context, word = keys // base, keys % base
        contexts, *after = _summed(context, once.astype(np.int64), twice.astype(np.int64), (n > 2).astype(np.int64))
        words, contexts_of = _summed(word, np.ones(len(word), np.int64))
        out = [(b, False, _pack(i), _pack(np.concatenate(v)), [0] * 4) for b, (i, *v) in _by_slot(contexts // BLOCK, contexts, *after)]
        out += [(b, True, _pack(i), _pack(v), [0] * 4) for b, (i, v) in _by_slot(words // BLOCK, words, contexts_of)]
        out[0] = (*out[0][:4], [int((n == k).sum()) for k in range(1, 5)])
        return pd.DataFrame(out, columns=["block", "of_words", "ids", "counts", "having"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stats = np.zeros((BLOCK, 4), np.int64)
        for of_words, ids, counts in zip(rows.of_words, rows.ids, rows.counts, strict=True):
            at, values = _unpack([ids]) % BLOCK, _unpack([counts])
            if of_words:
                stats[at, 3] += values  # ids of a row are distinct
            else:
                stats[at, :3] += values.reshape(3, -1).T
        used = int(np.flatnonzero(stats.any(axis=1)).max(initial=-1)) + 1
        _save(folder, f"stats-{key[0]}", stats[:used] if used == BLOCK else np.concatenate([stats[:used], np.zeros((min(BLOCK - used, 2), 4), np.int64)]))
        low = stats[:, 3]
        having = np.sum(rows.having.tolist(), axis=0).tolist()
        return pd.DataFrame({"having": [having], "low": [[int((low == k).sum()) for k in range(1, 5)]], "more": [int((low > 2).sum())], "pairs": [int(low.sum())]})

    packed = docs.mapInPandas(count, "shard long, keys binary, n binary")
    written = packed.groupBy("shard").applyInPandas(write, "block long, of_words boolean, ids binary, counts binary, having array<long>")
    made = written.groupBy("block").applyInPandas(join, "having array<long>, low array<long>, more long, pairs long").collect()  # a row for each block
    having, low = (np.sum([r[k] for r in made], axis=0).tolist() if made else [0] * 4 for k in ("having", "low"))
    model.pairs = sum(r.pairs for r in made)
    model.discounts, model.low_discounts = _discounts(having), _discounts(low)
    spared = low[0] * model.low_discounts[0] + low[1] * model.low_discounts[1] + sum(r.more for r in made) * model.low_discounts[2]
    model.low_mass = spared / model.pairs if model.pairs else 1.0


_SCORES = ["n_tokens", "n_known", "base_score", "score"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known (seen in training), train_tokens (long), base_score, score (log10) and perplexity.

    base_score adds one to training counts; score is the model's log10 probability of the text. Null text is as empty: its
    one token is the end. Columns with these names are replaced; rows are neither dropped nor merged.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    @pandas_udf(StructType([StructField(c, DoubleType() if "score" in c else LongType()) for c in _SCORES]))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        arrays = _arrays(model)
        whole = model.train_tokens + model.words + 1
        for batch in texts:
            out = []
            for _, hashes, sizes in _chunks(batch.tolist()):
                logs, counts = arrays.log10(hashes, sizes)
                at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                base = np.log10((counts + 1) / whole)
                out.append(pd.DataFrame({"n_tokens": sizes, "n_known": np.add.reduceat((counts > 0).astype(np.int64), at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at)}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=_SCORES)

    found = docs.withColumn("_s", run(F.col("text"))).withColumns({c: F.col(f"_s.{c}") for c in _SCORES}).drop("_s")
    return found.withColumns({"train_tokens": F.lit(model.train_tokens).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})
