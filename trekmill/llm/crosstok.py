"""Alignment of two tokenizers' tokens over the same bytes by a dangling-suffix transducer, and its support in the corpus.

Both tokenizers read one leading space and the text. The side that has covered more bytes leads; what the other hasn't yet
matched of the leader's last token dangles. The lagging side gives the next token, which overlaps the leader's last token.
What dangles after that depends on the dangling bytes and the new token alone, so transitions are memoised by these two. Where
nothing dangles both sides end at the same byte, and a group closes.

No token of either vocabulary reaches from a visible character over a space, so both encodings and the transducer start anew
at a space between visible characters. Workers keep what they find for such a piece of text, as words come again and again.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from trekmill.llm.common import cut

#: Pieces that a worker remembers, about, and characters of text aligned at once.
PIECES, PART_CHARS = 200_000, 1_000_000
#: Pairs whose counts every worker gets, at most; the others are joined. Sums that a counting task holds, at most.
HEAD_PAIRS, TASK_PAIRS = 1_000_000, 1_000_000

_ALIGNED = StructType([StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()), StructField("n_links", LongType()), StructField("groups", StringType()), StructField("pairs", BinaryType())])
#: In place of a transition that hasn't been worked out.
_NEW = 1 << 62
#: A space between visible characters; U+180E is white space to some versions of Unicode only.
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class SideA:
    """A byte-level tokenizer file: the bytes of its ids, and encoding without special tokens.

    Where the file is a plain byte-level vocabulary (its own pre-tokenisation, each merge's result numbered in the merges'
    order), the same vocabulary is encoded by the faster library; the ids are the same.
    """

    def __init__(self, path: str):
        alphabet, told = byte_alphabet(), json.loads(Path(path).read_text())
        own = lambda entry: bytes(map(alphabet.__getitem__, entry)) if all(c in alphabet for c in entry) else entry.encode()
        vocab = told["model"]["vocab"]
        found = {i: own(entry) for entry, i in vocab.items()}
        self.bytes = [found.get(i, b"") for i in range(max(found, default=-1) + 1)]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in told["model"].get("merges", ())]
        first = len(vocab) - len(pairs) - sum(t["content"] in vocab for t in told.get("added_tokens", ()))
        before, options = told.get("pre_tokenizer") or {}, ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "dropout", "ignore_merges")
        plain = told["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told.get("normalizer")
        self.fast = None
        if plain and not any(told["model"].get(k) for k in options) and first == 256 and all(vocab.get(x + y) == first + i for i, (x, y) in enumerate(pairs)):
            ranks = {self.bytes[i]: i for i in range(first + len(pairs))}
            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast:
            return list(map(self.fast.encode_ordinary, texts))
        return [e.ids for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


def side_b(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A piece model and the bytes of its ids: U+2581 is a space, byte pieces are their byte."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    piece = own.id_to_piece
    return own, [bytes([int(piece(i)[3:5], 16)]) if own.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]


class Transducer:
    """States are (side that leads, dangling bytes), numbered; 0 is "nothing dangles". A leads in states above 0, B below."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], states: int = 100_000):
        self.a_bytes, self.b_bytes, self.most = a_bytes, b_bytes, states
        self.base = len(b_bytes)
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple[bool, bytes], int] = {}
        self.dangling: list[bytes] = [b""]
        self.steps: list[dict[int, int | None]] = [{}]  # by state without sign: the lagging side's next token to the state after it
        self.opened: dict[int, dict[int, int | None]] = {}  # A's first token of a group to the steps of the state that it makes

    def state(self, a_leads: bool, rest: bytes) -> int:
        if not rest:
            return 0
        at = self.number.get((a_leads, rest))
        if at is None:
            at = self.number[a_leads, rest] = len(self.dangling) * (1 if a_leads else -1)
            self.dangling.append(rest)
            self.steps.append({})
        return at

    def step(self, state: int, token: int) -> int | None:
        """The state after the lagging side's next token; None where its bytes differ from those that dangle."""
        known = self.steps[abs(state)]
        if token not in known:
            rest, new = self.dangling[abs(state)], (self.b_bytes if state > 0 else self.a_bytes)[token]
            if rest.startswith(new):
                known[token] = self.state(state > 0, rest[len(new) :])
            else:
                known[token] = self.state(state < 0, new[len(rest) :]) if new.startswith(rest) else None
        return known[token]

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]] | None:
        """Groups as `a1,a2|b1,b2` and links as a * base + b, both in order; None if the sides' bytes differ."""
        if len(self.dangling) > self.most:
            self.forget()
        base, steps, opened, groups, links, i, j = self.base, self.steps, self.opened, [], [], 0, 0
        try:
            while i < len(a):
                first_a, first_b, x, y = i, j, a[i], b[j]
                i, j = i + 1, j + 1
                known = opened.get(x)
                if known is None:
                    known = opened[x] = steps[self.state(True, self.a_bytes[x])]
                state = known.get(y, _NEW)
                if state == _NEW:
                    state = self.step(self.state(True, self.a_bytes[x]), y)
                links.append(x * base + y)
                while state:
                    if state > 0:
                        y = b[j]
                        j, after = j + 1, steps[state].get(y, _NEW)
                        state = self.step(state, y) if after == _NEW else after
                    else:
                        x = a[i]
                        i, after = i + 1, steps[-state].get(x, _NEW)
                        state = self.step(state, x) if after == _NEW else after
                    links.append(x * base + y)
                if state is None:
                    return None
                if i - first_a == 1 == j - first_b:
                    groups.append(f"{x}|{y}")
                else:
                    groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
        except IndexError:  # one side ended while the other had bytes left
            return None
        return (groups, links) if j == len(b) else None


def pieces_of(text: str) -> list[str]:
    """text with a leading space, cut before each space that stands between visible characters."""
    return [" " + p for p in _CUT.split(text)]


class Aligner:
    """Both tokenizers, the transducer, and what is known of pieces, in arrays by piece number."""

    def __init__(self, a_path: str, b_path: str):
        self.a, (self.b, self.b_bytes) = SideA(a_path), side_b(b_path)
        self.machine = Transducer(self.a.bytes, self.b_bytes)
        self.whole = any(re.search(r"\S ", token.decode("utf-8", "replace")) for token in chain(self.a.bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = array("q")  # four a piece: A tokens, B tokens, groups, links; A tokens -1: bytes differ
        self.links = array("q")  # those of all pieces, one after the other

    def _align_new(self, pieces: list[str]) -> None:
        b_ids = self.b.encode([p[1:] for p in pieces], num_threads=1)
        for piece, a, b in zip(pieces, self.a.encode(pieces), b_ids, strict=True):
            found = self.machine.align(a, b) if b"".join(map(self.a.bytes.__getitem__, a)) == piece.encode() else None
            groups, links = found or ((), ())
            self.at[piece] = len(self.groups)
            self.groups.append(";".join(groups))
            self.counts.extend((len(a), len(b), len(groups), len(links)) if found else (-1, 0, 0, 0))
            self.links.extend(links)

    def align(self, texts: list[str | None]) -> pd.DataFrame:
        """A row of _ALIGNED for each text."""
        if len(self.at) > PIECES or len(self.links) > 20 * PIECES:
            self.forget()
        cut = [([" " + t] if self.whole else pieces_of(t)) if t else [] for t in texts]
        self._align_new([p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.at])
        counts, links = np.frombuffer(self.counts, np.int64).reshape(-1, 4), np.frombuffer(self.links, np.int64)
        first = np.concatenate(([0], np.cumsum(counts[:, 3])))
        rows, get, groups = [], self.at.__getitem__, self.groups.__getitem__
        for pieces in cut:
            numbers = list(map(get, pieces))
            own, times = np.unique(np.array(numbers, np.int64), return_counts=True)
            mine = counts[own]
            if not len(own) or (mine[:, 0] < 0).any():
                rows.append((0, 0, 0, 0, "", None))
                continue
            size = mine[:, 3]
            at = np.arange(size.sum()) + np.repeat(first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            rows.append((*(times @ mine).tolist(), ";".join(map(groups, numbers)), pack(*_summed(links[at], np.repeat(times, size)))))
        return pd.DataFrame(rows, columns=_ALIGNED.names)


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences and their counts, by byte planes, compressed."""
    both = np.concatenate([np.diff(keys, prepend=0), counts]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(packed: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    keys, counts = np.ascontiguousarray(planes.T).view("<i8").ravel().reshape(2, -1)
    return np.cumsum(keys), counts


def _parts(texts: pd.Series) -> Iterator[list[str | None]]:
    """Runs of texts of about PART_CHARS characters together, so that a worker answers in bounded parts."""
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t or "")
        if total >= PART_CHARS:
            yield held
            held, total = [], 0
    if held:
        yield held


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", to: str = "aligned") -> DataFrame:
    """docs with the struct `to`: n_a, n_b, n_groups, n_links (long), groups (`a1,a2|b1;a3|b2,b3`), pairs (packed links).

    A is a byte-level tokenizer file, B a piece model; workers must be able to read both. A reads space and text, B the text,
    to which it adds the space itself. Special tokens aren't recognised. Null and empty texts, and texts whose joined bytes
    differ from space and text on either side, have no tokens: zeros, '' and null. Texts are aligned whole, at any length;
    rows are neither dropped nor merged; a column named as `to` is replaced, all others stay.
    """

    @pandas_udf(_ALIGNED)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _aligner(a_path, b_path)
        for batch in texts:
            for part in _parts(batch):
                yield own.align(part)

    return docs.withColumn(to, run(F.col(text_col)))


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by pair, summed within a task as far as memory allows."""
    held, size = [], 0

    def summed() -> pd.DataFrame:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        held[:] = [(keys, counts)]
        return pd.DataFrame({"pair": keys, "docs": counts})

    for batch in batches:
        for packed in batch["pairs"]:
            keys, _ = unpack(packed)
            held.append((keys, np.ones(len(keys), np.int64)))
            size += len(keys)
            if size >= 2 * TASK_PAIRS:
                if len(out := summed()) >= TASK_PAIRS:
                    yield out
                    held.clear()
                size = len(out) if held else 0
    if held:
        yield summed()


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, docs, best): in how many documents each id pair is linked, and whether no pair of its A id is in more.

    aligned: a column `pairs`. A pair is a * base + b. A group by A id has as many rows as B has ids at most.
    """
    by_pair = aligned.select("pairs").mapInPandas(_totals, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = cut(by_pair.withColumn("a", F.expr(f"pair div {base}")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def head_of(counts: DataFrame, most: int = HEAD_PAIRS) -> int:
    """The least number of documents from which on there are `most` pairs or fewer; the counts of a level come together."""
    level = F.floor(F.log2("docs") * 8).cast("long")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("docs").alias("least")).collect(), reverse=True)
    total, least = 0, 1 << 62
    for r in levels:  # some hundred levels at most
        total += r.n
        if total > most:
            break
        least = r.least
    return least


_SUPPORT = "n_best long, count_sum long, rest array<long>, rest_n array<long>"


def support(aligned: DataFrame, base: int, pairs_col: str = "pairs", head: int = HEAD_PAIRS) -> DataFrame:
    """aligned (written or checkpointed) with n_best and count_sum in place of `pairs_col`.

    A link counts for as many documents of aligned as hold its id pair linked. n_best: links whose pair is in most documents
    among its A id's pairs, ties included; count_sum: over all links. The counts of the `head` commonest pairs at most go to
    every worker (a bound of 17 MB), those of all others are joined by pair; none of these is common. Rows without links: 0.
    Columns with these names are replaced, others stay; rows that repeat stay apart.
    """
    rows = aligned.select(F.struct(*[F.col(f"`{c}`") for c in aligned.columns if c not in (pairs_col, "n_best", "count_sum")]).alias("row"), F.col(pairs_col).alias("pairs"))
    counts = cut(pair_counts(rows, base))
    least = head_of(counts, head)
    top = counts.where(F.col("docs") >= least).toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(np.array(top[c].to_numpy()) for c in ("pair", "docs", "best")))

    @pandas_udf(_SUPPORT)
    def run(packed: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keys, docs, best = shared.value
        for batch in packed:
            out = []
            for x in batch:
                pair, n = unpack(x)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                at, rest = at[known], ~known
                out.append((int(n[known][best[at]].sum()), int((n[known] * docs[at]).sum()), pair[rest], n[rest]))
            yield pd.DataFrame(out, columns=["n_best", "count_sum", "rest", "rest_n"])

    found = cut(rows.select("row", run("pairs").alias("s"), F.expr("uuid()").alias("key")))
    tail = found.select("key", F.explode(F.arrays_zip(F.col("s.rest").alias("pair"), F.col("s.rest_n").alias("n"))).alias("r")).select("key", "r.pair", "r.n")
    added = tail.join(counts.where(F.col("docs") < least), "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("best_n"), F.sum(F.col("n") * F.col("docs")).alias("sum_n"))
    both = found.join(added, "key", "left")
    total = lambda one, more: (F.col(f"s.{one}") + F.coalesce(F.col(more), F.lit(0))).alias(one)
    return both.select("row.*", total("n_best", "best_n"), total("count_sum", "sum_n"))


def aligned_support(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD_PAIRS) -> DataFrame:
    """docs, less `text`, with n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum; the groups aren't kept.

    The alignment is written once in the shared folder, as counting and scoring both read it.
    """
    found = align(docs, a_path, b_path)
    digest = F.when(F.col("aligned.n_a") == 0, "").otherwise(F.sha2(F.col("aligned.groups"), 256)).alias("groups_sha256")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*_ALIGNED.names, "aligned", "text", "groups_sha256")]
    written = cut(found.select(*own, *[F.col(f"aligned.{n}") for n in ("n_a", "n_b", "n_groups", "n_links", "pairs")], digest))
    return support(written, len(side_b(b_path)[1]), head=head)
