"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut where the public pattern would cut them: each character becomes a symbol (its class, with what a look at
the next two characters settles), a symbol is a function from the state before to the state after, and as composition
of functions is associative the states at all places come from a scan. A slice starts wherever state and symbol say so.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from trekmill.llm.common import small_batches

#: White space as the pattern's \s has it.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, BLANK, WHITE, APOSTROPHE = range(6)

# Symbols: a letter, number or other character; a space that joins what follows; white space before more white
# space or the end; white space that stands alone before other text; an apostrophe with an ending of one or two, and
# the same where a text begins.
S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_WHITE, S_ALONE, S_END1, S_END2, S_NEW1, S_NEW2 = range(10)
# States: what the character before belongs to.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOINED, WANT2, WANT1, CUT = range(8)

_BLOCK = 256
#: Characters that are pre-tokenised at once; texts are joined up to this.
_CHUNK = 1 << 18
#: Slices in the table of ids that a worker keeps; a full one is kept as the table before, and a new one begun.
_CACHED = 1 << 17
#: Slices with more bytes than this are merged with a heap and are not kept.
_LONG = 64


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(SPACES)] = WHITE
    table[0x20] = BLANK
    table[0x27] = APOSTROPHE
    return table


@cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice starts) by [symbol, state]."""
    after = np.empty((10, 8), np.uint8)
    starts = np.ones((10, 8), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
    for state in range(8):
        for symbol in range(10):
            if symbol in run:
                after[symbol, state] = run[symbol]
                starts[symbol, state] = state not in (run[symbol], JOINED)
            elif symbol == S_JOIN:
                after[symbol, state] = JOINED
            elif symbol == S_WHITE:
                after[symbol, state] = IN_WHITE
                starts[symbol, state] = state != IN_WHITE
            elif symbol == S_ALONE:
                after[symbol, state] = CUT
            elif symbol in (S_NEW1, S_NEW2):
                after[symbol, state] = WANT1 if symbol == S_NEW1 else WANT2
            elif state in (IN_OTHERS, JOINED):  # an apostrophe inside a run of others has no ending
                after[symbol, state] = IN_OTHERS
                starts[symbol, state] = False
            else:
                after[symbol, state] = WANT1 if symbol == S_END1 else WANT2
        if state in (WANT1, WANT2):  # the ending's letters
            after[S_LETTER, state] = CUT if state == WANT1 else WANT1
            starts[S_LETTER, state] = False
    return after, starts


def _symbols(points: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Symbol of each character; last marks where a text ends."""
    kind = _classes()[points]
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE, S_OTHER], np.uint8)[kind]
    n = len(points)
    white = (kind == BLANK) | (kind == WHITE)
    text_next = np.zeros(n, bool)
    text_next[:-1] = ~white[1:]
    text_next &= ~last
    alone = white & text_next
    out[alone] = np.where(kind[alone] == BLANK, S_JOIN, S_ALONE)
    at = np.flatnonzero((kind == APOSTROPHE) & ~last)
    if len(at):
        one = points[at + 1]
        short = np.isin(one, [ord(e) for e in ENDINGS if len(e) == 1])
        out[at[short]] = S_END1
        more = at[~short & ~last[np.minimum(at + 1, n - 1)]]
        if len(more):
            pair = points[more + 1].astype(np.int64) << 21 | points[more + 2]
            out[more[np.isin(pair, [ord(e[0]) << 21 | ord(e[1]) for e in ENDINGS if len(e) == 2])]] = S_END2
    new = np.append(0, np.flatnonzero(last[:-1]) + 1)
    out[new[out[new] == S_END1]] = S_NEW1
    out[new[out[new] == S_END2]] = S_NEW2
    return out


def _states(symbols: np.ndarray) -> np.ndarray:
    """State before each character, from IN-nothing (CUT), by a blocked scan of the symbols' functions."""
    after, _ = _machine()
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, S_JOIN, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    flat = after.ravel()
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)  # each block's function, begun as identity
    for row in grid:
        whole = flat[(row.astype(np.uint8) << 3) | whole]
    step = 1
    composed = whole.copy()  # after log2 rounds the function of all blocks up to each
    while step < blocks:
        composed[:, step:] = np.take_along_axis(composed[:, step:], composed[:, :-step], axis=0)
        step *= 2
    state = np.full(blocks, CUT, np.uint8)
    state[1:] = composed[CUT, :-1]
    out = np.empty((_BLOCK, blocks), np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = flat[(row << 3) | state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def slice_starts(points: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Places where slices start, in characters; last marks the last character of each of several joined texts."""
    if not len(points):
        return np.zeros(0, np.int64)
    if last is None:
        last = np.zeros(len(points), bool)
        last[-1] = True
    symbols = _symbols(points, last)
    states = _states(symbols)
    starts = _machine()[1][symbols, states]
    starts[0] = True
    starts[1:] |= last[:-1]
    return np.flatnonzero(starts)


class Encoder:
    """Ranks, and the ids of slices met before."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.before: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a slice: the neighbouring pair of least rank is merged, the leftmost of equals, until none has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > _LONG:
            return self._merge_long(piece)
        rank, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < 1 << 30:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 30)
        return tuple(self.ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        n, rank = len(piece), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(ids)

    def of_slice(self, piece: bytes) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.before.get(piece) or self.merge(piece)
            if len(piece) <= _LONG:
                if len(self.known) >= _CACHED:
                    self.before, self.known = self.known, {}
                self.known[piece] = ids
        return ids

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[list[int], list[int]]]:
        """For each text its ids, and the byte offset of each slice's end."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > _CHUNK:
                yield from self._encode_chunk(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._encode_chunk(held)

    def _encode_chunk(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.cumsum(lengths)
        last = np.zeros(len(points), bool)
        last[text_ends[lengths > 0] - 1] = True
        starts = slice_starts(points, last)
        width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        places = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        cuts = np.append(places[starts], places[-1])
        whole = "".join(texts).encode("utf-8", "surrogatepass")
        bounds = np.searchsorted(starts, text_ends).tolist()
        cuts, of_slice, known = cuts.tolist(), self.of_slice, self.known.get
        first = 0
        for upto in bounds:
            ids: list[int] = []
            ends = cuts[first + 1 : upto + 1]
            for a, b in zip(cuts[first:upto], ends, strict=True):
                piece = whole[a:b]
                ids += known(piece) or of_slice(piece)
            begin = cuts[first]
            yield ids, [e - begin for e in ends]
            first = upto

    def forget(self) -> None:
        """Lets go of the slices met, so that an idle worker holds none of them."""
        self.known, self.before = {}, {}

    def decode(self, ids) -> bytes:
        """The bytes of ids, strictly: an unknown id is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_ENCODED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("slice_ends", ArrayType(IntegerType()))])
_DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


#: Texts of a batch that are in Python's hands at once.
_TEXTS = 256


def _lists(values: array, sizes: list[int]) -> pa.ListArray:
    """Rows of whole numbers from one buffer; no number becomes an object of its own."""
    return pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), np.frombuffer(values, np.int32))


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Small parts of each batch, which are answered one by one, so that a worker never holds a whole batch's ids."""
    for batch in batches:
        for at in range(0, len(batch), _TEXTS):
            yield batch.slice(at, _TEXTS)


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs with `ids` and `slice_ends` (byte offsets at which the pre-tokeniser's slices end).

    path: a rank file that workers can read. Special tokens are not recognised. Null text is as empty: no ids. Columns
    with these names are replaced; rows are neither dropped nor merged. A worker holds the ids of 256 texts at once, as packed integers.
    With `decoded` there is also what `decode` gives for the ids, without a second pass of them through the workers.
    """
    small_batches(docs)
    fields = _ENCODED.names + ["decoded"] * decoded

    @arrow_udf(StructType(_ENCODED.fields + [StructField("decoded", BinaryType())] * decoded))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for part in _parts(texts):
            ids, ends, n_ids, n_ends, again = array("i"), array("i"), [], [], []
            for i, e in own.encode_all(t or "" for t in part.to_pylist()):
                ids.extend(i)
                ends.extend(e)
                n_ids.append(len(i))
                n_ends.append(len(e))
                if decoded:
                    again.append(own.decode(i))
            yield pa.StructArray.from_arrays([_lists(ids, n_ids), _lists(ends, n_ends), *[pa.array(again, pa.binary())] * decoded], fields)
        own.forget()

    return docs.withColumn("_e", run(F.col(text_col))).withColumns({c: F.col(f"_e.{c}") for c in fields}).drop("_e")


def decode(docs: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """docs with `decoded` (binary) from ids. Null ids: empty. An id that the vocabulary lacks fails the job."""

    @arrow_udf(BinaryType())
    def run(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for part in _parts(ids):
            yield pa.array([own.decode(row.values.to_pylist() if row.is_valid else ()) for row in part], pa.binary())

    return docs.withColumn("decoded", run(F.col(ids_col)))


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of encoding `text` and decoding the ids again, in one pass.

    As encode and decode; the ids and bytes themselves don't leave the workers.
    """

    small_batches(docs)

    @pandas_udf(_DIGEST)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        digits = {i: str(i) for i in own.tokens}.__getitem__
        sha = hashlib.sha256
        for batch in texts:
            rows = [(len(ids), sha(" ".join(map(digits, ids)).encode()).hexdigest(), sha(own.decode(ids)).hexdigest()) for ids, _ in own.encode_all([t or "" for t in batch])]
            yield pd.DataFrame(rows, columns=_DIGEST.names)
        own.forget()

    return docs.withColumn("_d", run(F.col(text_col))).withColumns({n: F.col(f"_d.{n}") for n in _DIGEST.names}).drop("_d")
