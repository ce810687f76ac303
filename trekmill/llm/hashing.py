"""64-bit hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters that are hashed, or counted, at once.
CHUNK = 1 << 21
#: Odd multipliers of the hashes.
_BASE, _MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    edge = np.diff(np.concatenate(([True], _WHITE[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs."""
    h = a * _MIX + (b ^ (b >> _SHIFT)) * _TURN
    return h ^ (h >> _SHIFT)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes of all words at a time."""
    starts, ends = word_places(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    chunks = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h, left, at, of = np.full(len(starts), _BASE), ends - starts, starts, np.arange(len(starts))
    while len(of):
        eight = np.ascontiguousarray(chunks[at]).view("<u8").ravel()
        short = np.minimum(left, 8).astype(np.uint64)
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - short * np.uint64(8))
        h[of] = mixed(h[of] + short, eight)
        more = left > 8
        of, at, left = of[more], at[more] + 8, left[more] - 8
    return h


def doubled(values: np.ndarray, done: int, width: int) -> np.ndarray:
    """Hashes of `width` neighbours from each element on, from those of `done`."""
    while done < width:
        step = min(done, width - done)
        values, done = mixed(values[:-step], values[step:]), done + step
    return values


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters together; many short texts are hashed at once."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def joined_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of all texts, the text of each word, and each text's first word."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    firsts = np.searchsorted(word_places(data)[0], begins)
    words = word_hashes(data)
    return words, np.repeat(np.arange(len(texts)), np.diff(np.append(firsts, len(words)))), firsts
