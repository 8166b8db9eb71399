"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _MIX = 0x100000001B3, np.uint64(0xFF51AFD7ED558CCD)


def _word_bytes() -> np.ndarray:
    is_word = np.zeros(256, bool)
    for low, high in ((48, 57), (97, 122), (128, 255)):
        is_word[low : high + 1] = True
    return is_word


_IS_WORD = _word_bytes()


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            powers = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                powers.append(np.multiply.accumulate(x))
            self.up, self.down = powers
        return self.up, self.down


_POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each word, in order.

    Words are runs of ASCII letters, digits and bytes above 7F of the
    lower-case text; null has none.
    """
    parts = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_binary()).to_pylist()
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ends_of = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[data]])))
    begin, end = edge[::2], edge[1::2]  # data ends with a blank, so every word ends
    up, down = _POWERS.to(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)])
    word = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return np.searchsorted(ends_of, begin, "right"), word


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true in the given ranges of bytes, both ends included."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: A-Z to a-z, all other bytes to themselves.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of each run of word bytes; a run never goes on from one text into the next."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of ``data``."""
    up, down = _POWERS.to(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


class RunHashes:
    """64-bit hashes of runs of words, any of them in constant time."""

    def __init__(self, word: np.ndarray):
        up, self.down = _POWERS.to(len(word) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up[: len(word)], dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.total[start + length] - self.total[start]) * self.down[start] + np.asarray(length).astype(np.uint64))
