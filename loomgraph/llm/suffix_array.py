"""Order of suffixes by external induced sorting.

Suffixes are typed S or L; the leftmost S suffixes (LMS) are sorted as tuples
of their first symbols, and all others follow by induction: taking suffixes
from the smallest on yields the L suffixes in order, and from the largest on
the S suffixes.  The priority queues that the induction needs are one first-in
first-out queue for each first symbol, as entries arrive in order; a queue
beyond its share of memory goes to a file.  Whole runs of entries are moved at
once.

Suffixes are ordered by their first ``DEPTH`` symbols at least, which is where
the recursion can end: common prefixes are asked for up to that length only.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SYMBOLS = 257  # the separator 0, and bytes + 1
DEPTH = 56
_WORD = 7  # symbols of nine bits in a word


class SpillQueue:
    """Runs of positions in the order in which they came; beyond ``limit`` bytes they wait in a temporary file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.runs, self.file, self.written = limit, 0, [], None, 0

    def push(self, run: np.ndarray) -> None:
        self.runs.append(run)
        self.held += run.nbytes
        if self.held > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for part in self.runs:
                part.tofile(self.file)
                self.written += len(part)
            self.runs, self.held = [], 0

    def read(self) -> np.ndarray:
        parts = self.runs
        if self.file is not None:
            self.file.seek(0)
            parts = [np.fromfile(self.file, np.int32, self.written), *parts]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def words(text: np.ndarray) -> np.ndarray:
    """The seven symbols from each position on as one integer; the end counts as separators."""
    padded = np.concatenate([text, np.zeros(_WORD, text.dtype)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(_WORD):
        out |= padded[k : k + len(text)] << np.uint64(9 * (_WORD - 1 - k))
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the end is smaller than any symbol, so the last one is L."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    rising = np.concatenate([step > 0, [False]])
    return np.concatenate([rising[decided], [False]])


def _split(positions: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs by symbol; each keeps its order."""
    order = np.argsort(symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    edge = np.flatnonzero(np.diff(symbols)) + 1
    starts = np.concatenate([[0], edge]).tolist()
    for a, b in zip(starts, [*starts[1:], len(positions)], strict=True):
        yield int(symbols[a]), positions[a:b]


def _sorted_tuples(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions ordered by DEPTH symbols; ties are refined word by word."""
    order = at[np.argsort(word[at], kind="stable")]
    group = np.zeros(len(order), np.int64)
    key = word[order]
    group[1:] = np.cumsum(key[1:] != key[:-1])
    for k in range(1, DEPTH // _WORD):
        same = np.zeros(len(order), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        rest = order[tied]
        further = np.minimum(rest.astype(np.int64) + k * _WORD, len(word) - 1)
        key = word[further]
        inner = np.lexsort((key, group[tied]))
        order[tied], key = rest[inner], key[inner]
        fresh = np.zeros(len(order), np.int64)
        fresh[tied[1:]] = (group[tied[1:]] == group[tied[:-1]]) & (key[1:] != key[:-1])
        group = group + np.cumsum(fresh)
    return order


def suffix_order(text: np.ndarray, word: np.ndarray, memory: int = 256 << 20) -> np.ndarray:
    """All positions of ``text`` (at least one symbol, all below SYMBOLS) in suffix order."""
    is_s = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + np.int32(1)
    lms = _sorted_tuples(word, lms)
    symbols = text[lms]
    edges = np.searchsorted(symbols, np.arange(SYMBOLS + 1))  # sorted suffixes begin with sorted symbols
    limit = memory // (2 * SYMBOLS)
    l_queues = [SpillQueue(limit) for _ in range(SYMBOLS)]
    s_queues = [SpillQueue(limit) for _ in range(SYMBOLS)]

    def induce(run: np.ndarray, kind: bool, queues: list[SpillQueue], own: int) -> list[np.ndarray]:
        before = run[run > 0] - np.int32(1)
        before = before[is_s[before] == kind]
        again = []
        if len(before):
            for symbol, part in _split(before, text[before]):
                queues[symbol].push(part)
                if symbol == own:
                    again.append(part)
        return again

    l_queues[int(text[-1])].push(np.array([len(text) - 1], np.int32))  # what the end induces
    for c in range(SYMBOLS):
        waiting = [l_queues[c].read()]
        while waiting:
            waiting = [x for run in waiting for x in induce(run, False, l_queues, c)]
        induce(lms[edges[c] : edges[c + 1]], False, l_queues, -1)
    for c in range(SYMBOLS - 1, -1, -1):
        waiting = [s_queues[c].read()]
        while waiting:
            waiting = [x for run in waiting for x in induce(run, True, s_queues, c)]
        induce(l_queues[c].read()[::-1], True, s_queues, -1)
    return np.concatenate([x for c in range(SYMBOLS) for x in (l_queues[c].read(), s_queues[c].read()[::-1])])
