"""Best-fit packing by large-item matching.

Lengths are integers up to the capacity, so pieces of one length can stand for
each other.  The plan is made from the histogram of lengths alone (at most
``capacity`` counters, whatever the corpus): pieces above a third of the
capacity are matched greedily, at most two to a bin; shorter ones go, longest
first, to the smallest gap that holds them.  Runs of like bins are planned
together, so the plan has a few runs for each length and is safe to broadcast.
Each piece then finds its place from its length and its rank among the pieces
of that length; ranks come from counts by task, so no length is gathered in
one task.

Edge cases: a null text is empty and becomes one piece that holds the end id
alone.  Repeated rows are packed one by one.  An empty table gives no rows.
Input columns other than the two named are not read.
"""

from __future__ import annotations

import bisect
import functools
import re
import string
import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks, release, stored

CAPACITY = 2048
#: What the tokenizer counts as white space.  str.split() also splits at 1C to 1F.
_SPACE = re.compile("[\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_CACHED_WORDS, _CACHED_LENGTH = 1_500_000, 64  # about 200 bytes a word in each worker process


class WordCoder(dict):
    """Packed little-endian ids by white-space separated word.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids one after the other.
    """

    def __init__(self, path: str, most: int = _CACHED_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and "<|" not in word:  # "<|" may begin a special token
            stem = word.rstrip(string.punctuation)
            low = stem.lower()
            if low and len(low) < len(word):  # letters or digits and then marks are separate to the tokenizer
                ids = self[low] + self[word[len(stem) :]]
            elif low and low != word:
                ids = self[low]
            else:
                ids = self._encoded(word)
        else:
            ids = self._encoded(word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        words = [w for w in _SPACE.split(text) if w] if odd else text.split()
        return b"".join(map(self.__getitem__, words))


@functools.cache
def coder(path: str, most: int = _CACHED_WORDS) -> WordCoder:
    """One for each worker process, kept between tasks."""
    return WordCoder(path, most)


def pieces(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, cached_words: int = _CACHED_WORDS) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32, task, rank [, ids].

    ``rank`` counts from 0 among the pieces of one length and task.  ``ids`` are
    little-endian unsigned 32-bit ids.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier stages of the same process have left
        encode, task, seen = coder(tokenizer_path, cached_words).encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in blocks(batches, "text"):
            rows: list[list] = [[] for _ in names]
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = encode(value or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    n = len(part) // 4
                    for column, x in zip(rows, (key, piece, at // 4, n, zlib.crc32(part), task, seen[n], part), strict=False):
                        column.append(x)
                    seen[n] += 1
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first bin, pieces in a bin, offset in the bin), sorted.

    A run puts pieces of one length, by rank, into successive bins.
    """
    left, used, runs = dict(histogram), dict.fromkeys(histogram, 0), []
    bins = 0
    gaps: list[tuple[int, int, int]] = []  # gap, first bin, bins; sorted

    def put(length: int, first: int, count: int, each: int, offset: int) -> None:
        runs.append((length, used[length], first, each, offset))
        used[length] += count * each
        left[length] -= count * each

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        count = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        if b == a and not count:  # one piece remains; its partner is a shorter one, if any
            b = large[at - 1] if at > 0 else None
            count = 1
        if b == a:
            put(a, bins, count, 2, 0)
        else:
            put(a, bins, count, 1, 0)
            if b is not None:
                put(b, bins, count, 1, a)
        if gap := capacity - a - (b or 0):
            bisect.insort(gaps, (gap, bins, count))
        bins += count
        large = [x for x in large if left[x]]
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, (length,))
            if at == len(gaps):
                each = capacity // length
                gap, first, count = capacity, bins, -(-left[length] // each)
                bins += count
            else:
                gap, first, count = gaps.pop(at)
            each = gap // length
            full = min(count, left[length] // each)
            rest = left[length] - full * each if full < count else 0
            parts = [(full, each), (1, rest)] if rest else [(full, each)]
            for n, k in parts:
                if n:
                    put(length, first, n, k, capacity - gap)
                    if gap - k * length:
                        bisect.insort(gaps, (gap - k * length, first, n))
                    first, count = first + n, count - n
            if count:
                bisect.insort(gaps, (gap, first, count))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def place(cut: DataFrame, runs: np.ndarray) -> DataFrame:
    """Add sequence_id and offset by length and overall rank."""
    keys = (runs[:, 0] << 48) | runs[:, 1]
    shared = cut.sparkSession.sparkContext.broadcast((keys, runs))
    schema = cut.drop("rank", "task").schema.add("sequence_id", "long").add("offset", "long")
    names = [f.name for f in schema.fields]

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            along = rank - run[:, 1]
            columns = [batch.column(c) for c in names[:-2]] + [pa.array(run[:, 2] + along // run[:, 3]), pa.array(run[:, 4] + along % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut.drop("task").mapInArrow(look_up, schema)


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, cached_words: int = _CACHED_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset for each piece.

    Tokenizing runs once; its rows are written to the shared folder, as their
    ranks must not change between the count and the placing.
    """
    cut = stored(pieces(docs, tokenizer_path, doc_id, text, capacity, end_id, with_ids, cached_words), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan(histogram, capacity)
    if not len(runs):
        runs = np.array([[0, 0, 0, 1, 0]], np.int64)
    ranked = cut.join(counts.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    return place(ranked.select(*cut.columns), runs)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, for rows of ``pack(..., with_ids=True)``; a sequence is bounded by the capacity."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
