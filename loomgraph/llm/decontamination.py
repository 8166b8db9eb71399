"""Benchmark decontamination: documents that hold windows of benchmark items.

A window is ``window`` consecutive words of an item (an item of fewer is one
window).  It is a set of shingles of ``SHINGLE`` words, of which a text that
holds the window must hold all; so one of them, the rarest in the corpus, is
enough to find it: the prefix for a containment of 1.

1. One pass over the documents counts the shingles of items, by hashed slot:
   ``SLOTS`` counters whatever the sizes.  Rarity steers the cost alone.
2. Every window gets its rarest shingle and where it begins in the window.
3. A second pass looks the shingles of each document up among these prefixes.
   The place of a prefix gives the place of the window; positional and length
   bounds keep it inside the document; the window's hash names it, and its
   words are compared byte by byte.

Documents are never shuffled.  The windows go to all workers in blocks of a
measured size, ``block_bytes`` at most; items beyond one block take one more
pass over the documents for each block, and what the passes find is merged by
row.  Copies of one window are held once, with all their items.

Edge cases: null and empty texts have no words, in documents and items alike.
Rows with one doc_id are judged on their own, repeated rows too.  Rows of one
item_id count as one item; an item without id marks words and is not named.
Empty tables give empty results, or no hits.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, discard, stored, utf8
from .words import ASCII_LOWER, RunHashes, byte_class, span_hashes, word_spans

SHINGLE = 3
SLOTS = 1 << 20
BLOCK_BYTES = 96 << 20
#: Items are dealt out in parts of so many windows.
PART_WINDOWS = 1000
_CHUNK = 1 << 18
_IS_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_SPANS = "array<struct<start:bigint,stop:bigint>>"


class Words:
    """The words of a column of texts, with hashes of all runs of them."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = utf8(texts)
        self.raw, data = data, ASCII_LOWER[data]
        self.begin, self.end, self.text = word_spans(data, self.offsets, _IS_WORD)
        self.size = self.end - self.begin
        self.runs = RunHashes(span_hashes(data, self.begin, self.end))
        self.bytes = data[_IS_WORD[data]]  # all words, one after the other
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.per_text = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.per_text)])

    def starts(self, length: int) -> np.ndarray:
        """Words from which ``length`` words follow in the same text."""
        word = np.arange(len(self.begin))
        return word[word + length <= self.first[self.text + 1]]


def _slot(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(SLOTS - 1)).astype(np.int64)


def _spread(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups given by ``at`` (ends of runs): the index of the asker and of each member."""
    count = at[group + 1] - at[group]
    asker = np.repeat(np.arange(len(group)), count)
    return asker, np.arange(len(asker)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[group], count)


def _equal(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Are these parts of a and b equal?  Compared in chunks, so that memory is bounded."""
    same = np.ones(len(length), bool)
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * _CHUNK, "right")))
        n = length[at:to]
        owner = np.repeat(np.arange(at, to), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        same[owner[a[a_begin[owner] + step] != b[b_begin[owner] + step]]] = False
        at = to
    return same


@dataclass
class Block:
    """Windows with their prefixes, as sorted arrays."""

    token: np.ndarray  # prefixes, sorted, once each
    sizes: np.ndarray  # lengths of prefixes in words
    slots: np.ndarray  # flags of their slots
    place_at: np.ndarray  # runs of places by prefix
    place: np.ndarray  # offset of the prefix in the window, length of the window
    key: np.ndarray  # hashes of windows, sorted
    length: np.ndarray  # words of a window
    word: np.ndarray  # its first word among ``at``
    bytes: np.ndarray  # words of items, one after the other
    at: np.ndarray  # where they begin
    item_at: np.ndarray  # runs of items by window
    item: np.ndarray  # numbers of items
    ids: list[str]  # ids by number, sorted as UTF-8

    def same(self, words: Words, start: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Are the words from ``start`` on just those of the windows?"""
        n = self.length[window]
        mine, theirs = self.at[self.word[window]], words.at[start]
        size = self.at[self.word[window] + n] - mine
        ok = size == words.at[start + n] - theirs
        for k in range(int(n.max(initial=0))):  # sizes of words
            has = np.flatnonzero(ok & (k < n))
            at = self.word[window[has]] + k
            ok[has] = self.at[at + 1] - self.at[at] == words.size[start[has] + k]
        found = np.flatnonzero(ok)
        ok[found] = _equal(self.bytes, mine[found], words.bytes, theirs[found], size[found])
        return ok

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of every window in the texts."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size in self.sizes.tolist():
            start = words.starts(size)
            token = words.runs.of(start, size)
            near = self.slots[_slot(token)]
            start, token = start[near], token[near]
            at = np.minimum(np.searchsorted(self.token, token), max(len(self.token) - 1, 0))
            near = self.token[at] == token
            start, at = start[near], at[near]
            for low in range(0, len(start), _CHUNK):
                found.append(self._verified(words, start[low : low + _CHUNK], at[low : low + _CHUNK]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _verified(self, words: Words, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asker, place = _spread(self.place_at, at)
        text = words.text[start[asker]]
        begin, n = start[asker] - self.place[place, 0], self.place[place, 1]
        inside = (begin >= words.first[text]) & (begin + n <= words.first[text + 1])  # positional and length bounds
        begin, n = begin[inside], n[inside]
        key = words.runs.of(begin, n)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        asker = np.repeat(np.arange(len(key)), high - low)
        window = np.arange(len(asker)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[asker]
        begin, n = begin[asker], n[asker]
        same = n == self.length[window]
        begin, window = begin[same], window[same]
        ok = self.same(words, begin, window)
        return begin[ok], window[ok]


def _window_starts(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each window of each text, in order."""
    whole = np.flatnonzero((words.per_text > 0) & (words.per_text < window))
    start = np.concatenate([words.starts(window), words.first[whole]])
    length = np.concatenate([np.full(len(start) - len(whole), window, np.int64), words.per_text[whole]])
    order = np.argsort(start, kind="stable")
    return start[order], length[order]


def _slots_of_items(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = Words(batch.column("text"))
            start, length = _window_starts(words, window)
            for size in np.unique(np.minimum(length, SHINGLE)).tolist():
                # A window of ``length`` words has a shingle at each of its first ``length - size + 1`` words.
                of = words.starts(size) if size == SHINGLE else start[length == size]
                slot = np.unique(_slot(words.runs.of(of, size)))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(slot), size))], ["slot", "size"])

    return run


def _counts(slots: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in blocks(batches, "text"):
            words = Words(batch.column("text"))
            for size in sizes:
                slot = _slot(words.runs.of(words.starts(size), size))
                counts += np.bincount(slot[slots[slot]], minlength=SLOTS)
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[has])], ["slot", "n"])

    return run


def _prefixes(counts, window: int):
    """Parts of items: id, words, and for each window the offset of its rarest shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = Words(batch.column("text"))
            start, length = _window_starts(words, window)
            size = np.minimum(length, SHINGLE)
            offset = np.zeros(len(start), np.int64)
            best = np.full(len(start), -1, np.int64)
            rarest = np.zeros(len(start), np.uint64)
            for k in range(max(1, window - SHINGLE + 1)):
                has = np.flatnonzero(k + size <= length)
                token = words.runs.of(start[has] + k, size[has])
                n = counts.value[_slot(token)]
                less = (best[has] < 0) | (n < best[has]) | ((n == best[has]) & (token < rarest[has]))
                has = has[less]
                offset[has], best[has], rarest[has] = k, n[less], token[less]
            text = words.text[start]
            at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))])
            items, parts, offsets = [], [], []
            ids = batch.column("item").to_pylist()
            spelled = words.bytes.tobytes()
            for t in np.flatnonzero(np.diff(at)).tolist():
                for low in range(int(at[t]), int(at[t + 1]), PART_WINDOWS):
                    high = min(low + PART_WINDOWS, int(at[t + 1]))
                    edges = words.at[start[low] : start[high - 1] + length[high - 1] + 1].tolist()
                    items.append(ids[t])
                    parts.append(b" ".join(spelled[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)))
                    offsets.append(offset[low:high].astype(np.uint8 if window < 256 else np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.binary()), pa.array(offsets, pa.binary())], ["item", "words", "offsets"])

    return run


def assembled(parts: pa.Table, window: int) -> Block:
    """One block from parts of items."""
    words = Words(parts.column("words").combine_chunks())
    start, length = _window_starts(words, window)
    raw = b"".join(parts.column("offsets").to_pylist())
    offset = np.frombuffer(raw, np.uint8 if window < 256 else np.int32).astype(np.int64)
    names = parts.column("item").to_pylist()
    ids = sorted({x for x in names if x is not None}, key=lambda x: x.encode())
    number = {x: k for k, x in enumerate(ids)}
    item = np.fromiter((number.get(x, -1) for x in names), np.int64, len(names))[words.text[start]]
    size = np.minimum(length, SHINGLE)
    token, key = words.runs.of(start + offset, size), words.runs.of(start, length)
    places, which = np.unique(np.stack([token, offset.astype(np.uint64), length.astype(np.uint64)], 1), axis=0, return_inverse=True)
    tokens, count = np.unique(places[:, 0], return_counts=True)
    slots = np.zeros(SLOTS, bool)
    slots[_slot(tokens)] = True
    # Windows with one hash are one window, unless their words differ (then each stands for itself).
    order = np.lexsort((item, key))
    start, length, item, key = start[order], length[order], item[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    block = Block(tokens, np.unique(size), slots, np.concatenate([[0], np.cumsum(count)]), places[:, 1:].astype(np.int64), key, length, start, words.bytes, words.at, np.zeros(0, np.int64), item, ids)
    if len(key):
        new |= ~((length == length[head]) & block.same(words, start, head))
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    named = np.unique(np.stack([group, item], 1)[item >= 0], axis=0)
    block.key, block.length, block.word = key[first], length[first], start[first]
    block.item_at = np.searchsorted(named[:, 0], np.arange(len(first) + 1))
    block.item = named[:, 1]
    return block


def _lists(owner: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]), pa.int32())


def _found(block, kept: str, everywhere: bool):
    """Arrow batches with ``kept``, n_words, n_hit, items and spans; only texts with hits unless ``everywhere``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: Block = block.value
        ids = pa.array(of.ids, pa.string())
        for batch in blocks(batches, "text"):
            rows = batch.num_rows
            words = Words(batch.column("text"))
            start, window = of.hits(words)
            edges = np.zeros(len(words.begin) + 1, np.int64)
            np.add.at(edges, start, 1)
            np.add.at(edges, start + of.length[window], -1)
            hit = np.cumsum(edges[:-1]) > 0
            n_hit = np.bincount(words.text[hit], minlength=rows)
            asked = np.unique(np.stack([words.text[start], window], 1), axis=0)
            asker, item = _spread(of.item_at, asked[:, 1])
            pairs = np.unique(np.stack([asked[asker, 0], of.item[item]], 1), axis=0)
            # Spans: runs of hit words in one text, in code points.
            opens, closes = hit.copy(), hit.copy()
            if len(hit):
                apart = words.text[1:] != words.text[:-1]
                opens[1:] &= ~hit[:-1] | apart
                closes[:-1] &= ~hit[1:] | apart
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
            points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
            text = words.text[opens]
            before = points[words.offsets[text]]
            spans = pa.StructArray.from_arrays([pa.array(points[words.begin[opens]] - before), pa.array(points[words.end[closes]] - before)], ["start", "stop"])
            columns = [
                batch.column(kept),
                pa.array(words.per_text),
                pa.array(n_hit),
                pa.ListArray.from_arrays(_lists(pairs[:, 0], rows), ids.take(pa.array(pairs[:, 1]))),
                pa.ListArray.from_arrays(_lists(text, rows), spans),
            ]
            out = pa.RecordBatch.from_arrays(columns, [kept, "n_words", "n_hit", "items", "spans"])
            yield out if everywhere else out.filter(pa.array(n_hit > 0))

    return run


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for each document.

    ``n_hit`` counts words inside any occurrence of a window; ``items`` names the
    items with such windows, sorted as UTF-8; ``spans`` are the runs of hit words
    in code points of the text (start, and stop behind the last).
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    asked = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))

    slots = np.zeros(SLOTS, bool)
    of_items = asked.mapInArrow(_slots_of_items(window), "slot long, size long").distinct().toArrow()
    slots[np.array(of_items.column("slot"), np.int64)] = True
    sizes = np.unique(np.array(of_items.column("size"), np.int64)).tolist()
    counted = texts.select("text").mapInArrow(_counts(slots, sizes), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[np.array(counted.column("slot"), np.int64)] = np.array(counted.column("n"), np.int64)

    parts = stored(asked.mapInArrow(_prefixes(context.broadcast(counts), window), "item string, words binary, offsets binary").distinct(), "windows")
    # A window takes about 80 bytes beside its words: hashes, place, item and the arrays of its word.
    weight = F.octet_length("words") + 80 * F.octet_length("offsets") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64
    total = parts.agg(F.sum(weight.cast("long"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) if total else 1
    if n_blocks == 1:
        block = context.broadcast(assembled(parts.toArrow(), window))
        discard(parts)
        return texts.mapInArrow(_found(block, "doc_id", True), f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans {_SPANS}")

    rows = stored(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    part = F.pmod(F.xxhash64("item", "words", "offsets"), F.lit(n_blocks))
    passes = []
    for k in range(n_blocks):
        block = context.broadcast(assembled(parts.where(part == k).toArrow(), window))
        passes.append(stored(rows.select("row", "text").mapInArrow(_found(block, "row", False), f"row long, n_words long, n_hit long, items array<string>, spans {_SPANS}"), "hits"))
        block.unpersist()
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    found = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = rows.select("row", "doc_id", "text").join(found, "row", "left")
    return found.mapInArrow(_merged, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans {_SPANS}")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several passes made one, and the words in them counted."""
    for batch in blocks(batches, "text"):
        words = Words(batch.column("text"))
        points = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
        begin = points[words.begin] - points[words.offsets[words.text]]
        n_hit, merged = [], []
        for row, spans in enumerate(batch.column("spans").to_pylist()):
            own = begin[words.first[row] : words.first[row + 1]]
            joined: list[list[int]] = []
            for span in spans or []:
                # Two runs become one if they overlap, or if no word stands between them.
                if joined and np.searchsorted(own, span["start"]) <= np.searchsorted(own, joined[-1][1]):
                    joined[-1][1] = max(joined[-1][1], span["stop"])
                else:
                    joined.append([span["start"], span["stop"]])
            n_hit.append(sum(int(np.searchsorted(own, b) - np.searchsorted(own, a)) for a, b in joined))
            merged.append([{"start": a, "stop": b} for a, b in joined])
        items = [x or [] for x in batch.column("items").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [batch.column("doc_id"), pa.array(words.per_text), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(merged, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])


ORACLE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT doc_id, d.i, d.n, item_id FROM d JOIN i ON d.g = i.g AND d.n = i.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
