"""Removal of byte strings that an earlier document holds, by suffix arrays.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a
document with a smaller doc_id.  Equal strings must meet, so suffixes are
dealt by content: every string holds an anchor, the leftmost of its
``LENGTH - GRAM + 1`` grams with the smallest hash, and equal strings have equal
anchors.

1. Texts are laid out once in a table bucketed by a hash of doc_id, so that
   later passes read them without a shuffle.
2. Each shard sends the hashes of its anchors; those that only one document
   has are dropped, which leaves the parts of texts that may recur.
3. The segments around the other anchors (all strings of one anchor: under
   ``2 * LENGTH`` bytes) are dealt by anchor.  Equal segments are one.  Where an
   anchor has several different segments, their suffixes are sorted by
   external induced sorting, and suffixes next to each other with ``LENGTH``
   bytes in common are one string.  Each string gets the smallest doc_id.
4. The strings of each document with a smaller doc_id elsewhere go back to its
   shard, where the bytes are taken out.

A group of equal copies is settled by its text's digest; only the copy with the
smallest doc_id is searched for strings.  No step gathers a string's or an
anchor's occurrences: each shard sends one entry for each different anchor.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing.
Rows that share a doc_id are one document to each other and lose nothing to
each other.  Rows with a null doc_id lose nothing and remove nothing.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, release, stored
from .suffix_array import suffix_order, words

LENGTH, GRAM = 50, 19
SHARD_BYTES, LEAST_SHARDS = 8 << 20, 48
BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 48
_BLOCK = 1 << 20
_SORTED_SEGMENTS = 8_000  # that share a suffix array; one anchor's segments are never parted
_BASE = 0x100000001B3
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(GRAM):
        out += data[k : k + n] * np.uint64(factor)
        factor = factor * _BASE % (1 << 64)
    out = (out ^ (out >> np.uint64(31))) * _MIX
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def _sliding_least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each ``width`` successive values and the place of its leftmost; width is a power of two."""
    at = np.arange(len(x), dtype=np.int32)
    step = 1
    while step < width:
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        step *= 2
    return x, at


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, first string and number of strings of each anchor in texts that begin at ``starts`` (n + 1 of them).

    Strings of several equal grams belong to the leftmost.
    """
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return none
    least, at = _sliding_least(_gram_hashes(data), width)  # by first byte of the string
    inside = np.zeros(len(least) + 1, np.int32)  # strings that cross a border are none
    begin, end = starts[:-1], np.maximum(starts[1:] - LENGTH + 1, starts[:-1])
    np.add.at(inside, np.minimum(begin, len(least)), 1)
    np.add.at(inside, np.minimum(end, len(least)), -1)
    valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(valid):
        return none
    at = at[valid]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)))
    return least[valid[first]], at[first].astype(np.int64), valid[first], np.diff(np.append(first, len(valid)))


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BLOCK, "right")) - 1)
        yield at, to
        at = to


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _laid_out(docs: DataFrame, doc_id: str, text: str, shards: int, carry: list[str]) -> DataFrame:
    """doc_id, text as bytes, shard, and the carried columns as c0, c1, ...; bucketed by shard."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    return bucketed(rows, ["shard"], shards, "zstd")


def _sent(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard and the different anchor hashes of a part of the shard, with the smallest and largest doc_id of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            shards, texts = batch.column("shard").to_numpy(), _bytes(batch.column("text"))
            for shard in np.unique(shards):
                own = np.flatnonzero((shards == shard) & known)
                hashes, docs = [], []
                data, starts = _joined([texts[i] for i in own])
                for a, b in _blocks(starts):
                    h, _, first, _ = anchors(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                    hashes.append(h)
                    docs.append(ids[own][a:b][np.searchsorted(starts[a + 1 : b] - starts[a], first, "right")])
                h, d = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, docs))
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                if not len(first):
                    continue
                low, high, h = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first), h[first]
                of = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
                edges = np.searchsorted(of, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                cut = [slice(edges[k], edges[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), shard, np.int32)), *[pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (h, low, high)]], ["bucket", "shard", "hashes", "low", "high"])

    return table.mapInArrow(run, "bucket int, shard int, hashes binary, low binary, high binary")


def _shared_hashes(table: pa.Table) -> pa.Table:
    """By shard, the hashes that documents with different doc_ids have."""
    parts = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    h = np.concatenate(parts)
    low, high = (np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()]) for c in ("low", "high"))
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    many = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
    keep = np.empty(len(h), bool)
    keep[order] = np.repeat(many, np.diff(np.append(first, len(h))))
    edges = np.cumsum([len(x) for x in parts])[:-1]
    blobs = [p[k].tobytes() for p, k in zip(parts, np.split(keep, edges), strict=True)]
    return pa.table({"shard": table["shard"], "hashes": pa.array(blobs, pa.binary())})


def _pad(segments: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in segments), np.uint8).reshape(len(segments), width)


def _is_copy(key: int, text: bytes, copies: set[tuple[int, str]]) -> bool:
    return (key, hashlib.sha256(text).hexdigest()) in copies


def _segments(buckets: int):
    """From a shard's texts, its shared hashes and its copies: segments by bucket."""

    def work(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows: dict[str, list] = {c: [] for c in ("bucket", "shard", "docs", "firsts", "strings", "grams", "segments")}
        blobs = [x for x in told["hashes"].to_pylist() if x]
        shared = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])) if blobs else np.zeros(0, np.uint64)
        if texts.num_rows and len(shared):
            copies = set(zip(told["copy"].to_pylist(), told["digest"].to_pylist(), strict=True))
            ids = texts["doc_id"].to_pylist()
            all_texts = _bytes(texts["text"])
            own = [i for i, x in enumerate(ids) if x is not None and not _is_copy(x, all_texts[i], copies)]
            data, starts = _joined([all_texts[i] for i in own])
            names = np.array([ids[i] for i in own], np.int64)
            pack = zstandard.ZstdCompressor(level=1).compress
            width = 2 * LENGTH - GRAM
            for a, b in _blocks(starts):
                part = data[starts[a] : starts[b]]
                h, gram, first, size = anchors(part, starts[a : b + 1] - starts[a])
                at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                on = shared[at] == h
                h, gram, first, size = h[on], gram[on], first[on], size[on]
                if not len(h):
                    continue
                doc = np.searchsorted(starts[a + 1 : b] - starts[a], first, "right")
                of = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
                order = np.lexsort((h, of))
                of, gram, first, size, doc = of[order], gram[order], first[order], size[order], doc[order]
                padded = np.append(part, np.zeros(width, np.uint8))
                view = np.lib.stride_tricks.sliding_window_view(padded, width)[first].copy()
                view[np.arange(width)[None, :] >= (size + LENGTH - 1)[:, None]] = 0
                edges = np.searchsorted(of, np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    cut = slice(edges[k], edges[k + 1])
                    rows["bucket"].append(int(k))
                    rows["docs"].append(names[a:b][doc[cut]].tobytes())
                    rows["firsts"].append((first[cut] - (starts[a:b] - starts[a])[doc[cut]]).tobytes())
                    rows["strings"].append(size[cut].astype(np.uint8).tobytes())
                    rows["grams"].append((gram[cut] - first[cut]).astype(np.uint8).tobytes())
                    rows["segments"].append(pack(view[cut].tobytes()))
            rows["shard"] = [texts["shard"][0].as_py()] * len(rows["bucket"])
        release()
        kinds = dict.fromkeys(rows, pa.binary()) | {"bucket": pa.int32(), "shard": pa.int32()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in rows.items()})

    return work


def smallest_doc(segments: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For different segments with their smallest doc_id: the smallest doc_id of each of their strings, by suffix array.

    A row has up to LENGTH - GRAM + 1 strings; what is behind is the largest integer.
    """
    n, width = segments.shape
    most = LENGTH - GRAM + 1
    out = np.full((n, most), np.iinfo(np.int64).max)
    real = np.arange(width)[None, :] < (size + LENGTH - 1)[:, None]
    text = np.where(real, segments.astype(np.uint16) + 1, 0)
    text = np.concatenate([text, np.zeros((n, 1), np.uint16)], 1)
    keep = np.concatenate([real, np.ones((n, 1), bool)], 1)
    flat = text[keep]
    owner = np.repeat(np.arange(n, dtype=np.int32), keep.sum(1))
    inner = np.broadcast_to(np.arange(width + 1, dtype=np.int16), keep.shape)[keep]
    word = words(flat)
    order = suffix_order(flat, word)
    order = order[inner[order] < size[owner[order]]]  # suffixes that begin a string
    differs = np.zeros(len(order), bool)
    differs[:1] = True
    for k in range(0, LENGTH - 6, 7):
        w = word[order + k]
        differs[1:] |= w[1:] != w[:-1]
    last = flat[order + LENGTH - 1]
    differs[1:] |= last[1:] != last[:-1]
    first = np.flatnonzero(differs)
    least = np.minimum.reduceat(doc[owner[order]], first)
    out[owner[order], inner[order]] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def _by_anchor(matrix: np.ndarray, index: np.ndarray, size: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``smallest_doc`` of the segments ``matrix[index]``, some anchors at a time; an anchor with one segment needs no sorting."""
    most = LENGTH - GRAM + 1
    grams = np.lib.stride_tricks.sliding_window_view(matrix, GRAM, axis=1)[index, gram]
    _, anchor, uses = np.unique(np.ascontiguousarray(grams).view(np.dtype((np.void, GRAM))).ravel(), return_inverse=True, return_counts=True)
    out = np.where(np.arange(most)[None, :] < size[:, None], doc[:, None], np.iinfo(np.int64).max)
    several = np.flatnonzero(uses[anchor] > 1)
    several = several[np.argsort(anchor[several], kind="stable")]
    at = 0
    while at < len(several):
        to = int(np.searchsorted(anchor[several], anchor[several[min(at + _SORTED_SEGMENTS, len(several)) - 1]], "right"))
        part = several[at:to]
        out[part] = smallest_doc(matrix[index[part]], size[part], doc[part])
        at = to
    return out


def _search(table: pa.Table) -> pa.Table:
    """By shard, doc_id, first byte and mask of the strings that an earlier document holds."""
    width, most = 2 * LENGTH - GRAM, LENGTH - GRAM + 1
    unpack = zstandard.ZstdDecompressor().decompress
    docs = [np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()]
    counts = [len(x) for x in docs]
    doc = np.concatenate(docs)
    first = np.concatenate([np.frombuffer(x, np.int64) for x in table["firsts"].to_pylist()])
    size = np.concatenate([np.frombuffer(x, np.uint8) for x in table["strings"].to_pylist()]).astype(np.int64)
    matrix = np.frombuffer(b"".join(unpack(x) for x in table["segments"].to_pylist()), np.uint8).reshape(-1, width)
    gram = np.concatenate([np.frombuffer(x, np.uint8) for x in table["grams"].to_pylist()]).astype(np.int64)
    rows = np.concatenate([matrix, size[:, None].astype(np.uint8), gram[:, None].astype(np.uint8)], 1).view(np.dtype((np.void, width + 2))).ravel()
    _, index, which = np.unique(rows, return_index=True, return_inverse=True)
    del rows
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    found = _by_anchor(matrix, index, size[index], gram[index], least)
    mask = np.zeros(len(doc), np.int64)
    for k in range(most):
        mask |= (found[which, k] < doc).astype(np.int64) << k
    del found, matrix
    release()
    shards = np.repeat(table["shard"].to_numpy(), counts)
    order = np.argsort(shards, kind="stable")
    order = order[mask[order] != 0]
    edges = np.flatnonzero(np.append(True, np.diff(shards[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    cuts = np.split(order, edges[1:]) if len(order) else []
    return pa.table({"shard": pa.array([shards[c[0]] for c in cuts], pa.int32()), **{n: pa.array([x[c].tobytes() for c in cuts], pa.binary()) for n, x in (("docs", doc), ("firsts", first), ("masks", mask))}})


def _taken_out(with_text: bool, carry: int):
    def work(texts: pa.Table, told: pa.Table) -> pa.Table:
        most = LENGTH - GRAM + 1
        copies = set(zip(told["copy"].to_pylist(), told["digest"].to_pylist(), strict=True))
        blobs = {c: [x for x in told[c].to_pylist() if x] for c in ("docs", "firsts", "masks")}
        doc, first, mask = (np.concatenate([np.frombuffer(x, np.int64) for x in blobs[c]]) if blobs[c] else np.zeros(0, np.int64) for c in blobs)
        order = np.argsort(doc, kind="stable")
        doc, first, mask = doc[order], first[order], mask[order]
        rows: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")}
        for key, text in zip(texts["doc_id"].to_pylist(), _bytes(texts["text"]), strict=True):
            n, kept, spans = len(text), text, np.zeros((0, 2), np.int64)
            if key is not None and n >= LENGTH and _is_copy(key, text, copies):
                kept, spans = b"", np.array([[0, n]])
            elif key is not None:
                a, b = np.searchsorted(doc, [key, key + 1])
                if a < b:
                    row, bit = np.nonzero(mask[a:b, None] >> np.arange(most) & 1)
                    begins = first[a:b][row] + bit
                    begins = begins[begins <= n - LENGTH]
                    step = np.bincount(begins, minlength=n + 1) - np.bincount(begins + LENGTH, minlength=n + 1)
                    gone = np.cumsum(step)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                    spans = edge.reshape(-1, 2)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, x in zip(rows, (key, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, spans.astype(np.int64).tobytes()), strict=True):
                rows[column].append(x)
        release()
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | ({"kept": pa.binary(), "removed": pa.binary()} if with_text else {})
        return pa.table({c: pa.array(rows[c], k) for c, k in kinds.items()} | {f"c{k}": texts[f"c{k}"] for k in range(carry)})

    return work


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    ``with_text`` adds kept (bytes) and removed (pairs of int64: start, stop);
    the columns named in ``carry`` come along as c0, c1, ...
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards, buckets = max(LEAST_SHARDS, total // SHARD_BYTES), max(LEAST_BUCKETS, total // BUCKET_BYTES)
    table = _laid_out(docs, doc_id, text, shards, list(carry))
    texts = table.select("doc_id", "text", "shard")
    digests = table.where("doc_id IS NOT NULL").select("doc_id", "shard", F.sha2("text", 256).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    copies = stored(digests.join(least, "digest").where("doc_id > least").select("shard", F.col("doc_id").alias("copy"), "digest"), "copies")
    shared = stored(_sent(texts, buckets).groupBy("bucket").applyInArrow(_shared_hashes, "shard int, hashes binary"), "anchors")
    told = shared.unionByName(copies, allowMissingColumns=True)
    cut = texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_segments(buckets), "bucket int, shard int, docs binary, firsts binary, strings binary, grams binary, segments binary")
    found = stored(cut.groupBy("bucket").applyInArrow(_search, "shard int, docs binary, firsts binary, masks binary"), "strings")
    told = found.unionByName(copies, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed binary" * with_text
    schema += "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return table.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_taken_out(with_text, len(carry)), schema)


def remove_from_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that stays; characters that lose some of their bytes go whole."""
    carry = [c for c in docs.columns if c != text]
    found = remove(docs, doc_id, text, with_text=True, carry=carry)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["kept", *batch.schema.names[1:]])

    names = [f"c{k}" for k in range(len(carry))]
    kept = found.select("kept", *names)
    kinds = ", ".join(["kept string", *[f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True)]])
    out = kept.mapInArrow(decoded, kinds)
    return out.select(*[F.col("kept" if c == text else names[carry.index(c)]).alias(c) for c in docs.columns])
