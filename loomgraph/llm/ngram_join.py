"""N-gram Jaccard self-join with Bayesian candidate pruning.

A text's set holds the 64-bit hashes of its shingles of five words (of all its
words, if it has fewer).  Texts with equal sets are one class from the start.

Candidates share a band of five MinHash bytes out of 32 bands, so a pair at
the threshold is missed with probability (1 - 0.8^5)^32 < 4e-6.  Signatures
are compared 32 bytes at a time; with a uniform prior the share of equal bytes
has a Beta posterior, and a pair is dropped once the posterior probability
that it reaches the threshold is under ``TOLERANCE``.  The rest is verified
exactly on the sets.

No pairs are listed.  In each band the members are first compared with the
band's smallest member; what that leaves apart is compared in bounded tiles;
the survivors form clusters, and all pairs in a cluster are verified tile by
tile by a product of incidence matrices that only counts links.

Edge cases: texts without a word link with nothing, and neither do rows with a
null doc_id.  Rows are compared by their texts, so rows that share a doc_id may
be in different classes; repeated rows are copies of each other.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import CHUNK, LINK_SCHEMA, by_group, components, count_links, tiles
from .shared import blocks, plain, stored
from .words import mixed, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_BYTES, STEP = 32, 5, 32
TOLERANCE = 1e-6


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, n, dtype=np.uint32)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingles of all texts in turn, and the n + 1 offsets."""
    text, word = word_hashes(texts)
    n = len(texts)
    count = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    of, shingle = text[: 0], word[:0]
    if len(word) >= words:
        shingle = np.zeros(len(word) - words + 1, np.uint64)
        for k in range(words):
            shingle = mixed(shingle * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(shingle)])
        inside = text[words - 1 :] == text[: len(shingle)]
        of, shingle = text[: len(shingle)][inside], shingle[inside]
    short = np.flatnonzero((count > 0) & (count < words))
    few = np.array([int.from_bytes(blake2b(word[first[i] : first[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
    of, shingle = np.concatenate([of, short]), np.concatenate([shingle, few])
    order = np.lexsort((shingle, of))
    of, shingle = of[order], shingle[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.searchsorted(of[new], np.arange(n + 1))


def signatures(sets: np.ndarray, offsets: np.ndarray, size: int = BANDS * BAND_BYTES) -> np.ndarray:
    """One byte of each MinHash; rows of empty sets are zero."""
    n = len(offsets) - 1
    out = np.zeros((n, size), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    base, starts = (sets >> np.uint64(32)).astype(np.uint32), offsets[full]
    flips, factors = _constants(size, 11), _constants(size, 12) | np.uint32(1)
    for k in range(size):
        least = np.minimum.reduceat((base ^ flips[k]) * factors[k], starts)
        out[full, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, size: int = BANDS * BAND_BYTES, step: int = STEP) -> list[int]:
    """After each step, the matches under which a pair is dropped.

    Bytes of different MinHashes are equal once in 256, so similarity s means
    that bytes are equal with probability p = s + (1 - s) / 256.  With m of n
    equal, P(p >= q) is that of at most m successes in n + 1 trials of chance q.
    """
    q = threshold + (1 - threshold) / 256
    out = []
    for n in range(step, size + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * q**m * (1 - q) ** (n + 1 - m)
        out.append(m)
    return out


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive the pruning."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _tag(text: str) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, a hash of the text, the digest of the set, its size and its signature; digest is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            sets, offsets = shingle_sets(batch.column("text"))
            signs = signatures(sets, offsets)
            sizes = np.diff(offsets)
            digests = [blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array([s.tobytes() for s in signs], pa.binary())], ["doc_id", "tag", "digest", "size", "sign"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _tag(text).alias("tag"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, tag long, digest binary, size int, sign binary")


def _pruned(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = BANDS * BAND_BYTES
        for batch in batches:
            if batch.num_rows:
                on = likely(_matrix(batch.column("sign_a"), width), _matrix(batch.column("sign_b"), width))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(on)) for c in ("a", "b")], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _probe(table: pa.Table) -> pa.RecordBatch | None:
    """Links of a tile between members of different clusters, one for each member and cluster."""
    ids, root = table["member"].to_numpy(), table["root"].to_numpy()
    probe = table["probe"].to_numpy()
    signs = _matrix(table["sign"], BANDS * BAND_BYTES)
    a, b = [], []
    for k in np.flatnonzero(probe):
        others = np.flatnonzero(root != root[k])
        hit = others[likely(np.broadcast_to(signs[k], (len(others), signs.shape[1])), signs[others])]
        hit = hit[np.unique(root[hit], return_index=True)[1]]
        a += [ids[k]] * len(hit)
        b += ids[hit].tolist()
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """node, root over members that survive the pruning with another one; ``classes`` has member and sign."""
    keys = classes.select("member", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.substring("sign", k * BAND_BYTES + 1, F.lit(BAND_BYTES)).alias("key")))).alias("k")).select("member", "k.band", "k.key")
    full = stored(keys.groupBy("band", "key").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    rows = stored(keys.join(full, ["band", "key"]), "banded")
    pairs = rows.where("member <> least").select(F.col("least").alias("a"), F.col("member").alias("b")).distinct()
    sign_a, sign_b = (classes.select(F.col("member").alias(c), F.col("sign").alias(f"sign_{c}")) for c in "ab")
    near = stored(_pruned(pairs.join(sign_b, "b").join(sign_a, "a")), "near")
    roots = stored(components(near), "roots")
    # Bands that still hold more than one cluster: members outside the least member's cluster meet all others, in chunks.
    labelled = rows.join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    of_least = roots.select(F.col("node").alias("least"), F.col("root").alias("least_root"))
    labelled = labelled.join(of_least, "least", "left").withColumn("probe", F.col("root") != F.coalesce("least_root", "least"))
    mixed_bands = labelled.where("probe").groupBy("band", "key").agg(F.count(F.lit(1)).alias("probes"))
    open_rows = labelled.join(mixed_bands, ["band", "key"]).where("probe or probes > 0")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    open_rows = open_rows.withColumn("own", F.pmod(F.xxhash64("member"), chunks).cast("int")).withColumn("chunk", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array("own"))))
    tiled = open_rows.join(classes.select("member", "sign"), "member").select("band", "key", "chunk", "member", "root", "probe", "sign")
    more = stored(by_group(tiled.withColumn("group", F.xxhash64("band", "key", "chunk")), ["group", "band", "chunk"], _probe, "a long, b long"), "more")
    if more.isEmpty():
        return roots
    return components(near.unionByName(more))


def _verify(table: pa.Table) -> pa.RecordBatch | None:
    """Exact links of a tile by a product of incidence matrices, a block of shingles at a time."""
    ids, copies, side = (table[c].to_numpy() for c in ("member", "copies", "side"))
    within = table["low"][0] == table["high"][0]
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = uses[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        shared += has @ has.T
    shared = shared.astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - shared
    # J >= 4/5 in integers
    return count_links(side, within, shared * 5 >= either * 4, ids, copies)


def _linked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tag, class_id and n_links for each row."""
    signs = stored(signed(docs, doc_id, text), "signs")
    usable = signs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # A class has a number of its own, as rows of different classes may share a doc_id.
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sign").alias("sign"))
    classes = stored(classes.withColumn("member", F.monotonically_increasing_id()), "classes")
    clusters = stored(candidate_clusters(classes.select("member", "sign")).withColumnRenamed("node", "member"), "clusters")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            sets, offsets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("member"), pa.array([sets[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], ["member", "shingles"])

    wanted = clusters.join(classes.select("member", "first"), "member").select("member", "first.doc_id", "first.tag")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _tag(text).alias("tag"), F.col(text).alias("text")).join(wanted, ["doc_id", "tag"]).select("member", "text")
    sets = stored(texts.mapInArrow(shingled, "member long, shingles binary").dropDuplicates(["member"]), "members")
    members = clusters.withColumnRenamed("root", "cluster").join(classes.select("member", "copies"), "member")
    cut = tiles(members, "cluster", "member").join(sets, "member").select("cluster", "low", "high", "side", "member", "copies", "shingles")
    linked = stored(by_group(cut, ["cluster", "low", "high"], _verify, LINK_SCHEMA), "links")
    roots = components(linked.select(F.col("member").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    counts = linked.groupBy("member").agg(F.sum("links").alias("links"))
    known = classes.select("digest", "member", "copies", F.col("first.doc_id").alias("least")).join(roots, "member", "left").join(counts, "member", "left")
    known = stored(known.select("digest", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    smallest = known.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(smallest, "root", "left").select("digest", F.coalesce("class_id", "least").alias("class_id"), "n_links")
    rows = signs.select("doc_id", "tag", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    return rows.select("doc_id", "tag", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id reached by links), n_links (other documents linked) for each row."""
    return _linked(docs, doc_id, text).drop("tag")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that of the smallest doc_id; repeated rows of it count once."""
    rows, names = plain(docs)
    kept = _linked(rows, names[doc_id], names[text]).where("doc_id = class_id OR doc_id IS NULL").select(F.col("doc_id").alias("_kept"), F.col("tag").alias("_tag")).distinct()
    left = rows.join(kept, F.col(names[doc_id]).cast("long").eqNullSafe(F.col("_kept")) & (_tag(names[text]) == F.col("_tag")), "left_semi")
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
