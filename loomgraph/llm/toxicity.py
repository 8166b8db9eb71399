"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hash buckets of its lower-case words, word
pairs, word triples, and pairs with one word left out.  Words are runs of ASCII
letters, digits and bytes above 7F.  Learning visits a bounded sample of
labelled texts one by one with a rate for each coordinate; the L1 term leaves
few weights other than zero, and these are broadcast.  Of each class a sample
of at most ``sample_docs`` texts and ``sample_bytes`` bytes on average is drawn
by a hash of doc_id.  Classes are sampled apart, and the bias takes back what
that does to their ratio, so scores mean the same at every size.

Edge cases: a null or empty text has no feature, and its score is that of the
bias.  With no usable label, or one class only, the score is the class's share
(0 without any label).  Labels that disagree about a document count as toxic.
Repeated rows are scored alike; rows that share a doc_id and differ are scored
by their own texts and learned from each under the doc_id's label.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks
from .words import mixed, word_hashes

BITS = 20
SAMPLE_DOCS, SAMPLE_BYTES = 8_000, 32 << 20  # of each class
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word, pair, triple and skip-pair; repeats stay."""
    text, word = word_hashes(texts)
    shift = np.uint64(64 - bits)
    of, buckets = [text], [(word * _SEEDS[0]) >> shift]
    for seed, gap in ((1, 1), (2, 2)):  # a pair, and one with a word left out
        same = text[gap:] == text[:-gap]
        pair = mixed(word[:-gap] * _SEEDS[seed] + word[gap:])
        of.append(text[gap:][same])
        buckets.append(pair[same] >> shift)
    same = text[2:] == text[:-2]
    of.append(text[2:][same])
    buckets.append(mixed(mixed(word[:-2] * _SEEDS[3] + word[1:-1]) + word[2:])[same] >> shift)
    return np.concatenate(of), np.concatenate(buckets).astype(np.int64)


@dataclass
class Weights:
    """The weights that are not zero."""

    bias: float = -1000.0
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.buckets] = self.values
        return out


def fit(texts: list[str | None], labels: list[int], bits: int = BITS, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.02, rounds: int = 6, seed: int = 7) -> Weights:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Weights(bits=bits) if not len(y) or not y[0] else Weights(1000.0, bits=bits)
    rows: list[np.ndarray] = []
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        of, buckets = features(pa.array(part, pa.string()), bits)
        both = np.unique((of << bits) | buckets)
        rows += np.split((both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both >> bits, np.arange(1, len(part))))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    bias_n = 1.0
    order = np.arange(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        for k in order.tolist():
            at = rows[k]
            zk, nk = z[at], n[at]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) > l1, (np.sign(zk) * l1 - zk) / ((beta + root) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y[k]
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
            z[at] = zk + g - (np.sqrt(nk + g * g) - root) / alpha * w
            n[at] = nk + g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return Weights(bias, kept, (np.sign(z[kept]) * l1 - z[kept]) / ((beta + np.sqrt(n[kept])) / alpha + l2), bits)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Weights:
    """Fit on a sample of the labelled documents of each class for which ``usable`` (over doc_id) holds."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y")).where(usable)
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.col(text)).alias("size")).where("size IS NOT NULL")
    counts = sizes.join(known, "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    shares = {r["y"]: min(1.0, sample_docs / r["n"], sample_bytes / max(1, r["bytes"])) for r in counts}
    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    draw = (F.pmod(hashed, F.lit(1_000_000)) + F.pmod(F.shiftright(hashed, 24), F.lit(1 << 20)) / float(1 << 20)) / 1e6
    wanted = F.lit(False)
    for y, share in shares.items():
        wanted |= (F.col("y") == y) & (draw < share)
    sample = F.broadcast(known.where(wanted))  # two classes of sample_docs
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t IS NOT NULL")
    rows = sorted((r["doc_id"], r["y"], r["t"]) for r in texts.join(sample, "doc_id").collect())
    weights = fit([r[2] for r in rows], [r[1] for r in rows])
    if len({r[1] for r in rows}) == 2:
        weights.bias -= float(np.log(shares[1] / shares[0]))
    return weights


def score(docs: DataFrame, weights: Weights, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        dense = weights.dense()
        for batch in blocks(batches, "text", 1 << 20):
            of, buckets = features(batch.column("text"), weights.bits)
            told = dense[buckets] != 0
            both = np.unique((of[told] << weights.bits) | buckets[told])
            sums = np.bincount(both >> weights.bits, dense[both & ((1 << weights.bits) - 1)], batch.num_rows) + weights.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(read, f"doc_id {kind}, score double")
