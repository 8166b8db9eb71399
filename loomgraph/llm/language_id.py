"""Language identification by prediction by partial matching (PPM).

For each language a context tree of variable order counts which byte follows
which context.  Escape method C without exclusions: in a context seen ``n``
times with ``d`` different followers, a follower seen ``c`` times costs
``-log2(c / (n + d))`` bits, and any other byte costs ``-log2(d / (n + d))``
bits plus its cost in the context shortened by one byte; below the empty
context a byte costs 8 bits.  Statistics are frozen after learning, so the
cost of a byte in its context is a constant, and all constants of all
languages lie in one table that is looked up for whole blocks of text.

Learning reads a sample of each language (drawn by a hash of doc_id) of at most
``train_bytes`` bytes on average.  The table has a cost for every gram and
language, so with L languages a sample also has at most ``MODEL_CELLS / L**2``
bytes; no language is left out.  Scoring reads every byte of every text, in
slices that overlap by the order.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text if no language could be learned.  Null languages are not
learned.  Repeated rows are scored alike.  Ties go to the language first by
name.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks

ORDER = 4
TRAIN_BYTES, MODEL_CELLS = 1_000_000, 100_000_000
SLICE = 1 << 20
UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _folded() -> np.ndarray:
    """Byte to byte: digits count as one symbol, and so do white space and control bytes."""
    to = np.arange(256, dtype=np.uint8)
    to[:33] = 32
    to[48:58] = 48
    return to


_FOLDED = _folded()


def prepare(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case folded bytes with ``order`` blanks before each text, and the place of each text's first blank."""
    pad = b" " * order
    parts = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_binary()).to_pylist()
    data = _FOLDED[np.frombuffer(pad + pad.join(parts), np.uint8)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + order
    return data, np.concatenate([[0], np.cumsum(sizes)])


def grams(data: np.ndarray, order: int, top: int) -> np.ndarray:
    """Key of the ``order + 1`` bytes that end at each position from ``top`` on; the last byte is the lowest."""
    n = len(data) - top
    key = data[top:].astype(np.uint64)
    for k in range(1, order + 1):
        key |= data[top - k : top - k + n].astype(np.uint64) << np.uint64(8 * k)
    return key


@dataclass
class Table:
    """Open-addressing table from keys to row numbers, looked up for many keys at once."""

    slots: np.ndarray
    rows: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        slots, rows = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, -1, np.int32)
        shift, waiting = 64 - bits, np.arange(len(keys))
        at = ((keys * _MULTIPLIER) >> np.uint64(shift)).astype(np.int64)
        while len(waiting):
            free = rows[at[waiting]] < 0
            first = waiting[free][np.unique(at[waiting[free]], return_index=True)[1]]
            slots[at[first]], rows[at[first]] = keys[first], first
            waiting = waiting[rows[at[waiting]] != waiting]
            at[waiting] = (at[waiting] + 1) & ((1 << bits) - 1)
        return cls(slots, rows, shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number, -1 for an absent key."""
        at = ((keys * _MULTIPLIER) >> np.uint64(self.shift)).astype(np.int64)
        found = np.where(self.slots[at] == keys, self.rows[at], -1)
        open_ = np.flatnonzero((found < 0) & (self.rows[at] >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.rows) - 1)
            row = self.rows[at]
            hit = (row >= 0) & (self.slots[at] == keys[open_])
            found[open_[hit]] = row[hit]
            on = (row >= 0) & ~hit
            open_, at = open_[on], at[on]
        return found


class Model:
    """Frozen costs in bits: by gram and by context, one row for each, one column for each language."""

    def __init__(self, languages: list[str], order: int):
        self.languages, self.order = languages, order
        self.keys: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self._tables: list[tuple[Table, Table]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    @classmethod
    def learn(cls, samples: Mapping[str, list[str]], order: int = ORDER) -> Model:
        model = cls(sorted(samples), order)
        data = [prepare(pa.array(samples[x], pa.string()), order)[0] for x in model.languages]
        lower: np.ndarray | None = None
        for k in range(order + 1):
            counted = []
            for x in data:
                counted.append(np.unique(grams(x, k, order), return_counts=True))
            keys = np.unique(np.concatenate([c[0] for c in counted]))
            contexts = np.unique(keys >> np.uint64(8))
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            costs, escapes = np.zeros((len(keys), len(data))), np.zeros((len(contexts), len(data)))
            for column, (own, counts) in enumerate(counted):
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, own)] = counts
                n, d = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
                seen = n > 0
                escapes[seen, column] = np.log2((n[seen] + d[seen]) / d[seen])
                below = 8.0 if lower is None else lower[np.searchsorted(model.keys[-1], keys & np.uint64((1 << (8 * k)) - 1)), column]
                with np.errstate(divide="ignore", invalid="ignore"):
                    costs[:, column] = np.where(c > 0, np.log2((n + d)[of] / c), escapes[of, column] + below)
            lower = costs
            model.keys.append(keys)
            model.costs.append(costs.astype(np.float32))
            model.contexts.append(contexts)
            model.escapes.append(escapes.astype(np.float32))
        return model

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text under each language."""
        if self._tables is None:
            self._tables = [(Table.of(k), Table.of(c)) for k, c in zip(self.keys, self.contexts, strict=True)]
            self._columns = [np.ascontiguousarray(np.vstack([x, np.zeros((1, x.shape[1]), np.float32)]).T) for x in self.costs]
        top = self.order
        data, starts = prepare(texts, top)
        out = np.zeros((len(texts), len(self.languages)))
        # A text's bytes stand from its first blank + order on.
        begin, end = starts[:-1] + top, starts[1:]
        for at in range(top, len(data), SLICE):
            part = data[at - top : at + SLICE]
            own = slice(np.searchsorted(end, at, "right"), np.searchsorted(begin, at + SLICE))
            low, high = (np.clip(x[own] - at, 0, len(part) - top) for x in (begin, end))
            for column, costs in enumerate(self._costs(part)):
                sums = np.concatenate([[0.0], np.cumsum(costs, dtype=np.float64)])
                out[own, column] += sums[high] - sums[low]
        return out

    def _costs(self, data: np.ndarray) -> list[np.ndarray]:
        """By language, the cost of each byte behind the first ``order`` ones."""
        top = self.order
        key = grams(data, top, top)
        row = self._tables[top][0].find(key)
        per = [x[row] for x in self._columns[top]]  # row -1 is the last, of zeros
        todo = np.flatnonzero(row < 0)
        for k in range(top, -1, -1):
            if not len(todo):
                break
            context = self._tables[k][1].find((key[todo] & np.uint64((1 << (8 * (k + 1))) - 1)) >> np.uint64(8))
            known = context >= 0
            for x, column in zip(per, range(len(self.languages)), strict=True):
                x[todo[known]] += self.escapes[k][context[known], column]
            if not k:
                for x in per:
                    x[todo] += 8
                break
            found = self._tables[k - 1][0].find(key[todo] & np.uint64((1 << (8 * k)) - 1))
            hit = found >= 0
            for x, column in zip(per, self._columns[k - 1], strict=True):
                x[todo[hit]] += column[found[hit]]
            todo = todo[~hit]
        return per


def learn(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES, order: int = ORDER) -> Model:
    """Fit on a sample of the rows for which ``usable`` holds.

    A language's sample has about ``train_bytes``, or less where there are many
    languages, and always holds one document at least: where chance draws none,
    that with the smallest hash, cut to as many characters.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = rows.groupBy("l").agg(F.sum(F.octet_length("t")).alias("n"))
    count = sizes.count()
    if not count:
        return Model([], order)
    wanted = min(train_bytes, MODEL_CELLS // count**2)
    draw = F.shiftrightunsigned(F.xxhash64(F.col("i").cast("string"), F.lit("language")), 11) / F.lit(float(1 << 53))
    sampled = rows.join(F.broadcast(sizes), "l").where(draw * F.col("n") < wanted)
    samples: dict[str, list[str]] = {}
    for r in sorted(sampled.select("l", "t").collect()):  # train_bytes for each language on average
        samples.setdefault(r["l"], []).append(r["t"])
    if len(samples) < count:
        first = rows.where(~F.col("l").isin(list(samples))).groupBy("l").agg(F.min_by(F.substring("t", 1, max(wanted, 1)), F.struct(draw.alias("d"), F.col("i").cast("string").alias("i"))).alias("t"))
        samples |= {r["l"]: [r["t"]] for r in first.collect()}  # a text for each language left
        samples = dict(sorted(samples.items()))
    return Model.learn(samples, order)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for each row.

    ``score`` is the share of the best language if all are as likely before
    the text is read: two to the power of minus its code length, over the sum.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in blocks(batches, "text", 1 << 20):
            texts = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(texts)
            best, score, per_byte = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n)
            if model.languages:
                bits = model.bits(texts)
                best = np.where(lettered, bits.argmin(1), best)
                over = bits - bits.min(1, keepdims=True)
                score = np.where(lettered, 1 / np.exp2(-np.minimum(over, 1000)).sum(1), 0.0)
                size = np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1)
                per_byte = np.where(lettered, bits.min(1) / size, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(per_byte)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(read, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
