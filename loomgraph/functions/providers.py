"""Interfaces to outside models and their offline stand-ins.

The stand-ins are deterministic; their results are not those of real models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import words


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Unit vector of word counts by hash; a text without words gives the zero vector."""
    buckets = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(buckets, lambda b: b == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)) + 1e-10
    return F.transform(counts, lambda x: (x / norm).cast("float"))


def letter_embedding(text: Column) -> Column:
    """Counts of the 26 Latin letters; cheap enough to compare the sentences of whole texts."""
    low = F.lower(text)
    return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: F.regexp_count(low, F.char(c)).cast("double"))


def _letters(texts: pa.Array) -> np.ndarray:
    """Counts of the bytes a to z by text."""
    size = pc.binary_length(texts.cast(pa.string()).fill_null("")).to_numpy(zero_copy_only=False)
    data = np.frombuffer("".join(texts.fill_null("").to_pylist()).encode(), np.uint8)
    at = np.flatnonzero((data >= 97) & (data <= 122))
    return np.bincount(np.repeat(np.arange(len(size)), size)[at] * 26 + data[at] - 97, minlength=26 * len(size)).astype(np.float64, copy=False).reshape(-1, 26)


@F.arrow_udf(ArrayType(DoubleType()))
def letter_similarities(texts: pa.Array) -> pa.Array:
    """Of lists of lower-case texts: the cosine of the letters of each but the first to those of the one before, 0 without letters."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = texts.flatten()
    value = np.zeros(len(flat))
    for low in range(1, len(flat), 1 << 16):
        v = _letters(flat.slice(low - 1, (1 << 16) + 1))
        norm = np.sqrt((v[:-1] * v[:-1]).sum(1) * (v[1:] * v[1:]).sum(1))
        value[low : low + len(norm)] = (v[:-1] * v[1:]).sum(1) / np.where(norm > 0, norm, 1)
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    ends = np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value[~first]))


def same_score(query: Column, text: Column, score: Column) -> Column:
    """Cross-encoder stand-in: the score stays."""
    return score


def call_model(rows: DataFrame, generate: Callable[[list[str]], list[str]], prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """Batches of prompts through ``generate`` (which must be picklable); a batch that keeps failing gives nulls."""
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list[str | None] = [None] * len(frame)
            for _ in range(retries + 1):
                try:
                    answers = list(generate(frame[prompt].tolist()))
                    break
                except OSError:
                    continue
            yield frame.assign(answer=answers)

    return rows.mapInPandas(run, f"{schema}, answer string")
