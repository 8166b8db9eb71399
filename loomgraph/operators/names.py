"""Join of names by Jaro-Winkler similarity, tile by tile.

Texts of lengths s and l with a common prefix of p characters (4 at most) reach
the similarity t only if their Jaro similarity reaches j = (t - 0.1 p) / (1 - 0.1 p),
and 0.7 if p > 0; so m matching characters fulfil m / s + m / l >= 3 j - 1.  That
bounds the lengths that can meet, and from below how many characters, each with
the number of its occurrence, both texts have in common.

Names are dealt into blocks of one length.  Two blocks whose lengths can meet
are a tile: one matrix product counts what each pair has in common, pairs that
reach the bound for their prefix are scored, all at once, and only those that
are alike become rows.  A task holds one tile; a frequent prefix or character
makes none larger.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import codes_of, jaro_winkler_codes
from ..session import written

BLOCK = 2048
_COLUMNS = 1024
_CELLS = 1 << 21
_EPSILON = 1e-9


def least_matches(least: float, prefix: int, a: int, b: int) -> int:
    """How many characters of texts of lengths a and b must match, given their common prefix (4 stands for more)."""
    own = (least - _EPSILON - 0.1 * prefix) / (1 - 0.1 * prefix)
    return math.ceil((3 * (max(own, 0.7) if prefix else own) - 1) * a * b / (a + b) - _EPSILON)


def can_meet(least: float, a: int, b: int) -> bool:
    return any(least_matches(least, p, a, b) <= min(a, b) for p in range(min(4, a, b) + 1))


def _occurrences(codes: np.ndarray) -> np.ndarray:
    """For each character how often it stands before in its row."""
    order = np.argsort(codes, 1, kind="stable")
    ordered = np.take_along_axis(codes, order, 1)
    place = np.broadcast_to(np.arange(codes.shape[1]), codes.shape)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    run = place - np.maximum.accumulate(np.where(new, place, 0), 1)
    out = np.empty(codes.shape, np.int64)
    np.put_along_axis(out, order, run, 1)
    return out


def in_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Characters in common of all pairs of rows."""
    marks = [c.astype(np.int64) * (1 << 20) + _occurrences(c) for c in (x, y)]
    shared = np.intersect1d(*marks)
    total = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, len(shared), _COLUMNS):
        part = shared[at : at + _COLUMNS]
        sides = []
        for m in marks:
            side = np.zeros((len(m), len(part)), np.float32)
            where = np.minimum(np.searchsorted(part, m), len(part) - 1)
            row, column = np.nonzero(part[where] == m)
            side[row, where[row, column]] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def bounded(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y that have enough characters in common; all of x have one length, and all of y."""
    n, m = x.shape[1], y.shape[1]
    prefix = np.zeros((len(x), len(y)), np.int8)
    equal = np.ones((len(x), len(y)), bool)
    for k in range(min(4, n, m)):
        equal &= x[:, k, None] == y[None, :, k]
        prefix += equal
    need = np.array([least_matches(least, p, n, m) for p in range(5)], np.float32)
    return np.nonzero(in_common(x, y) >= need[prefix])


def _tile(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.column("name").combine_chunks() for t in (left, right))
        found = [pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})]
        if len(a) and len(b):
            texts = [t.to_pylist() for t in (a, b)]
            x, y = (codes_of(t, len(t[0])) for t in texts)
            i, j = bounded(x, y, least)
            step = max(1, _CELLS // max(x.shape[1], y.shape[1]))
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                score = jaro_winkler_codes(x[p], np.full(len(p), x.shape[1]), y[q], np.full(len(p), y.shape[1]))
                kept = score >= least - _EPSILON  # a sum of thirds
                found.append(pa.table({"a": a.take(pa.array(p[kept])), "b": b.take(pa.array(q[kept])), "similarity": pa.array(score[kept])}))
        return pa.concat_tables(found)

    return run


def alike(left: DataFrame, right: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """a, b, similarity for texts ``a`` of left and ``b`` of right whose Jaro-Winkler similarity is ``least`` (over 0.7) or more.

    Null and empty texts are like none; equal texts have similarity 1.
    """
    if not 0.7 < least <= 1:
        raise ValueError("similarity must be over 0.7")
    sides, blocks = [], []
    for df, name in ((left, "a"), (right, "b")):
        names = written(df.select(F.col(name).cast("string").alias("name")).where("name <> ''").distinct().withColumn("n", F.char_length("name")), "names")
        counts = names.groupBy("n").count().collect()  # a row for each length
        parts = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["n"], -(-r["count"] // block))]), F.col("n")) if counts else F.lit(1)
        sides.append(names.withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")))
        blocks.append([(r["n"], -(-r["count"] // block)) for r in counts])
    pairs = [(n, m, p, q) for n, p in blocks[0] for m, q in blocks[1] if can_meet(least, n, m)]
    lengths = left.sparkSession.createDataFrame(pairs, "na int, nb int, pa int, pb int")  # by length, so it does not grow with the names
    tiles = lengths.select("na", "nb", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("xa"), "pb").select("na", "nb", "xa", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("xb"))
    key = ["na", "nb", "xa", "xb"]
    a, b = (side.select("name", F.col("n").alias(f"n{c}"), F.col("part").alias(f"x{c}")).join(tiles, [f"n{c}", f"x{c}"]).groupBy(*key) for side, c in zip(sides, "ab", strict=True))
    return a.cogroup(b).applyInArrow(_tile(least), "a string, b string, similarity double")
