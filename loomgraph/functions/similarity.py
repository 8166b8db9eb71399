"""Jaro-Winkler similarity (F33, F34, M09), batch by batch over Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import to_latin


def jaro_winkler_pair(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters; 0 if a string is empty."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, unused in zip(b, free, strict=True) if not unused]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def codes_of(texts: list[str], width: int) -> np.ndarray:
    """Code points by row, zeros behind; no text holds more than ``width``."""
    rows = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32)
    return rows.reshape(len(texts), width)


def _batch(a: list[str], b: list[str]) -> np.ndarray:
    """Similarities of pairs of texts that are not empty."""
    n, m = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    return jaro_winkler_codes(codes_of(a, int(n.max())), n, codes_of(b, int(m.max())), m)


def jaro_winkler_codes(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of texts given as rows of code points, n and m of which count in each row; none may be empty."""
    # All rows at once, a step for each character of the first texts.
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    place = np.arange(y.shape[1])
    free = place < m[:, None]
    left = np.zeros(x.shape, bool)
    row = np.arange(len(x))
    for i in range(x.shape[1]):
        hit = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None])
        first = hit.argmax(1)
        found = hit[row, first] & (i < n)
        left[:, i] = found
        free[row[found], first[found]] = False
    right = (place < m[:, None]) & ~free
    count = left.sum(1)
    most = int(count.max(initial=0))
    # The matched characters of both sides in order, then the rest.
    one = np.take_along_axis(x, np.argsort(~left, 1, kind="stable"), 1)[:, :most]
    two = np.take_along_axis(y, np.argsort(~right, 1, kind="stable"), 1)[:, :most]
    moved = ((one != two) & (np.arange(most) < count[:, None])).sum(1) // 2
    some = np.maximum(count, 1)
    jaro = np.where(count > 0, (count / n + count / m + (count - moved) / some) / 3, 0.0)
    wide = min(4, x.shape[1], y.shape[1])
    same = (x[:, :wide] == y[:, :wide]) & (np.arange(wide) < np.minimum(n, m)[:, None])
    prefix = np.minimum.accumulate(same, axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


def jaro_winkler_batch(a: list[str | None], b: list[str | None], cells: int = 1 << 20) -> np.ndarray:
    """Similarity of each pair, as ``jaro_winkler_pair`` gives it; null makes it not a number."""
    out = np.full(len(a), np.nan)
    known = [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
    out[known] = 0.0
    full = sorted((k for k in known if a[k] and b[k]), key=lambda k: max(len(a[k]), len(b[k])))
    at = 0
    while at < len(full):  # pairs of like lengths, so many that their characters fill ``cells``
        to = at + 1
        while to < len(full) and (to - at + 1) * max(len(a[full[to]]), len(b[full[to]])) <= cells:
            to += 1
        part = full[at:to]
        out[part] = _batch([a[k] for k in part], [b[k] for k in part])
        at = to
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    found = jaro_winkler_batch(a.tolist(), b.tolist())
    return pd.Series(found).astype(object).where(~np.isnan(found), None).astype("float64")


def string_similarity(a: Column, b: Column) -> Column:
    return jaro_winkler(F.lower(a), F.lower(b))


def phonetic_similarity(a: Column, b: Column) -> Column:
    return jaro_winkler(to_latin(F.lower(a)), to_latin(F.lower(b)))
