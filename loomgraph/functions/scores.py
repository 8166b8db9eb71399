"""Scalar formulas of retrieval, memory and evaluation as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_WEIGHTS = {"document": 1.0, "table": 0.95, "list": 0.9, "fact": 0.85, "summary": 0.8, "enriched": 0.75}
DEFAULT_SOURCE_WEIGHT = 0.7
ANSWER_WEIGHTS = {  # source match, key information, relevance, no contradiction
    "url_only": (0.50, 0.10, 0.30, 0.10),
    "short": (0.20, 0.40, 0.25, 0.15),
    "short_no_url": (0.00, 0.50, 0.30, 0.20),
    "full": (0.10, 0.40, 0.30, 0.20),
    "full_no_url": (0.00, 0.45, 0.35, 0.20),
    "empty": (0.00, 0.00, 0.70, 0.30),
}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or different lengths."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm))


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def hours_since(at: Column, now: Column) -> Column:
    return F.coalesce((_micros(now) - _micros(at)) / 3.6e9, F.lit(1000.0))


def recency(at: Column, now: Column) -> Column:
    return F.pow(F.lit(0.995), hours_since(at, now))


def base_score(recent: Column, importance: Column, fused: Column, relevance: Column | None = None) -> Column:
    """Mix of recency, importance and fused rank; with an embedding, of relevance too (0.5 if unknown)."""
    if relevance is None:
        return 0.2 * recent + 0.3 * importance / 10 + 0.5 * fused * 10
    return 0.2 * recent + 0.2 * importance / 10 + 0.3 * F.coalesce(relevance, F.lit(0.5)) + 0.3 * fused * 10


def source_weight(kind: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, F.lower(kind)), F.lit(DEFAULT_SOURCE_WEIGHT))


def weigh_source(score: Column, kind: Column, share: float = 0.2) -> Column:
    return score * (1 - share) + score * source_weight(kind) * share


def combined_similarity(meaning: Column, sound: Column, spelling: Column) -> Column:
    return 0.5 * meaning + 0.25 * sound + 0.25 * spelling


def match_confidence(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "high").when(similarity >= 0.80, "medium").when(similarity >= 0.60, "low").otherwise("none")


def base_level(history: Column, now: Column, decay: float = 0.5) -> Column:
    """ln of the sum of ages in seconds to the power of minus ``decay``; minus infinity without an access."""
    ages = F.transform(history, lambda t: F.pow(F.greatest((_micros(now) - _micros(t)) / 1e6, F.lit(1.0)), F.lit(-decay)))
    total = F.aggregate(ages, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.ln(total)).otherwise(F.lit(float("-inf")))


def synthetic_history(created: Column, last: Column, count: Column) -> Column:
    """``count`` accesses spread evenly from ``created``; the last access itself is not among them."""
    span = _micros(last) - _micros(created)
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda i: F.timestamp_micros((_micros(created) + F.floor(span * i / count)).cast("bigint")))


def retrieval_probability(level: Column, threshold: float = -2.0, noise: float = 0.4) -> Column:
    x = F.least(F.greatest((F.lit(threshold) - level) / noise, F.lit(-100.0)), F.lit(100.0))
    return F.when(level == float("-inf"), 0.0).otherwise(1 / (1 + F.exp(x)))


def status_of(level: Column, deprioritize: float = -1.0, archive: float = -2.5) -> Column:
    return F.when(level < archive, "archived").when(level < deprioritize, "deprioritized").otherwise("active")


def shared_memory_score(links: Column, asked: Column, importance: Column) -> Column:
    return (links / asked * 0.6 + importance / 10 * 0.4) * (1 + (links - 1) * 0.5)


def path_memory_score(overlap: Column, importance: Column) -> Column:
    return importance / 10 * F.when(overlap > 0, 1 + (overlap - 1) * 0.3).otherwise(0.5) * 0.7


def success_rate(success: Column, failure: Column) -> Column:
    return F.coalesce(F.try_divide(success, success + failure), F.lit(0.0))


def answer_type(answer: Column, url: Column) -> Column:
    """empty, url_only, or short/full, with _no_url where no source is named."""
    text, link = F.trim(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(url, F.lit("")))
    short = (F.char_length(text) < 50) | (F.size(F.array_remove(F.split(text, r"\s+"), "")) < 5)
    kind = F.when(short, "short").otherwise("full")
    return F.when((text == "") & (link == ""), "empty").when(text == "", "url_only").when(link == "", F.concat(kind, F.lit("_no_url"))).otherwise(kind)


def overall(kind: Column, parts: Sequence[Column]) -> Column:
    """Weighted sum of the four judged parts by answer type, within 0 and 1; unknown types count as full."""
    total = F.lit(None).cast("double")
    for name, weights in reversed(ANSWER_WEIGHTS.items()):
        total = F.when(kind == name, sum(p * w for p, w in zip(parts, weights, strict=True))).otherwise(total)
    full = sum(p * w for p, w in zip(parts, ANSWER_WEIGHTS["full"], strict=True))
    return F.least(F.greatest(F.coalesce(total, full), F.lit(0.0)), F.lit(1.0))


def sm2_strength(strength: Column, quality: Column) -> Column:
    """SM-2 easiness after a recall of the given quality, within 1.3 and 2.5; a lapse costs 0.2."""
    up = strength + 0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02)
    return F.when(quality >= 3, F.least(F.greatest(up, F.lit(1.3)), F.lit(2.5))).otherwise(F.greatest(strength - 0.2, F.lit(1.3)))
