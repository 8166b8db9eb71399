"""Rank fusion, normalisation, diversity and ordered selections."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def ranked_wide(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``ranked`` for few groups of any size: ranges of the order are numbered each for itself, after the rows of all ranges before."""
    placed = written(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    numbered = ranked(placed, [*group, "_part"], order, "_own")
    same = F.lit(True)
    for c in (*group, "_part"):
        same &= numbered[c].eqNullSafe(starts[c])
    found = numbered.join(F.broadcast(starts), same).select(*[numbered[c] for c in df.columns], (F.col("_own") + F.col("_before")).cast("int").alias(name))
    return found


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` of each group; Spark limits groups before the shuffle."""
    return ranked(df, group, order, "_rank").where(F.col("_rank") <= k).drop("_rank")


def fuse(lists: DataFrame, query: Sequence[str] = (), item: str = "id", source: str = "source", score: str = "score", k: int = 60, weights: Mapping[str, float] | None = None, wide: bool = False) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over the lists that hold an item.

    Adds sources, original scores and ranks by source.  Weights of absent lists
    are not spread over the others.  Ties within a list go by item.  ``wide`` is
    for lists that are too long for one task each.
    """
    numbered = (ranked_wide if wide else ranked)(lists, [*query, source], [F.desc(score), F.asc(item)])
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col(source)), F.lit(0.0))
    return numbered.groupBy(*query, item).agg(
        F.sum(weight / (k + F.col("rank"))).alias("fused"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(source, score)))).alias("scores"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(source, "rank")))).alias("ranks"),
    )


def min_max(df: DataFrame, group: Sequence[str], score: str, name: str = "normalized") -> DataFrame:
    """(v - min) / (max - min) in each group, 1 where all values are equal; the bounds are aggregated before the shuffle."""
    bounds = df.groupBy(*group).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    joined = df.join(bounds, list(group)) if group else df.join(F.broadcast(bounds))  # one row
    return joined.withColumn(name, F.when(F.col("_high") > F.col("_low"), (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)).drop("_low", "_high")


def head_blend(df: DataFrame, query: Sequence[str], score: str, rerank: str, head: int = 64) -> DataFrame:
    """The first ``head`` rows take the mean of both scores and stay before the tail, whatever their values."""
    numbered = ranked(df, query, [F.desc(score), F.asc("id")], "_rank")
    blended = numbered.withColumn("segment", (F.col("_rank") > head).cast("int")).withColumn("blended", F.when(F.col("segment") == 0, (F.col(score) + F.coalesce(rerank, score)) / 2).otherwise(F.col(score)))
    return ranked(blended, query, [F.asc("segment"), F.desc("blended"), F.asc("id")], "place").drop("_rank")


def select_diverse(query: np.ndarray, vectors: np.ndarray, k: int, balance: float = 0.5) -> list[int]:
    """Maximal marginal relevance: indices in the order of their selection; ties go to the first."""

    def unit(x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-10)

    vectors = unit(vectors.astype(float))
    relevance = vectors @ unit(query.astype(float))
    nearest, open_, out = np.zeros(len(vectors)), np.ones(len(vectors), bool), []
    for _ in range(min(k, len(vectors))):
        gain = np.where(open_, balance * relevance - (1 - balance) * nearest, -np.inf)
        best = int(gain.argmax())
        out.append(best)
        open_[best] = False
        against = vectors @ vectors[best]
        nearest = against if len(out) == 1 else np.maximum(nearest, against)
    return out


def mmr(candidates: DataFrame, query: str, k: int, balance: float = 0.5, fetch: int = 200) -> DataFrame:
    """Diverse selection for each query from its best ``fetch`` candidates (id, score, embedding, query_embedding).

    Rows without an embedding of the query's length are left out; if that
    leaves none, the first ``k`` stay.  The score becomes the mean of the old
    one and 1 - place / k.
    """
    best = top_k(candidates, [query], [F.desc("score"), F.asc("id")], fetch)
    kind = candidates.schema
    schema = f"{query} {kind[query].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, place int, score double"

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True])
        wanted = rows["query_embedding"].iloc[0]
        fits = rows[[x is not None and wanted is not None and len(x) == len(wanted) for x in rows["embedding"]]]
        if fits.empty:
            out = rows.head(k)
            return pd.DataFrame({query: out[query], "id": out["id"], "place": range(len(out)), "score": out["score"]})
        order = select_diverse(np.array(wanted), np.stack([np.array(x) for x in fits["embedding"]]), k, balance)
        out = fits.iloc[order]
        return pd.DataFrame({query: out[query], "id": out["id"], "place": range(len(out)), "score": [(s + 1 - i / k) / 2 for i, s in enumerate(out["score"])]})

    return best.groupBy(query).applyInPandas(choose, schema)


def first_of(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """First row of each key, then the first ``limit`` of these."""
    named = df.withColumns({f"_k{i}": c for i, c in enumerate(keys)})
    found = top_k(named, [f"_k{i}" for i in range(len(keys))], order, 1).drop(*[f"_k{i}" for i in range(len(keys))])
    return found.orderBy(*order).limit(limit) if limit is not None else found


def semantic_breaks(similarities: DataFrame, doc: str = "doc_id", at: str = "idx", value: str = "similarity", floor: float = 0.5, dip: float = 0.7) -> DataFrame:
    """Breaks between sentences: similarity under ``floor``, or inside a text under ``dip`` times the mean of its neighbours."""
    w = Window.partitionBy(doc).orderBy(at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return similarities.withColumn("is_break", (F.col(value) < floor) | F.coalesce(F.col(value) < dip * (before + after) / 2, F.lit(False)))


def breaks_in(similarities: Column, floor: float = 0.5, dip: float = 0.7) -> Column:
    """The same for all similarities of one text as a list."""

    def told(m: Column) -> Column:
        inside = lambda x, k: (k > 0) & (x < dip * (F.get(m, k - 1) + F.get(m, k + 1)) / 2)
        return F.transform(m, lambda x, k: (x < floor) | F.coalesce(inside(x, k), F.lit(False)))

    return F.get(F.transform(F.array(similarities), told), F.lit(0))  # the list is made once, not for each of its items


def budget_chunks(sizes: Iterator[int], most: int = 1024) -> list[int]:
    """Chunk number of each sentence: a chunk ends before it would exceed ``most`` tokens."""
    out, total, chunk = [], 0, 0
    for n in sizes:
        if total and total + n > most:
            chunk, total = chunk + 1, 0
        total += n
        out.append(chunk)
    return out


def journey(trace: DataFrame, item: str = "id") -> DataFrame:
    """For each item: the stage with its best rank, and the last stage that recorded it."""
    return trace.groupBy(item).agg(F.min_by("stage", F.struct("rank", "step")).alias("first_appearance"), F.max_by("stage", "step").alias("last_stage"), F.count(F.lit(1)).alias("n_stages"))


def greedy_merges(pairs: Sequence[tuple[int, int, float]]) -> dict[int, int]:
    """Merged id to canonical id, from the most similar pair on; an id that was merged takes no part again.

    The order of the decisions matters, so this runs on the driver; the input
    is the reviewed high-confidence pairs, whose number callers must bound.
    """
    merged: dict[int, int] = {}
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in merged and b not in merged:
            merged[b] = a
    return merged


def merges(pairs: DataFrame) -> DataFrame:
    """id and canonical: what ``greedy_merges`` decides for pairs (a, b, similarity), for any number of them.

    A pair is decided once no earlier pair that could merge one of its ends is
    open, so all pairs that come first at both ends are decided in one round.
    """
    open_ = written(pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity")).where("a <> b").select(F.struct((-F.col("similarity")).alias("s"), "a", "b").alias("place"), "a", "b"), "pairs")
    done: DataFrame | None = None
    while not open_.isEmpty():
        first = open_.groupBy(F.col("b").alias("node")).agg(F.min("place").alias("first"))
        ends = open_.join(first.select(F.col("node").alias("a"), F.col("first").alias("of_a")), "a", "left").join(first.select(F.col("node").alias("b"), F.col("first").alias("of_b")), "b")
        made = written(ends.where("place = of_b AND (of_a IS NULL OR place < of_a)").select(F.col("b").alias("id"), F.col("a").alias("canonical"), "place"), "merged")
        done = made if done is None else done.unionByName(made)
        at = made.select("id", F.col("place").alias("merged"))
        left = open_.join(at.withColumnsRenamed({"id": "a", "merged": "ma"}), "a", "left").join(at.withColumnsRenamed({"id": "b", "merged": "mb"}), "b", "left")
        open_ = written(left.where("(ma IS NULL OR place < ma) AND (mb IS NULL OR place < mb)").select("place", "a", "b"), "pairs")
    if done is None:
        return pairs.select(F.col("b").alias("id"), F.col("a").alias("canonical")).where("false")
    return done.select("id", "canonical")


def bernoulli(rows: DataFrame, item: str, sample: float, seed: int = 0) -> DataFrame:
    """Each row with a chance of 1 / ``sample``, decided by a hash of seed and ``item``: the same rows on every run and cluster."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
    return rows.where(draw * sample < float(1 << 32))
