"""Composite retrieval over a batch of queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import base_score, path_memory_score, recency, shared_memory_score, weigh_source
from ..functions.text import expanded_query
from ..session import checkpointed
from .graph import activate, bridges, memories_for, shortest_paths
from .ranking import fuse, mmr
from .search import Bm25Index, nearest

WEIGHTS = {"bm25": 0.25, "vector": 0.25, "graph": 0.20, "path": 0.30}
#: Further lists of a question that was rewritten: expanded terms, a paraphrase, a made-up answer.
MORE_WEIGHTS = {"bm25_expanded": 0.25, "rewrite": 0.25, "hyde": 0.25}


def graph_list(seeds: DataFrame, relations: DataFrame, memory_concept: DataFrame, memories: DataFrame, threshold: float = 0.15, k: int = 200, concepts: DataFrame | None = None) -> DataFrame:
    """Memories about activated concepts; the score sums the activation of all activated concepts of a memory."""
    active = checkpointed(activate(seeds, relations, concepts).select("id", "activation"))
    found = memories_for(active.where(F.col("activation") >= threshold), memory_concept, memories).orderBy(F.desc("links"), F.desc("importance"), "id").limit(k)
    links = memory_concept.join(active.withColumnRenamed("id", "concept_id"), "concept_id")
    sums = links.groupBy(F.col("memory_id").alias("id")).agg(F.round(F.sum("activation"), 9).alias("score"))
    return found.select("id").join(sums, "id").select("id", "score", F.lit("graph").alias("source"))


def path_list(seeds: DataFrame, relations: DataFrame, memory_concept: DataFrame, memories: DataFrame, limit: int = 50, max_length: int = 3) -> DataFrame:
    """Memories that several seeds share, then those about concepts on the shortest paths between them."""
    asked = seeds.select("id")
    n = asked.agg(F.count(F.lit(1)).alias("asked"))
    shared = memories_for(asked, memory_concept, memories, min_links=2).orderBy(F.desc("links"), F.desc("importance"), "id").limit(limit)
    shared = shared.join(F.broadcast(n)).select("id", F.round(shared_memory_score(F.col("links"), F.col("asked"), F.col("importance")), 9).alias("score"))
    between = shortest_paths(asked, relations, max_length).select(F.explode("path").alias("id")).distinct().join(asked, "id", "left_anti")
    rest = memories_for(between, memory_concept, memories, exclude=shared.select("id")).orderBy(F.desc("importance"), "id").limit(limit)
    rest = rest.select("id", F.round(path_memory_score(F.col("links"), F.col("importance")), 9).alias("score"))
    return shared.unionByName(rest).select("id", "score", F.lit("path").alias("source"))


def retrieve(lists: DataFrame, memories: DataFrame, now: Column, k: int = 20, relevance: DataFrame | None = None, source_type: str | None = None, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Fuse ranked lists (id, score, source) and rank by recency, importance, relevance and fused rank."""
    fused = fuse(lists, weights=weights)
    joined = memories.join(fused, "id")
    close = None
    if relevance is not None:
        joined, close = joined.join(relevance.select("id", "relevance"), "id", "left"), F.col("relevance")
    score = base_score(recency(F.col("last_accessed"), now), F.col("importance"), F.col("fused"), close)
    score = weigh_source(score, F.lit(source_type) if source_type else F.lit("document"))
    scored = joined.select("id", F.array_join("sources", "+").alias("sources"), F.round("fused", 6).alias("fused"), F.round(score, 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def bm25_list(index: Bm25Index, question: DataFrame, memories: DataFrame, k: int = 50, source: str = "bm25") -> DataFrame:
    """Retrievable memories by BM25; ``question`` is one row (query_id, text)."""
    live = memories.where(F.col("status").isin("active", "deprioritized")).select("id")
    hits = index.search(question, k=None).join(live, "id", "left_semi")
    return hits.select("id", F.round("score", 9).alias("score"), F.lit(source).alias("source")).orderBy(F.desc("score"), "id").limit(k)


def vector_list(vectors: DataFrame, question: DataFrame, memories: DataFrame, k: int = 50, source: str = "vector") -> DataFrame:
    """Retrievable memories by cosine; ``question`` is one row (query_id, embedding)."""
    live = memories.where(F.col("status").isin("active", "deprioritized")).select("id")
    return nearest(question, vectors.join(live, "id", "left_semi"), k).select("id", F.round("score", 9).alias("score"), F.lit(source).alias("source"))


def expanded_question(question: DataFrame, matched: DataFrame) -> DataFrame:
    """The question (query_id, text), or the names and aliases of its matched concepts (query_id, name, aliases) where there are any."""
    terms = matched.select("query_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t")).groupBy("query_id").agg(F.collect_set("t").alias("terms"))
    joined = question.join(terms, "query_id", "left")
    return joined.select("query_id", expanded_query(F.col("text"), F.coalesce("terms", F.array().cast("array<string>"))).alias("text"))


def path_result(seeds: DataFrame, relations: DataFrame, concepts: DataFrame, memory_concept: DataFrame, memories: DataFrame, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Memories on paths between the seeds, and the concepts that bridge them; with fewer than two seeds both are empty."""
    many = seeds.agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("n")
    asked = seeds.select("id").join(F.broadcast(many)).select("id")  # one row or none
    return path_list(asked, relations, memory_concept, memories, limit), bridges(asked, relations, concepts)


def retrieve_all(lists: DataFrame, memories: DataFrame, now: Column, k: int, relevance: DataFrame | None = None, vectors: DataFrame | None = None, question: DataFrame | None = None, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Fusion of all given lists, base score, source weight and, with vectors, a diverse choice: id, sources, fused, score, place."""
    scored = retrieve(lists, memories, now, 200 if vectors is not None else k, relevance, weights=weights)
    if vectors is not None and question is not None:
        near = scored.join(vectors.select("id", "embedding"), "id", "left").join(F.broadcast(question.select("query_id", F.col("embedding").alias("query_embedding"))))
        chosen = mmr(near.select("query_id", "id", "score", "embedding", "query_embedding"), "query_id", k)
        return scored.drop("score").join(chosen.select("id", F.round("score", 6).alias("score"), "place"), "id")
    w = Window.orderBy(F.desc("score"), "id")  # k rows
    return scored.withColumn("place", F.row_number().over(w) - 1)


def retrieve_many(named: Mapping[str, DataFrame], memories: DataFrame, now: Column, k: int = 20, relevance: DataFrame | None = None) -> DataFrame:
    """Like ``retrieve``, over the lists of several forms of one question (id, score), by their names."""
    lists = None
    for name, rows in named.items():
        own = rows.select("id", "score", F.lit(name).alias("source"))
        lists = own if lists is None else lists.unionByName(own)
    return retrieve(lists, memories, now, k, relevance, weights=WEIGHTS | MORE_WEIGHTS)


def source_counts(retrieved: DataFrame, sources: str = "sources") -> DataFrame:
    """Retrieved items by source."""
    return retrieved.select(F.explode(F.split(sources, r"\+")).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def recorded(stages: Mapping[str, DataFrame]) -> DataFrame:
    """step, stage, id, rank and score of every item in each stage (id, score) of a retrieval."""
    out = None
    for step, (name, rows) in enumerate(stages.items()):
        w = Window.partitionBy("stage").orderBy(F.desc("score"), "id")
        own = rows.select(F.lit(step).alias("step"), F.lit(name).alias("stage"), "id", F.col("score").cast("double").alias("score")).withColumn("rank", F.row_number().over(w))
        out = own if out is None else out.unionByName(own)
    return out


def step_stats(trace: DataFrame) -> DataFrame:
    """Items and the least, greatest and mean score of each stage."""
    return trace.groupBy("step", "stage").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"))


def item_journey(trace: DataFrame, item: Column) -> DataFrame:
    """Each stage with the item's rank and score there; null and a reason where it is absent."""
    steps = trace.select("step", "stage").distinct()
    own = trace.where(F.col("id") == item).select("step", "rank", "score")
    joined = steps.join(own, "step", "left")
    seen = F.max(F.when(F.col("rank").isNotNull(), F.col("step"))).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))  # a handful of steps
    return joined.withColumn("reason", F.when(F.col("rank").isNotNull(), "present").when(seen.isNull(), "not found yet").otherwise("dropped"))


def found_by_text(trace: DataFrame, memories: DataFrame, text: str) -> DataFrame:
    """Recorded items whose content holds ``text``, whatever its case."""
    return trace.join(memories.where(F.lower("content").contains(text.lower())).select("id"), "id", "left_semi")


def write_trace(trace: DataFrame, path: str) -> None:
    trace.write.mode("overwrite").json(path)
