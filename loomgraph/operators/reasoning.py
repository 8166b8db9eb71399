"""Answers from retrieved memories: what is forced in or out, estimates, alternatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.providers import call_model
from ..functions.text import clean_answer
from .graph import memories_for
from .learning import alternative_episodes, new_episodes


def without_nodes(memories: DataFrame, activated: DataFrame, ids: Sequence) -> tuple[DataFrame, DataFrame]:
    """Retrieved memories and activated concepts less the excluded ids."""
    gone = F.col("id").isin(list(ids))
    return memories.where(~gone), activated.where(~gone)


def with_memories(retrieved: DataFrame, memories: DataFrame, ids: Sequence) -> DataFrame:
    """Forced memories (score 1, source F) in reversed order of their naming before the others; ids without a memory are left out."""
    order = F.create_map(*[F.lit(x) for pair in ((i, len(ids) - k) for k, i in enumerate(ids)) for x in pair])
    kept = retrieved.withColumn("place", F.col("place") + len(ids))
    forced = memories.where(F.col("id").isin(list(ids))).join(retrieved.select("id"), "id", "left_anti").select("id", F.lit(1.0).alias("score"), F.lit("F").alias("sources"), (F.try_element_at(order, F.col("id"))).cast("int").alias("place"))
    return kept.select("id", "score", "sources", "place").unionByName(forced)


def with_concepts(activated: DataFrame, ids: DataFrame) -> DataFrame:
    """Forced concepts that are not activated yet get full activation."""
    fresh = ids.select("id").distinct().join(activated.select("id"), "id", "left_anti").withColumn("activation", F.lit(1.0))
    return activated.select("id", "activation").unionByName(fresh)


def fallback_seeds(matched: DataFrame, by_vector: DataFrame, by_words: DataFrame, k: int = 5, close: float = 0.3, enough: float = 0.5) -> DataFrame:
    """query_id, id: matched names; for questions without one the best ``k`` by vector over ``close`` and by words over ``enough``."""
    open_ = by_vector.where(F.col("score") > close).select("query_id", "id", "score").unionByName(by_words.where(F.col("score") > enough).select("query_id", "id", "score"))
    rest = open_.join(matched.select("query_id"), "query_id", "left_anti").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    from .ranking import top_k

    best = top_k(rest, ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], k)
    return matched.select("query_id", "id").distinct().unionByName(best.select("query_id", "id"))


def confidence(retrieved: DataFrame, query: str = "query_id") -> DataFrame:
    """Mean confidence of the memories, 0.1 more (up to 1) if three or more sources agree; ``retrieved`` has confidence and an array sources."""
    each = retrieved.groupBy(query).agg(F.avg("confidence").alias("c"), F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("n_sources"))
    return each.select(query, F.when(F.col("n_sources") >= 3, F.least(F.lit(1.0), F.col("c") + 0.1)).otherwise(F.col("c")).alias("confidence"))


def importance(query: Column, n_concepts: Column, n_activated: Column, n_procedures: Column) -> Column:
    """5, more for many concepts, a broad topic, procedures and a long question; 10 at most."""
    more = F.when(n_concepts > 3, 1.0).otherwise(0.0) + F.when(n_activated > 5, 1.0).otherwise(0.0) + F.when(n_procedures > 2, 1.0).otherwise(0.0) + F.when(F.char_length(query) > 100, 0.5).otherwise(0.0)
    return F.least(F.lit(10.0), 5.0 + more)


def for_concepts(concepts: DataFrame, memory_concept: DataFrame, memories: DataFrame, k: int = 10, relevance: DataFrame | None = None) -> DataFrame:
    """id, score: memories about ``concepts`` by importance, averaged with ``relevance`` (id, relevance) where it is known."""
    found = memories_for(concepts, memory_concept, memories).orderBy(F.desc("links"), F.desc("importance"), "id").limit(2 * k)
    score = F.col("importance") / 10
    if relevance is not None:
        found = found.join(relevance.select("id", "relevance"), "id", "left")
        score = F.when(F.col("relevance").isNotNull(), (score + F.col("relevance")) / 2).otherwise(score)
    return found.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def alternatives(concepts: DataFrame, tried: DataFrame, memory_concept: DataFrame, memories: DataFrame, limit: int = 10) -> DataFrame:
    """id, score: memories about the concepts of a failed answer that it did not use."""
    found = memories_for(concepts, memory_concept, memories, exclude=tried).orderBy(F.desc("links"), F.desc("importance"), "id").limit(2 * limit)
    return found.select("id", (F.col("importance") / 10).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def prompts(questions: DataFrame, contexts: DataFrame, instruction: str) -> DataFrame:
    """query_id and prompt: instruction, context and question."""
    joined = questions.join(contexts, "query_id", "left")
    return joined.select("query_id", "query", F.concat(F.lit(instruction), F.lit("\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\n"), F.col("query")).alias("prompt"))


def reason(questions: DataFrame, contexts: DataFrame, activated: DataFrame, used: DataFrame, estimates: DataFrame, generate: Callable[[list[str]], list[str]], now: Column, instruction: str = "") -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, answer, confidence) and the episodes that record them.

    ``activated`` and ``used`` have query_id and an array ids; ``estimates``
    has query_id, confidence and importance.
    """
    said = call_model(prompts(questions, contexts, instruction), generate)
    answers = said.join(estimates, "query_id", "left").select("query_id", clean_answer(F.col("answer")).alias("answer"), F.coalesce("confidence", F.lit(0.3)).alias("confidence"))
    rows = said.join(activated.select("query_id", F.col("ids").alias("concepts_activated")), "query_id", "left").join(used.select("query_id", F.col("ids").alias("memories_used")), "query_id", "left").join(estimates.select("query_id", "importance"), "query_id", "left")
    rows = rows.withColumn("id", F.concat(F.lit("episode-"), F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), "query"), 256)))
    return answers, new_episodes(rows, now)


def re_reason(failed: DataFrame, tried: DataFrame, memory_concept: DataFrame, memories: DataFrame, episodes: DataFrame, episode_concept: DataFrame, behavior: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a second answer can build on: untried memories, and successful episodes of another behaviour, for the concepts ``failed`` (id)."""
    return alternatives(failed, tried, memory_concept, memories, limit), alternative_episodes(episodes, episode_concept, failed, behavior, 0.0, 5)
