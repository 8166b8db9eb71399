"""Updates of strength, activation, links and knowledge as frame-to-frame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import base_level, sm2_strength, status_of, success_rate, synthetic_history
from ..functions.text import behavior_of
from .graph import induced
from .search import nearest

# Fixed values.
PROCEDURE_WORDS = ("чтобы", "нужно", "следует", "используй")
REFLECTION_KINDS = {"ПАТТЕРН": "pattern", "ПРОБЕЛ": "gap", "СВЯЗЬ": "connection"}


def review(memories: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """SM-2: ``reviews`` has id and quality (0 to 5), one for each memory."""
    joined = memories.join(reviews.select("id", "quality"), "id", "left")
    hit, recalled = F.col("quality").isNotNull(), F.col("quality") >= 3
    return joined.withColumn("strength", F.when(hit, sm2_strength(F.col("strength"), F.col("quality"))).otherwise(F.col("strength"))).withColumn(
        "access_count", F.col("access_count") + F.when(recalled, 1).otherwise(0)).withColumn("last_accessed", F.when(recalled, now).otherwise(F.col("last_accessed"))).drop("quality")


def strengthen(memories: DataFrame, ids: DataFrame, boost: float = 0.1) -> DataFrame:
    """An id that is named n times is strengthened n times."""
    times = ids.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    joined = memories.join(times, "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    grown = F.least(F.greatest(F.col("strength"), F.lit(2.5)), F.col("strength") + boost * F.col("_n"))
    return joined.withColumn("strength", F.when(F.col("_n") > 0, F.least(F.lit(2.5), grown)).otherwise(F.col("strength"))).withColumn("access_count", F.col("access_count") + F.col("_n")).drop("_n")


def weaken(memories: DataFrame, ids: DataFrame, factor: float = 0.95) -> DataFrame:
    times = ids.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    joined = memories.join(times, "id", "left")
    return joined.withColumn("strength", F.when(F.col("_n") > 0, F.greatest(F.lit(1.3), F.col("strength") * F.pow(F.lit(factor), F.col("_n")))).otherwise(F.col("strength"))).drop("_n")


def calibrate(memories: DataFrame, decay: float = 0.99) -> DataFrame:
    return memories.withColumn("strength", F.when(F.col("strength") > 1.3, F.greatest(F.lit(1.3), F.col("strength") * decay)).otherwise(F.col("strength")))


def hebbian(relations: DataFrame, nodes: DataFrame, step: float) -> DataFrame:
    """Edges among ``nodes`` (id) grow by ``step`` up to 1, or fade by it down to 0.1 if it is negative."""
    touched = induced(relations.select("source_id", "target_id"), nodes).withColumn("_hit", F.lit(True))
    joined = relations.join(touched, ["source_id", "target_id"], "left")
    moved = F.least(F.lit(1.0), F.col("weight") + step) if step > 0 else F.greatest(F.lit(0.1), F.col("weight") + step)
    counted = F.col("co_occurrence_count") + F.when(F.col("_hit") & F.lit(step > 0), 1).otherwise(0)
    return joined.withColumn("weight", F.when(F.col("_hit"), moved).otherwise(F.col("weight"))).withColumn("co_occurrence_count", counted).drop("_hit")


def forget(memories: DataFrame, now: Column, decay: float = 0.5) -> DataFrame:
    """ACT-R activation and the status that follows, for active and deprioritized memories."""
    history = synthetic_history(F.col("created_at"), F.col("last_accessed"), F.col("access_count"))
    if "access_history" in memories.columns:
        history = F.when(F.size("access_history") > 0, F.col("access_history")).otherwise(history)
    open_ = F.coalesce(F.col("status"), F.lit("active")).isin("active", "deprioritized")
    leveled = memories.withColumn("base_level_activation", F.when(open_, base_level(history, now, decay)))
    return leveled.withColumn("status", F.when(open_, status_of(F.col("base_level_activation"))).otherwise(F.col("status")))


def status_histogram(memories: DataFrame) -> DataFrame:
    return memories.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def consolidation(episodes: DataFrame, key: str) -> DataFrame:
    """Groups of similar episodes that are ripe: three of four criteria hold."""
    s, f = F.col("success_count"), F.col("failure_count")
    found = episodes.groupBy(key).agg(
        F.count_if(s > f).alias("n_successful"),
        (F.sum(s) / F.greatest(F.sum(s) + F.sum(f), F.lit(1))).alias("rate"),
        F.avg("importance").alias("importance"),
        F.count_distinct("domain").alias("n_domains"),
    )
    met = sum(c.cast("int") for c in (F.col("n_successful") >= 3, F.col("rate") >= 0.85, F.col("importance") >= 7, F.col("n_domains") >= 2))
    return found.withColumn("met", met).withColumn("ripe", F.col("met") >= 3)


def reflection_due(episodes: DataFrame, now: Column, hours: int = 24, newest: int = 100, threshold: float = 150.0) -> DataFrame:
    """Sum of importance over the newest episodes of the window, and whether it calls for a reflection."""
    recent = episodes.where((F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("created_at") <= now)).orderBy(F.desc("created_at"), "id").limit(newest)
    return recent.agg(F.coalesce(F.sum("importance"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n")).withColumn("due", F.col("total") >= threshold)


def apply_feedback(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """Counters after feedback events (episode_id, feedback): success for positive, failure for negative and correction."""
    sums = events.groupBy(F.col("episode_id").alias("id")).agg(F.count_if(F.col("feedback") == "positive").alias("_up"), F.count_if(F.col("feedback").isin("negative", "correction")).alias("_down"))
    joined = episodes.join(sums, "id", "left")
    return joined.withColumn("success_count", F.col("success_count") + F.coalesce("_up", F.lit(0))).withColumn("failure_count", F.col("failure_count") + F.coalesce("_down", F.lit(0))).drop("_up", "_down")


def resolve_contradictions(pairs: DataFrame, min_confidence: float = 0.7, gap: float = 0.3) -> DataFrame:
    """Which memory of a judged pair is superseded; null where a person must decide.

    ``pairs`` has kind, confidence, action (keep_new, keep_old), newer_is_correct,
    id_old, id_new, confidence_old, confidence_new.
    """
    sure = (F.col("kind") == "direct") & (F.col("confidence") >= min_confidence)
    clear = (F.abs(F.col("confidence_new") - F.col("confidence_old")) >= gap) | F.col("newer_is_correct")
    loser = F.when(F.col("action") == "keep_new", F.col("id_old")).when(F.col("action") == "keep_old", F.col("id_new"))
    return pairs.withColumn("superseded", F.when(sure & clear, loser))


def alternative_episodes(episodes: DataFrame, episode_concept: DataFrame, concepts: DataFrame, exclude_behavior: str | None = None, min_rate: float = 0.0, k: int = 10) -> DataFrame:
    """Successful episodes that share the most concepts; the limit comes before the filter on the success rate."""
    good = episodes.where("success_count > failure_count")
    if exclude_behavior is not None:
        good = good.where(F.col("behavior_name") != exclude_behavior)
    links = episode_concept.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").distinct()
    overlap = links.groupBy(F.col("episode_id").alias("id")).agg(F.count(F.lit(1)).alias("overlap"))
    best = good.join(overlap, "id").orderBy(F.desc("overlap"), F.desc("success_count"), "id").limit(k)
    return best.withColumn("rate", success_rate(F.col("success_count"), F.col("failure_count"))).where(F.col("rate") >= min_rate)


def create_or_strengthen(relations: DataFrame, links: DataFrame, now: Column, initial: float = 0.5, boost: float = 0.05) -> DataFrame:
    """Links (source_id, target_id, relation_type) that exist grow by ``boost`` up to 1; others begin with ``initial``."""
    asked = links.select("source_id", "target_id", F.col("relation_type").alias("_type")).distinct().groupBy("source_id", "target_id").agg(F.min("_type").alias("_type")).withColumn("_asked", F.lit(True))
    joined = relations.withColumn("_old", F.lit(True)).join(asked, ["source_id", "target_id"], "full")
    old, hit = F.coalesce("_old", F.lit(False)), F.coalesce("_asked", F.lit(False))
    values = {
        "weight": F.when(old & hit, F.least(F.lit(1.0), F.col("weight") + boost)).when(old, F.col("weight")).otherwise(initial),
        "co_occurrence_count": F.when(old & hit, F.col("co_occurrence_count") + 1).when(old, F.col("co_occurrence_count")).otherwise(1),
        "relation_type": F.when(old, F.col("relation_type")).otherwise(F.col("_type")),
        "last_used": F.when(hit, now).otherwise(F.col("last_used") if "last_used" in relations.columns else F.lit(None)),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in relations.columns])


def touch_concepts(concepts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more activation for each of ``ids``; an unknown count stays unknown."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = concepts.join(hit, "id", "left")
    out = joined.withColumn("activation_count", F.when(F.col("_hit"), F.col("activation_count") + 1).otherwise(F.col("activation_count")))
    return out.withColumn("last_activated", F.when(F.col("_hit"), now).otherwise(F.col("last_activated") if "last_activated" in concepts.columns else F.lit(None).cast("timestamp"))).drop("_hit")


def touch_memories(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One more access for each of ``ids``, kept in the history where there is one."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = memories.join(hit, "id", "left").withColumn("access_count", F.col("access_count") + F.when(F.col("_hit"), 1).otherwise(0)).withColumn("last_accessed", F.when(F.col("_hit"), now).otherwise(F.col("last_accessed")))
    if "access_history" in memories.columns:
        out = out.withColumn("access_history", F.when(F.col("_hit"), F.concat(F.coalesce("access_history", F.array().cast("array<timestamp>")), F.array(now))).otherwise(F.col("access_history")))
    return out.drop("_hit")


def restore(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Memories are accessed, set active, and rated at once, which may archive them again."""
    touched = touch_memories(memories, ids, now).join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    opened = touched.withColumn("status", F.when(F.col("_hit"), "active").otherwise(F.col("status")))
    rated = forget(opened.where("_hit"), now)
    return opened.where("_hit IS NULL").drop("_hit").unionByName(rated.drop("_hit"), allowMissingColumns=True)


def correction_memories(corrections: DataFrame, now: Column) -> DataFrame:
    """A memory for each correction (episode_id, correction_text, concepts_activated); its first five concepts are inherited."""
    low = F.lower("correction_text")
    procedure = low.rlike("|".join(PROCEDURE_WORDS))
    return corrections.select(
        F.concat(F.lit("memory-correction-"), F.sha2(F.concat_ws("|", F.col("episode_id").cast("string"), "correction_text"), 256)).alias("id"),
        F.col("correction_text").alias("content"), F.slice("concepts_activated", 1, 5).alias("concept_ids"), F.array("episode_id").alias("source_episode_ids"),
        F.when(procedure, "procedure").otherwise("fact").alias("memory_type"), F.lit(8.0).alias("importance"), F.lit(0.95).alias("confidence"), F.lit(2.5).alias("strength"), now.alias("created_at"), F.lit("active").alias("status"),
    )


def feedback(kind: str, episodes: DataFrame, memories: DataFrame, relations: DataFrame, events: DataFrame, used: DataFrame, activated: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What feedback of one kind does; ``events`` has episode_id, ``used`` episode_id and memory_id, ``activated`` episode_id and concept_id.

    Positive: success, memories stronger, links stronger.  Negative: failure,
    memories and links weaker.  Correction: failure and a new memory.
    """
    marked = events.select("episode_id", F.lit(kind).alias("feedback"))
    out = {"episodes": apply_feedback(episodes, marked)}
    if kind == "correction":
        return out | {"new_memories": correction_memories(events.join(activated.groupBy("episode_id").agg(F.array_sort(F.collect_set("concept_id")).alias("concepts_activated")), "episode_id", "left"), now)}
    ids = used.join(events.select("episode_id"), "episode_id", "left_semi").select(F.col("memory_id").alias("id"))
    nodes = activated.join(events.select("episode_id"), "episode_id", "left_semi").select(F.col("concept_id").alias("id")).distinct()
    if kind == "positive":
        return out | {"memories": strengthen(memories, ids), "relations": hebbian(relations, nodes, 0.05)}
    return out | {"memories": weaken(memories, ids), "relations": hebbian(relations, nodes, -0.02)}


def _most_similar(rows: DataFrame, asked: DataFrame, k: int, least: float) -> DataFrame:
    near = nearest(asked.select(F.col("id").alias("asked_id"), "embedding"), rows.select("id", "embedding"), k, "asked_id", itself=False)
    return near.where(F.col("score") >= least).withColumnRenamed("score", "similarity")


def similar_episodes(episodes: DataFrame, asked: DataFrame, k: int = 10, least: float = 0.7, successful: bool = True) -> DataFrame:
    """asked_id, id, similarity: the most similar other episodes by embedding of their behaviour."""
    rows = episodes.where("success_count > failure_count") if successful else episodes
    return _most_similar(rows, asked, k, least)


def crystallize(episodes: DataFrame, groups: DataFrame, now: Column, cap: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New procedure memories, updated episodes and links, for the ripe groups of ``groups`` (key, id).

    A memory has the instruction of the group's first episode and up to ``cap``
    concepts of all, in order of their ids.
    """
    joined = groups.join(episodes, "id")
    met = consolidation(joined, "key").where("ripe").select("key")
    ripe = joined.join(met, "key", "left_semi")
    made = ripe.groupBy("key").agg(
        F.min_by("behavior_instruction", "id").alias("content"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("concepts_activated")))), 1, cap).alias("concept_ids"),
        F.array_sort(F.collect_set("id")).alias("source_episode_ids"),
    )
    made = made.select(F.concat(F.lit("memory-procedure-"), F.sha2(F.col("key").cast("string"), 256)).alias("id"), "content", "concept_ids", "source_episode_ids", F.lit("procedure").alias("memory_type"), F.lit(8.0).alias("importance"), F.lit("active").alias("status"), now.alias("created_at"))
    links = made.select(F.explode("source_episode_ids").alias("episode_id"), F.col("id").alias("memory_id"))
    marks = links.select(F.col("episode_id").alias("id"), F.col("memory_id").alias("_memory"))
    updated = episodes.join(marks, "id", "left").withColumn("consolidated", F.coalesce("consolidated", F.lit(False)) | F.col("_memory").isNotNull()).withColumn("consolidated_memory_id", F.coalesce("_memory", "consolidated_memory_id")).drop("_memory")
    return made, updated, links


def reflections(answers: DataFrame, now: Column) -> DataFrame:
    """Memories from the lines KIND: text of a model's reflection (id, answer)."""
    kinds = F.create_map(*[F.lit(x) for pair in REFLECTION_KINDS.items() for x in pair])
    lines = answers.select("id", F.posexplode(F.split("answer", "\n")).alias("line", "t"))
    pattern = rf"(?iu)^\s*({'|'.join(REFLECTION_KINDS)})\s*[:|]\s*(.+?)\s*$"
    found = lines.where(F.col("t").rlike(pattern)).select("id", "line", F.try_element_at(kinds, F.upper(F.regexp_extract("t", pattern, 1))).alias("kind"), F.regexp_extract("t", pattern, 2).alias("content"))
    return found.select(F.concat_ws("-", F.lit("memory-reflection"), F.col("id").cast("string"), F.col("line").cast("string")).alias("id"), "kind", "content", F.lit("relationship").alias("memory_type"), F.lit(9.0).alias("importance"), F.lit(0.7).alias("confidence"), F.lit(2.0).alias("strength"), now.alias("created_at"))


def contradiction_candidates(memories: DataFrame, asked: DataFrame, k: int = 10, least: float = 0.7) -> DataFrame:
    """asked_id, id, similarity: active memories most similar to each of ``asked`` (id, embedding)."""
    return _most_similar(memories.where("status = 'active'"), asked, k, least)


def parse_contradictions(answers: DataFrame) -> DataFrame:
    """kind, confidence, action and newer_is_correct from a judge's answer ``CONTRADICTION|kind|confidence|action|newer``; others are none."""
    line = F.regexp_extract("answer", r"CONTRADICTION\|([^\n]+)", 1)
    at = lambda i: F.lower(F.trim(F.get(F.split(line, r"\|"), F.lit(i))))
    kind = F.when(at(0).isin("direct", "partial", "temporal"), at(0)).otherwise("none")
    return answers.select("id_old", "id_new", kind.alias("kind"), F.coalesce(at(1).try_cast("double"), F.lit(0.0)).alias("confidence"), F.when(at(2).isin("keep_new", "keep_old", "merge", "ask"), at(2)).otherwise("ask").alias("action"), F.coalesce(at(3).isin("yes", "true", "да"), F.lit(False)).alias("newer_is_correct"))


def supersede(memories: DataFrame, resolved: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Memories with their new status, and the edges new_id, old_id, for pairs (id_old, id_new, superseded)."""
    edges = resolved.where("superseded IS NOT NULL").select(F.when(F.col("superseded") == F.col("id_old"), F.col("id_new")).otherwise(F.col("id_old")).alias("new_id"), F.col("superseded").alias("old_id")).distinct()
    last = edges.groupBy(F.col("old_id").alias("id")).agg(F.max("new_id").alias("_by"))
    joined = memories.join(last, "id", "left")
    out = joined.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("_by", F.col("superseded_by") if "superseded_by" in memories.columns else F.lit(None)))
    return out.withColumn("superseded_at", F.when(F.col("_by").isNotNull(), now)).drop("_by"), edges


def new_episodes(answers: DataFrame, now: Column) -> DataFrame:
    """Episodes from answered questions (id, query, answer, concepts_activated, memories_used, importance)."""
    b = behavior_of(F.col("query"), F.col("answer"))
    return answers.withColumn("_b", b).select(
        "id", "query", "concepts_activated", "memories_used", F.col("_b.name").alias("behavior_name"), F.col("_b.instruction").alias("behavior_instruction"), F.col("_b.domain").alias("domain"),
        "importance", F.lit(1).alias("repetition_count"), F.lit(0).alias("success_count"), F.lit(0).alias("failure_count"), now.alias("created_at"), F.lit(False).alias("consolidated"),
    )


def record_outcomes(episodes: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Success (which also counts a repetition) and failure by ``outcomes`` (id, success)."""
    sums = outcomes.groupBy("id").agg(F.count_if("success").alias("_up"), F.count_if(~F.col("success")).alias("_down"))
    joined = episodes.join(sums, "id", "left")
    up, down = F.coalesce("_up", F.lit(0)), F.coalesce("_down", F.lit(0))
    out = joined.withColumn("success_count", F.col("success_count") + up).withColumn("failure_count", F.col("failure_count") + down).withColumn("repetition_count", F.coalesce(F.col("repetition_count") if "repetition_count" in episodes.columns else F.lit(None), F.lit(1)) + up)
    return out.withColumn("last_used", F.when(up + down > 0, now).otherwise(F.col("last_used") if "last_used" in episodes.columns else F.lit(None).cast("timestamp"))).drop("_up", "_down")


def mark_consolidated(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Episodes of ``links`` (episode_id, memory_id) are consolidated into the first memory by id."""
    marks = links.groupBy(F.col("episode_id").alias("id")).agg(F.min("memory_id").alias("_memory"))
    return episodes.join(marks, "id", "left").withColumn("consolidated", F.col("_memory").isNotNull()).withColumn("consolidated_memory_id", F.col("_memory")).drop("_memory")
