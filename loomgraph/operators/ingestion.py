"""Documents to concepts, relations and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import with_quality
from .resolver import merged_by_name, resolve
from .structure import concept_lines, list_memories, lists, memory_lines, protocol_lines, relation_lines, table_memories, tables

# Fixed values.
ENRICHED_SOURCES = ("table", "list", "person", "table_fact", "list_fact")


def quality_gate(memories: DataFrame, threshold: float = 0.4, min_words: int = 20) -> DataFrame:
    """Memories made from tables, lists and persons stay; others must reach the quality threshold."""
    scored = with_quality(memories, "content", "_quality", min_words=min_words)
    enriched = F.coalesce(F.col("source_type").isin(*ENRICHED_SOURCES), F.lit(False))
    return scored.where(enriched | (F.col("_quality") >= threshold)).drop("_quality")


def ingest(docs: DataFrame, raw: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """New graph rows from documents (doc_id, text) and the extraction output for them (id, raw).

    Concepts are merged by name and resolved against ``known``; ids of new ones
    follow from their names.  A document without extraction output still gives
    the memories of its tables and lists.
    """
    spoken = protocol_lines(raw)
    own = concept_lines(spoken)
    mentioned = memory_lines(spoken).select("id", F.explode("concepts").alias("name"), F.lit("general").alias("type"), F.lit(None).cast("string").alias("description"))
    named = merged_by_name(own.select("name", "type", "description").dropDuplicates(["name"]), mentioned.select("name", "type", "description").dropDuplicates(["name"]))
    found = resolve(named.select("name"), known)
    new_id = F.concat(F.lit("c_"), F.sha2("name", 256))
    ids = found.select("name", F.coalesce(F.col("concept_id").cast("string"), new_id).alias("concept_id"), F.col("concept_id").isNull().alias("is_new"))
    concepts = named.join(ids.where("is_new"), "name").select(F.col("concept_id").alias("id"), "name", "type", "description")
    pairs = relation_lines(spoken, own)
    to = lambda side: ids.select(F.col("name").alias(side), F.col("concept_id").alias(f"{side}_id"))
    relations = pairs.join(to("source"), "source").join(to("target"), "target").where("source_id <> target_id").groupBy("source_id", "target_id", "relation_type").agg(F.max("weight").alias("weight"))
    text = memory_lines(spoken).select(F.col("id").alias("doc_id"), "content", "memory_type", "importance", F.lit("document").alias("source_type"), "concepts")
    none = F.array().cast("array<string>")
    rows = [table_memories(tables(docs)), list_memories(lists(docs))]
    structured = rows[0].unionByName(rows[1]).select("doc_id", "content", F.lit("fact").alias("memory_type"), "importance", "source_type", none.alias("concepts"))
    memories = quality_gate(text.unionByName(structured)).withColumn("id", F.concat(F.lit("mem_"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "content"), 256))).dropDuplicates(["id"])
    links = memories.select(F.col("id").alias("memory_id"), F.explode("concepts").alias("name")).join(ids.select("name", "concept_id"), "name").select("memory_id", "concept_id").distinct()
    return {"concepts": concepts, "relations": relations, "memories": memories.drop("concepts"), "memory_concept": links, "memory_document": memories.select(F.col("id").alias("memory_id"), "doc_id")}


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows of the documents table from doc_id, text and, where there are such columns, title, doc_type, source_path and source_hash."""
    given = lambda name, other: F.coalesce(F.col(name), other) if name in docs.columns else other
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), given("title", F.col("doc_id").cast("string")).alias("title"), text.alias("content"), given("doc_type", F.lit("text")).alias("doc_type"),
        given("source_path", F.lit(None).cast("string")).alias("source_path"), given("source_hash", F.sha2(text, 256)).alias("source_hash"), F.lit("processing").alias("status"),
    )


def processed(documents: DataFrame, memory_document: DataFrame, memory_concept: DataFrame, now: Column) -> DataFrame:
    """``documents`` with the ids of their memories and of the concepts these are about, marked as done."""
    links = memory_document.select("memory_id", F.col("doc_id").cast("string").alias("id"))
    memories = links.groupBy("id").agg(F.array_sort(F.collect_set("memory_id")).alias("extracted_memory_ids"))
    concepts = links.join(memory_concept.select("memory_id", "concept_id"), "memory_id").groupBy("id").agg(F.array_sort(F.collect_set("concept_id")).alias("extracted_concept_ids"))
    none = F.array().cast("array<string>")
    full = documents.join(memories, "id", "left").join(concepts, "id", "left")
    return full.select(*documents.drop("status").columns, F.lit("completed").alias("status"), F.coalesce("extracted_memory_ids", none).alias("extracted_memory_ids"), F.coalesce("extracted_concept_ids", none).alias("extracted_concept_ids"), now.alias("processed_at"))


def all_edges(relations: DataFrame, memory_concept: DataFrame, episode_concept: DataFrame) -> DataFrame:
    """source, target and kind of the edges of three tables; repeats stay."""
    parts = [
        relations.select(F.col("source_id").cast("string").alias("source"), F.col("target_id").cast("string").alias("target"), F.lit("relation").alias("kind")),
        memory_concept.select(F.col("memory_id").cast("string").alias("source"), F.col("concept_id").cast("string").alias("target"), F.lit("memory").alias("kind")),
        episode_concept.select(F.col("episode_id").cast("string").alias("source"), F.col("concept_id").cast("string").alias("target"), F.lit("episode").alias("kind")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
