"""Schemas of the graph's tables, with the defaults that readers fill in."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONCEPT_TYPES = ("tool", "resource", "action", "state", "config", "error", "general")
RELATION_TYPES = ("is_a", "contains", "uses", "needs", "causes", "related_to")
MEMORY_TYPES = ("fact", "procedure", "relationship")

CONCEPT = (
    "id string, name string, type string, description string, embedding array<float>, parent_id string, level int, activation_count bigint, "
    "last_activated timestamp, created_at timestamp, updated_at timestamp, aliases array<string>, is_canonical boolean, canonical_id string, "
    "status string, enriched_definition string, enriched_at timestamp, layout_x double, layout_y double, cluster int"
)
MEMORY = (
    "id string, content string, search_content string, subject string, predicate string, object string, concept_ids array<string>, "
    "source_doc_ids array<string>, source_episode_ids array<string>, memory_type string, importance double, confidence double, strength double, "
    "created_at timestamp, last_accessed timestamp, valid_from timestamp, valid_until timestamp, superseded_at timestamp, access_count bigint, "
    "status string, base_level_activation double, access_history array<timestamp>, superseded_by string, embedding array<float>, metadata string"
)
EPISODE = (
    "id string, query string, concepts_activated array<string>, memories_used array<string>, behavior_name string, behavior_instruction string, "
    "domain string, answer_summary string, feedback string, correction_text string, importance double, repetition_count int, success_count int, "
    "failure_count int, created_at timestamp, last_used timestamp, consolidated boolean, consolidated_memory_id string, embedding array<float>"
)
DOCUMENT = (
    "id string, title string, content string, doc_type string, source_path string, source_hash string, status string, error_message string, "
    "extracted_concept_ids array<string>, extracted_memory_ids array<string>, created_at timestamp, processed_at timestamp, author string, version string, tags array<string>"
)
RELATION = (
    "source_id string, target_id string, relation_type string, weight double, edge_embedding array<float>, co_occurrence_count bigint, "
    "last_used timestamp, is_semantic boolean, is_universal boolean, source_type string, provenance_doc_id string"
)
LINKS = {
    "memory_concept": "memory_id string, concept_id string",
    "memory_document": "memory_id string, doc_id string",
    "episode_concept": "episode_id string, concept_id string",
    "episode_memory": "episode_id string, memory_id string",
    "episode_crystallized": "episode_id string, memory_id string",
    "memory_supersedes": "new_id string, old_id string",
    "possible_duplicates": "source_id string, target_id string, labse double, phonetic double, string double, combined double, confidence string",
}
TABLES = {"concepts": CONCEPT, "memories": MEMORY, "episodes": EPISODE, "documents": DOCUMENT, "relations": RELATION} | LINKS


@functools.cache
def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


KEYS = {"concepts": ["id"], "memories": ["id"], "episodes": ["id"], "documents": ["id"], "relations": ["source_id", "target_id"]} | {n: [c.split()[0] for c in t.split(", ")[:2]] for n, t in LINKS.items()}

DEFAULTS: dict[str, dict[str, object]] = {
    "concepts": {"type": "general", "level": 2, "activation_count": 0, "is_canonical": True, "status": "active"},
    "memories": {"memory_type": "fact", "importance": 5.0, "confidence": 0.8, "strength": 2.5, "access_count": 0, "status": "active"},
    "episodes": {"domain": "general", "importance": 5.0, "repetition_count": 1, "success_count": 0, "failure_count": 0, "consolidated": False},
    "documents": {"doc_type": "text", "status": "pending"},
    "relations": {"relation_type": "related_to", "weight": 0.5, "co_occurrence_count": 0, "is_semantic": False, "is_universal": False, "source_type": "document"},
}
EMPTY_ARRAYS = {"concepts": ["aliases"], "memories": ["concept_ids", "source_doc_ids", "source_episode_ids", "access_history"], "episodes": ["concepts_activated", "memories_used"], "documents": ["tags"]}


def conform(rows: DataFrame, table: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``table``, missing ones null, defaults filled in; extra columns go, but for those ``beside``."""
    schema = schema_of(table)
    out = []
    for field in schema.fields:
        column = F.col(f"`{field.name}`").cast(field.dataType) if field.name in rows.columns else F.lit(None).cast(field.dataType)
        default = DEFAULTS.get(table, {}).get(field.name)
        if default is not None:
            column = F.coalesce(column, F.lit(default).cast(field.dataType))
        elif field.name in EMPTY_ARRAYS.get(table, []):
            column = F.coalesce(column, F.array().cast(field.dataType))
        out.append(column.alias(field.name))
    return rows.select(*out, *beside)
