"""Queries that write the driver's tables to a store and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..session import shared_dir
from ..sources.derive import Graph
from ..sources.store import GraphStore
from ..streaming import events as streams
from ..streaming import feedback
from .catalogue import query


def _root(g: Graph) -> str:
    return f"{shared_dir(g.spark)}/loomgraph/{g.spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"


def _store(g: Graph) -> GraphStore:
    made = GraphStore(g.spark, _root(g))
    made.setup()
    return made


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


@query("""WITH c AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS name, type, aliases FROM concepts WHERE id % 20 <> 0)
SELECT id::VARCHAR AS id, name, CASE WHEN id % 5 = 0 THEN 'state' ELSE type END AS type, aliases[1] AS alias FROM c
UNION ALL SELECT 'new' || id, 'new ' || name, 'general', NULL FROM concepts WHERE id % 7 = 0""")
def store_upserts(g: Graph) -> DataFrame:
    """All concepts saved; every third gets another name, every fifth another type, every seventh a new twin, every twentieth is deleted (user input)."""
    store, rows = _store(g), g.concepts()
    store.save("concepts", rows.withColumn("id", F.col("id").cast("string")))
    named = rows.where("id % 3 = 0").select(F.col("id").cast("string").alias("id"), F.upper("name").alias("name"))
    new = rows.where("id % 7 = 0").select(F.concat(F.lit("new"), "id").alias("id"), F.concat(F.lit("new "), "name").alias("name"))
    store.save("concepts", named.unionByName(new))
    store.save("concepts", rows.where("id % 5 = 0").select(F.col("id").cast("string").alias("id"), F.lit("state").alias("type")))
    store.delete("concepts", rows.where("id % 20 = 0").select(F.col("id").cast("string").alias("id")))
    return store.read("concepts").select("id", "name", "type", F.get("aliases", F.lit(0)).alias("alias"))


@query("""WITH ec AS (SELECT DISTINCT episode_id, concept_id FROM episode_concept JOIN concepts ON concepts.id = concept_id),
em AS (SELECT DISTINCT e.id AS episode_id, m.id AS memory_id FROM episodes e JOIN memories m ON m.id = e.user_id),
md AS (SELECT DISTINCT memory_id, doc_id FROM memory_document JOIN docs ON docs.id = doc_id),
all_ AS (SELECT 'memory_concept' AS link, memory_id AS a, concept_id AS b FROM memory_concept UNION ALL SELECT 'memory_document', * FROM md UNION ALL SELECT 'episode_concept', * FROM ec UNION ALL SELECT 'episode_memory', * FROM em UNION ALL SELECT 'relations', source_id, target_id FROM relations)
SELECT link, a::VARCHAR AS a, b::VARCHAR AS b FROM all_""")
def store_links(g: Graph) -> DataFrame:
    """Nodes and links of all kinds in one commit; links to nodes that are not there (concept 0) are left out."""
    store = _store(g)
    own = store.begin()
    for table, rows in (("concepts", g.concepts()), ("memories", g.memories().drop("doc_id")), ("documents", g.documents()), ("episodes", g.episodes().drop("user_id"))):
        own.save(table, rows.withColumn("id", F.col("id").cast("string")))
    links = {
        "memory_concept": g.memory_concept(),
        "memory_document": g.memory_document(),
        "episode_concept": g.episode_concept(),
        "episode_memory": g.episodes().select(F.col("id").alias("episode_id"), F.col("user_id").alias("memory_id")),
    }
    for table, rows in links.items():
        own.save(table, _text(rows, *rows.columns))
    edges = g.relations()
    own.save("relations", edges.withColumns({c: F.col(c).cast("string") for c in ("source_id", "target_id")}))
    number = own.commit()
    found: DataFrame | None = None
    for table in [*links, "relations"]:
        rows = store.read(table, number)
        part = rows.select(F.lit(table).alias("link"), F.col(rows.columns[0]).alias("a"), F.col(rows.columns[1]).alias("b"))
        found = part if found is None else found.unionByName(part)
    return found


@query("SELECT id::VARCHAR AS id, content, round(importance, 6) AS importance, status FROM memories WHERE status <> 'archived' UNION ALL SELECT 'later', 'one more', 5.0, 'active'")
def store_rollback(g: Graph) -> DataFrame:
    """Archived memories are deleted, then everything is cleared; the state before that comes back and is written to again."""
    store = _store(g)
    rows = g.memories().withColumn("id", F.col("id").cast("string"))
    store.save("memories", rows)
    store.delete("memories", rows.where("status = 'archived'").select("id"))
    before = store.backup()
    store.clear()
    store.rollback(before)
    store.save("memories", g.spark.createDataFrame([("later", "one more")], "id string, content string"))
    store.compact("memories")
    return store.read("memories").select("id", "content", F.round("importance", 6).alias("importance"), "status")


@query("SELECT n.id::VARCHAR AS id, c.name FROM (SELECT id FROM concepts WHERE id % 20 = 0) n JOIN concepts c USING (id)")
def store_lookup(g: Graph) -> DataFrame:
    """Rows by a list of ids (the allowed query set), read from their buckets after an upsert."""
    store, rows = _store(g), g.concepts().withColumn("id", F.col("id").cast("string"))
    store.save("concepts", rows.withColumn("name", F.lit("old")))
    store.save("concepts", rows.select("id", "name"))
    wanted = [r["id"] for r in rows.where("cast(id AS bigint) % 20 = 0").select("id").collect()]  # stands for ids that a user asks for
    return store.get("concepts", [*wanted, "none"]).select("id", "name")


@query("""SELECT 'documents' AS name, count(DISTINCT doc_id) AS n FROM documents UNION ALL SELECT 'concepts', count(*) FROM (SELECT DISTINCT source FROM documents UNION SELECT DISTINCT lang FROM documents)
UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT source, lang FROM documents)
UNION ALL SELECT 'stored', count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL""", graph_views=False)
def ingested_documents(g: Graph) -> DataFrame:
    """Documents with the concepts and relations that were found in them, saved in one commit and counted in the store."""
    engine = Engine(g.spark, _root(g))
    docs = g.table("documents").select("doc_id", "text", "lang", "source")
    lines = F.concat(F.lit("CONCEPT|"), "source", F.lit("|resource|A source\nCONCEPT|language "), "lang", F.lit("|state|A language\nRELATION|"), "source", F.lit("|language "), "lang", F.lit("|uses|1"))
    counts = engine.ingest(docs.select("doc_id", "text"), docs.select(F.col("doc_id").alias("id"), lines.alias("raw")))
    same = engine.store.read("documents").join(docs.select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("h")), "id").where("source_hash = h AND status = 'completed'").select("id").distinct()
    rows = [(t, counts[t]) for t in ("documents", "concepts", "relations")] + [("stored", same.count())]
    return g.spark.createDataFrame(rows, "name string, n long")


@query("""WITH k AS (SELECT event_type, user_id, ts, CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'episode' ELSE 'memory' END AS node FROM events)
SELECT node, user_id::VARCHAR AS id, count_if(event_type IN ('purchase', 'signup')) AS successes, count_if(event_type = 'error') AS failures, count_if(node = 'memory') AS accesses, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM k GROUP BY node, user_id""", graph_views=False)
def feedback_stream(g: Graph) -> DataFrame:
    """All events as a stream of files in no order, some of them delivered twice (user input), applied to a store batch by batch."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("access")
    node = F.when(kind == "access", "memory").otherwise("episode")
    rows = g.table("events").select("event_id", node.alias("node"), F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    store, path = _store(g), f"{_root(g)}-events"
    rows.repartition(2, "event_id").write.parquet(path)
    rows.where("event_id % 7 = 0").coalesce(1).write.mode("append").parquet(path)
    changes = feedback.tallies(feedback.stream_of(g.spark, path), "40 days", keep=20)
    streams.drain(changes, f"{path}-state", feedback.applied(store), mode="update")
    none = F.lit(0).cast("long")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("last")
    episodes = store.read("episodes").select(F.lit("episode").alias("node"), "id", F.col("success_count").cast("long").alias("successes"), F.col("failure_count").cast("long").alias("failures"), none.alias("accesses"), shown("last_used"))
    return episodes.unionByName(store.read("memories").select(F.lit("memory").alias("node"), "id", none.alias("successes"), none.alias("failures"), F.col("access_count").alias("accesses"), shown("last_accessed")))
