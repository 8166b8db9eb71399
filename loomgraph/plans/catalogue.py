"""Queries over the driver's tables and their SQL.

Scores are rounded to six digits on both sides, as sums of doubles depend on
their order.  Every order ends in an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.providers import letter_similarities
from ..operators import evaluation, graph, learning, ranking, resolver, retrieval, search
from ..session import checkpointed
from ..sources.derive import SQL, Graph
from ..streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "1998-12-31 00:00:00"
RETRIEVED_AT = "2001-08-02 00:00:00"
EPISODES_AS_OF = "2024-01-20 00:00:00"
SEEDS = "seeds AS (SELECT source_id AS id FROM relations GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 3)"


def query(sql: str | None = None, *, graph_views: bool = True) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Register a function of a ``Graph`` under its name; ``sql`` may begin with further common table expressions."""

    def register(make: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Graph(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            with_more = text.upper().startswith("WITH ")
            ORACLE_SQL[make.__name__] = (f"WITH RECURSIVE {SQL}, {text[5:]}" if with_more else f"WITH {SQL} {text}") if graph_views else text
        return make

    return register


def now(at: str = AS_OF):
    return F.lit(at).cast("timestamp")


def seeds(g: Graph, k: int = 3) -> DataFrame:
    counts = g.relations().groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "id").limit(k).select("id")


# Filters and projections.


@query("SELECT id, name, type FROM concepts WHERE status IS NULL OR status = 'active'")
def active_concepts(g: Graph) -> DataFrame:
    return g.concepts().where(graph.is_active(F.col("status"))).select("id", "name", "type")


@query("SELECT id, status, round(importance, 6) AS importance FROM memories WHERE status IN ('active', 'deprioritized')")
def retrievable_memories(g: Graph) -> DataFrame:
    return g.memories().where(F.col("status").isin("active", "deprioritized")).select("id", "status", F.round("importance", 6).alias("importance"))


@query("SELECT id, name FROM concepts WHERE lower(name) = lower((SELECT name FROM concepts ORDER BY id LIMIT 1))")
def concept_by_name(g: Graph) -> DataFrame:
    first = g.concepts().orderBy("id").limit(1).select(F.lower("name").alias("n"))
    return g.concepts().join(F.broadcast(first), F.lower("name") == F.col("n")).select("id", "name")


@query("SELECT id, name FROM concepts WHERE len(list_filter(aliases, lambda a: lower(a) = 'brand#11')) > 0 AND (status IS NULL OR status = 'active')")
def concept_by_alias(g: Graph) -> DataFrame:
    hit = F.exists("aliases", lambda a: F.lower(a) == "brand#11")
    return g.concepts().where(hit & graph.is_active(F.col("status"))).select("id", "name")


@query("""
WITH hits AS (
  (SELECT 'concept' AS kind, id, name AS label FROM concepts WHERE contains(lower(name), 're') ORDER BY id LIMIT 50)
  UNION ALL (SELECT 'semantic', id, content FROM memories WHERE contains(lower(content), 're') ORDER BY id LIMIT 50)
  UNION ALL (SELECT 'episodic', id, behavior_name FROM episodes WHERE contains(lower(behavior_name), 're') ORDER BY id LIMIT 50))
SELECT kind, id, CASE WHEN length(label) > 60 THEN left(label, 60) || '...' ELSE label END AS label FROM hits""")
def search_nodes(g: Graph) -> DataFrame:
    sides = ((g.concepts(), "concept", "name"), (g.memories(), "semantic", "content"), (g.episodes(), "episodic", "behavior_name"))
    found = [df.where(F.lower(c).contains("re")).orderBy("id").limit(50).select(F.lit(kind).alias("kind"), "id", T.shorten(F.col(c), 60).alias("label")) for df, kind, c in sides]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT id, layout_x, layout_y FROM concepts WHERE layout_x BETWEEN 100 AND 400 AND layout_y BETWEEN 200 AND 600")
def viewport(g: Graph) -> DataFrame:
    return g.concepts().where(F.col("layout_x").between(100, 400) & F.col("layout_y").between(200, 600)).select("id", "layout_x", "layout_y")


@query("""
WITH d AS (SELECT id, count(r.source_id) AS degree FROM concepts LEFT JOIN relations r ON r.source_id = id GROUP BY id)
SELECT id, degree FROM d WHERE degree >= 0.5 * (SELECT max(degree) FROM d)""")
def relative_degree(g: Graph) -> DataFrame:
    counts = g.relations().groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    degree = g.concepts().select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    top = degree.agg(F.max("degree").alias("most"))
    return degree.join(F.broadcast(top)).where(F.col("degree") >= 0.5 * F.col("most")).select("id", "degree")


@query(f"""SELECT id FROM memories WHERE status = 'active' AND created_at <= TIMESTAMP '{AS_OF}' AND (last_accessed IS NULL OR last_accessed + INTERVAL 900 DAY >= TIMESTAMP '{AS_OF}')""")
def valid_memories(g: Graph) -> DataFrame:
    until = F.col("last_accessed") + F.expr("INTERVAL 900 DAYS")
    return g.memories().where((F.col("status") == "active") & (F.col("created_at") <= now()) & (until.isNull() | (until >= now()))).select("id")


@query(f"SELECT id, created_at FROM episodes WHERE created_at > TIMESTAMP '{EPISODES_AS_OF}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{EPISODES_AS_OF}' ORDER BY created_at DESC, id LIMIT 100")
def recent_episodes(g: Graph) -> DataFrame:
    at = now(EPISODES_AS_OF)
    return g.episodes().where((F.col("created_at") > at - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") <= at)).orderBy(F.desc("created_at"), "id").limit(100).select("id", "created_at")


@query("SELECT id, name, coalesce(type, 'unknown') AS type, activation_count FROM concepts ORDER BY activation_count DESC NULLS FIRST, id LIMIT 50 OFFSET 50")
def concept_page(g: Graph) -> DataFrame:
    return g.concepts().orderBy(F.desc_nulls_first("activation_count"), "id").offset(50).limit(50).select("id", "name", F.coalesce("type", F.lit("unknown")).alias("type"), "activation_count")


@query("SELECT id, memory_type, CASE WHEN length(content) > 12 THEN left(content, 12) || '...' ELSE content END AS content FROM memories WHERE memory_type = 'fact' ORDER BY importance DESC, id LIMIT 50")
def memory_page(g: Graph) -> DataFrame:
    return g.memories().where("memory_type = 'fact'").orderBy(F.desc("importance"), "id").limit(50).select("id", "memory_type", T.shorten(F.col("content"), 12).alias("content"))


@query("WITH " + SEEDS + """,
e AS (SELECT source_id, target_id, weight FROM relations WHERE source_id IN (SELECT id FROM seeds) UNION ALL SELECT target_id, source_id, weight FROM relations WHERE target_id IN (SELECT id FROM seeds))
SELECT source_id, target_id AS neighbor_id, name, max(weight) AS weight FROM e JOIN concepts ON id = target_id GROUP BY 1, 2, 3""")
def concept_neighbourhood(g: Graph) -> DataFrame:
    asked, rel = seeds(g), g.relations().select("source_id", "target_id", "weight")
    both = rel.unionByName(rel.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")).join(asked.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    named = both.join(g.concepts().select(F.col("id").alias("target_id"), "name"), "target_id")
    return named.groupBy("source_id", F.col("target_id").alias("neighbor_id"), "name").agg(F.max("weight").alias("weight"))


# Joins.


@query("WITH " + SEEDS + """
SELECT source_id, target_id, weight FROM (
  SELECT r.source_id, r.target_id, r.weight, row_number() OVER (PARTITION BY r.source_id ORDER BY r.weight DESC, r.target_id) AS n
  FROM relations r JOIN seeds s ON s.id = r.source_id JOIN concepts c ON c.id = r.target_id WHERE c.status IS NULL OR c.status = 'active') WHERE n <= 50""")
def neighbors(g: Graph) -> DataFrame:
    return graph.neighbours(seeds(g), g.relations(), g.concepts()).select("source_id", "target_id", "weight")


@query("WITH " + SEEDS + """
SELECT id, count(*) AS links, round(importance, 6) AS importance FROM memories m JOIN memory_concept k ON k.memory_id = m.id
WHERE k.concept_id IN (SELECT id FROM seeds) AND status IN ('active', 'deprioritized') GROUP BY id, importance ORDER BY count(*) DESC, importance DESC, id LIMIT 50""")
def memories_for_concepts(g: Graph) -> DataFrame:
    found = graph.memories_for(seeds(g), g.memory_concept(), g.memories())
    return found.orderBy(F.desc("links"), F.desc("importance"), "id").limit(50).select("id", "links", F.round("importance", 6).alias("importance"))


@query("WITH " + SEEDS.replace("LIMIT 3", "LIMIT 40") + """
SELECT id, count(*) AS links FROM memories m JOIN memory_concept k ON k.memory_id = m.id
WHERE k.concept_id IN (SELECT id FROM seeds) AND status IN ('active', 'deprioritized') GROUP BY id, importance HAVING count(*) >= 2 ORDER BY count(*) DESC, importance DESC, id LIMIT 50""")
def shared_memories(g: Graph) -> DataFrame:
    found = graph.memories_for(seeds(g, 40), g.memory_concept(), g.memories(), min_links=2)
    return found.orderBy(F.desc("links"), F.desc("importance"), "id").limit(50).select("id", "links")


@query("WITH " + SEEDS + """
SELECT DISTINCT d.id, d.title FROM docs d JOIN memory_document k ON k.doc_id = d.id JOIN memory_concept c ON c.memory_id = k.memory_id JOIN seeds s ON s.id = c.concept_id""")
def source_documents(g: Graph) -> DataFrame:
    asked = g.memory_concept().join(seeds(g).withColumnRenamed("id", "concept_id"), "concept_id", "left_semi").select("memory_id")
    return g.documents().join(g.memory_document().join(asked, "memory_id", "left_semi").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "title")


EPISODE_SQL = """WITH asked AS (SELECT DISTINCT concept_id FROM episode_concept WHERE concept_id BETWEEN 1 AND 9),
best AS (SELECT e.id, e.behavior_name, e.success_count, e.failure_count, count(DISTINCT k.concept_id) AS overlap FROM episodes e JOIN episode_concept k ON k.episode_id = e.id
  WHERE k.concept_id IN (SELECT concept_id FROM asked) AND success_count > failure_count {more} GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 3 DESC, 1 LIMIT {k})
SELECT id, behavior_name, overlap, round(success_count / (success_count + failure_count), 6) AS rate FROM best WHERE success_count / (success_count + failure_count) >= {rate}"""


def _episodes(g: Graph, behavior: str | None, rate: float, k: int) -> DataFrame:
    asked = g.spark.range(1, 10)
    found = learning.alternative_episodes(g.episodes(), g.episode_concept(), asked, behavior, rate, k)
    return found.select("id", "behavior_name", "overlap", F.round("rate", 6).alias("rate"))


@query(EPISODE_SQL.format(more="", k=10, rate=0.5))
def successful_episodes(g: Graph) -> DataFrame:
    return _episodes(g, None, 0.5, 10)


@query(EPISODE_SQL.format(more="AND behavior_name <> 'purchase'", k=5, rate=0.0))
def alternative_episodes(g: Graph) -> DataFrame:
    return _episodes(g, "purchase", 0.0, 5)


@query("WITH " + SEEDS.replace("LIMIT 3", "LIMIT 20") + " SELECT a.id AS a, b.id AS b FROM seeds a JOIN seeds b ON a.id < b.id")
def seed_pairs(g: Graph) -> DataFrame:
    top = seeds(g, 20)
    return top.select(F.col("id").alias("a")).join(F.broadcast(top.select(F.col("id").alias("b"))), F.expr("a < b"))


@query("SELECT id FROM concepts c WHERE (status IS NULL OR status = 'active') AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_id = c.id OR r.target_id = c.id)")
def orphans(g: Graph) -> DataFrame:
    return graph.orphans(g.concepts(), g.relations())


@query("SELECT c.id, count(e.x) AS degree FROM concepts c LEFT JOIN (SELECT source_id AS x FROM relations UNION ALL SELECT target_id FROM relations) e ON e.x = c.id GROUP BY c.id")
def node_degrees(g: Graph) -> DataFrame:
    return graph.degrees(g.concepts(), g.relations())


@query("SELECT source_id, target_id FROM relations WHERE source_id IN (SELECT id FROM concepts WHERE cluster < 4) AND target_id IN (SELECT id FROM concepts WHERE cluster < 4)")
def induced_links(g: Graph) -> DataFrame:
    return graph.induced(g.relations(), g.concepts().where("cluster < 4")).select("source_id", "target_id")


@query("""WITH e AS (SELECT source_id, target_id FROM relations UNION SELECT target_id, source_id FROM relations),
hubs AS (SELECT source_id AS hub FROM e GROUP BY 1 HAVING count(*) >= 8)
SELECT source_id AS id, target_id AS hub FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, target_id) AS n FROM e
  WHERE target_id IN (SELECT hub FROM hubs) AND source_id NOT IN (SELECT hub FROM hubs) GROUP BY 1, 2) WHERE n = 1""")
def primary_hubs(g: Graph) -> DataFrame:
    return graph.primary_hub(g.relations(), 8)


CENTROIDS = "m AS (SELECT cluster, avg(layout_x) AS cx, avg(layout_y) AS cy, count(*) AS n FROM concepts GROUP BY cluster)"


@query(f"WITH {CENTROIDS}" + """ SELECT id, cluster FROM (SELECT c.id, m.cluster, row_number() OVER (PARTITION BY c.id ORDER BY round(pow(layout_x - cx, 2) + pow(layout_y - cy, 2), 6), m.cluster) AS n
FROM concepts c, m) WHERE n = 1""")
def nearest_centroid(g: Graph) -> DataFrame:
    centers = g.concepts().groupBy("cluster").agg(F.avg("layout_x").alias("cx"), F.avg("layout_y").alias("cy"))
    return graph.nearest_centroid(g.concepts().select("id", F.col("layout_x").alias("x"), F.col("layout_y").alias("y")), centers)


@query("SELECT least(a.cluster, b.cluster) AS low, greatest(a.cluster, b.cluster) AS high, count(*) AS n FROM relations r JOIN concepts a ON a.id = r.source_id JOIN concepts b ON b.id = r.target_id WHERE a.cluster <> b.cluster GROUP BY 1, 2")
def cluster_edges(g: Graph) -> DataFrame:
    return graph.cluster_links(g.relations(), g.concepts())


# Aggregations.


@query("""SELECT 'concepts' AS kind, count(*) AS n FROM concepts UNION ALL SELECT 'memories', count(*) FROM memories UNION ALL SELECT 'documents', count(*) FROM docs
UNION ALL SELECT 'episodes', count(*) FROM episodes UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'memory_concept', count(*) FROM memory_concept""")
def graph_counts(g: Graph) -> DataFrame:
    frames = {"concepts": g.concepts(), "memories": g.memories(), "documents": g.documents(), "episodes": g.episodes(), "relations": g.relations(), "memory_concept": g.memory_concept()}
    out = None
    for kind, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT relation_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM relations), 1) AS pct FROM relations GROUP BY 1")
def edge_types(g: Graph) -> DataFrame:
    counts = g.relations().groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("relation_type", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("SELECT min(layout_x) AS min_x, max(layout_x) AS max_x, min(layout_y) AS min_y, max(layout_y) AS max_y, count(*) AS n, count(DISTINCT cluster) AS clusters FROM concepts")
def bounding_box(g: Graph) -> DataFrame:
    return g.concepts().agg(F.min("layout_x").alias("min_x"), F.max("layout_x").alias("max_x"), F.min("layout_y").alias("min_y"), F.max("layout_y").alias("max_y"), F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"))


@query("""SELECT count(*) AS total, count(*) FILTER (status IS NULL OR status = 'active') AS active, count(*) FILTER (status = 'merged') AS merged,
count(*) FILTER (enriched_definition IS NOT NULL) AS defined, round(count(*) FILTER (enriched_definition IS NOT NULL) / count(*), 6) AS coverage, sum(len(aliases))::BIGINT AS aliases FROM concepts""")
def concept_status(g: Graph) -> DataFrame:
    defined = F.count_if(F.col("enriched_definition").isNotNull())
    return g.concepts().agg(F.count(F.lit(1)).alias("total"), F.count_if(graph.is_active(F.col("status"))).alias("active"), F.count_if(F.col("status") == "merged").alias("merged"), defined.alias("defined"), F.round(defined / F.count(F.lit(1)), 6).alias("coverage"), F.sum(F.size("aliases")).alias("aliases"))


@query("""WITH d AS (SELECT c.id, count(e.x) AS degree FROM concepts c LEFT JOIN (SELECT source_id AS x FROM relations UNION ALL SELECT target_id FROM relations) e ON e.x = c.id GROUP BY c.id)
SELECT round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree FROM d""")
def degree_stats(g: Graph) -> DataFrame:
    return graph.degrees(g.concepts(), g.relations()).agg(F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"))


@query("""SELECT coalesce(source_type, 'document') AS source_type, count(*) AS n, count(*) FILTER (is_semantic) AS semantic, count(*) FILTER (NOT is_semantic) AS contextual,
count(*) FILTER (is_universal) AS universal, round(count(*) FILTER (is_semantic) / count(*), 6) AS ratio FROM relations GROUP BY 1""")
def edge_quality(g: Graph) -> DataFrame:
    n, semantic = F.count(F.lit(1)), F.count_if("is_semantic")
    return g.relations().groupBy(F.coalesce("source_type", F.lit("document")).alias("source_type")).agg(n.alias("n"), semantic.alias("semantic"), F.count_if(~F.col("is_semantic")).alias("contextual"), F.count_if("is_universal").alias("universal"), F.round(semantic / n, 6).alias("ratio"))


@query("""WITH a AS (SELECT user_id, count(*) FILTER (success_count > failure_count) AS n_successful, round(sum(success_count) / greatest(sum(success_count) + sum(failure_count), 1), 6) AS rate,
round(avg(importance), 6) AS importance, count(DISTINCT domain) AS n_domains FROM episodes GROUP BY user_id)
SELECT *, ((n_successful >= 3)::INT + (rate >= 0.85)::INT + (importance >= 7)::INT + (n_domains >= 2)::INT) >= 3 AS ripe FROM a""")
def consolidation_candidates(g: Graph) -> DataFrame:
    found = learning.consolidation(g.episodes(), "user_id")
    return found.select("user_id", "n_successful", F.round("rate", 6).alias("rate"), F.round("importance", 6).alias("importance"), "n_domains", "ripe")


@query(f"""WITH r AS (SELECT importance FROM episodes WHERE created_at > TIMESTAMP '{EPISODES_AS_OF}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{EPISODES_AS_OF}' ORDER BY created_at DESC, id LIMIT 100)
SELECT coalesce(sum(importance), 0.0)::DOUBLE AS total, count(*) AS n, coalesce(sum(importance), 0.0) >= 150 AS due FROM r""")
def reflection_trigger(g: Graph) -> DataFrame:
    return learning.reflection_due(g.episodes(), now(EPISODES_AS_OF))


@query("SELECT domain, behavior_name, count(*) AS n FROM episodes GROUP BY ROLLUP (domain, behavior_name)")
def behaviour_rollup(g: Graph) -> DataFrame:
    return g.episodes().rollup("domain", "behavior_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CENTROIDS} SELECT cluster, round(cx, 6) AS cx, round(cy, 6) AS cy, n FROM m")
def cluster_metadata(g: Graph) -> DataFrame:
    return g.concepts().groupBy("cluster").agg(F.round(F.avg("layout_x"), 6).alias("cx"), F.round(F.avg("layout_y"), 6).alias("cy"), F.count(F.lit(1)).alias("n"))


@query("WITH " + SEEDS + """ SELECT count(*) AS edges, (SELECT count(*) FROM memory_concept WHERE concept_id IN (SELECT id FROM seeds)) AS memories
FROM relations WHERE source_id IN (SELECT id FROM seeds) OR target_id IN (SELECT id FROM seeds)""")
def merge_impact(g: Graph) -> DataFrame:
    asked = seeds(g).withColumn("hit", F.lit(True))
    edges = g.relations().join(asked.toDF("source_id", "s"), "source_id", "left").join(asked.toDF("target_id", "t"), "target_id", "left").where("s OR t").agg(F.count(F.lit(1)).alias("edges"))
    touched = g.memory_concept().join(asked.withColumnRenamed("id", "concept_id"), "concept_id", "left_semi").agg(F.count(F.lit(1)).alias("memories"))
    return edges.join(F.broadcast(touched))


# Ranking and fusion.

LISTS = """lists AS (SELECT 'bm25' AS source, id, importance AS score FROM memories UNION ALL SELECT 'graph', id, strength FROM memories
UNION ALL SELECT 'path', id, confidence + importance FROM memories WHERE memory_type <> 'fact'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM lists)"""


def _lists(g: Graph) -> DataFrame:
    """Three rankings of the memories; the last one knows no facts, so some memories miss from it."""
    m = g.memories()
    parts = [("bm25", F.col("importance"), m), ("graph", F.col("strength"), m), ("path", F.col("confidence") + F.col("importance"), m.where("memory_type <> 'fact'"))]
    frames = [rows.select(F.lit(s).alias("source"), "id", c.alias("score")) for s, c, rows in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(f"WITH {LISTS} SELECT id, round(sum(1.0 / (60 + rank)), 9) AS fused, string_agg(source, '+' ORDER BY source) AS sources FROM ranked GROUP BY id")
def rrf(g: Graph) -> DataFrame:
    return ranking.fuse(_lists(g), wide=True).select("id", F.round("fused", 9).alias("fused"), F.array_join("sources", "+").alias("sources"))


@query(f"WITH {LISTS} SELECT id, round(sum(CASE source WHEN 'bm25' THEN 0.25 WHEN 'graph' THEN 0.2 ELSE 0.3 END / (60 + rank)), 9) AS fused FROM ranked GROUP BY id")
def weighted_rrf(g: Graph) -> DataFrame:
    return ranking.fuse(_lists(g), weights=retrieval.WEIGHTS, wide=True).select("id", F.round("fused", 9).alias("fused"))


@query("""SELECT id, status, round(CASE WHEN high > low THEN (importance - low) / (high - low) ELSE 1.0 END, 6) AS normalized
FROM (SELECT *, min(importance) OVER (PARTITION BY status) AS low, max(importance) OVER (PARTITION BY status) AS high FROM memories)""")
def min_max(g: Graph) -> DataFrame:
    return ranking.min_max(g.memories(), ["status"], "importance").select("id", "status", F.round("normalized", 6).alias("normalized"))


@query("SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS n FROM relations) WHERE n <= 10")
def top_neighbours(g: Graph) -> DataFrame:
    return ranking.top_k(g.relations(), ["source_id"], [F.desc("weight"), F.asc("target_id")], 10).select("source_id", "target_id", "weight")


SENTENCES = r"""t AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace({held}, '([.!?])\s+([A-ZА-ЯЁ0-9])', '\1' || chr(2) || '\2', 'g'), '\n\s*([-•*])', chr(10) || chr(2) || '\1', 'g'), chr(2)) AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, list_filter(list_transform(parts, lambda x: regexp_replace(replace(x, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b FROM t),
sent AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a WHEN len(b) > 0 THEN b ELSE [text] END AS s FROM p)"""
_held = "text"
for _short in sorted(T.ABBREVIATIONS, key=len, reverse=True):
    _held = f"replace({_held}, '{_short}', '{_short.replace('.', chr(1))}')"
SENTENCES = SENTENCES.replace("{held}", _held)
LETTERS = "list_transform(range(97, 123), lambda c: (length(lower(x)) - length(replace(lower(x), chr(c::INT), '')))::DOUBLE)"
BREAKS = SENTENCES + f""",
e AS (SELECT doc_id, list_transform(s, lambda x: {LETTERS}) AS v FROM sent), i AS (SELECT doc_id, unnest(range(1, len(v))) AS i, v FROM e),
sim AS (SELECT doc_id, i AS idx, round(coalesce(CASE WHEN list_sum(v[i]) > 0 AND list_sum(v[i + 1]) > 0 THEN list_cosine_similarity(v[i], v[i + 1]) END, 0), 9) AS similarity FROM i),
br AS (SELECT doc_id, idx, similarity, similarity < 0.5 OR coalesce(similarity < 0.7 * (lag(similarity) OVER w + lead(similarity) OVER w) / 2, false) AS is_break FROM sim WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""


def sentences_of(g: Graph) -> DataFrame:
    """doc_id, idx (from 0) and sentence of each text."""
    return g.table("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


def sentence_breaks(g: Graph) -> DataFrame:
    """doc_id, sentences of each text, and for each sentence but the first whether it is a break to the one before, by their letters; a text is a row, so nothing is shuffled."""
    rows = g.table("documents").where("text IS NOT NULL").select("doc_id", T.sentences(F.col("text")).alias("sentences"))
    near = rows.withColumn("similarities", F.transform(letter_similarities(F.transform("sentences", F.lower)), lambda x: F.round(x, 9)))
    return near.select("doc_id", "sentences", ranking.breaks_in(F.col("similarities")).alias("breaks"))


@query(f"WITH {BREAKS} SELECT doc_id, idx::INT AS idx, is_break FROM br", graph_views=False)
def semantic_breaks(g: Graph) -> DataFrame:
    # posexplode alone would add a filter on the list, for which all sentences are split once more.
    return sentence_breaks(g).select("doc_id", F.posexplode_outer("breaks").alias("idx", "is_break")).where("idx IS NOT NULL").withColumn("idx", (F.col("idx") + 1).cast("int"))


@query("SELECT id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, id) AS n FROM memories) WHERE n = 1 ORDER BY importance DESC, id LIMIT 5")
def distinct_sources(g: Graph) -> DataFrame:
    return ranking.first_of(g.memories(), [F.col("doc_id")], [F.desc("importance"), F.asc("id")], 5).select("id", "doc_id")


@query("""WITH r AS (SELECT id, importance, strength / 2.5 AS again, row_number() OVER (ORDER BY importance DESC, id) AS n FROM memories WHERE memory_type = 'fact')
SELECT id, round(CASE WHEN n <= 64 THEN (importance + again) / 2 ELSE importance END, 6) AS blended,
row_number() OVER (ORDER BY n > 64, CASE WHEN n <= 64 THEN (importance + again) / 2 ELSE importance END DESC, id)::INT AS place FROM r QUALIFY place <= 200""")
def rerank_head(g: Graph) -> DataFrame:
    top = g.memories().where("memory_type = 'fact'").orderBy(F.desc("importance"), "id").limit(200).select("id", "importance", (F.col("strength") / 2.5).alias("again"))
    return ranking.head_blend(top, [], "importance", "again").select("id", F.round("blended", 6).alias("blended"), "place")


# Graph algorithms.


def _hop(n: int, close: str) -> str:
    """Common table expressions of one more hop of activation."""
    p = n - 1
    return f"""n{n} AS (SELECT r.*, f.activation AS carried, f.path, row_number() OVER (PARTITION BY r.source_id ORDER BY r.weight DESC, r.target_id) AS k
  FROM edges r JOIN g{p} f ON f.id = r.source_id AND f.activation >= 0.15 JOIN concepts c ON c.id = r.target_id WHERE c.status IS NULL OR c.status = 'active'),
m{n} AS (SELECT target_id AS id, path, round(carried * weight * {close} * 0.85 * 0.4 * CASE WHEN is_universal AND is_semantic THEN 1.5 ELSE 1.0 END, 12) AS moved
  FROM n{n} WHERE k <= 50 AND target_id NOT IN (SELECT id FROM seeds) AND {close} >= 0.15),
f{n} AS (SELECT id, sum(moved) AS fresh, (array_agg(path ORDER BY moved DESC, path))[1] AS behind FROM m{n} GROUP BY 1 ORDER BY round(sum(moved), 9) DESC, id LIMIT 20),
g{n} AS (SELECT f{n}.id, f{n}.fresh AS activation, behind || '-' || f{n}.id AS path FROM f{n} LEFT JOIN b{p} b ON b.id = f{n}.id WHERE b.id IS NULL OR f{n}.fresh > b.activation),
b{n} AS (SELECT id, activation, {n} AS hop, path FROM g{n} UNION ALL SELECT id, activation, hop, path FROM b{p} WHERE id NOT IN (SELECT id FROM g{n}))"""


def _hops(hops: int, edges: str = "SELECT * FROM relations", close: str = "1.0") -> str:
    start = f"edges AS ({edges}), g0 AS (SELECT id, 1.0::DOUBLE AS activation, id::VARCHAR AS path FROM seeds), b0 AS (SELECT id, activation, 0 AS hop, path FROM g0)"
    return ", ".join([start, *[_hop(n, close) for n in range(1, hops + 1)]])


def _activation(hops: int, **options: str) -> str:
    return f"WITH {SEEDS}, {_hops(hops, **options)} SELECT id, round(activation, 6) AS activation, hop, path FROM b{hops}"


def _activated(g: Graph, hops: int) -> DataFrame:
    found = graph.activate(checkpointed(seeds(g)), checkpointed(g.relations()), checkpointed(g.concepts()), hops=hops)
    return found.select("id", F.round("activation", 6).alias("activation"), "hop", "path")


@query(_activation(1))
def activation_1_hop(g: Graph) -> DataFrame:
    return _activated(g, 1)


@query(_activation(3))
def activation_3_hops(g: Graph) -> DataFrame:
    return _activated(g, 3)


CLOSE = """SELECT r.*, round((1 + list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2, 9) AS close
  FROM relations r JOIN embeddings v ON v.vec_id = (r.source_id + r.target_id) % 100"""


@query(_activation(3, edges=CLOSE, close="close"))
def activation_by_relevance(g: Graph) -> DataFrame:
    """Edges carry embeddings, and those far from the question's pass less on."""
    v = g.table("embeddings")
    asked = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    near = v.where("vec_id < 100").join(F.broadcast(asked)).select("vec_id", F.round((1 + S.cosine(F.col("embedding"), F.col("q"))) / 2, 9).alias("close"))
    edges = g.relations().withColumn("vec_id", (F.col("source_id") + F.col("target_id")) % 100).join(F.broadcast(near), "vec_id").drop("vec_id")  # 100 rows
    found = graph.activate(checkpointed(seeds(g)), checkpointed(edges), checkpointed(g.concepts()), F.col("close"))
    return found.select("id", F.round("activation", 6).alias("activation"), "hop", "path")


QUESTION_VECTOR = "WITH qv AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), cv AS (SELECT c.id, list_cosine_similarity(v.embedding::DOUBLE[], q.e) AS score FROM concepts c JOIN embeddings v ON v.vec_id = c.id % 200, qv q), seeds AS (SELECT id FROM cv ORDER BY round(score, 9) DESC, id LIMIT 5)"


@query(f"{QUESTION_VECTOR}, {_hops(2)} SELECT id, round(activation, 6) AS activation, hop, path FROM b2")
def activation_from_question(g: Graph) -> DataFrame:
    """The concepts nearest to a question's vector are the seeds."""
    v = g.table("embeddings")
    asked = [float(x) for x in v.where("vec_id = 0").first()["embedding"]]
    vectors = g.concepts().select("id", (F.col("id") % 200).alias("vec_id")).join(v.select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    found = graph.activate_from(asked, vectors, checkpointed(g.relations()), checkpointed(g.concepts()), hops=2)
    return found.select("id", F.round("activation", 6).alias("activation"), "hop", "path")


PATHS = "WITH " + SEEDS.replace("LIMIT 3", "LIMIT 12") + """, e AS (SELECT source_id AS a, target_id AS b FROM relations UNION SELECT target_id, source_id FROM relations),
walk AS (SELECT id AS a, id AS tip, [id] AS path, 0 AS length FROM seeds UNION ALL SELECT w.a, e.b, list_append(w.path, e.b), w.length + 1 FROM walk w JOIN e ON e.a = w.tip WHERE w.length < 3 AND NOT list_contains(w.path, e.b))
"""


@query(PATHS + """SELECT a, b, length, array_to_string(path, '-') AS path FROM (SELECT a, tip AS b, length, path, row_number() OVER (PARTITION BY a, tip ORDER BY length, path) AS n FROM walk WHERE a < tip AND tip IN (SELECT id FROM seeds)) WHERE n = 1""")
def shortest_paths(g: Graph) -> DataFrame:
    found = graph.shortest_paths(seeds(g, 12), g.relations())
    return found.select("a", "b", "length", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@query("WITH " + SEEDS.replace("LIMIT 3", "LIMIT 12") + """, e AS (SELECT source_id AS a, target_id AS b FROM relations UNION SELECT target_id, source_id FROM relations),
one AS (SELECT s.id AS q, e.b AS tip FROM seeds s JOIN e ON e.a = s.id), two AS (SELECT q, tip FROM one UNION SELECT one.q, e.b FROM one JOIN e ON e.a = one.tip)
SELECT tip AS id, count(*) AS reached FROM two JOIN concepts c ON c.id = tip WHERE tip NOT IN (SELECT id FROM seeds) AND (status IS NULL OR status = 'active') GROUP BY tip HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20""")
def bridge_concepts(g: Graph) -> DataFrame:
    return graph.bridges(seeds(g, 12), g.relations(), g.concepts())


@query("""WITH m AS (SELECT source_id - source_id % 4 AS s, target_id - target_id % 4 AS t, weight, co_occurrence_count AS n FROM relations)
SELECT s AS source_id, t AS target_id, max(weight) AS weight FROM m WHERE s <> t GROUP BY 1, 2""")
def merged_edges(g: Graph) -> DataFrame:
    ids = g.relations().select(F.col("source_id").alias("id")).distinct()
    return graph.redirect(g.relations().select("source_id", "target_id", "weight", "co_occurrence_count"), ids.withColumn("canonical", F.col("id") - F.col("id") % 4)).select("source_id", "target_id", "weight")


@query()
def communities(g: Graph) -> DataFrame:
    return graph.propagate_labels(g.concepts(), g.relations(), rounds=3)


# Search.

BM25 = """WITH toks AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents),
dl AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT token, id, count(*) AS tf FROM toks GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark),
s AS (SELECT query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (token) JOIN df USING (token) JOIN dl ON dl.id = p.id, st GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s) WHERE n <= 10"""


@query(BM25, graph_views=False)
def bm25(g: Graph) -> DataFrame:
    index = search.Bm25Index(g.table("documents"), item="doc_id", text="text")
    return index.search(g.table("benchmark").withColumnRenamed("item_id", "query_id"), k=10).select("query_id", "id", F.round("score", 6).alias("score"))


KNN = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM q, embeddings)
SELECT query_id, id, round({score}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s) WHERE n <= 10"""


def _vectors(g: Graph) -> tuple[DataFrame, DataFrame]:
    rows = g.table("embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows.withColumnRenamed("vec_id", "id")


@query(KNN.format(score="score"), graph_views=False)
def knn(g: Graph) -> DataFrame:
    return search.nearest(*_vectors(g), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query(KNN.format(score="(1 + score) / 2"), graph_views=False)
def knn_index_score(g: Graph) -> DataFrame:
    return search.nearest(*_vectors(g), 10, as_index_score=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def ivf_search(g: Graph) -> DataFrame:
    asked, rows = _vectors(g)
    return search.IvfIndex(rows, cells=16).search(asked, 10, probes=4)


@query()
def mmr(g: Graph) -> DataFrame:
    """Ten vectors for each question, chosen among all, near to it and far from each other."""
    return search.diverse(*_vectors(g), 10)


# Learning.


@query("""SELECT id, round(CASE WHEN q >= 3 THEN least(greatest(strength + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02), 1.3), 2.5) ELSE greatest(strength - 0.2, 1.3) END, 6) AS strength,
access_count + CASE WHEN q >= 3 THEN 1 ELSE 0 END AS access_count FROM (SELECT *, id % 6 AS q FROM memories)""")
def sm2(g: Graph) -> DataFrame:
    m = g.memories()
    return learning.review(m, m.select("id", (F.col("id") % 6).alias("quality")), now()).select("id", F.round("strength", 6).alias("strength"), "access_count")


@query("WITH " + SEEDS.replace("LIMIT 3", "LIMIT 30") + """ SELECT source_id, target_id, round(CASE WHEN source_id IN (SELECT id FROM seeds) AND target_id IN (SELECT id FROM seeds) THEN least(1.0, weight + 0.05) ELSE weight END, 6) AS weight FROM relations""")
def hebbian_up(g: Graph) -> DataFrame:
    return learning.hebbian(g.relations(), seeds(g, 30), 0.05).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


@query("WITH " + SEEDS.replace("LIMIT 3", "LIMIT 30") + """ SELECT source_id, target_id, round(CASE WHEN source_id IN (SELECT id FROM seeds) AND target_id IN (SELECT id FROM seeds) THEN greatest(0.1, weight - 0.02) ELSE weight END, 6) AS weight FROM relations""")
def hebbian_down(g: Graph) -> DataFrame:
    return learning.hebbian(g.relations(), seeds(g, 30), -0.02).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


FORGET = f"""WITH h AS (SELECT id, status, list_sum(list_transform(range(0, access_count), lambda i: pow(greatest((epoch_us(TIMESTAMP '{AS_OF}') - (epoch_us(created_at) + floor((epoch_us(last_accessed) - epoch_us(created_at)) * i / access_count)))::DOUBLE / 1e6, 1.0), -0.5))) AS s FROM memories),
l AS (SELECT id, status, CASE WHEN status IN ('active', 'deprioritized') THEN CASE WHEN coalesce(s, 0) > 0 THEN ln(s) ELSE '-inf'::DOUBLE END END AS b FROM h)
"""


@query(FORGET + "SELECT id, CASE WHEN b IS NULL THEN status WHEN b < -2.5 THEN 'archived' WHEN b < -1 THEN 'deprioritized' ELSE 'active' END AS status, round(CASE WHEN isinf(b) THEN -1e9 ELSE b END, 4) AS activation FROM l")
def forgetting(g: Graph) -> DataFrame:
    found = learning.forget(g.memories(), now())
    level = F.when(F.col("base_level_activation") == float("-inf"), -1e9).otherwise(F.col("base_level_activation"))
    return found.select("id", "status", F.round(level, 4).alias("activation"))


@query("SELECT status, count(*) AS n FROM memories GROUP BY 1")
def status_histogram(g: Graph) -> DataFrame:
    return learning.status_histogram(g.memories())


@query("SELECT id, round(CASE WHEN strength > 1.3 THEN greatest(1.3, strength * 0.99) ELSE strength END, 6) AS strength FROM memories")
def calibrated(g: Graph) -> DataFrame:
    return learning.calibrate(g.memories()).select("id", F.round("strength", 6).alias("strength"))


@query("""WITH n AS (SELECT DISTINCT name FROM concepts), p AS (SELECT a.name AS a, b.name AS b, round(jaro_winkler_similarity(a.name, b.name), 6) AS similarity FROM n a JOIN n b ON a.name < b.name)
SELECT a, b, similarity, CASE WHEN similarity >= 0.95 THEN 'high' WHEN similarity >= 0.8 THEN 'medium' WHEN similarity >= 0.6 THEN 'low' ELSE 'none' END AS confidence FROM p WHERE similarity >= 0.8""")
def similar_names(g: Graph) -> DataFrame:
    names = g.concepts().select("name").distinct()
    scored = resolver.alike(names.select(F.col("name").alias("a")), names.select(F.col("name").alias("b"))).where("a < b").withColumn("similarity", F.round("similarity", 6))
    return scored.select("a", "b", "similarity", S.match_confidence(F.col("similarity")).alias("confidence"))


# Evaluation.

JUDGED = """WITH j AS (SELECT d.lang AS query_id, d.doc_id AS item_id, quality AS relevance FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT lang AS query_id, doc_id AS item_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50), c AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
t AS (SELECT query_id, count(*) AS n_rel FROM j WHERE relevance > 0 GROUP BY 1), h AS (SELECT r.* FROM r JOIN j USING (query_id, item_id) WHERE relevance > 0),
i AS (SELECT query_id, k, (SELECT sum(1.0 / log2(x + 1)) FROM range(1, least(k, n_rel) + 1) g(x)) AS best FROM t, c)
SELECT q.query_id, c.k, round(coalesce((SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank <= c.k) / n_rel, 0), 6) AS recall,
round((SELECT count(*) FROM h WHERE h.query_id = q.query_id AND rank <= c.k) / c.k, 6) AS precision, round(coalesce((SELECT 1.0 / min(rank) FROM h WHERE h.query_id = q.query_id), 0), 6) AS mrr,
round(coalesce((SELECT sum(1.0 / log2(rank + 1)) FROM h WHERE h.query_id = q.query_id AND rank <= c.k) / best, 0), 6) AS ndcg
FROM (SELECT DISTINCT query_id FROM r) q CROSS JOIN c LEFT JOIN t USING (query_id) LEFT JOIN i ON i.query_id = q.query_id AND i.k = c.k"""


@query(JUDGED, graph_views=False)
def retrieval_metrics(g: Graph) -> DataFrame:
    docs = g.table("documents").select("doc_id", "lang", "n_chars")
    judged = g.table("labels").join(docs, "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), F.col("quality").alias("relevance"))
    runs = ranking.ranked(docs, ["lang"], [F.desc("n_chars"), F.asc("doc_id")]).where("rank <= 50").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id"), "rank")
    found = evaluation.metrics(runs, judged)
    return found.select("query_id", "k", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


# Text.

_stops = ", ".join(f"'{w}'" for w in T.STOPWORDS)
QUALITY = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS d, len(list_filter(w, lambda x: x NOT IN ({_stops}))) AS k, len(list_distinct(list_filter(w, lambda x: x NOT IN ({_stops})))) AS kd FROM w)
SELECT doc_id, round(CASE WHEN n < 5 THEN 0.0 ELSE 0.2 * least(1.0, n / 20.0) * CASE WHEN n > 500 THEN 0.9 ELSE 1.0 END + 0.3 * CASE WHEN n < 50 THEN least(1.0, d / n * 1.2) ELSE d / n END + 0.25 * k / n + 0.25 * kd / n END, 6) AS quality FROM c"""


@query(QUALITY, graph_views=False)
def chunk_quality(g: Graph) -> DataFrame:
    return T.with_quality(g.table("documents").select("doc_id", "text"), "text").select("doc_id", F.round("quality", 6).alias("quality"))


@query(f"SELECT doc_id FROM ({QUALITY}) WHERE quality >= 0.4", graph_views=False)
def good_chunks(g: Graph) -> DataFrame:
    return T.good_chunks(g.table("documents").select("doc_id", "text"), "text").select("doc_id")


@query("SELECT doc_id, sha256(text) AS source_hash FROM documents", graph_views=False)
def content_hash(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))


@query("SELECT conv_id, text AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1", graph_views=False)
def last_questions(g: Graph) -> DataFrame:
    asked = g.table("conversations").where("role = 'user'")
    return asked.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


@query("SELECT page_id, length(html) AS n_html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages", graph_views=False)
def page_hosts(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", F.char_length("html").cast("bigint").alias("n_html"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([^\s]) {2,}', '\1 ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""", graph_views=False)
def clean_whitespace(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


# Streams; on a table their transformations are ordinary aggregations.


@query("""SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, sum(1.0 + event_id % 10)::DOUBLE AS total, count(*) AS n, sum(1.0 + event_id % 10) >= 150 AS due
FROM (SELECT event_id, unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS window_start FROM events) GROUP BY 1""", graph_views=False)
def importance_windows(g: Graph) -> DataFrame:
    return streams.importance_windows(g.table("events"))


@query("""WITH o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events, round(sum(value), 4) AS total_value FROM s GROUP BY user_id, k""", graph_views=False)
def user_sessions(g: Graph) -> DataFrame:
    return streams.sessions(g.table("events")).withColumn("total_value", F.round("total_value", 4))


@query("SELECT event_type, count(*) FILTER (event_type IN ('purchase', 'signup')) AS successes, count(*) FILTER (event_type = 'error') AS failures, count(*) AS n FROM events GROUP BY 1", graph_views=False)
def feedback_counters(g: Graph) -> DataFrame:
    return streams.feedback_counters(g.table("events"))


# The flagship: one retrieval from a question to ranked memories.

QUESTION = "q AS (SELECT 'urgent order ' || (SELECT string_agg(id::VARCHAR, ' ' ORDER BY id) FROM seeds) AS text)"
WORDS_LIST = """toks AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS token FROM memories), dl AS (SELECT id, count(*) AS dl FROM toks GROUP BY 1), st AS (SELECT (SELECT count(*) FROM memories) AS n, sum(dl) / (SELECT count(*) FROM memories) AS avgdl FROM dl),
post AS (SELECT token, id, count(*) AS tf FROM toks GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM post GROUP BY 1), qt AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM q),
bm AS (SELECT post.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN post USING (token) JOIN df USING (token) JOIN dl ON dl.id = post.id, st GROUP BY 1),
by_words AS (SELECT bm.id, score FROM bm JOIN memories m ON m.id = bm.id WHERE status IN ('active', 'deprioritized') ORDER BY score DESC, bm.id LIMIT 50)"""
VECTOR_LIST = """vs AS (SELECT m.id, round(list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM memories m JOIN embeddings v ON v.vec_id = m.id % 200 WHERE status IN ('active', 'deprioritized')),
by_vector AS (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 50)"""
GRAPH_LIST = """ac AS (SELECT id, activation FROM b3), gm AS (SELECT m.id, m.importance, count(*) AS links FROM memories m JOIN memory_concept k ON k.memory_id = m.id WHERE k.concept_id IN (SELECT id FROM ac WHERE activation >= 0.15) AND status IN ('active', 'deprioritized') GROUP BY 1, 2 ORDER BY links DESC, importance DESC, id LIMIT 200),
by_graph AS (SELECT gm.id, round(sum(activation), 9) AS score FROM gm JOIN memory_concept k ON k.memory_id = gm.id JOIN ac ON ac.id = k.concept_id GROUP BY 1)"""
PATH_LIST = """e2 AS (SELECT source_id AS a, target_id AS b FROM relations UNION SELECT target_id, source_id FROM relations),
w1 AS (SELECT s.id AS a, e.b AS tip, [s.id, e.b] AS path FROM seeds s JOIN e2 e ON e.a = s.id),
w2 AS (SELECT w.a, e.b AS tip, min(list_append(w.path, e.b)) AS path FROM w1 w JOIN e2 e ON e.a = w.tip WHERE NOT list_contains(w.path, e.b) GROUP BY 1, 2),
w3 AS (SELECT w.a, e.b AS tip, min(list_append(w.path, e.b)) AS path FROM w2 w JOIN e2 e ON e.a = w.tip WHERE NOT list_contains(w.path, e.b) GROUP BY 1, 2),
ways AS (SELECT a, tip, path, row_number() OVER (PARTITION BY a, tip ORDER BY len(path)) AS n FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) WHERE a < tip AND tip IN (SELECT id FROM seeds)),
between_ AS (SELECT DISTINCT unnest(path) AS id FROM ways WHERE n = 1), mid AS (SELECT id FROM between_ WHERE id NOT IN (SELECT id FROM seeds)),
sh AS (SELECT m.id, m.importance, count(*) AS links FROM memories m JOIN memory_concept k ON k.memory_id = m.id WHERE k.concept_id IN (SELECT id FROM seeds) AND status IN ('active', 'deprioritized') GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY links DESC, importance DESC, id LIMIT 50),
pm AS (SELECT m.id, m.importance, count(*) AS links FROM memories m JOIN memory_concept k ON k.memory_id = m.id WHERE k.concept_id IN (SELECT id FROM mid) AND status IN ('active', 'deprioritized') AND m.id NOT IN (SELECT id FROM sh) GROUP BY 1, 2 ORDER BY importance DESC, id LIMIT 50),
by_path AS (SELECT id, round((links / (SELECT count(*) FROM seeds) * 0.6 + importance / 10 * 0.4) * (1 + (links - 1) * 0.5), 9) AS score FROM sh UNION ALL SELECT id, round(importance / 10 * (1 + (links - 1) * 0.3) * 0.7, 9) FROM pm)"""
FUSED = f"""al AS (SELECT 'bm25' AS source, * FROM by_words UNION ALL SELECT 'graph', * FROM by_graph UNION ALL SELECT 'path', * FROM by_path UNION ALL SELECT 'vector', * FROM by_vector),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM al),
fu AS (SELECT id, sum(CASE source WHEN 'bm25' THEN 0.25 WHEN 'vector' THEN 0.25 WHEN 'graph' THEN 0.2 ELSE 0.3 END / (60 + rank)) AS fused, string_agg(source, '+' ORDER BY source) AS sources FROM rk GROUP BY 1),
ba AS (SELECT fu.id, sources, fused, 0.2 * pow(0.995, (epoch_us(TIMESTAMP '{RETRIEVED_AT}') - epoch_us(last_accessed::TIMESTAMP)) / 3.6e9) + 0.3 * importance / 10 + 0.5 * fused * 10 AS base FROM fu JOIN memories m ON m.id = fu.id)"""
RETRIEVE = f"WITH {SEEDS}, {_hops(3)}, {QUESTION}, {WORDS_LIST}, {VECTOR_LIST}, {GRAPH_LIST}, {PATH_LIST}, {FUSED}"
RETRIEVED = RETRIEVE + " SELECT id, sources, round(fused, 6) AS fused, round(base * 0.8 + base * 1.0 * 0.2, 6) AS score FROM ba ORDER BY score DESC, id LIMIT 20"


def memory_vectors(g: Graph) -> DataFrame:
    return g.memories().select("id", (F.col("id") % 200).alias("vec_id")).join(g.table("embeddings").select("vec_id", "embedding"), "vec_id").select("id", "embedding")


def all_lists(g: Graph) -> dict[str, DataFrame]:
    """BM25, vector, graph and path list of one question about the seeds."""
    top, relations = checkpointed(seeds(g)), checkpointed(g.relations())
    concepts, links, memories = checkpointed(g.concepts()), g.memory_concept(), g.memories()
    asked = top.agg(F.concat(F.lit("urgent order "), F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), " ")).alias("text")).select(F.lit(0).alias("query_id"), "text")
    vector = g.table("embeddings").where("vec_id = 0").select(F.lit(0).alias("query_id"), "embedding")
    return {
        "bm25": retrieval.bm25_list(search.Bm25Index(memories), asked, memories),
        "vector": retrieval.vector_list(memory_vectors(g), vector, memories),
        "graph": retrieval.graph_list(top, relations, links, memories, concepts=concepts),
        "path": retrieval.path_result(top, relations, concepts, links, memories)[0],
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark, sf_dir)
    lists = None
    for rows in all_lists(g).values():
        lists = rows if lists is None else lists.unionByName(rows)
    return retrieval.retrieve(lists, g.memories(), now(RETRIEVED_AT), 20)


@query(RETRIEVED)
def retrieve_bm25_graph(g: Graph) -> DataFrame:
    return flagship(g.spark, g.dir)
