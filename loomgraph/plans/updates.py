"""Queries of updates, names, reasoning, stores, traces and evaluation over the graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.similarity import string_similarity
from ..operators import communities, enrichment, evaluation, graph, ingestion, learning, ranking, reasoning, repulsion, resolver, retrieval, search, spacing, structure
from ..session import checkpointed, written
from ..sources import readers, store
from ..sources.derive import Graph
from ..streaming import events as streams
from .catalogue import AS_OF, EPISODES_AS_OF, RETRIEVE, RETRIEVED_AT, SEEDS, _hops, all_lists, memory_vectors, now, query, seeds
from .texts import SPOKEN, _spoken

SEEDS30 = SEEDS.replace("LIMIT 3", "LIMIT 30")

# Learning.


@query("""WITH h AS (SELECT order_id AS id, count(*) AS n FROM (SELECT l_orderkey AS order_id FROM lineitem) GROUP BY 1)
SELECT m.id, round(CASE WHEN n > 0 THEN least(2.5, strength + 0.1 * n) ELSE strength END, 6) AS strong, round(CASE WHEN n > 0 THEN greatest(1.3, strength * pow(0.95, n)) ELSE strength END, 6) AS weak, access_count + coalesce(n, 0) AS access_count FROM memories m LEFT JOIN h USING (id)""")
def strengthened(g: Graph) -> DataFrame:
    ids = g.table("lineitem").select(F.col("l_orderkey").alias("id"))
    weak = learning.weaken(g.memories(), ids).select("id", F.round("strength", 6).alias("weak"))
    return learning.strengthen(g.memories(), ids).select("id", F.round("strength", 6).alias("strong"), "access_count").join(weak, "id")


@query(f"""WITH {SEEDS30}, pairs AS (SELECT a.id AS source_id, b.id AS target_id FROM seeds a JOIN seeds b ON a.id < b.id),
f AS (SELECT coalesce(r.source_id, p.source_id) AS source_id, coalesce(r.target_id, p.target_id) AS target_id, r.weight, r.co_occurrence_count AS n, r.relation_type, p.source_id IS NOT NULL AS hit, r.source_id IS NOT NULL AS old FROM relations r FULL JOIN pairs p ON p.source_id = r.source_id AND p.target_id = r.target_id)
SELECT source_id, target_id, round(CASE WHEN old AND hit THEN least(1.0, weight + 0.05) WHEN old THEN weight ELSE 0.5 END, 6)::DOUBLE AS weight, CASE WHEN old AND hit THEN n + 1 WHEN old THEN n ELSE 1 END AS co_occurrence_count, CASE WHEN old THEN relation_type ELSE 'related_to' END AS relation_type FROM f""")
def linked_seeds(g: Graph) -> DataFrame:
    top = checkpointed(seeds(g, 30))
    pairs = top.select(F.col("id").alias("source_id")).join(F.broadcast(top.select(F.col("id").alias("target_id"))), F.expr("source_id < target_id")).withColumn("relation_type", F.lit("related_to"))
    rows = g.relations().select("source_id", "target_id", "weight", "co_occurrence_count", "relation_type")
    return learning.create_or_strengthen(rows, pairs, now()).select("source_id", "target_id", F.round("weight", 6).alias("weight"), "co_occurrence_count", "relation_type")


@query(f"""WITH {SEEDS30} SELECT id, activation_count + CASE WHEN id IN (SELECT id FROM seeds) THEN 1 ELSE 0 END AS activation_count, CASE WHEN id IN (SELECT id FROM seeds) THEN TIMESTAMP '{AS_OF}' END AS last_activated FROM concepts""")
def touched_concepts(g: Graph) -> DataFrame:
    return learning.touch_concepts(g.concepts(), seeds(g, 30), now()).select("id", "activation_count", F.col("last_activated").cast("timestamp_ntz").alias("last_activated"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 4) SELECT m.id, access_count + CASE WHEN a.id IS NULL THEN 0 ELSE 1 END AS access_count,
CASE WHEN a.id IS NULL THEN last_accessed ELSE TIMESTAMP '2001-08-02' END AS last_accessed FROM memories m LEFT JOIN a USING (id)""")
def touched_memories(g: Graph) -> DataFrame:
    ids = g.table("lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("id"))
    at = F.lit(RETRIEVED_AT).cast("timestamp_ntz")
    return learning.touch_memories(g.memories(), ids, at).select("id", "access_count", "last_accessed")


@query("""WITH m AS (SELECT *, CASE WHEN status = 'archived' THEN access_count + 1 ELSE access_count END AS n, CASE WHEN status = 'archived' THEN TIMESTAMP '2001-08-02' ELSE last_accessed END AS seen FROM memories),
h AS (SELECT id, status, n, list_sum(list_transform(range(0, n), lambda i: pow(greatest((epoch_us(TIMESTAMP '2001-08-02') - (epoch_us(created_at) + floor((epoch_us(seen) - epoch_us(created_at)) * i / n)))::DOUBLE / 1e6, 1.0), -0.5))) AS s FROM m)
SELECT id, n AS access_count, CASE WHEN status <> 'archived' THEN status WHEN ln(s) < -2.5 THEN 'archived' WHEN ln(s) < -1 THEN 'deprioritized' ELSE 'active' END AS status FROM h""")
def restored(g: Graph) -> DataFrame:
    at = F.lit(RETRIEVED_AT).cast("timestamp_ntz")
    gone = g.memories().where("status = 'archived'").select("id")
    return learning.restore(g.memories(), gone, at).select("id", "access_count", "status")


CORRECTIONS = """c AS (SELECT event_id AS episode_id, CASE WHEN event_id % 3 = 0 THEN 'Нужно ' || event_type ELSE 'it is ' || event_type END AS t FROM events WHERE event_type = 'error')"""


@query(f"WITH {CORRECTIONS} SELECT 'memory-correction-' || sha256(c.episode_id || '|' || t) AS id, t AS content, CASE WHEN c.episode_id % 3 = 0 THEN 'procedure' ELSE 'fact' END AS memory_type, 8.0::DOUBLE AS importance, e.concept_id::VARCHAR AS concepts FROM c JOIN episode_concept e USING (episode_id)")
def correction_memories(g: Graph) -> DataFrame:
    e = g.episodes().where("behavior_name = 'error'")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Нужно "), "behavior_name")).otherwise(F.concat(F.lit("it is "), "behavior_name"))
    events = e.select(F.col("id").alias("episode_id"), text.alias("correction_text"))
    made = learning.feedback("correction", g.episodes(), g.memories(), g.relations(), events, g.memory_concept().select(F.col("memory_id").alias("episode_id"), "memory_id"), g.episode_concept(), now())["new_memories"]
    return made.select("id", "content", "memory_type", "importance", F.array_join(F.col("concept_ids").cast("array<string>"), "|").alias("concepts"))


@query("""WITH p AS (SELECT id FROM episodes WHERE behavior_name = 'purchase') SELECT e.id, success_count + (p.id IS NOT NULL)::INT AS success_count, failure_count, coalesce(r.n, 0) AS strengthened
FROM episodes e LEFT JOIN p USING (id) LEFT JOIN (SELECT count(*) AS n FROM relations WHERE source_id IN (SELECT concept_id FROM episode_concept WHERE episode_id IN (SELECT id FROM p)) AND target_id IN (SELECT concept_id FROM episode_concept WHERE episode_id IN (SELECT id FROM p)) AND weight < 1) r ON e.id = 0""")
def positive_feedback(g: Graph) -> DataFrame:
    good = g.episodes().where("behavior_name = 'purchase'").select(F.col("id").alias("episode_id"))
    out = learning.feedback("positive", g.episodes(), g.memories(), g.relations(), good, g.memory_concept().select(F.col("memory_id").alias("episode_id"), "memory_id"), g.episode_concept(), now())
    grown = out["relations"].select("source_id", "target_id", F.col("weight").alias("new")).join(g.relations(), ["source_id", "target_id"]).agg(F.count_if(F.col("new") > F.col("weight")).alias("n"))
    return out["episodes"].join(F.broadcast(grown)).select("id", "success_count", "failure_count", F.when(F.col("id") == 0, F.col("n")).otherwise(0).alias("strengthened"))


@query("""WITH o AS (SELECT *, id % 7 AS key, 'do ' || behavior_name AS instruction FROM episodes WHERE importance >= 7),
a AS (SELECT key, count(*) FILTER (success_count > failure_count) AS s, sum(success_count) / greatest(sum(success_count) + sum(failure_count), 1) AS r, avg(importance) AS i, count(DISTINCT domain) AS d FROM o GROUP BY 1),
k AS (SELECT key FROM a WHERE (s >= 3)::INT + (r >= 0.85)::INT + (i >= 7)::INT + (d >= 2)::INT >= 3), e AS (SELECT * FROM o WHERE key IN (SELECT key FROM k))
SELECT 'memory-procedure-' || sha256(key::VARCHAR) AS id, first(instruction ORDER BY id) AS content, array_to_string(list_sort(list(DISTINCT c.concept_id))[1:10], '|') AS concepts, count(DISTINCT id) AS n_episodes FROM e LEFT JOIN episode_concept c ON c.episode_id = e.id GROUP BY key""")
def crystallized(g: Graph) -> DataFrame:
    e = g.episodes().where("importance >= 7")
    links = g.episode_concept().groupBy(F.col("episode_id").alias("id")).agg(F.array_sort(F.collect_set("concept_id")).alias("concepts_activated"))
    rows = e.withColumn("behavior_instruction", F.concat(F.lit("do "), "behavior_name")).withColumn("consolidated", F.lit(False)).withColumn("consolidated_memory_id", F.lit(None).cast("string")).join(links, "id", "left")
    made, _, _ = learning.crystallize(rows, e.select((F.col("id") % 7).alias("key"), "id"), now())
    return made.select("id", "content", F.array_join(F.col("concept_ids").cast("array<string>"), "|").alias("concepts"), F.size("source_episode_ids").cast("bigint").alias("n_episodes"))


@query("""SELECT 'memory-reflection-' || s_suppkey || '-1' AS id, 'pattern' AS kind, 'seen ' || s_name AS content, 9.0::DOUBLE AS importance FROM supplier UNION ALL SELECT 'memory-reflection-' || s_suppkey || '-2', 'gap', 'unknown', 9.0 FROM supplier""", graph_views=False)
def reflections(g: Graph) -> DataFrame:
    rows = g.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Here:\nПАТТЕРН: seen "), "s_name", F.lit("\nпробел | unknown\nx: y")).alias("answer"))
    return learning.reflections(rows, now()).select("id", "kind", "content", "importance")


@query("""WITH p AS (SELECT id AS id_new, id - 1 AS id_old, confidence AS cn, id % 3 = 0 AS direct, id % 2 = 0 AS keep_new FROM memories WHERE id % 4 = 0 AND id - 1 IN (SELECT id FROM memories)),
r AS (SELECT p.*, m.confidence AS co FROM p JOIN memories m ON m.id = id_old),
s AS (SELECT id_old, id_new, CASE WHEN direct AND abs(cn - co) >= 0.3 THEN CASE WHEN keep_new THEN id_old ELSE id_new END END AS gone FROM r),
e AS (SELECT CASE WHEN gone = id_old THEN id_new ELSE id_old END AS by_, gone FROM s WHERE gone IS NOT NULL)
SELECT m.id, CASE WHEN e.by_ IS NOT NULL THEN 'superseded' ELSE status END AS status, e.by_ AS superseded_by FROM memories m LEFT JOIN (SELECT gone, max(by_) AS by_ FROM e GROUP BY 1) e ON e.gone = m.id""")
def superseded(g: Graph) -> DataFrame:
    m = g.memories()
    answer = F.concat(F.lit("well\nCONTRADICTION|"), F.when(F.col("id") % 3 == 0, "direct").otherwise("partial"), F.lit("|0.9|"), F.when(F.col("id") % 2 == 0, "keep_new").otherwise("keep_old"), F.lit("|no"))
    answers = m.where("id % 4 = 0").select((F.col("id") - 1).alias("id_old"), F.col("id").alias("id_new"), answer.alias("answer"))
    own = lambda side: m.select(F.col("id").alias(f"id_{side}"), F.col("confidence").alias(f"confidence_{side}"))
    judged = learning.parse_contradictions(answers).join(own("old"), "id_old").join(own("new"), "id_new")
    return learning.supersede(m, learning.resolve_contradictions(judged, gap=0.2999), now())[0].select("id", "status", F.col("superseded_by").cast("bigint").alias("superseded_by"))


SIMILAR = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0), s AS (SELECT q.id AS asked_id, v.id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM q JOIN v ON v.id <> q.id)"


@query(f"{SIMILAR} SELECT asked_id, id, round(score, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, id) AS n FROM s WHERE score >= 0.2) WHERE n <= 10", graph_views=False)
def contradiction_candidates(g: Graph) -> DataFrame:
    v = g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit("active").alias("status"))
    return learning.contradiction_candidates(v, v.where("id % 20 = 0"), 10, 0.2).select("asked_id", "id", F.round(F.round("similarity", 9), 6).alias("similarity"))


@query(f"{SIMILAR}, g AS (SELECT s.* FROM s JOIN events e ON e.event_id = s.id WHERE event_type IN ('purchase', 'signup')) SELECT asked_id, id, round(score, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, id) AS n FROM g WHERE score >= 0.1) WHERE n <= 10", graph_views=False)
def similar_behaviours(g: Graph) -> DataFrame:
    v = g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = g.episodes().join(v, "id").where("behavior_name IN ('purchase', 'signup')")
    return learning.similar_episodes(rows, v.where("id % 20 = 0"), 10, 0.1).select("asked_id", "id", F.round(F.round("similarity", 9), 6).alias("similarity"))


@query(f"""{SIMILAR}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 10),
r AS (SELECT asked_id, t.id, score * CASE WHEN e.success_count > 0 THEN 1 + 0.5 * e.success_count / (e.success_count + e.failure_count) ELSE 1.0 END * (0.8 + 0.2 * pow(0.995, (epoch_us(TIMESTAMP '{EPISODES_AS_OF}') - epoch_us(e.created_at)) / 3.6e9)) AS score FROM t JOIN episodes e ON e.id = t.id)
SELECT asked_id AS query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY round(score, 9) DESC, id) AS n FROM r) WHERE n <= 5""".replace("WITH v AS", "WITH v AS"))
def rescored_episodes(g: Graph) -> DataFrame:
    v = g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    others = search.nearest(asked, v, 11).where("id <> query_id")
    hits = ranking.top_k(others, ["query_id"], [F.desc("score"), F.asc("id")], 10)
    found = search.rescored_episodes(hits, g.episodes().withColumn("last_used", F.col("created_at")), now(EPISODES_AS_OF), 5)
    return found.select("query_id", "id", F.round("rescored", 6).alias("score"))


@query("""SELECT 'episode-' || conv_id || '-' || turn AS id, CASE WHEN turn % 4 = 0 THEN 'troubleshoot' ELSE 'general_response' END AS behavior_name, 'git' AS domain, 1 AS repetition_count FROM conversations WHERE role = 'user'""", graph_views=False)
def new_episodes(g: Graph) -> DataFrame:
    rows = g.table("conversations").where("role = 'user'")
    asked = F.concat(F.when(F.col("turn") % 4 == 0, "an error in ").otherwise("tell me of "), F.lit("git"))
    none = F.array().cast("array<string>")
    answers = rows.select(F.concat_ws("-", F.lit("episode"), "conv_id", "turn").alias("id"), asked.alias("query"), F.lit("ok").alias("answer"), none.alias("concepts_activated"), none.alias("memories_used"), F.lit(5.0).alias("importance"))
    return learning.new_episodes(answers, now()).select("id", "behavior_name", "domain", "repetition_count")


@query("""WITH o AS (SELECT event_id AS id, count(*) FILTER (event_id % 2 = 0) AS up, count(*) FILTER (event_id % 2 = 1) AS down FROM events WHERE event_type = 'click' GROUP BY 1), c AS (SELECT event_id AS id FROM events WHERE event_type = 'signup')
SELECT e.id, success_count + coalesce(up, 0) AS success_count, failure_count + coalesce(down, 0) AS failure_count, 1 + coalesce(up, 0) AS repetition_count, c.id IS NOT NULL AS consolidated FROM episodes e LEFT JOIN o USING (id) LEFT JOIN c USING (id)""")
def recorded_outcomes(g: Graph) -> DataFrame:
    e = g.episodes()
    outcomes = e.where("behavior_name = 'click'").select("id", (F.col("id") % 2 == 0).alias("success"))
    links = e.where("behavior_name = 'signup'").select(F.col("id").alias("episode_id"), F.lit("m").alias("memory_id"))
    return learning.mark_consolidated(learning.record_outcomes(e, outcomes, now()), links).select("id", "success_count", "failure_count", "repetition_count", "consolidated")


@query("""SELECT user_id AS id, array_to_string(list_transform(list_sort(list(DISTINCT ts))[-5:], lambda t: epoch_us(t)::VARCHAR), ',') AS history FROM events GROUP BY 1""", graph_views=False)
def access_history(g: Graph) -> DataFrame:
    found = streams.access_history(g.table("events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), keep=5)
    return found.select("id", F.array_join(F.transform("history", lambda t: F.unix_micros(t).cast("string")), ",").alias("history"))


# Names.

_asked = "SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_partkey % 2 = 0 UNION SELECT upper(p_brand) FROM part UNION SELECT 'x' || lower(p_name) FROM part UNION SELECT 'qqq zzz'"


@query(f"""WITH live AS (SELECT * FROM concepts WHERE status IS NULL OR status = 'active'), kn AS (SELECT lower(name) AS key, max(id) AS id FROM live GROUP BY 1), al AS (SELECT lower(a) AS key, max(id) AS id FROM (SELECT unnest(aliases) AS a, id FROM live) GROUP BY 1),
so AS (SELECT key, max(id) AS id FROM (SELECT * FROM kn UNION ALL SELECT * FROM al) GROUP BY 1), asked AS ({_asked}),
h AS (SELECT a.name, kn.id AS exact, al.id AS alias FROM asked a LEFT JOIN kn ON kn.key = lower(a.name) LEFT JOIN al ON al.key = lower(a.name)),
fz AS (SELECT h.name, s.id, round(jaro_winkler_similarity(lower(h.name), s.key), 9) AS sim, row_number() OVER (PARTITION BY h.name ORDER BY round(jaro_winkler_similarity(lower(h.name), s.key), 9) DESC, s.id) AS n FROM h, so s WHERE exact IS NULL AND alias IS NULL AND jaro_winkler_similarity(lower(h.name), s.key) >= 0.9)
SELECT h.name, coalesce(exact, alias, fz.id) AS concept_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN alias IS NOT NULL THEN 'alias' WHEN fz.id IS NOT NULL THEN 'phonetic' END AS matched_by, CASE WHEN exact IS NOT NULL OR alias IS NOT NULL THEN 1.0 ELSE round(sim, 6) END AS similarity FROM h LEFT JOIN fz ON fz.name = h.name AND n = 1""")
def resolved_names(g: Graph) -> DataFrame:
    p = g.table("part")
    names = p.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("name")).union(p.select(F.upper("p_brand"))).union(p.select(F.concat(F.lit("x"), F.lower("p_name")))).union(g.spark.range(1).select(F.lit("qqq zzz")))
    return resolver.resolve(names, g.concepts()).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT c.id, n.turn AS place FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN (SELECT upper(name) FROM concepts ORDER BY id LIMIT 1) ELSE 'none such' END AS name FROM conversations) n JOIN concepts c ON lower(c.name) = lower(n.name)""")
def matched_names(g: Graph) -> DataFrame:
    first = g.concepts().orderBy("id").limit(1).select(F.upper("name").alias("first"))
    names = g.table("conversations").join(F.broadcast(first)).select(F.col("turn").alias("place"), F.when(F.col("turn") % 2 == 0, F.col("first")).otherwise("none such").alias("name"))
    return resolver.matched(names, g.concepts()).select(F.col("concept_id").alias("id"), "place")


@query("""WITH a AS (SELECT name, min(id) AS id FROM concepts WHERE id % 2 = 0 GROUP BY 1), b AS (SELECT name, min(id) AS id FROM concepts GROUP BY 1) SELECT b.name, coalesce(a.id, b.id) AS id FROM b LEFT JOIN a USING (name)""")
def merged_concepts(g: Graph) -> DataFrame:
    rows = g.concepts().select("name", "id")
    return resolver.merged_by_name(rows.where("id % 2 = 0"), rows)


@query("""SELECT 'Person ' || s_suppkey AS name, 'analyst' AS role, s_name AS team, 'Person ' || s_suppkey || ' — analyst (команда ' || s_name || ')' AS content FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'PERSON ' || s_suppkey, 'lead', '', 'PERSON ' || s_suppkey || ' — lead' FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 3 > 0""", graph_views=False)
def merged_persons(g: Graph) -> DataFrame:
    s = g.table("supplier")
    i = F.col("s_suppkey").cast("string")
    known = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("Person "), i).alias("name"), F.lit("analyst").alias("role"), F.col("s_name").alias("team"))
    told = s.select(F.concat(F.lit("PERSON "), i).alias("name"), F.when(F.col("s_suppkey") % 3 > 0, "lead").otherwise("").alias("role"), F.lit("").alias("team"))
    return resolver.merged_persons(known, told).withColumn("content", resolver.person_content(F.col("role"), F.col("name"), F.col("team")))


@query("""SELECT id, array_to_string(list_concat(aliases, [upper(aliases[1]), 'new']), '|') AS every, array_to_string(CASE WHEN id % 2 = 0 THEN aliases ELSE list_append(aliases, 'new') END, '|') AS once, array_to_string(list_sort(list_distinct([lower(name), aliases[1], aliases[2]])), ' ') AS terms FROM concepts""")
def more_aliases(g: Graph) -> DataFrame:
    a = F.col("aliases")
    added = F.when(F.col("id") % 2 == 0, F.upper(a[0])).otherwise(F.lit("new"))
    return g.concepts().select("id", F.array_join(resolver.add_aliases(a, F.array(F.upper(a[0]), F.lit("new"))), "|").alias("every"), F.array_join(resolver.add_alias_once(F.col("name"), a, added), "|").alias("once"), T.expanded_query(F.lit("q"), T.expand_terms(F.col("name"), a)).alias("terms"))


@query("""WITH n AS (SELECT DISTINCT name FROM concepts) SELECT name, round(jaro_winkler_similarity(name, name || 's'), 6) AS similarity FROM n""")
def name_similarity(g: Graph) -> DataFrame:
    return g.concepts().select("name").distinct().select("name", F.round(string_similarity(F.upper("name"), F.concat("name", F.lit("s"))), 6).alias("similarity"))


# Reasoning.

GRAPH_RETRIEVED = RETRIEVE + ", re AS (SELECT id, sources, round(base * 0.8 + base * 1.0 * 0.2, 6) AS score FROM ba ORDER BY score DESC, id LIMIT 20)"


def _retrieved(g: Graph) -> DataFrame:
    lists = None
    for rows in all_lists(g).values():
        lists = rows if lists is None else lists.unionByName(rows)
    return checkpointed(retrieval.retrieve_all(lists, g.memories(), now(RETRIEVED_AT), 20).select("id", "sources", "score", "place"))


@query(f"""{GRAPH_RETRIEVED}, x AS (SELECT id FROM re ORDER BY score DESC, id LIMIT 1), i AS (SELECT min(id) AS id FROM memories WHERE id NOT IN (SELECT id FROM re))
SELECT id, sources, score FROM re WHERE id NOT IN (SELECT id FROM x) UNION ALL SELECT id, 'F', 1.0 FROM i""")
def forced_memories(g: Graph) -> DataFrame:
    found = _retrieved(g)
    first = found.orderBy(F.desc("score"), "id").first()["id"]
    other = g.memories().join(found, "id", "left_anti").agg(F.min("id")).first()[0]
    kept, _ = reasoning.without_nodes(found, g.concepts().select("id"), [first])
    return reasoning.with_memories(kept, g.memories(), [other]).select("id", "sources", "score")


@query(f"WITH {SEEDS}, {_hops(2)}, f AS (SELECT id FROM concepts ORDER BY id LIMIT 5) SELECT id, round(activation, 6) AS activation FROM b2 UNION ALL SELECT id, 1.0 FROM f WHERE id NOT IN (SELECT id FROM b2)")
def forced_concepts(g: Graph) -> DataFrame:
    active = graph.activate(checkpointed(seeds(g)), checkpointed(g.relations()), checkpointed(g.concepts()), hops=2)
    return reasoning.with_concepts(active, g.concepts().orderBy("id").limit(5).select("id")).select("id", F.round("activation", 6).alias("activation"))


@query(f"""{GRAPH_RETRIEVED}, u AS (SELECT DISTINCT unnest(string_split(sources, '+')) AS s FROM re), p AS (SELECT count(*) FILTER (memory_type = 'procedure') AS p FROM re JOIN memories USING (id))
SELECT round((SELECT avg(confidence) FROM re JOIN memories USING (id)) + CASE WHEN (SELECT count(*) FROM u) >= 3 THEN 0.1 ELSE 0 END, 6) AS confidence, 5.0::DOUBLE + 1.0 + CASE WHEN (SELECT count(*) FROM b3) > 5 THEN 1.0 ELSE 0 END + CASE WHEN p > 2 THEN 1.0 ELSE 0 END::DOUBLE AS importance FROM p""")
def answer_estimates(g: Graph) -> DataFrame:
    rows = _retrieved(g).join(g.memories().select("id", "confidence", "memory_type"), "id").withColumn("query_id", F.lit(0)).withColumn("sources", F.split("sources", r"\+"))
    active = graph.activate(checkpointed(seeds(g)), checkpointed(g.relations()), checkpointed(g.concepts())).agg(F.count(F.lit(1)).alias("a"))
    procedures = rows.agg(F.count_if(F.col("memory_type") == "procedure").alias("p"))
    weight = reasoning.importance(F.lit("short"), F.lit(4), F.col("a"), F.col("p")).alias("importance")
    return reasoning.confidence(rows).join(F.broadcast(active.join(F.broadcast(procedures)).select(weight))).select(F.round("confidence", 6).alias("confidence"), "importance")


@query(f"""WITH {SEEDS}, m AS (SELECT id, importance, count(*) AS links FROM memories m JOIN memory_concept k ON k.memory_id = m.id WHERE k.concept_id IN (SELECT id FROM seeds) AND status IN ('active', 'deprioritized') AND id % 2 = 1 GROUP BY 1, 2 ORDER BY links DESC, importance DESC, id LIMIT 20)
SELECT id, round(importance / 10, 6) AS score FROM m ORDER BY importance / 10 DESC, id LIMIT 10""")
def alternative_memories(g: Graph) -> DataFrame:
    found, _ = reasoning.re_reason(seeds(g), g.memories().where("id % 2 = 0").select("id"), g.memory_concept(), g.memories(), g.episodes(), g.episode_concept(), "purchase")
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {SEEDS}, m AS (SELECT m.id, importance, count(*) AS links FROM memories m JOIN memory_concept k ON k.memory_id = m.id WHERE k.concept_id IN (SELECT id FROM seeds) AND status IN ('active', 'deprioritized') GROUP BY 1, 2 ORDER BY links DESC, importance DESC, m.id LIMIT 20)
SELECT m.id, round((importance / 10 + list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2, 6) AS score FROM m JOIN embeddings v ON v.vec_id = m.id % 200 ORDER BY 2 DESC, 1 LIMIT 10""")
def memories_of_concepts(g: Graph) -> DataFrame:
    asked = g.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    close = memory_vectors(g).join(F.broadcast(asked)).select("id", F.round(S.cosine(F.col("embedding"), F.col("q")), 12).alias("relevance"))
    return reasoning.for_concepts(seeds(g), g.memory_concept(), g.memories(), 10, close).withColumn("score", F.round("score", 6))


@query("""WITH q AS (SELECT conv_id AS query_id, text FROM conversations WHERE turn = 0), m AS (SELECT DISTINCT query_id, c.id FROM q JOIN concepts c ON c.id = query_id WHERE query_id % 2 = 0),
v AS (SELECT query_id, c.id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings a ON a.vec_id = query_id JOIN concepts c ON c.id < 100 JOIN embeddings b ON b.vec_id = c.id),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM v WHERE score > 0.1 AND query_id NOT IN (SELECT query_id FROM m))
SELECT query_id, id FROM m UNION ALL SELECT query_id, id FROM r WHERE n <= 5""")
def fallback_seeds(g: Graph) -> DataFrame:
    asked = g.table("conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"))
    matched = asked.where("query_id % 2 = 0").join(g.concepts().select(F.col("id").alias("query_id"), "id"), "query_id")
    v = g.table("embeddings")
    wanted = asked.join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    near = search.nearest(wanted, v.where("vec_id < 100").join(g.concepts().select(F.col("id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("id"), "embedding"), 5)
    return reasoning.fallback_seeds(matched, near, near.where("false"), close=0.1)


# Retrieval.


@query(RETRIEVE + " SELECT s.source, count(*) AS n FROM (SELECT unnest(string_split(sources, '+')) AS source FROM (SELECT * FROM ba ORDER BY round(base * 0.8 + base * 1.0 * 0.2, 6) DESC, id LIMIT 20)) s GROUP BY 1")
def retrieval_sources(g: Graph) -> DataFrame:
    return retrieval.source_counts(_retrieved(g))


TRACE = RETRIEVE + """, tr AS (SELECT 0 AS step, 'bm25' AS stage, id, score FROM by_words UNION ALL SELECT 1, 'vector', id, score FROM by_vector UNION ALL SELECT 2, 'graph', id, score FROM by_graph UNION ALL SELECT 3, 'path', id, score FROM by_path
UNION ALL (SELECT 4, 'final', id, round(base * 0.8 + base * 1.0 * 0.2, 6) AS s FROM ba ORDER BY s DESC, id LIMIT 20)), nu AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, id) AS rank FROM tr)"""


def _trace(g: Graph) -> DataFrame:
    lists = {k: checkpointed(v) for k, v in all_lists(g).items()}
    every = None
    for rows in lists.values():
        every = rows if every is None else every.unionByName(rows)
    return retrieval.recorded({**{k: v.select("id", "score") for k, v in lists.items()}, "final": retrieval.retrieve(every, g.memories(), now(RETRIEVED_AT), 20).select("id", "score")})


@query(TRACE + " SELECT step, stage, id, round(score, 6) AS score, rank::INT AS rank FROM nu")
def retrieval_trace(g: Graph) -> DataFrame:
    return _trace(g).select("step", "stage", "id", F.round("score", 6).alias("score"), "rank")


@query(TRACE + " SELECT step, stage, count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean FROM nu GROUP BY 1, 2")
def retrieval_steps(g: Graph) -> DataFrame:
    return retrieval.step_stats(_trace(g)).select("step", "stage", "n", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean")])


@query(TRACE + """, x AS (SELECT id FROM nu WHERE stage = 'final' AND rank = 1), sp AS (SELECT DISTINCT step, stage FROM nu), o AS (SELECT sp.*, nu.rank FROM sp LEFT JOIN (SELECT * FROM nu WHERE id IN (SELECT id FROM x)) nu USING (step))
SELECT step, o.stage, rank::INT AS rank, CASE WHEN rank IS NOT NULL THEN 'present' WHEN max(CASE WHEN rank IS NOT NULL THEN step END) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 'not found yet' ELSE 'dropped' END AS reason FROM o""")
def item_journey(g: Graph) -> DataFrame:
    trace = checkpointed(_trace(g))
    best = trace.where("stage = 'final' AND rank = 1").first()["id"]
    return retrieval.item_journey(trace, F.lit(best)).select("step", "stage", "rank", "reason")


@query(TRACE + """ SELECT id, first(stage ORDER BY rank, step) AS first_appearance, last(stage ORDER BY step) AS last_stage, count(*) AS n_stages FROM nu WHERE id IN (SELECT id FROM memories WHERE contains(content, 'order 1')) GROUP BY 1""")
def traced_items(g: Graph) -> DataFrame:
    return ranking.journey(retrieval.found_by_text(_trace(g), g.memories(), "Order 1"))


@query(RETRIEVE + """, one AS (SELECT 'bm25' AS source, id, score FROM by_words UNION ALL SELECT 'rewrite', id, score FROM by_vector UNION ALL SELECT 'hyde', id, score FROM by_graph UNION ALL SELECT 'path', id, score FROM by_path),
rw AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM one), fw AS (SELECT id, sum(CASE source WHEN 'path' THEN 0.3 ELSE 0.25 END / (60 + rank)) AS fused, string_agg(source, '+' ORDER BY source) AS sources FROM rw GROUP BY 1)
SELECT fw.id, sources, round(fused, 6) AS fused FROM fw JOIN memories m ON m.id = fw.id ORDER BY round(0.2 * pow(0.995, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(last_accessed::TIMESTAMP)) / 3.6e9) + 0.3 * importance / 10 + 0.5 * fused * 10, 6) DESC, fw.id LIMIT 20""")
def retrieve_rewritten(g: Graph) -> DataFrame:
    """Lists of several forms of one question."""
    found = all_lists(g)
    named = {"bm25": found["bm25"], "rewrite": found["vector"], "hyde": found["graph"], "path": found["path"]}
    return retrieval.retrieve_many(named, g.memories(), now(RETRIEVED_AT), 20).select("id", "sources", "fused")


@query("""WITH toks AS (SELECT id, unnest(regexp_extract_all(name, '[\\p{L}\\p{N}_]+')) AS token FROM concepts), dl AS (SELECT id, count(*) AS dl FROM toks GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), p AS (SELECT token, id, count(*) AS tf FROM toks GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')) AS token FROM part WHERE p_partkey % 20 = 0),
s AS (SELECT query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN p USING (token) JOIN df USING (token) JOIN dl ON dl.id = p.id, st GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s) WHERE n <= 10""")
def concept_search(g: Graph) -> DataFrame:
    asked = g.table("part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    return search.concept_search(g.concepts(), asked, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS place FROM (SELECT id FROM memories UNION ALL SELECT -1) WHERE id % 100 = 0 OR id = -1) SELECT h.id, place::INT AS place, coalesce(content, '') AS content, content IS NULL AS missing FROM h LEFT JOIN memories USING (id)""")
def hydrated_hits(g: Graph) -> DataFrame:
    hits = ranking.ranked(g.memories().select("id").union(g.spark.range(-1, 0)).where("id % 100 = 0 OR id = -1").withColumn("k", F.lit(1)), ["k"], [F.desc("id")], "place").drop("k")
    found = search.hydrated(hits, g.memories().select("id", "content"), keep_missing=True)
    return found.select("id", "place", F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNull().alias("missing"))


@query("""SELECT s.id AS summary_id, m.id::VARCHAR AS raw_id, m.content FROM memories s JOIN memories m ON m.id = s.id + 1""")
def raw_tables(g: Graph) -> DataFrame:
    link = F.to_json(F.struct((F.col("id") + 1).cast("string").alias("linked_raw_id")))
    return structure.raw_tables(g.memories().select("id", link.alias("metadata")), g.memories())


# Ingestion, stores and reports.


@query(f"""WITH {SPOKEN}, kn AS (SELECT lower(name) AS name, max(id) AS id FROM concepts WHERE status IS NULL OR status = 'active' GROUP BY 1), s AS (SELECT DISTINCT name FROM p UNION SELECT 'box')
SELECT s.name, coalesce(kn.id::VARCHAR, 'c_' || sha256(s.name)) AS concept_id FROM s LEFT JOIN kn USING (name) WHERE kn.id IS NULL""")
def ingested_concepts(g: Graph) -> DataFrame:
    docs = g.table("part").select(F.col("p_partkey").alias("doc_id"), F.lit("plain").alias("text"))
    known = g.concepts().withColumn("aliases", F.array().cast("array<string>"))
    # Names are far enough apart that none is taken for another one.
    return ingestion.ingest(docs, _spoken(g), known)["concepts"].select("name", F.col("id").alias("concept_id"))


@query("SELECT source_id::VARCHAR AS source, target_id::VARCHAR AS target, 'relation' AS kind FROM relations UNION ALL SELECT memory_id::VARCHAR, concept_id::VARCHAR, 'memory' FROM memory_concept UNION ALL SELECT episode_id::VARCHAR, concept_id::VARCHAR, 'episode' FROM episode_concept")
def all_edges(g: Graph) -> DataFrame:
    return ingestion.all_edges(g.relations(), g.memory_concept(), g.episode_concept())


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'table' ELSE 'document' END AS source_type, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n FROM documents) SELECT doc_id FROM d WHERE source_type = 'table' OR n >= 5 AND doc_id IN (SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 5)""", graph_views=False)
def gated_memories(g: Graph) -> DataFrame:
    """With a threshold just over 0 only texts of fewer than five words fail."""
    kind = F.when(F.col("doc_id") % 4 == 0, "table").otherwise("document")
    rows = g.table("documents").select("doc_id", F.col("text").alias("content"), kind.alias("source_type"))
    return ingestion.quality_gate(rows, threshold=0.0001).select("doc_id")


@query("SELECT id, name, CASE WHEN id % 5 = 0 THEN 'changed' ELSE status END AS status FROM concepts UNION ALL SELECT 0 - id, 'new', 'active' FROM concepts WHERE id % 50 = 7")
def upserted_concepts(g: Graph) -> DataFrame:
    """One batch of changed and new rows; of a key that comes twice the last by version counts."""
    old = g.concepts().select("id", "name", "status")
    changed = old.where("id % 5 = 0").select("id", "name", F.lit("changed").alias("status"), F.lit(2).alias("version"))
    stale = changed.select("id", F.lit("old").alias("name"), F.lit("old").alias("status"), F.lit(1).alias("version"))
    new = old.where("id % 50 = 7").select((0 - F.col("id")).alias("id"), F.lit("new").alias("name"), F.lit("active").alias("status"), F.lit(1).alias("version"))
    batch = store.last_wins(changed.unionByName(stale).unionByName(new), ["id"], "version").drop("version")
    return store.upsert(old, batch, ["id"])


@query("SELECT memory_id, concept_id FROM memory_concept WHERE memory_id IN (SELECT id FROM memories WHERE id % 2 = 0) AND concept_id IN (SELECT id FROM concepts WHERE status IS NULL OR status = 'active')")
def linked_memories(g: Graph) -> DataFrame:
    return store.only_linked(g.memory_concept(), g.memories().where("id % 2 = 0"), g.concepts().where(graph.is_active(F.col("status"))))


@query("SELECT id, name, 'general' AS type, 2 AS level, 'active' AS status, len(aliases) AS n_aliases FROM concepts")
def serialized_concepts(g: Graph) -> DataFrame:
    """Rows to JSON and back; what is not told gets its default."""
    rows = g.concepts().select(F.col("id").cast("string").alias("id"), "name", "aliases")
    back = readers.from_json(readers.as_json(rows), "concepts")
    return back.select(F.col("id").cast("bigint").alias("id"), "name", "type", "level", "status", F.size("aliases").cast("bigint").alias("n_aliases"))


@query("SELECT 'm-' || sha256(id || '|' || content) AS key, id FROM memories")
def stable_ids(g: Graph) -> DataFrame:
    return g.memories().select(readers.stable_id("m-", "id", "content").alias("key"), "id")


@query("SELECT id FROM memories WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def migrated_memories(g: Graph) -> DataFrame:
    known = g.table("embeddings").select(F.col("vec_id").alias("id"))
    return search.migrate(g.memories(), known, lambda c: F.array(F.char_length(c))).select("id")


@query("""WITH d AS (SELECT c.id, count(e.x) AS degree FROM concepts c LEFT JOIN (SELECT source_id AS x FROM relations UNION ALL SELECT target_id FROM relations) e ON e.x = c.id GROUP BY c.id)
SELECT count(*) AS nodes, round(avg(degree), 6) AS avg_degree, max(degree) AS max_degree, (SELECT count(*) FROM concepts WHERE status IS NULL OR status = 'active') AS active, (SELECT count(*) FROM relations) AS edges,
(SELECT count(*) FROM concepts c WHERE (status IS NULL OR status = 'active') AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.source_id = c.id OR r.target_id = c.id)) AS orphans FROM d""")
def graph_quality(g: Graph) -> DataFrame:
    return graph.quality_report(g.concepts(), g.relations())


@query("SELECT x AS id, count(*) AS degree FROM (SELECT source_id AS x FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY 1 HAVING count(*) >= 10")
def super_nodes(g: Graph) -> DataFrame:
    return graph.super_nodes(g.relations(), 10)


@query("""SELECT (SELECT count(*) FROM concepts) AS concepts, (SELECT count(*) FROM concepts WHERE id % 4 <> 0) AS merged, (SELECT count(*) FROM relations WHERE source_id % 4 <> 0 OR target_id % 4 <> 0) AS edges,
(SELECT count(*) FROM memory_concept WHERE concept_id IN (SELECT id FROM concepts WHERE id % 4 <> 0)) AS links, (SELECT count(*) FROM concepts WHERE id % 9 = 0) AS possible""")
def merge_report(g: Graph) -> DataFrame:
    merged = g.concepts().select("id", (F.col("id") - F.col("id") % 4).alias("canonical"))
    return graph.merge_report(g.concepts(), g.relations(), g.memory_concept(), merged, g.concepts().where("id % 9 = 0"))


@query("""WITH c AS (SELECT id, cluster AS label, layout_x AS x, layout_y AS y FROM concepts WHERE cluster <> 11 OR id % 24 = 11), s AS (SELECT label, count(*) AS n FROM c GROUP BY 1), big AS (SELECT label FROM s WHERE n >= (SELECT max(n) FROM s) - 1),
m AS (SELECT c.label, avg(x) AS cx, avg(y) AS cy FROM c JOIN big USING (label) GROUP BY 1), num AS (SELECT label, (row_number() OVER (ORDER BY n DESC, label) - 1)::INT AS cluster FROM s JOIN big USING (label)),
near AS (SELECT c.id, m.label, row_number() OVER (PARTITION BY c.id ORDER BY round(pow(x - cx, 2) + pow(y - cy, 2), 6), m.label) AS k FROM c, m WHERE c.label NOT IN (SELECT label FROM big))
SELECT id, cluster FROM c JOIN num USING (label) UNION ALL SELECT id, cluster FROM near JOIN num USING (label) WHERE k = 1""")
def merged_clusters(g: Graph) -> DataFrame:
    rows = g.concepts().where("cluster <> 11 OR id % 24 = 11")
    least = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] - 1
    return graph.merged_small(rows.select("id", F.col("cluster").alias("label")), rows.select("id", F.col("layout_x").alias("x"), F.col("layout_y").alias("y")), least)


@query("""WITH a AS (SELECT s_suppkey AS id, ['is_a','contains','uses','needs','causes','related_to'][(s_suppkey % 6)::INT + 1] AS t, [0.95, 0.85, 0.75, 0.7, 0.65, 0.5][(s_suppkey % 6)::INT + 1] AS w, s_suppkey % 15 / 10.0 AS s FROM supplier)
SELECT id, round(w * least(1.0, greatest(0.1, s)), 6)::DOUBLE AS weight, t IN ('is_a','contains','uses','needs','causes') AS is_semantic, t IN ('is_a','contains','uses','needs','causes') AS is_universal FROM a""", graph_views=False)
def classified_edges(g: Graph) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("is_a", "contains", "uses", "needs", "causes", "related_to")]), (k % 6).cast("int") + 1)
    rows = g.table("supplier").select(k.alias("id"), kind.alias("relation_type"), (k % 15 / 10).alias("strength"), F.lit(False).alias("is_semantic"), F.lit(False).alias("is_universal"))
    return enrichment.classify_edges(structure.enhanced_relations(rows)).select("id", F.round("weight", 6).alias("weight"), "is_semantic", "is_universal")


@query("""WITH c AS (SELECT lower(name) AS name, id FROM concepts), d AS (SELECT p_partkey AS id, lower(p_name) AS n FROM part) SELECT d.id AS source_id, c.id AS target_id, 'contains' AS relation_type, 0.8::DOUBLE AS weight FROM d JOIN c ON c.name = d.n WHERE d.id <> c.id""")
def defined_edges(g: Graph) -> DataFrame:
    rows = g.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("A thing|contains: "), F.lower("p_name"), F.lit("|uses: nothing")).alias("answer"))
    return enrichment.defined_edges(enrichment.definitions(rows), g.concepts()).select("source_id", "target_id", "relation_type", "weight")


@query("""SELECT id AS source_id, id + 1 AS target_id, CASE id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'reject' ELSE 'open' END AS outcome FROM concepts WHERE id % 4 IN (1, 2)""")
def reviewed_pairs(g: Graph) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "none")]), (F.col("id") % 4).cast("int") + 1)
    pairs = g.concepts().select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), level.alias("confidence"))
    decisions = pairs.where("source_id % 3 < 2").select("source_id", "target_id", F.when(F.col("source_id") % 3 == 0, "m").otherwise("n").alias("decision"))
    return enrichment.review(pairs, decisions).select("source_id", "target_id", "outcome")


@query("""SELECT status, '1. ' || first(content ORDER BY importance DESC, id) AS context, left(first(content ORDER BY id), 5) AS cut FROM memories GROUP BY 1""")
def prompt_contexts(g: Graph) -> DataFrame:
    m = g.memories()
    words = enrichment.memory_context(m.select("status", "id", F.col("importance").alias("score"), "content"), "status", most=1)
    docs = enrichment.document_context(m.select("status", "content", F.col("id").alias("rank")), "status", budget=5).select("status", F.col("content").alias("cut"))
    return words.join(docs, "status")


@query("SELECT id AS canonical, id + 1 AS id FROM concepts WHERE id % 10 = 0 AND id + 1 IN (SELECT id FROM concepts)")
def greedy_merges(g: Graph) -> DataFrame:
    """Pairs of every tenth concept (user input), which do not touch each other; ``merged_duplicates`` has pairs that do."""
    c = g.concepts().select("id")
    pairs = c.where("id % 10 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("id")).join(c, "id").select("a", F.col("id").alias("b"))
    return ranking.merges(pairs.withColumn("similarity", 1.0 / (1 + F.col("a")))).select("canonical", "id")


@query("""SELECT k, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, count(*) AS n_queries FROM (
  SELECT c.k, least(c.k, 3) / 3.0 AS recall, 1.0 AS mrr FROM (SELECT unnest([1, 3, 5, 10, 20]) AS k) c, (SELECT s_suppkey FROM supplier)) GROUP BY k""", graph_views=False)
def golden_run(g: Graph) -> DataFrame:
    """Three relevant items for each question, found at ranks 1 to 3."""
    s = g.table("supplier").select(F.col("s_name").alias("query"), F.array(*[F.concat(F.col("s_name"), F.lit(f"-{k}")) for k in range(3)]).alias("relevant_chunk_ids"))

    def found(asked: DataFrame) -> DataFrame:
        return asked.select("query_id", F.posexplode(F.array(*[F.concat("text", F.lit(f"-{k}")) for k in range(3)])).alias("rank", "item_id")).withColumn("rank", F.col("rank") + 1)

    return evaluation.run_golden(s, found)[1].select("k", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "n_queries")


@query("""SELECT count(*) AS n, 1.0::DOUBLE AS source_match, 0.5::DOUBLE AS key_info_match, 1.0::DOUBLE AS relevance, 0.25::DOUBLE AS no_contradiction, round(avg(CASE WHEN s_suppkey % 2 = 0 THEN 0.2 + 0.2 + 0.25 + 0.15 * 0.25 ELSE 0.5 * 0.5 + 0.3 + 0.2 * 0.25 END), 6)::DOUBLE AS overall, 0.0::DOUBLE AS good_share FROM supplier""", graph_views=False)
def judged_run(g: Graph) -> DataFrame:
    rows = g.table("supplier").select(F.col("s_name").alias("question"), F.lit("e").alias("expected"), F.lit("short one").alias("answer"), F.when(F.col("s_suppkey") % 2 == 0, "u").otherwise("").alias("url"))
    return evaluation.summary(evaluation.judge(rows, lambda prompts: ["RESULT|1|0.5|1|0.25"] * len(prompts)))


@query("""SELECT event_id AS id, round(ln(1 / sqrt(greatest(1, event_id * 60.0))), 6) AS level, CASE WHEN ln(1 / sqrt(greatest(1, event_id * 60.0))) < -2.5 THEN 'archived' WHEN ln(1 / sqrt(greatest(1, event_id * 60.0))) < -1 THEN 'deprioritized' ELSE 'active' END AS status FROM events""", graph_views=False)
def activation_levels(g: Graph) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    rows = g.table("events").select(F.col("event_id").alias("id"), F.array(F.timestamp_seconds(F.lit(1_700_000_000) - F.col("event_id") * 60)).alias("history"), at.alias("now"))
    return evaluation.activation_table(rows).select("id", F.round("level", 6).alias("level"), "status")


# Listings.


@query("SELECT id, behavior_name FROM episodes ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def episode_page(g: Graph) -> DataFrame:
    return g.episodes().orderBy(F.desc("created_at"), "id").offset(10).limit(50).select("id", "behavior_name")


@query("SELECT source_id, target_id FROM relations WHERE source_type IS NULL")
def unclassified_edges(g: Graph) -> DataFrame:
    return g.relations().where(F.col("source_type").isNull()).select("source_id", "target_id")


@query(f"""WITH {SEEDS}, e AS (SELECT source_id AS a, target_id AS b FROM relations UNION SELECT target_id, source_id FROM relations), n AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM seeds))
SELECT n.id, coalesce(name, '') AS label, layout_x AS x FROM n JOIN concepts c ON c.id = n.id WHERE layout_x IS NOT NULL ORDER BY n.id LIMIT 40""")
def map_neighbours(g: Graph) -> DataFrame:
    ends = graph.both_ways(g.relations()).join(seeds(g).withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    return ends.join(g.concepts(), "id").where("layout_x IS NOT NULL").orderBy("id").limit(40).select("id", F.coalesce("name", F.lit("")).alias("label"), F.col("layout_x").alias("x"))


@query("SELECT count(*) AS nodes, count(DISTINCT cluster) AS clusters, (SELECT count(*) FROM relations) AS edges, (SELECT count(*) FROM memories) AS memories FROM concepts")
def map_stats(g: Graph) -> DataFrame:
    nodes = g.concepts().agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("cluster").alias("clusters"))
    return nodes.join(F.broadcast(g.relations().agg(F.count(F.lit(1)).alias("edges")))).join(F.broadcast(g.memories().agg(F.count(F.lit(1)).alias("memories"))))


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT concept_id))[1:10], '|') AS concepts FROM episodes e JOIN episode_concept c ON c.episode_id = e.id GROUP BY 1""")
def concept_union(g: Graph) -> DataFrame:
    rows = g.episodes().join(g.episode_concept().withColumnRenamed("episode_id", "id"), "id")
    return rows.groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("concept_id")), 1, 10).cast("array<string>"), "|").alias("concepts"))


# Communities.

LINKED = "e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM relations)"


@query(f"""WITH {LINKED}, k AS (SELECT a AS id, count(*) AS k FROM e GROUP BY a), m AS (SELECT sum(k) AS m FROM k),
g AS (SELECT e.a AS id, e.b AS target, m - x.k * (y.k - x.k + x.k) AS gain FROM e JOIN k x ON x.id = e.a JOIN k y ON y.id = e.b, m)
SELECT id, target, gain::BIGINT AS gain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, target) AS r FROM g WHERE gain > 0) WHERE r = 1""")
def first_moves(g: Graph) -> DataFrame:
    """The best move of every node out of a community of its own."""
    edges = written(communities.adjacency(g.relations()))
    alone = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("label", F.col("id"))
    moves = communities.candidates(edges, alone, edges.agg(F.sum("w")).first()[0])
    return moves.select("id", "target", F.col("gain").cast("long").alias("gain"))


@query(f"""WITH {LINKED}, w AS (SELECT x.cluster AS c, y.cluster AS d FROM e JOIN concepts x ON x.id = e.a JOIN concepts y ON y.id = e.b),
t AS (SELECT c, sum((c = d)::INT) AS i, count(*) AS t FROM w GROUP BY c), s AS (SELECT sum(t)::DOUBLE AS s FROM t)
SELECT (SELECT count(DISTINCT cluster) FROM concepts) AS communities, round(sum(i) / s - sum((t / s) * (t / s)), 9) AS modularity FROM t, s GROUP BY s""")
def cluster_modularity(g: Graph) -> DataFrame:
    return communities.modularity(g.concepts().select("id", F.col("cluster").alias("label")), written(communities.adjacency(g.relations())))


@query()
def louvain_clusters(g: Graph) -> DataFrame:
    """Communities of all concepts; small ones join the nearest larger one on the map."""
    nodes = g.concepts().select("id", F.col("layout_x").alias("x"), F.col("layout_y").alias("y"))
    labels = written(communities.louvain(nodes, communities.adjacency(g.relations(), nodes), rounds=6, levels=4))
    return labels.join(communities.clusters(labels, nodes), "id")


@query()
def merged_duplicates(g: Graph) -> DataFrame:
    """Of all names that are alike, what each is merged into, most similar pairs first."""
    names = g.concepts().select("name").distinct()
    pairs = resolver.alike(names.select(F.col("name").alias("a")), names.select(F.col("name").alias("b")), 0.8).where("a < b")
    return ranking.merges(pairs.withColumn("similarity", F.round("similarity", 9)))


@query("""SELECT id, name, layout_x AS x, layout_y AS y FROM concepts WHERE layout_x BETWEEN 100 AND 900 AND layout_y BETWEEN 50 AND 950 AND ('0x' || md5('7:' || id)[1:8])::UBIGINT * 4.0::DOUBLE < 4294967296""")
def sampled_map(g: Graph) -> DataFrame:
    """About a quarter of the concepts in view."""
    seen = g.concepts().where("layout_x BETWEEN 100 AND 900 AND layout_y BETWEEN 50 AND 950")
    return ranking.bernoulli(seen, "id", 4.0, seed=7).select("id", "name", F.col("layout_x").alias("x"), F.col("layout_y").alias("y"))


@query("""WITH d AS (SELECT source_id AS id, count(*) AS n FROM (SELECT source_id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY 1),
p AS (SELECT c.id, layout_x AS x, layout_y AS y, 1.0 + coalesce(n, 0) / 20.0 AS r FROM concepts c LEFT JOIN d ON d.id = c.id),
q AS (SELECT a.id AS a, b.id AS b, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d, (a.r + b.r) * 2.5 AS m FROM p a JOIN p b ON a.id < b.id),
u AS (SELECT a, b, round((m - d) / 2 * (CASE WHEN d > 0 THEN dx / d ELSE 1 END) * 1000000)::BIGINT AS px, round((m - d) / 2 * (CASE WHEN d > 0 THEN dy / d ELSE 0 END) * 1000000)::BIGINT AS py FROM q WHERE d < m * 0.999),
s AS (SELECT a AS id, -px AS px, -py AS py FROM u UNION ALL SELECT b, px, py FROM u)
SELECT id, sum(px)::BIGINT AS px, sum(py)::BIGINT AS py FROM s GROUP BY id""")
def pushed_nodes(g: Graph) -> DataFrame:
    """One round of pushes (millionths) between all concepts of the map, whose circles grow with their edges."""
    degree = graph.degrees(g.concepts(), g.relations())
    rows = g.concepts().select("id", F.col("layout_x").alias("x"), F.col("layout_y").alias("y")).join(degree, "id")
    return spacing.pushes(written(rows.select("id", "x", "y", (1 + F.col("degree") / 20).alias("radius")), "circles"), 2.5)


def _bodies(g: Graph) -> DataFrame:
    degree = graph.degrees(g.concepts(), g.relations())
    return g.concepts().select("id", F.col("layout_x").alias("x"), F.col("layout_y").alias("y")).join(degree, "id").select("id", "x", "y", (1.0 + F.col("degree")).alias("m"))


@query("""WITH g AS (SELECT source_id AS id, count(*) AS n FROM (SELECT source_id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY 1),
p AS (SELECT c.id, layout_x AS x, layout_y AS y, 1.0::DOUBLE + coalesce(n, 0) AS m FROM concepts c LEFT JOIN g ON g.id = c.id),
e AS (SELECT min(x) AS ox, min(y) AS oy, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM p),
c AS (SELECT p.*, l, least(floor((x - ox) / side * (1 << l)), (1 << l) - 1)::BIGINT AS i, least(floor((y - oy) / side * (1 << l)), (1 << l) - 1)::BIGINT AS j FROM p, e, range(13) AS r(l)),
k AS (SELECT l::BIGINT AS l, i, j, count(*) AS n, sum(m) AS m, sum(m * x) / sum(m) AS x, sum(m * y) / sum(m) AS y FROM c GROUP BY ALL),
u AS (SELECT k.*, coalesce(a.n, 9) AS above FROM k LEFT JOIN k a ON a.l = k.l - 1 AND a.i = k.i // 2 AND a.j = k.j // 2),
b AS (SELECT a.l, a.i, a.j, s.i AS si, s.j AS sj, s.m, s.x, s.y, abs(a.i - s.i) <= 1 AND abs(a.j - s.j) <= 1 AS near, greatest(a.n, s.n) <= 8 AS few FROM u a JOIN u s ON s.l = a.l AND abs(a.i // 2 - s.i // 2) <= 1 AND abs(a.j // 2 - s.j // 2) <= 1 AND greatest(a.above, s.above) > 8),
f AS (SELECT l, i, j, m, x, y FROM b WHERE NOT near UNION ALL SELECT b.l, b.i, b.j, c.m, c.x, c.y FROM b JOIN c ON c.l = b.l AND c.i = b.si AND c.j = b.sj WHERE near AND few),
t AS (SELECT c.id, c.m * f.m / (pow(c.x - f.x, 2) + pow(c.y - f.y, 2)) AS w, c.x - f.x AS dx, c.y - f.y AS dy FROM c JOIN f USING (l, i, j) WHERE c.x <> f.x OR c.y <> f.y)
SELECT p.id, round(coalesce(sum(w * dx), 0), 6) AS fx, round(coalesce(sum(w * dy), 0), 6) AS fy FROM p LEFT JOIN t ON t.id = p.id GROUP BY p.id""")
def map_repulsions(g: Graph) -> DataFrame:
    """What pushes each concept of the map away from all others, whose masses grow with their edges."""
    return repulsion.repulsions(_bodies(g)).select("id", *[F.round(c, 6).alias(c) for c in ("fx", "fy")])


@query()
def arranged_nodes(g: Graph) -> DataFrame:
    """A map of all concepts after ten rounds of pulls along edges and pushes between all."""
    return repulsion.arrange(g.concepts(), g.relations(), rounds=10)
