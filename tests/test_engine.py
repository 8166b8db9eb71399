"""The engine end to end on a small graph, saved indexes, layouts, and streams with state."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.operators import graph, search, structure
from loomgraph.streaming import events

RAW = """CONCEPT|docker|tool|Runs containers
CONCEPT|image|resource|What docker runs
RELATION|docker|image|uses|1
MEMORY|docker runs an image in a container, and it keeps the layers of that image in a store of its own so that others find them again|fact|8|docker, image
MEMORY|short|fact|1|x
PERSON|Иван Петров|тимлид|core"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    # Inside, so that it is pickled by value: the workers cannot import this module.
    def answers(prompts):
        return [f"answer to {p.splitlines()[-1]}\nСТРАТЕГИЯ: Look up — ask the graph" for p in prompts]

    made = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}/g", answers)
    docs = spark.createDataFrame([("d1", "text"), ("d2", "# T\n\n| a | b |\n|---|---|\n| one thing | two |\n")], "doc_id string, text string")
    counts = made.ingest(docs, spark.createDataFrame([("d1", RAW)], "id string, raw string"))
    assert counts["concepts"] == 2 and counts["relations"] == 1 and counts["memory_concept"] == 2
    return made


def test_retrieve_and_reason(engine):
    found = engine.retrieve("what does docker keep", ["Docker"]).collect()
    assert found and "bm25" in found[0]["sources"]
    assert engine.reason("what does docker keep", ["Docker"], include=["c_extra"]) == "answer to what does docker keep"
    episode = engine.store.read("episodes").first()
    assert (episode["behavior_name"], episode["domain"], episode["success_count"]) == ("look_up", "docker", 0) and "c_extra" in episode["concepts_activated"]
    assert engine.store.read("memories").where("access_count = 1").count() >= 1
    engine.feedback(episode["id"], "positive")
    assert engine.store.read("episodes").first()["success_count"] == 1
    engine.feedback(episode["id"], "correction", "Нужно иначе, и это достаточно длинно")
    assert engine.store.read("memories").where("importance = 8 AND memory_type = 'procedure'").count() == 1
    memories, other = engine.re_reason(episode["id"])
    assert memories.count() >= 0 and other.count() == 0


def test_forced_nodes(engine):
    wanted = engine.store.read("memories").orderBy("id").first()["id"]
    engine.reason("nothing in common", ["docker"], include=[wanted])
    assert wanted in engine.store.read("episodes").where("query = 'nothing in common'").first()["memories_used"]
    engine.reason("what is docker", ["docker"], exclude=[wanted])
    assert wanted not in engine.store.read("episodes").where("query = 'what is docker'").first()["memories_used"]


def test_admin(engine):
    assert engine.stats().first()["nodes"] == 2 and engine.page("concepts", "name").count() == 2
    assert [r["name"] for r in engine.neighbours("docker").collect()] == ["image"]
    assert engine.forget().count() >= 1
    engine.calibrate()
    ids = {r["name"]: r["id"] for r in engine.store.read("concepts").collect()}
    assert engine.merge([(ids["docker"], ids["image"], 0.9)], dry_run=True) == {ids["image"]: ids["docker"]}
    engine.merge([(ids["docker"], ids["image"], 0.9)])
    assert engine.store.read("relations").count() == 0 and engine.store.read("concepts").where("status = 'merged'").count() == 1
    assert engine.duplicates().count() == 0
    episode = engine.store.read("episodes").first()["id"]
    assert engine.delete_episode(episode) and not engine.delete_episode(episode)
    engine.reset()
    assert engine.store.read("concepts").count() == 0


def test_saved_indexes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red stone"), (2, "blue river stone"), (3, "green")], "id long, content string")
    asked = spark.createDataFrame([(7, "stone river")], "query_id int, text string")
    search.Bm25Index(docs).save(f"{tmp_path}/b")
    again = search.Bm25Index.load(spark, f"{tmp_path}/b").search(asked).collect()
    assert sorted(again) == sorted(search.Bm25Index(docs).search(asked).collect()) and again[0]["id"] == 2
    r = np.random.default_rng(1)
    vectors = spark.createDataFrame([(k, r.standard_normal(8).tolist()) for k in range(200)], "id long, embedding array<double>")
    index = search.IvfIndex.load_or_build(vectors, f"{tmp_path}/i", cells=8)
    queries = vectors.where("id < 5").withColumnRenamed("id", "query_id")
    exact = {(x["query_id"], x["id"]) for x in search.nearest(queries, vectors, 5).collect()}
    assert {(x["query_id"], x["id"]) for x in index.search(queries, 5, probes=2).collect()} == exact
    assert search.IvfIndex.load_or_build(vectors, f"{tmp_path}/i").count() == 200
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        search.IvfIndex.load(spark, f"{tmp_path}/none")


def test_nearest_in_blocks(spark):
    """Blocks of queries, string ids, equal vectors, zero and null ones, and other lengths."""
    r = np.random.default_rng(2)
    rows = [(f"v{k:03}", r.standard_normal(6).tolist()) for k in range(60)] + [(f"w{k}", [1.0] * 6) for k in range(20)] + [("zero", [0.0] * 6), ("none", None), ("odd", [1.0, 2.0]), ("gap", [None] * 6)]
    table = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = table.withColumnRenamed("id", "query_id")
    got = {(x["query_id"], x["id"]): x["score"] for x in search.nearest(queries, table, 7, block=9).collect()}
    good = {i: np.array(v) for i, v in rows if v and None not in v and any(v)}
    for q, a in good.items():
        same = sorted(((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), i) for i, b in good.items() if len(b) == len(a)))[:7]
        assert {x[1] for x in got if x[0] == q} == {i for _, i in same}
    assert not {x[0] for x in got} & {"zero", "none", "gap"}


def test_layout_and_orbits(spark):
    edges = [(0, k, 1.0) for k in range(1, 8)] + [(8, 9, 1.0)]
    relations = spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    nodes = spark.createDataFrame([(k,) for k in range(11)], "id long")
    at = graph.layout(nodes, relations, rounds=4)
    assert at.count() == 11 and at.where("x IS NULL OR abs(x) > 3001").count() == 0
    moved = {r["id"]: r for r in graph.orbits(at, relations, min_degree=5).collect()}
    assert len(moved) == 11 and all(moved[k]["hub"] == 0 for k in range(1, 8)) and moved[9]["hub"] is None
    report = graph.quality_report(nodes.withColumn("status", F.lit("active")), relations.withColumn("relation_type", F.lit("uses"))).first()
    assert report["orphans"] == 1 and "uses: 8" in graph.report_text(report, [type("R", (dict,), {})(relation_type="uses", n=8)])


def test_overlapping_chunks():
    assert structure.cut_sentences([30] * 10, set(), most=100, least=10, overlap=35) == [(0, 3, 90), (2, 5, 90), (4, 7, 90), (6, 9, 90), (8, 10, 60)]
    assert structure.cut_sentences([5, 5, 50, 5], {2}, most=60, least=10, overlap=0) == [(0, 2, 10), (2, 4, 55)]
    assert structure.cut_sentences([], set()) == []


def test_access_history_on_a_stream(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02}:00", k % 2) for k in range(20)]
    for part in range(2):
        spark.createDataFrame(rows[part::2], "event_id long, t string, id long").select("id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, number):
        seen.update({r["id"]: r["history"] for r in batch.collect()})

    events.drain(events.access_history(stream, keep=3), f"{tmp_path}/state", keep, mode="update")
    whole = events.access_history(spark.read.parquet(f"{tmp_path}/in"), keep=3)
    assert seen == {r["id"]: r["history"] for r in whole.collect()}


def test_ingested_documents_and_links(spark, tmp_path):
    def extract(texts):
        return [RAW if "docker" in t else "" for t in texts]

    made = Engine(spark, f"file://{tmp_path}/g")
    docs = spark.createDataFrame([("d1", "text"), ("d2", "# T\n\n| a | b |\n|---|---|\n| one thing | two |\n"), ("d3", None)], "doc_id string, text string")
    raw = spark.createDataFrame([("d1", RAW), ("d2", None)], "id string, raw string")
    counts = made.ingest(docs, raw)
    for table, n in counts.items():
        assert made.store.read(table).count() == n, table
    assert counts["documents"] == 3 and counts["memory_document"] >= counts["memories"] >= 2
    rows = {r["id"]: r for r in made.store.read("documents").collect()}
    assert {r["status"] for r in rows.values()} == {"completed"} and len(rows["d1"]["extracted_memory_ids"]) >= 1 and len(rows["d1"]["extracted_concept_ids"]) == 2
    assert made.ingest(docs, raw) == counts | {"concepts": 0} and made.store.read("memories").count() == counts["memories"]
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/one.md").write_text("# Docker\n\nAll about docker.")
    (tmp_path / "in/deep/two.txt").write_text("nothing")
    (tmp_path / "in/three.bin").write_text("docker")
    other = Engine(spark, f"file://{tmp_path}/h")
    counts = other.ingest_directory(f"{tmp_path}/in", extract)
    assert counts["documents"] == 2 and counts["concepts"] == 2 and counts["memory_document"] == counts["memories"] > 0
    assert {(r["title"], r["doc_type"]) for r in other.store.read("documents").collect()} == {("Docker", "markdown"), ("two", "text")}


def test_vector_list_and_rewritten_questions(spark, tmp_path):
    def model(prompts):
        # Stands for a model: a paraphrase with a word of its own, and a made-up answer in the words of one memory.
        return ["zebra crossing" if "Переформулируй" in p else "striped animals live in herds and run from lions across the wide plains all day long" for p in prompts]

    made = Engine(spark, f"file://{tmp_path}/g", model)
    facts = [
        "striped animals live in herds and run from lions across the wide plains all day long in the sun of the savanna until night comes",
        "every zebra has its own pattern of lines that no other one shares so that they know each other by sight in the large groups they form",
        "a bridge of stone spans the river near the old town and carries carts and people from one bank to the other since many hundred years ago",
    ]
    raw = "\n".join(["CONCEPT|bridge|resource|A way over water", *(f"MEMORY|{f}|fact|6|bridge" for f in facts)])
    made.ingest(spark.createDataFrame([("d", "text")], "doc_id string, text string"), spark.createDataFrame([("d", raw)], "id string, raw string"))
    by = {r["content"][:6]: r["id"] for r in made.store.read("memories").collect()}
    plain = {r["id"]: set(r["sources"].split("+")) for r in made.retrieve("stone bridge", ["bridge"]).collect()}
    assert {"bm25", "vector", "graph"} <= plain[by["a brid"]]
    more = {r["id"]: set(r["sources"].split("+")) for r in made.retrieve_rewritten("stone bridge", ["bridge"]).collect()}
    assert "rewrite" in more[by["every "]] and "rewrite" not in more[by["a brid"]] and "hyde" in more[by["stripe"]]
    silent = Engine(spark, f"file://{tmp_path}/g")
    assert {r["id"]: set(r["sources"].split("+")) for r in silent.retrieve_rewritten("stone bridge", ["bridge"]).collect()} == plain
