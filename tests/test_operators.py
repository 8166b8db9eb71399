from __future__ import annotations

import math
import random
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import scores, text
from loomgraph.functions.providers import call_model, hashed_embedding
from loomgraph.functions.similarity import jaro_winkler_pair
from loomgraph.operators import evaluation, graph, learning, ranking, search, structure
from loomgraph.sources import readers
from loomgraph.sources.store import GraphStore, last_wins, upsert
from loomgraph.streaming import events


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


@pytest.fixture(scope="module")
def small_graph(spark):
    edges = [("c1", "c2", 0.9), ("c1", "c3", 0.8), ("c2", "c3", 0.85), ("c3", "c4", 0.7), ("c3", "c5", 0.6)]
    relations = spark.createDataFrame([(a, b, w, False, False) for a, b, w in edges], "source_id string, target_id string, weight double, is_universal boolean, is_semantic boolean")
    concepts = spark.createDataFrame([(f"c{k}", s) for k, s in zip(range(1, 6), ["active", None, "active", "merged", "active"], strict=True)], "id string, status string")
    return concepts, relations


def test_activation(spark, small_graph):
    seeds = spark.createDataFrame([("c1",)], "id string")
    got = {r["id"]: r["activation"] for r in graph.activate(seeds, small_graph[1], hops=1, threshold=0.1, rescale=0.5).collect()}
    assert got == {"c1": 1.0, "c2": pytest.approx(0.3825), "c3": pytest.approx(0.34)}


def test_activation_keeps_the_larger_value(spark, small_graph):
    seeds = spark.createDataFrame([("c1",)], "id string")
    rows = {r["id"]: (r["activation"], r["hop"]) for r in graph.activate(seeds, small_graph[1], hops=3, threshold=0.1, rescale=0.5).collect()}
    assert rows["c3"] == (pytest.approx(0.34), 1) and rows["c4"][1] == 2


def test_paths_neighbours_and_bridges(spark, small_graph):
    concepts, relations = small_graph
    ends = spark.createDataFrame([("c1",), ("c4",)], "id string")
    assert [tuple(r) for r in graph.shortest_paths(ends, relations).collect()] == [("c1", "c4", 2, ["c1", "c3", "c4"])]
    assert {r["target_id"] for r in graph.neighbours(ends, relations, concepts).collect()} == {"c2", "c3"}
    assert {r["id"] for r in graph.bridges(ends, relations, concepts).collect()} == {"c2", "c3", "c5"}


def test_redirect(spark):
    edges = spark.createDataFrame([(1, 3, 0.5, 1), (2, 3, 0.9, 2), (1, 2, 0.4, 1), (3, 2, 0.1, 1)], "source_id long, target_id long, weight double, co_occurrence_count long")
    merged = spark.createDataFrame([(2, 1)], "id long, canonical long")
    assert sorted((r["source_id"], r["target_id"], r["weight"]) for r in graph.redirect(edges, merged).collect()) == [(1, 3, 0.9), (3, 1, 0.1)]


def test_fusion(spark):
    rows = [("x", "a", 0.9), ("x", "b", 0.8), ("x", "c", 0.7), ("y", "b", 0.95), ("y", "a", 0.85), ("y", "d", 0.75)]
    got = {r["id"]: r for r in ranking.fuse(spark.createDataFrame(rows, "source string, id string, score double")).collect()}
    assert got["a"]["fused"] == pytest.approx(1 / 61 + 1 / 62) == pytest.approx(got["b"]["fused"])
    assert got["c"]["fused"] == pytest.approx(1 / 63) and got["a"]["ranks"] == {"x": 1, "y": 2}


def test_diverse_selection():
    vectors = np.array([[1.0, 0.0], [0.999, 0.01], [0.6, 0.8]])
    assert ranking.select_diverse(np.array([1.0, 0.1]), vectors, 3)[:2] == [1, 2]
    assert ranking.select_diverse(np.array([1.0, 0.1]), vectors, 3, balance=1.0) == [1, 0, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_in_rounds(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(0, 25), r.randint(0, 25), r.choice([0.9, 0.91, 0.92, 0.95])) for _ in range(60)] + [(k, k + 1, 0.8 + k / 1000) for k in range(30, 40)] + [(k + 1, k, 0.7) for k in range(50, 58)]
    pairs = [p for p in pairs if p[0] != p[1]]
    best = {}
    for a, b, s in pairs:
        best[a, b] = max(best.get((a, b), 0), s)
    wanted = ranking.greedy_merges([(a, b, s) for (a, b), s in best.items()])
    got = {x["id"]: x["canonical"] for x in ranking.merges(spark.createDataFrame(pairs, "a long, b long, similarity double")).collect()}
    assert got == wanted
    assert ranking.merges(spark.createDataFrame([], "a long, b long, similarity double")).count() == 0


def test_bernoulli(spark):
    rows = spark.range(8000)
    got = ranking.bernoulli(rows, "id", 4.0).count()
    assert 1800 < got < 2200 and ranking.bernoulli(rows, "id", 1.0).count() == 8000
    assert ranking.bernoulli(rows.repartition(3), "id", 4.0).exceptAll(ranking.bernoulli(rows, "id", 4.0)).count() == 0


def test_greedy_merges():
    assert ranking.greedy_merges([(1, 2, 0.99), (2, 3, 0.98), (1, 4, 0.97), (4, 5, 0.96)]) == {2: 1, 4: 1}


def test_budget_chunks():
    assert ranking.budget_chunks(iter([500, 500, 100, 2000, 10])) == [0, 0, 1, 2, 3]


@given(st.text("abcdef", max_size=9), st.text("abcdef", max_size=9))
def test_jaro_winkler_bounds(a, b):
    s = jaro_winkler_pair(a, b)
    assert 0 <= s <= 1 and s == pytest.approx(jaro_winkler_pair(b, a))
    assert (s == 1) == (a == b and a != "")


def test_jaro_winkler_values():
    assert jaro_winkler_pair("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler_pair("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_text_functions(spark):
    rows = [("---\na: 1\n---\n# Docker\r\n\r\n\r\n\r\n• one  two   three\n| + | — |\nend",)]
    got = values(spark, rows, "t string", clean=text.clean_markdown(F.col("t")), title=text.title_of(F.col("t")))[0]
    assert got == ("# Docker\n\n- one two three\n| да | нет |\nend", "Docker")
    assert values(spark, [("Щука ёж",), ("ДоM",), ("abс",)], "t string", x=text.to_latin(F.col("t")), y=text.fix_lookalikes(F.col("t"))) == [("Shchuka yozh", "Щука ёж"), ("DoM", "ДоМ"), ("abs", "abc")]
    assert values(spark, [("a+b(c)",)], "t string", x=text.escape_query(F.col("t"))) == [(r"a\+b\(c\)",)]
    assert values(spark, [("кто такой",), ("сравни это",), ("привет",)], "t string", k=text.dynamic_top_k(F.col("t"))) == [(4,), (8,), (6,)]
    assert values(spark, [("a",), ("one two three four five",)], "t string", q=F.round(text.chunk_quality(F.col("t"), ["one"]), 4)) == [(0.0,), (0.75,)]


def test_thinking_and_json(spark):
    rows = [("<think>x</think>yes",), ("a</think>b <think>c",), ('say ```json\n{"k": 1}\n``` so',), ("none",)]
    got = values(spark, rows, "t string", s=text.strip_thinking(F.col("t")), j=text.tolerant_json(F.col("t")).cast("string"))
    assert [g[0] for g in got[:2]] == ["yes", "ab c"]
    assert got[2][1] == '{"k":1}' and got[3][1] is None


def test_source_match(spark):
    rows = [("https://a.b/x/y", "https://a.b/x/y/", 1.0), ("https://a.b/x/y", "https://c.d/x/y", 1.0), ("https://a.b/p?pageId=7", "https://a.b/q?pageId=7", 0.95), ("https://a.b/1/y", "https://a.b/2/y", 0.9), ("https://a.b/q", "https://z.z/w", 0.0), ("", "", 0.0)]
    assert [g[0] for g in values(spark, rows, "a string, b string, w double", m=text.source_match(F.col("a"), F.col("b")))] == [r[2] for r in rows]


def test_scores(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    got = values(spark, [(None,), (datetime(2024, 1, 1),)], "t timestamp", h=scores.hours_since(F.col("t"), now), r=scores.recency(F.col("t"), now))
    assert got[0][0] == 1000 and got[1] == (24.0, pytest.approx(0.995**24))
    history = [([],), ([datetime(2024, 1, 1, 23, 59, 56)],)]
    got = values(spark, history, "h array<timestamp>", b=scores.base_level(F.col("h"), now), p=scores.retrieval_probability(scores.base_level(F.col("h"), now)), s=scores.status_of(scores.base_level(F.col("h"), now)))
    assert got[0] == (-math.inf, 0.0, "archived") and got[1][0] == pytest.approx(math.log(0.5)) and got[1][2] == "active"
    assert values(spark, [("Table",), (None,), ("person",)], "k string", w=scores.source_weight(F.col("k"))) == [(0.95,), (0.7,), (0.7,)]
    assert values(spark, [([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>", c=F.round(scores.cosine(F.col("a"), F.col("b")), 6)) == [(None,), (1.0,)]
    kinds = values(spark, [("", "u"), ("", ""), ("short", ""), ("word " * 30, "u")], "a string, u string", k=scores.answer_type(F.col("a"), F.col("u")))
    assert [k[0] for k in kinds] == ["url_only", "empty", "short_no_url", "full"]


def test_strengthen_counts_repeats(spark):
    memories = spark.createDataFrame([(1, 2.0, 0), (2, 1.32, 0)], "id long, strength double, access_count long")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert sorted(tuple(r) for r in learning.strengthen(memories, ids).select("id", F.round("strength", 6), "access_count").collect()) == [(1, 2.2, 2), (2, 1.42, 1)]
    assert {r["id"]: r["strength"] for r in learning.weaken(memories, ids).collect()} == {1: pytest.approx(2.0 * 0.95**2), 2: 1.3}


def test_metrics(spark):
    runs = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query_id string, item_id string, rank int")
    judged = spark.createDataFrame([("q", "b", 1), ("q", "d", 1), ("q", "a", 0)], "query_id string, item_id string, relevance int")
    got = {(r["query_id"], r["k"]): r for r in evaluation.metrics(runs, judged, (1, 3)).collect()}
    assert (got["q", 3]["recall"], got["q", 3]["mrr"]) == (0.5, 0.5) and got["q", 3]["precision"] == pytest.approx(1 / 3)
    assert got["q", 3]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["z", 3]["recall"] == 0


def test_bm25_and_ivf(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue cat")], "id long, content string")
    asked = spark.createDataFrame([("q", "red RED dog")], "query_id string, text string")
    assert [r["id"] for r in search.Bm25Index(docs).search(asked).orderBy(F.desc("score")).collect()] == [2, 1]
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(r.standard_normal((60, 8)))], "id long, embedding array<double>")
    asked = rows.where("id < 3").withColumnRenamed("id", "query_id")
    exact = {tuple(x) for x in search.nearest(asked, rows, 5).select("query_id", "id").collect()}
    found = {tuple(x) for x in search.IvfIndex(rows, cells=4).search(asked, 5, probes=4).select("query_id", "id").collect()}
    assert exact == found


def test_ivf_with_few_probes(spark):
    """Cells that are not probed first still give what is nearest."""
    r = np.random.default_rng(1)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(r.standard_normal((300, 8)))], "id long, embedding array<double>")
    asked = rows.where("id < 20").withColumnRenamed("id", "query_id")
    exact = {tuple(x) for x in search.nearest(asked, rows, 5).select("query_id", "id").collect()}
    index = search.IvfIndex(rows, cells=12)
    assert exact == {tuple(x) for x in index.search(asked, 5, probes=2).select("query_id", "id").collect()}
    assert len(exact & {tuple(x) for x in index.search(asked, 5, probes=2, proven=False).select("query_id", "id").collect()}) < len(exact)


def test_ivf_query_finds_the_nearest(spark):
    from loomgraph.plans import catalogue

    found, exact = ({(x["query_id"], x["id"]) for x in catalogue.QUERIES[q](spark, "/root/testdata/sf0.001").collect()} for q in ("ivf_search", "knn"))
    assert found == exact


def test_clean_whitespace_keeps_every_document(spark, tmp_path):
    from loomgraph.plans import catalogue

    def by_hand(text):
        if text is None:
            return None
        lines = re.sub(r"(?<=\S) {2,}", " ", text.replace("\r\n", "\n").replace("\r", "\n")).split("\n")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip(" \t") for x in lines))

    texts = ["a  b \nc", "end ", "tab\t\nx", "a\r\n \n\n\nb", "  indent  x", "", " ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in catalogue.QUERIES["clean_whitespace"](spark, str(tmp_path)).collect()}
    assert got == {k: by_hand(t) for k, t in enumerate(texts)}


def test_structure(spark):
    body = "# Rates\n\n| Name | Price | Free |\n|---|---|---|\n| A | 1 | да |\n| B | 2 | |\n\ntext\n\n1. one\n2. two\n    more\n4. four\n8. gone\n\n- [ ] x\n- [x] y\n"
    found = structure.find_tables(body)
    assert (found[0].title, found[0].headers, found[0].rows) == ("Rates", ["Name", "Price", "Free"], [["A", "1", "да"], ["B", "2", ""]])
    assert "[ТАБЛИЦА]" in structure.without_tables(body) and structure.without_lists(body).count("[СПИСОК]") == 2
    assert [(x.kind, x.items) for x in structure.find_lists(body)] == [("numbered", ["one", "two", "four"]), ("checklist", ["x", "y"])]
    chunks = structure.char_chunks("\n\n".join("p" * 900 for _ in range(4)))
    assert len(chunks) == 3 and all(len(c) <= 2200 for c, _, _ in chunks)
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string")
    assert structure.tables(docs).count() == 1 and structure.lists(docs).count() == 2 and structure.table_memories(structure.tables(docs)).count() == 3
    shown = structure.with_renderings(structure.tables(docs)).first()
    assert shown["row_texts"] == ["A — Price: 1, Free: да", "B — Price: 2"] and shown["column_texts"] == ["Price: A: 1, B: 2", "Free: A: да"]


def test_protocol(spark):
    raw = "CONCEPT|Docker|tool|x\nCONCEPT|docker|other|y\nCONCEPT|Image|odd|z\nRELATION|Docker|Image|uses|2\nRELATION|Docker|Docker|uses\nRELATION|Docker|Nothing|uses\nMEMORY|images are built|procedure|99|Docker, Image\nMEMORY|tiny|fact|1\nnoise"
    lines = structure.protocol_lines(spark.createDataFrame([(1, raw)], "id long, raw string")).cache()
    concepts = structure.concept_lines(lines)
    assert sorted((r["name"], r["type"]) for r in concepts.collect()) == [("docker", "tool"), ("image", "general")]
    assert [(r["source"], r["target"], r["weight"]) for r in structure.relation_lines(lines, concepts).collect()] == [("docker", "image", 0.75)]
    assert [(r["memory_type"], r["importance"], r["concepts"]) for r in structure.memory_lines(lines).collect()] == [("procedure", 10.0, ["docker", "image"])]


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/g")
    store.setup()
    store.save("concepts", spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "id string, name string"))
    store.save("relations", spark.createDataFrame([("a", "b"), ("a", "gone")], "source_id string, target_id string"))
    before = store.backup()
    assert store.read("concepts").count() == 2 and [r["weight"] for r in store.read("relations").collect()] == [0.5]
    store.save("concepts", spark.createDataFrame([("b", "new")], "id string, name string"))
    assert {r["name"] for r in store.get("concepts", ["b"]).collect()} == {"new"}
    assert store.query("SELECT count(*) AS n FROM concepts WHERE name = :name", name="new").first()["n"] == 1
    store.clear()
    assert store.read("concepts").count() == 0
    store.rollback(before)
    assert {r["name"] for r in store.get("concepts", ["b"]).collect()} == {"y"}
    now = store.version()
    (tmp_path / "g/_log/_half-written").write_text("x")
    assert store.version() == now > before


def test_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, w double")
    new = spark.createDataFrame([(2, None), (3, "c")], "id long, name string")
    assert sorted((tuple(r) for r in upsert(old, new, ["id"]).collect())) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)]
    assert last_wins(spark.createDataFrame([(1, 1), (1, 5), (1, 3)], "id long, at int"), ["id"], "at").first()["at"] == 5


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# Title\n\nbody")
    (tmp_path / "d/b.txt").write_text("plain")
    (tmp_path / "d/c.bin").write_text("no")
    rows = {r["title"]: r for r in readers.directory(spark, f"{tmp_path}/d").collect()}
    assert set(rows) == {"Title", "b"} and rows["Title"]["doc_type"] == "markdown"
    (tmp_path / "e.csv").write_text("﻿Вопрос;Ответ;URL\nwhat?;this;http://x\n;;\n", encoding="utf-8")
    assert [tuple(r) for r in readers.evaluation_csv(spark, f"{tmp_path}/e.csv").collect()] == [("what?", "this", "http://x")]
    (tmp_path / "g.json").write_text('[{"query": "q", "tags": ["t"]}]')
    assert [tuple(r) for r in readers.golden_queries(spark, f"{tmp_path}/g.json").collect()] == [("q", [], "", ["t"])]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r["event_type"]] = tuple(r)

    events.drain(events.feedback_counters(events.event_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/check", keep, mode="complete")
    assert seen == {r["event_type"]: tuple(r) for r in events.feedback_counters(table).collect()}


def test_providers(spark):
    rows = spark.createDataFrame([("a b a",), ("",)], "prompt string")
    vectors = [r[0] for r in rows.select(hashed_embedding(F.col("prompt"), 16)).collect()]
    assert sum(x * x for x in vectors[0]) == pytest.approx(1, abs=1e-5) and sum(vectors[1]) == 0
    assert [r["answer"] for r in call_model(rows, lambda p: [x.upper() for x in p]).collect()] == ["A B A", ""]
