"""Layers, commits, racing writers, and what a write costs."""

from __future__ import annotations

import threading

import pytest

from loomgraph.sources import store as store_module
from loomgraph.sources.store import MOST_LAYERS, Conflict, GraphStore


@pytest.fixture
def store(spark, tmp_path):
    made = GraphStore(spark, f"file://{tmp_path}/g")
    made.setup()
    made.setup()
    assert made.version() == 0
    return made


def concepts(spark, rows):
    return spark.createDataFrame(rows, "id string, name string")


def names(store, version=None):
    return {r["id"]: r["name"] for r in store.read("concepts", version).collect()}


def weight(tmp_path):
    return sum(f.stat().st_size for f in (tmp_path / "g/data").rglob("*.parquet"))


def test_a_write_costs_its_rows(spark, store, tmp_path):
    rows = [(f"c{k}", f"a long name of concept {k * 7919}") for k in range(20_000)]
    store.save("concepts", concepts(spark, rows))
    full = weight(tmp_path)
    store.save("concepts", concepts(spark, [("c5", "five"), ("c7", "seven"), ("new", "n")]))
    assert weight(tmp_path) - full < full / 5
    after = weight(tmp_path)
    store.save("concepts", concepts(spark, [("c5", "five"), ("c7", "seven")]))  # nothing changes
    store.save("concepts", concepts(spark, rows[8:4000]))
    assert weight(tmp_path) - after < full / 20 and len(store.latest()[1]["concepts"]) == 4
    got = names(store)
    assert len(got) == 20_001 and (got["c5"], got["c6"], got["new"]) == ("five", rows[6][1], "n")
    store.compact("concepts")
    assert names(store) == got and len(store.latest()[1]["concepts"]) == 1


def test_missing_columns_and_deletes(spark, store):
    store.save("concepts", spark.createDataFrame([("a", "x", "tool", ["p"]), ("b", "y", None, None)], "id string, name string, type string, aliases array<string>"))
    store.save("concepts", concepts(spark, [("a", "z"), ("c", None)]))
    found = {r["id"]: (r["name"], r["type"], r["aliases"], r["level"]) for r in store.read("concepts").collect()}
    assert found == {"a": ("z", "tool", ["p"], 2), "b": ("y", "general", [], 2), "c": (None, "general", [], 2)}
    store.save("relations", spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "gone")], "source_id string, target_id string"))
    store.delete("relations", spark.createDataFrame([("a",)], "source_id string"))
    assert [(r["source_id"], r["target_id"]) for r in store.read("relations").collect()] == [("b", "c")]
    store.delete("concepts", spark.createDataFrame([("a",), ("none",)], "id string"))
    assert set(names(store)) == {"b", "c"} and store.get("concepts", ["a", "b"]).count() == 1
    store.save("concepts", concepts(spark, [("a", "back")]))
    assert {r["type"] for r in store.get("concepts", ["a"]).collect()} == {"general"}  # nothing of the old row comes back


def test_several_tables_at_once(spark, store):
    own = store.begin()
    own.save("concepts", concepts(spark, [("a", "x")]))
    own.save("memories", spark.createDataFrame([("m", "text")], "id string, content string"))
    own.save("memory_concept", spark.createDataFrame([("m", "a"), ("m", "b")], "memory_id string, concept_id string"))
    assert store.read("concepts").count() == 0
    number = own.commit()
    assert [store.read(t).count() for t in ("concepts", "memories", "memory_concept")] == [1, 1, 1]
    store.clear()
    assert [store.read(t).count() for t in ("concepts", "memories", "memory_concept")] == [0, 0, 0]
    store.rollback(number)
    assert [store.read(t).count() for t in ("concepts", "memories", "memory_concept")] == [1, 1, 1]


def test_racing_upserts_both_stay(spark, store):
    store.save("concepts", concepts(spark, [("a", "x")]))
    own = [store.begin() for _ in range(4)]
    for k, each in enumerate(own):
        each.save("concepts", concepts(spark, [(f"n{k}", "new"), ("a", f"by {k}")]))
    gate, numbers = threading.Barrier(4), []

    def finish(each):
        gate.wait()
        numbers.append(each.commit())

    threads = [threading.Thread(target=finish, args=(e,)) for e in own]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == [2, 3, 4, 5]
    got = names(store)
    assert set(got) == {"a", "n0", "n1", "n2", "n3"} and got["a"].startswith("by ")


def test_racing_replacements_do_not(spark, store):
    store.save("concepts", concepts(spark, [("a", "x")]))
    first, second, third = store.begin(), store.begin(), store.begin()
    first.write("concepts", concepts(spark, [("a", "first")]))
    second.write("concepts", concepts(spark, [("a", "second")]))
    third.save("relations", spark.createDataFrame([("a", "a")], "source_id string, target_id string"))  # has read concepts
    first.commit()
    for late in (second, third):
        with pytest.raises(Conflict):
            late.commit()
    assert names(store) == {"a": "first"} and store.read("relations").count() == 0


def test_compaction_and_vacuum(spark, store, tmp_path):
    for k in range(MOST_LAYERS + 1):
        store.save("concepts", concepts(spark, [(f"c{k}", str(k)), ("a", str(k))]))
    assert len(store.latest()[1]["concepts"]) == 1
    got, before = names(store), weight(tmp_path)
    assert got == {f"c{k}": str(k) for k in range(MOST_LAYERS + 1)} | {"a": str(MOST_LAYERS)}
    assert names(store, 1) == {"c0": "0", "a": "0"}
    assert store.vacuum(keep=1) == MOST_LAYERS + 1 and weight(tmp_path) < before and names(store) == got


def test_last_column_of_a_partial_row(spark, store):
    """A row of one key twice in a batch counts once, and null is a value."""
    store.save("documents", spark.createDataFrame([("d", "t", "x"), ("d", "u", None)], "id string, title string, content string"))
    assert [(r["title"], r["content"]) for r in store.read("documents").collect()] == [("u", None)]
    store.save("documents", spark.createDataFrame([("d", None)], "id string, title string"))
    assert store.read("documents").first()["title"] is None


def test_buckets_grow_with_the_rows_of_a_save(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "BUCKET_ROWS", 10)
    store = GraphStore(spark, f"file://{tmp_path}/s")
    store.setup()
    rows = spark.range(300).selectExpr("cast(id AS string) AS id", "concat('n', id) AS name")
    store.save("concepts", rows.union(rows))
    store.save("concepts", rows.where("id < 5").selectExpr("id", "'new' AS name"))
    first, second = store.latest()[1]["concepts"]
    assert first["buckets"] == 30 and second["buckets"] == store_module.BUCKETS
    assert len(list((tmp_path / "s" / first["path"]).glob("_bucket=*"))) > 20
    assert {r["id"]: r["name"] for r in store.read("concepts").collect()} == {str(k): "new" if k < 5 else f"n{k}" for k in range(300)}
    assert {r["id"] for r in store.get("concepts", ["3", "299", "none"]).collect()} == {"3", "299"}
