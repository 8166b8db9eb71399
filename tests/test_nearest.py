"""Nearest neighbours in steps of bounded memory, and what is built on them."""

from __future__ import annotations

import numpy as np
import pytest

from loomgraph.operators import learning, search


@pytest.fixture(scope="module")
def vectors(spark):
    """More rows than a step, most of them copies, with rows that have no direction."""
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 4)).round(2)
    data = [(i, [float(x) for x in base[i % 40]], "active") for i in range(2 * search.STEP + 100)]
    odd = [(-1, None, "active"), (-2, [0.0] * 4, "active"), (-3, [float("nan")] * 4, "active"), (-4, [1.0], "active"), (-5, [1.0, None, 0.0, 0.0], "active")]
    return data, spark.createDataFrame(data + odd, "id long, embedding array<double>, status string").repartition(2)


def _brute(data, asked, k, least):
    x = np.array([v for _, v, _ in data])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for q in asked:
        scores = np.round(x @ x[q], 9)
        order = sorted((-s, i) for i, s in enumerate(scores) if i != q and s >= least)[:k]
        out |= {(q, i) for _, i in order}
    return out


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_contradictions_are_found_by_products_not_by_a_nested_loop(vectors):
    data, df = vectors
    found = learning.contradiction_candidates(df, df.where("id % 100 = 0"), 60, 0.9)
    assert "NestedLoopJoin" not in _plan(found)
    assert {(r["asked_id"], r["id"]) for r in found.collect()} == _brute(data, range(0, len(data), 100), 60, 0.9)


def test_similar_episodes_are_found_by_products_not_by_a_nested_loop(vectors):
    data, df = vectors
    found = learning.similar_episodes(df, df.where("id % 100 = 0"), 10, 0.5, successful=False)
    assert "NestedLoopJoin" not in _plan(found)
    assert {(r["asked_id"], r["id"]) for r in found.collect()} == _brute(data, range(0, len(data), 100), 10, 0.5)


def test_products_held_at_once_are_bounded():
    assert search.STEP * search.BLOCK * 8 <= 16 << 20


def test_upkeep_takes_the_smallest_ids_of_more_copies_than_a_search_keeps(spark, tmp_path):
    from loomgraph.plans.indexes import vector_upkeep
    from loomgraph.sources.derive import Graph

    r = np.random.default_rng(5)
    one, others = r.normal(size=8), r.normal(size=(60, 8))
    ids = r.permutation(6_000).tolist()
    rows = [(i, [float(x) for x in (one if i >= 60 else others[i])], i % 10) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(x["query_id"], x["id"]) for x in vector_upkeep(Graph(spark, str(tmp_path))).where("query_id = 100").collect()}
    assert found == {(100, i) for i in range(60, 71) if i % 10 != 3}


def test_partitioned_search_multiplies_matrices(spark, vectors):
    data, df = vectors
    rows = df.where("id >= 0").select("id", "embedding")
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = search.IvfIndex(rows, cells=4).search(asked, 60, probes=1)
    assert "zip_with" not in _plan(found) and "CartesianProduct" not in _plan(found)
    assert {(x["query_id"], x["id"]) for x in found.collect()} == {(x["query_id"], x["id"]) for x in search.nearest(asked, rows, 60).collect()}
