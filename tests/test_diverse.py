"""Maximal marginal relevance among all vectors, against a plain version of it."""

from __future__ import annotations

import numpy as np
import pytest

from loomgraph.operators import search


def plain(asked, rows, k, balance=0.5):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for q, v in asked.items():
        score = np.round(x @ (np.array(v) / np.linalg.norm(v)), 9)
        taken = []
        for place in range(min(k, len(ids))):
            nearest = (x @ x[taken].T).max(1) if taken else np.zeros(len(ids))
            gain = np.round(balance * score - (1 - balance) * nearest, 9)
            n = min((i for i in range(len(ids)) if i not in taken), key=lambda i: (-gain[i], -score[i], ids[i]))
            taken.append(n)
            out.add((q, ids[n], place, round((score[n] + 1 - place / k) / 2, 8)))
    return out


def rows_of(found):
    return {(r[0], r["id"], r["place"], round(r["score"], 8)) for r in found.collect()}


def many(seed, n=900):
    """Most vectors are near the first question; a few are not."""
    r = np.random.default_rng(seed)
    near, far = r.normal(size=6), r.normal(size=(40, 6))
    return {i: [float(x) for x in (near + 0.05 * r.normal(size=6) if i >= 40 else far[i])] for i in range(n)}


@pytest.mark.parametrize("pool,balance", [(64, 0.5), (3, 0.3), (1, 0.5)])
def test_all_vectors_are_candidates(spark, pool, balance):
    rows = many(1)
    asked = {0: rows[50], 1: rows[3], 2: [1.0] + [0.0] * 5}
    table = spark.createDataFrame([*rows.items(), (-1, [0.0] * 6), (-2, None), (-3, [1.0])], "id long, embedding array<double>").repartition(3)
    found = search.diverse(spark.createDataFrame([*asked.items(), (9, [0.0] * 6)], "query_id int, embedding array<double>"), table, 6, balance, block=2, pool=pool)
    wanted = plain(asked, rows, 6, balance)
    assert rows_of(found) == wanted
    assert len(wanted) == 18


def test_fewer_vectors_than_places(spark):
    rows = {"b": [1.0, 0.0], "a": [1.0, 0.0], "c": [-1.0, 0.2]}
    found = search.diverse(spark.createDataFrame([("q", [1.0, 0.1])], "question string, embedding array<double>"), spark.createDataFrame(list(rows.items()), "id string, embedding array<double>"), 5, query="question")
    assert rows_of(found) == plain({"q": [1.0, 0.1]}, rows, 5)
    none = search.diverse(spark.createDataFrame([], "query_id long, embedding array<double>"), spark.createDataFrame(list(rows.items()), "id string, embedding array<double>"), 5)
    assert none.columns == ["query_id", "id", "place", "score"] and none.count() == 0


def test_the_query_takes_no_cut_of_nearest_vectors(spark, tmp_path):
    from loomgraph.plans.catalogue import mmr
    from loomgraph.sources.derive import Graph

    rows = {i: [float(np.float32(x)) for x in v] for i, v in many(2, 400).items()}
    spark.createDataFrame([(i, v, 0) for i, v in rows.items()], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = rows_of(mmr(Graph(spark, str(tmp_path))))
    assert found == plain({i: v for i, v in rows.items() if i % 20 == 0}, rows, 10)
