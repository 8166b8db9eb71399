"""Quantised cells: recall, additions, deletions and merges."""

from __future__ import annotations

import numpy as np
import pytest

from loomgraph.operators.search import nearest
from loomgraph.operators.vectors import Model, VectorIndex


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def clustered(seed, n, start=0, width=24):
    r = np.random.default_rng(seed)
    middle = np.random.default_rng(0).standard_normal((20, width))
    return [(start + k, (middle[k % 20] + 0.6 * r.standard_normal(width)).tolist()) for k in range(n)]


def test_codes_are_near(spark):
    units = np.array([v for _, v in clustered(1, 600)])
    units /= np.linalg.norm(units, axis=1)[:, None]
    model = Model.fit(units, 8, 6)
    cell, codes = model.encode(units)
    centre, tables = model.tables(units[:50])
    near = centre[:, cell] + sum(t[:, codes[:, j]] for j, t in enumerate(tables))
    assert np.abs(near - units[:50] @ units.T).max() < 0.35 and np.corrcoef(near.ravel(), (units[:50] @ units.T).ravel())[0, 1] > 0.97
    again = Model.of(model.plain())
    assert (again.encode(units)[1] == codes).all()


def test_round_trip(spark, tmp_path):
    rows = dict(clustered(2, 900))
    odd = [(5000, None), (5001, [0.0] * 24), (5002, [None] * 24), (5003, [1.0])]
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.fit(table(spark, list(rows.items()) + odd), cells=12, subspaces=6, sample=500)
    asked = table(spark, clustered(3, 30, 100)).withColumnRenamed("id", "query_id")
    assert index.search(asked, 5).count() == 0
    index.add(table(spark, list(rows.items()) + odd))
    assert index.count() == 900 and index.calibrate(k=10, questions=60) >= 0.99

    def exact():
        return {(r["query_id"], r["id"]): r["score"] for r in nearest(asked, table(spark, list(rows.items())), 5).collect()}

    def found(of):
        return {(r["query_id"], r["id"]): r["score"] for r in of.search(asked, 5, probes=12, refine=64).collect()}

    assert found(index) == pytest.approx(exact())
    more = dict(clustered(4, 60, 870))  # thirty replace older vectors
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "v/segments").rglob("*.parquet")}
    index.add(table(spark, list(more.items())))
    rows |= more
    assert found(index) == pytest.approx(exact())
    nearest_ids = sorted({i for _, i in exact()})[:20]
    index.delete(spark.createDataFrame([(i,) for i in nearest_ids], "id long"))
    rows = {i: v for i, v in rows.items() if i not in nearest_ids}
    assert found(index) == pytest.approx(exact()) and index.count() == len(rows)
    assert all(f.stat().st_mtime_ns == at for f, at in files.items())
    again = VectorIndex(spark, f"file://{tmp_path}/v")
    again.merge()
    assert len(index.state()["segments"]) == 1 and found(index) == pytest.approx(exact())
    again.clear()
    assert index.count() == 0
