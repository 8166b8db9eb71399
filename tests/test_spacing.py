"""Pushes against all pairs, and no overlap in the end."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from loomgraph.operators import spacing

DDL = "id long, x double, y double, radius double"


def nodes(seed, n, extent):
    r = random.Random(seed)
    return [(k, r.uniform(-extent, extent), r.uniform(-extent, extent), r.choice([0.5, 1.0, 1.0, 1.7, 3.0, 12.0])) for k in range(n)]


def plain_pushes(rows, factor, slack=1e-3):
    out = defaultdict(lambda: [0, 0])
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            dx, dy, least = b[1] - a[1], b[2] - a[2], (a[3] + b[3]) * factor
            d = math.sqrt(dx * dx + dy * dy)
            if d < least * (1 - slack):
                ux, uy = (dx / d, dy / d) if d > 0 else (1.0, 0.0)
                for side, sign in ((a, -1), (b, 1)):
                    out[side[0]][0] += sign * round((least - d) / 2 * ux * 1e6)
                    out[side[0]][1] += sign * round((least - d) / 2 * uy * 1e6)
    return {i: tuple(p) for i, p in out.items()}


@pytest.mark.parametrize("factor", [0.3, 2.5])
def test_pushes_of_500_nodes(spark, factor):
    rows = nodes(1, 500, 60.0) + [(900, 5.0, 5.0, 1.0), (901, 5.0, 5.0, 1.0)]
    got = {r["id"]: (r["px"], r["py"]) for r in spacing.pushes(spark.createDataFrame(rows, DDL), factor).collect()}
    wanted = plain_pushes(rows, factor)
    assert got.keys() == wanted.keys() and all(got[i] == pytest.approx(wanted[i], abs=50) for i in wanted)


def test_nothing_overlaps_in_the_end(spark):
    rows = nodes(2, 60, 30.0) + [(900, 5.0, 5.0, 1.0), (901, 5.0, 5.0, 1.0)]
    got = [tuple(r) for r in spacing.separate(spark.createDataFrame(rows, DDL), 1.0, rounds=60).collect()]
    assert len(got) == len(rows) and not plain_pushes(got, 1.0)
    apart = [(1, 0.0, 0.0, 1.0), (2, 10.0, 0.0, 1.0)]
    assert sorted(map(tuple, spacing.separate(spark.createDataFrame(apart, DDL), 1.0).collect())) == apart
    assert spacing.separate(spark.createDataFrame([], DDL), 1.0).count() == 0


def test_no_pair_of_nodes_is_made_at_crowded_places(spark, monkeypatch):
    """Few places and radii: as many rows in every step as nodes, and sums as of all pairs, in whole numbers."""
    monkeypatch.setattr(spacing, "CELLS", 40)
    r = random.Random(5)
    rows = [(k, float(r.choice([-2, 0, 1, 30])), r.choice([0.0, -0.0, 0.5]), r.choice([0.0, 0.25, 1.0, 6.0])) for k in sorted(r.sample(range(5000), 700))]
    odd = [(9001, float("nan"), 0.0, 1.0), (9002, float("nan"), 0.0, 1.0), (9003, None, 0.0, 1.0), (9004, 0.0, 0.0, None), (9005, 500.0, 0.0, 1.0), (9006, 700.0, 0.0, 0.0), (9007, 700.0, 0.0, 0.0)]
    found = spacing.pushes(spark.createDataFrame(rows + odd, DDL).repartition(3), 0.5)
    got = {x["id"]: (x["px"], x["py"]) for x in found.collect()}
    wanted = plain_pushes(rows, 0.5)
    assert got.keys() == wanted.keys() and all(got[i] == pytest.approx(wanted[i], abs=700) for i in wanted)
    assert sum(x for x, _ in got.values()) == sum(y for _, y in got.values()) == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "a_id" not in plan and "b_id" not in plan


def test_pushes_of_names(spark):
    """Ids need not be numbers, and a place can be longer than a batch."""
    rows = [(k, 0.0, 0.0, 1.0 + k % 3) for k in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        found = spacing.pushes(spark.createDataFrame([(f"{i:04d}", x, y, r) for i, x, y, r in rows], "id string, x double, y double, radius double"), 1.0)
        assert {int(x["id"]): (x["px"], x["py"]) for x in found.collect()} == plain_pushes(rows, 1.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
