"""Forces against all pairs, and layouts against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from loomgraph.operators import repulsion

DDL = "id long, x double, y double, m double"


def crowds(seed, n):
    """Half of the nodes even, half in three dense spots, with masses of many sizes."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y = r.uniform(0, 1000), r.uniform(0, 1000)
        if k % 2:
            x, y = (100 + 300 * (k % 3) + r.gauss(0, 4), 500 + r.gauss(0, 4))
        out.append((k, x, y, float(r.choice([1, 1, 2, 5, 40]))))
    return out


def plain(rows):
    p, m = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d = p[:, None] - p[None]
    square = (d**2).sum(-1)
    share = np.where(square > 0, m[:, None] * m[None] / np.where(square > 0, square, 1), 0)
    return (share[..., None] * d).sum(1)


def forces(spark, rows, **options):
    got = {r["id"]: (r["fx"], r["fy"]) for r in repulsion.repulsions(spark.createDataFrame(rows, DDL), **options).collect()}
    assert len(got) == len(rows)
    return np.array([got[r[0]] for r in rows])


def test_error_of_the_forces(spark):
    rows = crowds(1, 1500)
    wanted = plain(rows)
    error = np.sqrt(((forces(spark, rows) - wanted) ** 2).sum() / (wanted**2).sum())
    typical = np.median(np.linalg.norm(forces(spark, rows) - wanted, axis=1) / np.linalg.norm(wanted, axis=1))
    assert error < 0.03 and typical < 0.03


def test_few_nodes_are_exact(spark):
    rows = crowds(2, 60) + [(900, 5.0, 5.0, 1.0), (901, 5.0, 5.0, 3.0)]
    assert np.allclose(forces(spark, rows, leaf=100), plain(rows), rtol=1e-9)
    assert np.allclose(forces(spark, [(1, 2.0, 3.0, 1.0)]), 0) and np.allclose(forces(spark, [(1, 2.0, 3.0, 1.0), (2, 2.0, 3.0, 1.0)]), 0)
    odd = spark.createDataFrame([(1, None, 2.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 2.0, 0.0, 1.0)], DDL)
    assert sorted(map(tuple, repulsion.repulsions(odd).collect())) == [(2, -0.5, 0.0), (3, 0.5, 0.0)]
    assert repulsion.repulsions(spark.createDataFrame([], DDL)).count() == 0


def test_a_crowd_at_one_place(spark):
    """Copies of one place beyond the leaf act as a mass on the last level, without a pair of them."""
    rows = [(k, 10.0, 10.0, 1.0) for k in range(300)] + [(300, 0.0, 0.0, 1.0), (301, 20.0, 10.0, 2.0)]
    wanted = plain(rows)
    assert np.sqrt(((forces(spark, rows) - wanted) ** 2).sum() / (wanted**2).sum()) < 0.03


def plain_layout(ids, edges, rounds, scale, gravity=0.05):
    part = lambda salt, k: int(hashlib.md5(f"{salt}:{k}".encode()).hexdigest()[:8], 16) / 4294967296
    p = np.array([[math.sqrt(part("r", k)) * scale * f(part("a", k) * 6.283185307179586) for f in (math.cos, math.sin)] for k in ids])
    w = np.zeros((len(ids), len(ids)))
    m = np.ones(len(ids))
    for a, b, weight in edges:
        for x, y in ((a, b), (b, a)):
            w[ids.index(x), ids.index(y)] += weight
            m[ids.index(x)] += 1
    for k in range(rounds):
        push = plain([(i, *p[i], m[i]) for i in range(len(ids))]) * (scale * scale / len(ids))
        move = push / m[:, None] + (w @ p - w.sum(1)[:, None] * p) / m[:, None] - gravity * p
        size = np.linalg.norm(move, axis=1)
        most = scale * 0.1 * (1 - k / rounds)
        p = p + move * np.where(size > most, most / np.where(size > 0, size, 1), 1)[:, None]
    return p / np.abs(p).max() * scale


def test_layout(spark):
    groups = [range(0, 6), range(6, 12)]
    edges = [(a, b, 1.0) for g in groups for a in g for b in g if a < b] + [(0, 6, 0.2)]
    ids = list(range(13))
    nodes = spark.createDataFrame([(k,) for k in ids] + [(0,), (None,)], "id long")
    odd = [(0, 99, 1.0), (3, 3, 1.0), (1, 2, None), (None, 2, 1.0)]
    relations = spark.createDataFrame(edges + odd, "source_id long, target_id long, weight double")
    got = {r["id"]: (r["x"], r["y"]) for r in repulsion.arrange(nodes, relations, rounds=8, scale=100.0, leaf=50).collect()}
    wanted = plain_layout(ids, edges, 8, 100.0)
    assert sorted(got) == ids and np.allclose([got[k] for k in ids], wanted, atol=1e-6)
    assert len({tuple(np.round(p, 3)) for p in wanted}) == len(ids) and np.abs(wanted).max() == pytest.approx(100.0)
    assert repulsion.arrange(nodes.where("id > 99"), relations, rounds=1).count() == 0


def test_tiles_give_what_one_tile_gives(spark, monkeypatch):
    """Many small tiles, some in parts as their nodes are too dense to be cut, and cells that are summed before they are sent."""
    rows = crowds(3, 900) + [(2000 + k, 333.25, 444.5, 2.0) for k in range(200)]
    wanted = forces(spark, rows)
    monkeypatch.setattr(repulsion, "TILE", 50)
    monkeypatch.setattr(repulsion, "COARSE", 5)
    cut = []
    tiles = repulsion._tiles
    monkeypatch.setattr(repulsion, "_tiles", lambda *a: cut.append(tiles(*a)) or cut[-1])
    assert np.allclose(forces(spark, rows), wanted, rtol=1e-7, atol=1e-6)
    _, parts, at = cut[0]
    assert len(at) > 30 and parts.max() > 3 and len(set(at[:, 0])) > 2
