"""Louvain against a plain version with the same rules; modularity, small clusters and numbers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import communities


def planted(seed, groups=6, size=12, inside=0.6, across=0.03):
    r = random.Random(seed)
    n = groups * size
    return [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < (inside if a // size == b // size else across)]


def plain_modularity(label, edges):
    total = sum(edges.values())
    inner, deg = Counter(), Counter()
    for (a, b), w in edges.items():
        deg[label[a]] += w
        inner[label[a]] += w * (label[a] == label[b])
    return sum(inner[c] / total - (deg[c] / total) ** 2 for c in deg)


def plain_settled(edges, label, turn, rounds, least_moved, seen):
    k, total = Counter(), sum(edges.values())
    for (a, _), w in edges.items():
        k[a] += w
    moved, before = 0, None
    for _ in range(rounds):
        shade = lambda c: ((hashlib.md5(f"{turn // 2}:{c}".encode()).hexdigest() < "8") + turn) % 2  # noqa: B023, E731
        tot, near = Counter(), defaultdict(Counter)
        for i, c in label.items():
            tot[c] += k[i]
        for (a, b), w in edges.items():
            if a != b:
                near[a][label[b]] += w
        moves = []
        for i, c in label.items():
            options = [(-(total * (w - near[i][c]) - k[i] * (tot[d] - tot[c] + k[i])), d) for d, w in near[i].items() if d != c and shade(c) == 0 and shade(d) == 1]
            if options and min(options)[0] < 0:
                g, d = min(options)
                moves.append((i, c, d, -g))
        made = {}
        for i, c, d, g in moves:
            cost = sum(k[j] for j, e, _, h in moves if e == c and len(str(h)) >= len(str(g))) + sum(k[j] for j, _, e, h in moves if e == d and len(str(h)) >= len(str(g))) - 2 * k[i]
            first = all(min((-h, j) for j, *e, h in moves if e[s] == (c, d)[s])[1] == i for s in (0, 1))
            if first or g > k[i] * cost:
                made[i] = d
        label = label | made
        seen(label)
        turn, moved = turn + 1, moved + len(made)
        if before is not None and before + len(made) <= least_moved * len(label):
            break
        before = len(made)
    return label, moved, turn + turn % 2


def plain_louvain(nodes, edges, rounds=10, levels=8, least_moved=0.01):
    """Dictionaries in place of frames, the rules of the module's docstring; also the modularity after each round."""
    found, turn, history, level = {i: i for i in nodes}, 0, [], edges
    for _ in range(levels):
        seen = lambda label: history.append(plain_modularity({i: label.get(found[i], found[i]) for i in nodes}, edges))  # noqa: B023, E731
        label, moved, turn = plain_settled(level, {a: a for a, _ in level}, turn, rounds, least_moved, seen)
        if not moved:
            break
        found = {i: label.get(c, c) for i, c in found.items()}
        fresh = Counter()
        for (a, b), w in level.items():
            fresh[label[a], label[b]] += w
        level = fresh
    label, _, _ = plain_settled(edges, {a: found[a] for a, _ in edges}, turn, rounds, least_moved, lambda label: history.append(plain_modularity(found | label, edges)))
    found |= label
    names = defaultdict(list)
    for i, c in found.items():
        names[c].append(i)
    return {i: min(names[c]) for i, c in found.items()}, history


def both(pairs):
    out = Counter()
    for a, b in {(min(p), max(p)) for p in pairs}:
        out[a, b] += 1
        out[b, a] += 1
    return out


@pytest.mark.parametrize(("pairs", "extra"), [(planted(1, 4, 9), [100, 101]), (planted(2, 3, 8, 0.9, 0.1) + [(5, 5), (3, 3)], []), ([(0, k) for k in range(1, 30)] + [(40, 41)], [50])])
def test_louvain(spark, pairs, extra):
    nodes = sorted({i for p in pairs for i in p} | set(extra))
    table = spark.createDataFrame([(i,) for i in nodes], "id long")
    edges = communities.adjacency(spark.createDataFrame(pairs + [p[::-1] for p in pairs[:3]] + [(0, 999)], "source_id long, target_id long"), table)
    assert {(r["src"], r["dst"]): r["w"] for r in edges.collect()} == dict(both(pairs))
    got = {r["id"]: r["label"] for r in communities.louvain(table, edges, rounds=4, levels=3).collect()}
    wanted, history = plain_louvain(nodes, both(pairs), rounds=4, levels=3)
    assert got == wanted
    assert all(b >= a - 1e-12 for a, b in zip(history, history[1:], strict=False))
    row = communities.modularity(spark.createDataFrame(list(got.items()), "id long, label long"), edges).first()
    assert row["modularity"] == pytest.approx(plain_modularity(got, both(pairs)), abs=1e-8) and row["communities"] == len(set(got.values()))
    for i in extra:
        assert got[i] == i


def test_planted_groups_are_found(spark):
    pairs = planted(3, 5, 16, 0.7, 0.01)
    table = spark.createDataFrame([(f"n{i:03}",) for i in range(80)], "id string")
    edges = communities.adjacency(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "source_id string, target_id string"))
    got = {r["id"]: r["label"] for r in communities.louvain(table, edges).collect()}
    assert len(set(got.values())) == 5 and all(len({got[f"n{g * 16 + k:03}"] for k in range(16)}) == 1 for g in range(5))


def test_weights_and_empty(spark):
    rel = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (2, 3, 0.0), (4, 4, 1.0)], "source_id long, target_id long, weight double")
    assert {tuple(r) for r in communities.adjacency(rel, weight="weight", scale=100).collect()} == {(1, 2, 75), (2, 1, 75), (4, 4, 200)}
    none = spark.createDataFrame([], "source_id long, target_id long")
    alone = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert {tuple(r) for r in communities.louvain(alone, communities.adjacency(none)).collect()} == {(1, 1), (2, 2)}
    assert communities.modularity(alone.withColumn("label", F.col("id")), communities.adjacency(none)).first()["modularity"] == 0.0


def test_nearest_place(spark):
    r = random.Random(4)
    points = [(k, r.gauss(0, 5), r.gauss(0, 5)) for k in range(150)] + [(900, 4000.0, -9.0), (901, 0.0, 0.0)]
    places = [(k, float(r.randint(-9, 9)), float(r.randint(-9, 9))) for k in range(40)]
    got = {x["id"]: x["place"] for x in communities.nearest_place(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(places, "place long, x double, y double")).collect()}
    assert got == {i: min((round(math.hypot(x - a, y - b), 6), p) for p, a, b in places)[1] for i, x, y in points}


def test_clusters(spark):
    labels = [(k, k // 25 * 25) for k in range(75)] + [(100 + k, 100 + k // 3 * 3) for k in range(9)]
    places = [(i, float(10 * (label // 25)), 1.0) for i, label in labels[:75]] + [(100 + k, 9.0 if k < 3 else 21.0 if k < 6 else 4.9, 0.0) for k in range(9)]
    at = spark.createDataFrame(places, "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in communities.clusters(spark.createDataFrame(labels, "id long, label long"), at).collect()}
    wanted = [0] * 3 + [2] * 3 + [1] * 3
    # Sizes 28, 28 and 28: numbers go by label.
    assert got == {k: k // 25 for k in range(75)} | dict(zip(range(100, 109), [1] * 3 + [2] * 3 + [0] * 3, strict=True)) and sorted(wanted) == sorted(got[k] for k in range(100, 109))
    few = communities.clusters(spark.createDataFrame(labels[75:], "id long, label long"), at).collect()
    assert {r["cluster"] for r in few} == {0, 1, 2}


def test_numbers(spark):
    rows = spark.range(0, 500, numPartitions=7).select(F.pmod(F.col("id") * 37, F.lit(500)).alias("v"))
    got = {(r["v"], r["number"]) for r in communities.numbered(rows, F.asc("v")).collect()}
    assert got == {(k, k) for k in range(500)}
