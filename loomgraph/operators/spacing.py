"""Nodes pushed apart until their circles keep a distance.

Two nodes closer than ``factor`` times the sum of their radii push each other,
each by half of what is missing.  All pushes of a round are added up at once, in
whole millionths, so the result does not depend on any order.

Pairs are found by a hash of places: nodes have levels by the size of their
radius, each level a grid whose cells are as wide as any distance that a pair
with a node of that level may need.  A node is looked up in the 3 x 3 cells
around it on its own level and all higher ones, so large hubs do not make the
cells of small nodes large.

Nodes of one place and radius push and are pushed alike by all other places, so
pairs are made of such groups, not of nodes.  Within a place the push depends on
how many nodes of each radius have smaller ids: nodes are read in order of ids
past a counter for each radius, which never makes a pair either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

UNIT = 1_000_000
CELLS = 1 << 20  # pairs of a node and a radius that a task looks at at once


def hub_radius(degree: Column, scale: float = 800.0) -> Column:
    return (2 + F.pow(F.log10(degree + 1), 2) * 4) * scale


def _between_places(groups: DataFrame, factor: float, slack: float) -> DataFrame:
    """x, y, radius, ox, oy: what a node of each group (x, y, radius, n) gets from the nodes of other places."""
    level = F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(1e-6)))).cast("int")
    at = groups.withColumn("level", level)
    levels = at.select(F.col("level").alias("grid")).distinct()  # as many as sizes have magnitudes
    width = 2 * factor * F.pow(F.lit(2.0), F.col("grid"))
    cell = lambda name: F.floor(F.col(name) / width).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asked = at.join(F.broadcast(levels), F.col("grid") >= F.col("level")).select("*", around.alias("i")).select("*", around.alias("j"))
    asked = asked.select("grid", (cell("x") + F.col("i")).alias("cx"), (cell("y") + F.col("j")).alias("cy"), *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "radius", "n", "level")])
    there = at.withColumn("grid", F.col("level"))
    there = there.select("grid", cell("x").alias("cx"), cell("y").alias("cy"), *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "radius", "n")])
    once = F.struct("a_x", "a_y", "a_radius") < F.struct("b_x", "b_y", "b_radius")
    pairs = asked.join(there, ["grid", "cx", "cy"]).where("a_x <> b_x OR a_y <> b_y").where((F.col("a_level") < F.col("grid")) | once)
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    pairs = pairs.select("*", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("d"), ((F.col("a_radius") + F.col("b_radius")) * factor).alias("least"))
    pairs = pairs.where(F.col("d") < F.col("least") * (1 - slack))
    push = lambda c: F.round((F.col("least") - F.col("d")) / 2 * (F.col(c) / F.col("d")) * UNIT).cast("long")
    pairs = pairs.select("*", push("dx").alias("px"), push("dy").alias("py"))
    both = F.array(*[F.struct(*[F.col(f"{own}_{c}").alias(c) for c in ("x", "y", "radius")], *[(sign * F.col(p) * F.col(f"{other}_n")).alias(p) for p in ("px", "py")]) for own, other, sign in (("a", "b", -1), ("b", "a", 1))])
    return pairs.select(F.explode(both).alias("p")).select("p.*").groupBy("x", "y", "radius").agg(F.sum("px").alias("ox"), F.sum("py").alias("oy"))


def _in_order(factor: float, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, px, py of rows in order of place: first the groups of a place (radius, n), then its nodes by id, with what they get from other places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[float, float] | None = None
        radii, counts, less = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            x, y, kind, radius = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "kind", "radius"))
            n = batch.column("n").to_numpy(zero_copy_only=False)
            px, py = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("ox", "oy"))
            shown = (kind > 0) & batch.column("touched").to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else []
            for low, high in zip(begins, [*begins[1:], len(x)], strict=True):
                if place != (x[low], y[low]):
                    place = x[low], y[low]
                    radii, counts = np.empty(0), np.empty(0, np.int64)
                first = low + int((kind[low:high] == 0).sum())
                if first > low:
                    radii, counts = np.concatenate([radii, radius[low:first]]), np.concatenate([counts, n[low:first]])
                    order = np.argsort(radii)
                    radii, counts, less = radii[order], counts[order], np.zeros(len(radii), np.int64)
                step = max(1, CELLS // max(1, len(radii)))
                for begin in range(first, high, step):
                    part = slice(begin, min(begin + step, high))
                    own = np.searchsorted(radii, radius[part])
                    is_own = own[:, None] == np.arange(len(radii))
                    before = np.cumsum(is_own, 0) - is_own + less
                    least = (radii[own][:, None] + radii) * factor
                    size = least / 2 * UNIT
                    size = np.floor(size) + (size - np.floor(size) >= 0.5)  # halves go up
                    push = np.where(least * (1 - slack) > 0, size, 0).astype(np.int64)
                    px[part] += (push * (2 * before + is_own - counts)).sum(1)
                    shown[part] |= ((push > 0) & (counts - is_own > 0)).any(1)
                    less = less + is_own.sum(0)
            chosen = pa.array(np.flatnonzero(shown))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(chosen), pa.array(px).take(chosen), pa.array(py).take(chosen)], names=["id", "px", "py"])

    return run


def pushes(nodes: DataFrame, factor: float, slack: float = 1e-3) -> DataFrame:
    """id, px, py (millionths): the sum of all pushes on each node (id, x, y, radius) that is pushed.

    A pair counts if it is closer than its distance less ``slack`` of it.  Nodes
    at one place are pushed along x, the smaller id to the left.
    """
    value = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c).cast("double")).alias(c)
    at = nodes.select("id", value("x"), value("y"), F.col("radius").cast("double").alias("radius")).where("abs(x) < double('inf') AND abs(y) < double('inf') AND radius IS NOT NULL")
    place, group = ["x", "y"], ["x", "y", "radius"]
    groups = at.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    whole = groups.join(groups.groupBy(*place).agg(F.sum("n").alias("m")), place).join(_between_places(groups, factor, slack), group, "left")
    whole = whole.withColumn("touched", F.col("ox").isNotNull()).fillna(0, ["ox", "oy"])
    placed = at.join(whole, group)
    alone = placed.where("m = 1 AND touched").select("id", F.col("ox").alias("px"), F.col("oy").alias("py"))
    shown = [*group, "kind", "id", "n", "ox", "oy", "touched"]
    rows = placed.where("m > 1").withColumn("kind", F.lit(1)).select(*shown).unionByName(whole.where("m > 1").select("*", F.lit(0).alias("kind"), F.lit(None).cast(at.schema["id"].dataType).alias("id")).select(*shown))
    crowded = rows.repartition(*place).sortWithinPartitions(*place, "kind", "id").mapInArrow(_in_order(factor, slack), f"id {at.schema['id'].dataType.simpleString()}, px long, py long")
    return alone.unionByName(crowded).groupBy("id").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))


def separate(nodes: DataFrame, factor: float = 0.3, rounds: int = 200) -> DataFrame:
    """id, x, y, radius after rounds of pushes, until no pair is too close or ``rounds`` have passed."""
    at = written(nodes.select("id", "x", "y", "radius"), "places")
    for _ in range(rounds):
        moved = written(pushes(at, factor), "pushes")
        if moved.isEmpty():
            break
        fresh = lambda c: (F.col(c) + F.coalesce(F.col(f"p{c}"), F.lit(0)) / UNIT).alias(c)
        at = written(at.join(moved, "id", "left").select("id", fresh("x"), fresh("y"), "radius"), "places")
    return at
