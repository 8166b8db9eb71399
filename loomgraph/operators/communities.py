"""Communities by modularity: local moving in rounds without conflicts, then contraction.

With whole-number weights A, degrees k and total 2m, modularity times (2m)^2 is
the sum over communities of 2m * inner - total^2.  Moving node i from c to d
raises it by twice

    G = 2m (k_id - k_ic) - k_i (total_d - total_c + k_i).

A round moves many nodes at once and still never lowers modularity:

* communities have one of two colours by a hash of round and name; nodes leave
  those of the first colour for those of the second, so no community both gains
  and loses;
* two nodes that leave one community, or enter one, cost k_i k_j at most.  Nodes
  with a gain of as many digits as i's or more come before i, and i moves if G
  exceeds its costs with all of these; the best node of both its communities
  moves anyhow, as the others have paid for it.

Sums by community and number of digits are all that a round needs, so no
community is ever held by one task.  Everything is exact in decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WHOLE = "decimal(19,0)"


def adjacency(relations: DataFrame, nodes: DataFrame | None = None, weight: str | None = None, scale: int = 1_000_000) -> DataFrame:
    """src, dst, w (long) in both directions: 1 for each linked pair, or its ``weight`` in units of 1 / ``scale``; a loop counts twice.

    With ``nodes`` (id), edges with an end elsewhere are left out.  Edges of one
    pair count once, or are added up with a weight.
    """
    w = F.lit(1).cast("long") if weight is None else F.round(F.col(weight) * scale).cast("long")
    edges = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), w.alias("w"))
    if nodes is not None:
        edges = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    once = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.max("w") if weight is None else F.sum("w")).alias("w")).where("w > 0")
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return once.select(F.explode(both).alias("e"), "w").select("e.src", "e.dst", "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: communities and modularity of ``labels`` (id, label) over an ``adjacency``."""
    at = labels.select("id", "label")
    known = edges.join(at.toDF("src", "c"), "src").join(at.toDF("dst", "d"), "dst")
    # Inner weight and total of each community; labels without an edge count as communities alone.
    own = known.groupBy(F.col("c").alias("label")).agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0)).alias("inner"), F.sum("w").alias("total"))
    own = at.select("label").distinct().join(own, "label", "left").fillna(0, ["inner", "total"])
    whole = own.agg(F.count(F.lit(1)).alias("communities"), F.sum("inner").cast("double").alias("inner"), F.sum("total").cast("double").alias("all"), F.sum(F.col("total").cast("double") * F.col("total")).alias("squares"))
    return whole.select("communities", F.coalesce(F.when(F.col("all") > 0, F.round(F.col("inner") / F.col("all") - F.col("squares") / F.col("all") / F.col("all"), 9)), F.lit(0.0)).alias("modularity"))


def colour(turn: int, label: Column) -> Column:
    """0 or 1; two rounds that follow one another swap the colours, and pairs of rounds mix them anew."""
    low = F.md5(F.concat(F.lit(f"{turn // 2}:"), label.cast("string")).cast("binary")) < "8"
    return (low.cast("int") + turn) % 2


def candidates(edges: DataFrame, labels: DataFrame, total: int, turn: int | None = None) -> DataFrame:
    """id, k, source, target, gain of the best move of each node that gains by one; ties go to the smallest label.

    ``labels`` has id, label and k, the degree; ``turn`` keeps moves to those
    from the first colour to the second.
    """
    totals = labels.groupBy("label").agg(F.sum("k").alias("total"))
    near = edges.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
    home = near.select("id", "label", F.col("w").alias("inner"))
    own = labels.select("id", "label", "k")
    if turn is not None:
        own = own.where(colour(turn, F.col("label")) == 0)
        near = near.where(colour(turn, F.col("label")) == 1)
    own = own.join(totals.withColumnRenamed("total", "own"), "label").join(home, ["id", "label"], "left").select("id", "k", F.col("label").alias("source"), "own", F.coalesce("inner", F.lit(0)).alias("inner"))
    moves = near.withColumnRenamed("label", "target").join(own, "id").where("target <> source").join(totals.withColumnRenamed("label", "target"), "target")
    gain = F.lit(total).cast(WHOLE) * (F.col("w") - F.col("inner")).cast(WHOLE) - F.col("k").cast(WHOLE) * (F.col("total") - F.col("own") + F.col("k")).cast(WHOLE)
    moves = moves.withColumn("gain", gain.cast("decimal(38,0)")).where("gain > 0")
    best = moves.groupBy("id").agg(F.min_by(F.struct("k", "source", "target", "gain"), F.struct((-F.col("gain")).alias("g"), "target")).alias("m"))
    return best.select("id", "m.*")


def _before(moves: DataFrame, side: str) -> DataFrame:
    """By label and number of digits: degrees of all nodes that come first, and the best node of the label."""
    sums = moves.groupBy(side, "digits").agg(F.sum("k").alias("k"), F.min_by("id", F.struct((-F.col("gain")).alias("g"), "id")).alias("best"))
    falling = Window.partitionBy(side).orderBy(F.desc("digits"))  # 38 rows at most
    return sums.select(side, "digits", F.sum("k").over(falling).alias(f"{side}_sum"), F.first("best").over(falling).alias(f"{side}_best"))


def accepted(moves: DataFrame) -> DataFrame:
    """id and label of the moves of one round that are made together."""
    moves = moves.withColumn("digits", F.length(F.col("gain").cast("string")))
    for side in ("source", "target"):
        moves = moves.join(_before(moves, side), [side, "digits"])
    champion = (F.col("source_best") == F.col("id")) & (F.col("target_best") == F.col("id"))
    others = (F.col("source_sum") + F.col("target_sum") - 2 * F.col("k")).cast(WHOLE)
    return moves.where(champion | (F.col("gain") > F.col("k").cast(WHOLE) * others)).select("id", F.col("target").alias("label"))


def _settled(edges: DataFrame, labels: DataFrame, total: int, turn: int, rounds: int, least_moved: float) -> tuple[DataFrame, int, int]:
    """Labels after rounds of moves, how many moved, and the next turn."""
    labels = written(labels.join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "id"))
    size, moved, before = labels.count(), 0, None
    for _ in range(rounds):
        moves = written(candidates(edges, labels, total, turn))
        fresh = written(accepted(moves).withColumnRenamed("label", "fresh"))
        n = fresh.count()
        if n:
            labels = written(labels.join(fresh, "id", "left").select("id", F.coalesce("fresh", "label").alias("label"), "k"))
        turn, moved = turn + 1, moved + n
        if before is not None and before + n <= least_moved * size:
            break
        before = n
    return labels.select("id", "label"), moved, turn + turn % 2


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 10, levels: int = 8, least_moved: float = 0.01) -> DataFrame:
    """id, label: communities of ``nodes`` (id) over an ``adjacency``; a label is the smallest id of the members.

    A level ends after ``rounds`` rounds, or when two of them have moved no more
    than ``least_moved`` of its nodes; contraction ends with a level without
    moves.  Then single nodes are moved once more between what was found.
    Nodes without edges stay alone.
    """
    found = written(nodes.select("id", F.col("id").alias("label")).distinct())
    edges = level = written(edges)
    total, turn = int(edges.agg(F.sum("w")).first()[0] or 0), 0
    for _ in range(levels):
        start = level.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
        labels, moved, turn = _settled(level, start, total, turn, rounds, least_moved)
        if not moved:
            break
        found = written(found.join(labels.toDF("label", "fresh"), "label", "left").select("id", F.coalesce("fresh", "label").alias("label")))
        level = written(level.join(labels.toDF("src", "c"), "src").join(labels.toDF("dst", "d"), "dst").groupBy(F.col("c").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")))
    linked = edges.select(F.col("src").alias("id")).distinct()
    labels, _, _ = _settled(edges, found.join(linked, "id", "left_semi"), total, turn, rounds, least_moved)
    found = found.select("id", F.col("label").alias("old")).join(labels, "id", "left").select("id", F.coalesce("label", "old").alias("label"))
    names = found.groupBy("label").agg(F.min("id").alias("name"))
    return found.join(names, "label").select("id", F.col("name").alias("label"))


def nearest_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """id and place of the nearest of ``places`` (place, x, y) for each of ``points`` (id, x, y); ties go to the smallest place.

    Both are put into cells of a grid; what lies within one cell's width in the
    3 x 3 cells around a point is nearest for certain.  Points without such a
    place are looked up again in cells twice as wide.
    """
    box = places.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not box["n"]:
        return points.select("id", F.lit(None).cast(places.schema["place"].dataType).alias("place"))
    width = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) / max(box["n"], 1) ** 0.5 or 1.0
    open_, found = written(points.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")), None
    cell = lambda name, at: F.floor(F.col(name) / at).cast("long")
    while not open_.isEmpty():
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asked = open_.select("id", "x", "y", around.alias("i")).select("*", around.alias("j")).select("id", "x", "y", (cell("x", width) + F.col("i")).alias("cx"), (cell("y", width) + F.col("j")).alias("cy"))
        there = places.select("place", F.col("x").alias("px"), F.col("y").alias("py"), cell("x", width).alias("cx"), cell("y", width).alias("cy"))
        distance = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
        near = asked.join(there, ["cx", "cy"]).groupBy("id").agg(F.min(F.struct(F.round(distance, 6).alias("d"), "place")).alias("m"))
        near = written(near.where(F.col("m.d") < width).select("id", "m.place"))
        found = near if found is None else found.unionByName(near)
        open_ = written(open_.join(near, "id", "left_anti"))
        width *= 2
    return points.select("id").join(found, "id", "left") if found is not None else points.select("id", F.lit(None).cast(places.schema["place"].dataType).alias("place"))


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """``rows`` with contiguous numbers from 0 in ``order``: sorted over all tasks, and only the sizes of partitions go to one place."""
    at = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row for each partition
    first, starts = 0, []
    for row in sizes:
        starts.append((row["_part"], first))
        first += row["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _first long")
    return at.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_at")


def clusters(labels: DataFrame, positions: DataFrame, least: int = 20) -> DataFrame:
    """id, cluster: communities under ``least`` nodes join, as a whole, the larger one with the nearest centre; numbers run from 0 by size.

    ``positions`` has id, x, y.  Without a community of that size all stay.
    """
    placed = labels.join(positions.select("id", "x", "y"), "id", "left")
    centres = written(placed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y")))
    large = centres.where(F.col("n") >= least)
    if large.isEmpty():
        moved = labels.select("id", "label")
    else:
        small = centres.where(F.col("n") < least).select(F.col("label").alias("id"), "x", "y")
        near = nearest_place(small, large.select(F.col("label").alias("place"), "x", "y")).toDF("label", "place")
        moved = labels.join(near, "label", "left").select("id", F.coalesce("place", "label").alias("label"))
    sizes = moved.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return moved.join(numbered(sizes, F.desc("n"), F.asc("label"), name="cluster").select("label", F.col("cluster").cast("int").alias("cluster")), "label").select("id", "cluster")
