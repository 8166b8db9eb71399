"""Repulsion of all nodes of a map by a pyramid of grids, and layouts with it.

Node ``i`` is pushed by ``m_i * m_j * (p_i - p_j) / |p_i - p_j|**2`` from every
other node ``j``.  Cells of all sizes are rows: level ``l`` cuts the square around
all nodes into ``2**l x 2**l`` cells.  Two cells of one level meet if their parents
touch and one of these holds more than ``leaf`` nodes.  Of cells that meet,

* those which do not touch act on each other by mass and centre of mass;
* those which touch and hold ``leaf`` nodes at most act node by node;
* all others are left to their children, but on the last level, where they act
  as masses too.

So each pair of nodes is counted once, on one level, and a cell has at most 27
far cells and 9 near ones to take into account, however dense the nodes are.
Against all pairs, the root of the mean square of the error is under 3 % of that
of the forces (tests).  Nodes at exactly one place do not push each other
(``spacing.pushes`` parts them).

The square is cut into tiles: the largest cells of ``TILE`` nodes at most, or
those of level ``COARSE``.  Sums of the cells of that level, 65,536 at most however
many nodes there are, go to all tasks and give the levels down to a tile.  What is
below, in a tile and the eight cells around it, is sent to the tile: nodes, and in
place of more than ``leaf`` nodes of a cell that is not opened from there their sum.
So a tile gets few rows from around it, and of a cell of the last level few rows too.
A tile of level ``COARSE`` that holds more nodes than ``TILE`` is dealt to several
tasks by the nodes' ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TILE = 1 << 15
COARSE = 8
#: Targets for which the nodes of near cells are listed at once.
_SLICE = 1 << 13
_SENT = "l long, i long, j long, n long, m double, x double, y double, tile long"
#: n, m, sx, sy of all cells of a level.
Grid = tuple[np.ndarray, ...]


def _pyramid(cells: pa.Table, top: int) -> list[Grid]:
    """Levels 0 to ``top`` from the cells (i, j, n, m, sx, sy) of the last."""
    at = cells["i"].to_numpy() << top | cells["j"].to_numpy()
    grids = [np.bincount(at, cells[c].to_numpy(), 1 << 2 * top).reshape(1 << top, -1) for c in ("n", "m", "sx", "sy")]
    levels = [tuple(grids)]
    for level in range(top - 1, -1, -1):
        levels.insert(0, tuple(g.reshape(1 << level, 2, 1 << level, 2).sum(axis=(1, 3)) for g in levels[0]))
    return levels


def _tiles(levels: list[Grid], most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The number of the tile that a cell is, by level, or -1; and by number the parts of a tile and its level, i and j."""
    top, count, parts, at, number = len(levels) - 1, 0, [], [], []
    covered = np.zeros((1, 1), dtype=bool)
    for level, (n, *_) in enumerate(levels):
        i, j = np.nonzero(~covered & (n > 0) & ((n <= most) | (level == top)))
        size = np.maximum(1, np.ceil(n[i, j] / most)).astype("i8")
        grid = np.full(n.shape, -1)
        grid[i, j] = count + np.cumsum(size) - size
        number.append(grid)
        parts.append(np.repeat(size, size))
        at.append(np.repeat(np.stack([np.full(len(i), level), i, j], 1), size, axis=0))
        count += int(size.sum())
        covered = np.kron(covered | (grid >= 0), np.ones((2, 2), dtype=bool))
    return number, np.concatenate(parts), np.concatenate(at)


def _owners(number: list[np.ndarray], parts: np.ndarray) -> pa.Table:
    """For each cell (ci, cj) of the last level in a tile the tile's first number and its parts."""
    top, found = len(number) - 1, np.full(number[-1].shape, -1)
    for level, grid in enumerate(number):
        found = np.maximum(found, np.kron(grid, np.ones((1 << (top - level),) * 2, dtype="i8")))
    i, j = np.nonzero(found >= 0)
    return pa.table({"ci": i, "cj": j, "first": found[i, j], "parts": parts[found[i, j]]})


def _sender(number: list[np.ndarray], parts: np.ndarray, leaf: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes (x, y, m, and i, j of the last level) to the tiles that they lie in or beside, as rows of ``_SENT``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            i, j, x, y, m = (batch.column(c).to_numpy() for c in ("i", "j", "x", "y", "m"))
            nodes, tiles, finest = [], [], []
            for t, grid in enumerate(number):
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        a, b = (i >> depth - t) + di, (j >> depth - t) + dj
                        k = np.flatnonzero((a >= 0) & (b >= 0) & (a < 1 << t) & (b < 1 << t))
                        k = k[grid[a[k], b[k]] >= 0]
                        # The last level on which a cell of the tile asks for the node's: it is two cells away at most.
                        last = np.full(len(k), t)
                        for level in range(t + 1, depth + 1) if len(k) else ():
                            away = [np.maximum((c0 << level - t) - (c >> depth - level), (c >> depth - level) + 1 - (c0 + 1 << level - t)) for c, c0 in ((i[k], a[k]), (j[k], b[k]))]
                            last[np.maximum(*away) <= 2] = level
                        nodes.append(k)
                        tiles.append(grid[a[k], b[k]])
                        finest.append(last)
            k, tile, last = np.concatenate(nodes), np.concatenate(tiles), np.concatenate(finest)
            a, b = i[k] >> depth - last, j[k] >> depth - last
            order = np.lexsort((b, a, last, tile))
            k, tile, last, a, b = k[order], tile[order], last[order], a[order], b[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (np.diff(tile) != 0) | (np.diff(last) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
            first = np.flatnonzero(new)
            size = np.diff(first, append=len(k))
            many = size > leaf
            one, lead = np.repeat(~many, size), first[many]
            mass, sx, sy = (np.add.reduceat(v[k], first)[many] for v in (m, m * x, m * y))
            ones = k[one]
            rows = [np.full(len(ones), depth), i[ones], j[ones], np.ones(len(ones), dtype="i8"), m[ones], x[ones], y[ones], tile[one]]
            rows = [np.concatenate(c) for c in zip(rows, [last[lead], a[lead], b[lead], size[many], mass, sx / mass, sy / mass, tile[lead]], strict=True)]
            copies = parts[rows[-1]]
            rows = [np.repeat(c, copies) for c in rows]
            rows[-1] += np.arange(len(rows[-1])) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["l", "i", "j", "n", "m", "x", "y", "tile"])

    return send


class _Cells:
    """The cells of a level, by number: of a whole grid, or those that rows of ``_SENT`` make up."""

    def __init__(self, level: int, grid: Grid | None = None, sent: dict[str, np.ndarray] | None = None):
        self.level, self.grid = level, grid
        if sent is not None:
            kept = np.flatnonzero(sent["l"] >= level)
            back = sent["l"][kept] - level
            key = sent["i"][kept] >> back << level | sent["j"][kept] >> back
            order = np.argsort(key, kind="stable")
            self.rows, key = kept[order], key[order]
            self.first = np.flatnonzero(np.diff(key, prepend=-1))
            self.key, self.size = key[self.first], np.diff(self.first, append=len(key))
            if grid is None:
                grid = tuple(np.add.reduceat(sent[c][self.rows], self.first) if len(key) else np.zeros(0) for c in ("n", "m", "sx", "sy"))
        self.n, self.m, self.sx, self.sy = (np.ravel(c) for c in grid)

    def held(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among the rows' cells, or -1."""
        if len(self.key) == 0:
            return np.full(key.shape, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def find(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of each cell, or -1 where there is none."""
        wide = 1 << self.level
        inside = (i >= 0) & (j >= 0) & (i < wide) & (j < wide)
        key = np.where(inside, i << self.level | j, 0)
        if self.grid is not None:
            return np.where(inside & (self.n[key] > 0), key, -1)
        return np.where(inside, self.held(key), -1)


def _forces(tile: np.ndarray, levels: list[Grid], to: dict[str, np.ndarray], sent: dict[str, np.ndarray], leaf: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What acts on the nodes ``to`` (i, j, x, y, m) of a tile, whose surroundings were ``sent``."""
    x, y, m = to["x"], to["y"], to["m"]
    fx, fy = np.zeros(len(x)), np.zeros(len(x))
    going, above = np.arange(len(x)), None
    oi, oj = (c.ravel() for c in np.meshgrid(np.arange(-2, 4), np.arange(-2, 4), indexing="ij"))
    for level in range(depth + 1):
        cells = _Cells(level, levels[level] if level <= tile[0] else None, sent if level >= tile[0] else None)
        key, of = np.unique(to["i"][going] >> depth - level << level | to["j"][going] >> depth - level, return_inverse=True)
        i, j = key >> level, key & (1 << level) - 1
        # Cells of this level (rows) and those of the children of all cells beside their parents (columns).
        bi, bj = ((i >> 1 << 1)[:, None] + oi, (j >> 1 << 1)[:, None] + oj) if level else (i[:, None], j[:, None])
        met = cells.find(bi, bj)
        there, own = met >= 0, (bi == i[:, None]) & (bj == j[:, None])
        near = (abs(bi - i[:, None]) <= 1) & (abs(bj - j[:, None]) <= 1)
        n = np.where(there, cells.n[met], 0)
        crowded = (there & near & (n > leaf)).any(axis=1)
        few = np.maximum(n, n[own][:, None]) <= leaf
        if level:
            up, there_up = above.find(i >> 1, j >> 1)[:, None], above.find(bi >> 1, bj >> 1)
            there &= np.maximum(above.n[up], np.where(there_up >= 0, above.n[there_up], 0)) > leaf
        lumps, single = there & (~near | ((level == depth) & ~few)), there & near & few
        for c in np.flatnonzero(lumps.any(axis=0)):
            some = lumps[of, c]
            at, k = met[of[some], c], going[some]
            mass, sx, sy = cells.m[at], cells.sx[at], cells.sy[at]
            mine = own[of[some], c]
            if mine.any():  # the node itself is taken out
                mass, sx, sy = mass - mine * m[k], sx - mine * m[k] * x[k], sy - mine * m[k] * y[k]
                alone = mass <= 0
                mass = np.where(alone, 1.0, mass)
                sx, sy = np.where(alone, x[k], sx), np.where(alone, y[k], sy)
            dx, dy = x[k] - sx / mass, y[k] - sy / mass
            square = dx * dx + dy * dy
            share = np.divide(mass * m[k], square, out=np.zeros(len(k)), where=square > 0)
            fx[k] += share * dx
            fy[k] += share * dy
        if single.any():
            held = cells.held(np.where(single, bi << level | bj, 0))
            for begin in range(0, len(going), _SLICE):
                node, column = np.nonzero(single[of[begin : begin + _SLICE]])
                at = held[of[begin + node], column]
                size = cells.size[at]
                k = np.repeat(going[begin + node], size)
                other = cells.rows[np.repeat(cells.first[at] - np.cumsum(size) + size, size) + np.arange(len(k))]
                dx, dy = x[k] - sent["x"][other], y[k] - sent["y"][other]
                square = dx * dx + dy * dy
                share = np.divide(sent["m"][other] * m[k], square, out=np.zeros(len(k)), where=square > 0)
                fx += np.bincount(k, share * dx, len(x))
                fy += np.bincount(k, share * dy, len(x))
        going, above = going[crowded[of]], cells
        if len(going) == 0:
            break
    return fx, fy


def repulsions(nodes: DataFrame, leaf: int = 8, depth: int = 12) -> DataFrame:
    """id, fx, fy for each node (id, x, y, m > 0); nodes without a place are left out."""
    placed = nodes.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("m").cast("double").alias("m")).where("x IS NOT NULL AND y IS NOT NULL")
    edge = placed.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count(F.lit(1)).alias("n")).first()
    if edge["n"] == 0:
        return placed.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    side, wide, top = edge["side"] or 1.0, 1 << depth, min(COARSE, depth)
    place = lambda c: F.least(F.floor((F.col(c) - edge[c]) / side * wide), F.lit(wide - 1)).cast("long").alias("i" if c == "x" else "j")
    at = placed.select("*", place("x"), place("y"))
    coarse = at.groupBy(F.shiftright("i", depth - top).alias("i"), F.shiftright("j", depth - top).alias("j"))
    sums = coarse.agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("x")).alias("sx"), F.sum(F.col("m") * F.col("y")).alias("sy"))
    levels = _pyramid(sums.toArrow(), top)  # 4**COARSE rows at most
    number, parts, tiles = _tiles(levels, max(TILE, leaf))
    owners = nodes.sparkSession.createDataFrame(_owners(number, parts))
    dealt = at.withColumn("ci", F.shiftright("i", depth - top)).withColumn("cj", F.shiftright("j", depth - top)).join(F.broadcast(owners), ["ci", "cj"])
    dealt = dealt.select("id", "x", "y", "m", "i", "j", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("tile")).repartition(len(tiles), "tile")
    sent = dealt.sortWithinPartitions("tile", "i", "j").select("i", "j", "x", "y", "m").mapInArrow(_sender(number, parts, leaf, depth), _SENT).repartition(len(tiles), "tile")
    kind = placed.schema["id"].dataType.simpleString()

    def act(key: tuple, to: pa.Table, near: pa.Table) -> pa.Table:
        rows = {c: near[c].to_numpy() for c in ("l", "i", "j", "n", "m", "x", "y")}
        rows |= {"sx": rows["m"] * rows["x"], "sy": rows["m"] * rows["y"]}
        fx, fy = _forces(tiles[key[0].as_py()], levels, {c: to[c].to_numpy() for c in ("i", "j", "x", "y", "m")}, rows, leaf, depth)
        return pa.table({"id": to["id"], "fx": fx, "fy": fy})

    return dealt.groupBy("tile").cogroup(sent.groupBy("tile")).applyInArrow(act, f"id {kind}, fx double, fy double")


def start(nodes: DataFrame, scale: float) -> DataFrame:
    """id, x, y: places on a disc by a hash of the ids."""
    part = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    far, turn = F.sqrt(part("r")) * scale, part("a") * 6.283185307179586
    return nodes.select("id", (far * F.cos(turn)).alias("x"), (far * F.sin(turn)).alias("y"))


def arrange(nodes: DataFrame, relations: DataFrame, rounds: int = 50, scale: float = 3000.0, gravity: float = 0.05, leaf: int = 8) -> DataFrame:
    """id, x, y of all nodes: edges pull (by weight and distance), all nodes push, and a weak pull leads to the middle.

    A node's mass is one more than its edges.  Steps get shorter from round to
    round, and in the end the map is stretched so that its farthest coordinate
    is ``scale``.  Edges without both ends, loops and null weights count nothing.
    """
    ids = written(nodes.select("id").where("id IS NOT NULL").distinct(), "ids")
    pairs = relations.where("source_id <> target_id AND weight IS NOT NULL").select("source_id", "target_id", "weight")
    pairs = pairs.unionByName(pairs.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    pairs = pairs.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    edges = written(pairs.groupBy("source_id", "target_id").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")), "edges")
    mass = edges.groupBy(F.col("source_id").alias("id")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    bodies = written(ids.join(mass, "id", "left").select("id", (1.0 + F.coalesce("n", F.lit(0))).alias("m"), F.coalesce("w", F.lit(0.0)).alias("w")), "bodies")
    count = bodies.count()
    at = written(start(ids, scale).join(bodies, "id"), "places")
    strength = scale * scale / max(count, 1)
    for k in range(rounds):
        most = scale * 0.1 * (1 - k / rounds)
        pushed = repulsions(at, leaf)
        pulled = edges.join(at.select(F.col("id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty")), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.sum(F.col("w") * F.col("tx")).alias("px"), F.sum(F.col("w") * F.col("ty")).alias("py"))
        total = lambda c: strength * F.col(f"f{c}") / F.col("m") + (F.coalesce(F.col(f"p{c}"), F.lit(0.0)) - F.col("w") * F.col(c)) / F.col("m") - gravity * F.col(c)
        moved = at.join(pushed, "id").join(pulled, "id", "left").select("id", "x", "y", "m", "w", total("x").alias("dx"), total("y").alias("dy"))
        size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
        step = F.when(size > most, F.lit(most) / size).otherwise(1.0)
        at = written(moved.select("id", (F.col("x") + F.col("dx") * step).alias("x"), (F.col("y") + F.col("dy") * step).alias("y"), "m", "w"), "places")
    widest = at.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    return at.select("id", *[(F.col(c) / widest * scale).alias(c) for c in ("x", "y")])
