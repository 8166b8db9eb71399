"""Nearest neighbours over product-quantised cells, with additions, deletions and merges.

The model is fitted once, on a bounded sample: centres of cells, and for each of
``subspaces`` parts of what is left of a vector less its centre, ``CODES``
typical values.  A vector is then one byte for each part.  As scores are inner
products of unit vectors, that of a question and a vector is near

    question . centre + sum over parts of question . typical value,

which needs one table for each question.  A search scores the codes of the cells
nearest to each question, takes ``refine`` times k of the best and ranks these
by their exact cosine.  ``calibrate`` measures recall against all vectors for a
bounded set of questions and sets the number of cells and ``refine``.

Vectors are added in segments without a new fit; a deletion is a list of ids.
Both are commits of a log.  A later vector of an id hides the earlier one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scores import cosine
from ..session import written
from ..sources.log import CommitLog, Conflict
from .ranking import top_k
from .search import BLOCK, best_of_block, blocks, cosines, last_scores, may_hold, nearest, sides_of

CODES = 256
MOST_SEGMENTS = 12


def _units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((values * values).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return good, values[good] / norm[good, None]


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of ``points`` (a bounded sample); fewer points than ``k`` are centres themselves."""
    r = np.random.default_rng(seed)
    centres = points[r.permutation(len(points))[:k]]
    for _ in range(rounds):
        at = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        count = np.bincount(at, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * points @ centres.T - (centres * centres).sum(1)).argmax(1)


class Model:
    """Centres of cells and typical values of the parts of what is left."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.edges = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])])

    @classmethod
    def fit(cls, units: np.ndarray, cells: int, subspaces: int) -> Model:
        centres = lloyd(units, min(cells, len(units)))
        rest = units - centres[nearest_centre(units, centres)]
        return cls(centres, [lloyd(np.ascontiguousarray(part), min(CODES, len(part))) for part in np.array_split(rest, subspaces, axis=1)])

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_centre(units, self.centres)
        rest = units - self.centres[cell]
        codes = [nearest_centre(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def tables(self, asked: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Inner products of questions with all centres and all typical values."""
        return asked @ self.centres.T, [asked[:, a:b] @ book.T for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]

    def plain(self) -> dict[str, Any]:
        return {"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books]}

    @classmethod
    def of(cls, plain: dict[str, Any]) -> Model:
        return cls(np.array(plain["centres"]), [np.array(b) for b in plain["books"]])


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_log")
        self.models = CommitLog(spark, f"{self.path}/_model")

    # State.

    def state(self) -> dict[str, Any]:
        return self.log.read(self.log.last())

    def _commit(self, number: int, state: dict[str, Any]) -> None:
        if not self.log.create(number, state):
            raise Conflict(f"another writer has changed {self.path}")

    def _model(self, state: dict[str, Any]) -> Model:
        return Model.of(self.models.read(state["model"]))

    def _rows(self, state: dict[str, Any], *columns: str) -> DataFrame | None:
        """Rows that are not hidden."""
        found = hidden = None
        for s in state["segments"]:
            at = f"{self.path}/{s['path']}"
            if s["kind"] == "rows":
                rows = self.spark.read.parquet(at).select("id", "cell", *columns).withColumn("_at", F.lit(s["number"]))
                found = rows if found is None else found.unionByName(rows)
            gone = self.spark.read.parquet(f"{at}-hidden" if s["kind"] == "rows" else at).select("id", F.lit(s["number"]).alias("_until")) if s["hides"] else None
            hidden = gone if hidden is None else hidden.unionByName(gone) if gone is not None else hidden
        if found is not None and hidden is not None:
            found = found.join(hidden.groupBy("id").agg(F.max("_until").alias("_until")), "id", "left").where("_until IS NULL OR _at >= _until").drop("_until")
        return found.drop("_at") if found is not None else None

    # Upkeep.

    def fit(self, vectors: DataFrame, cells: int = 64, subspaces: int = 16, sample: int = 20_000, item: str = "id") -> None:
        """Fit the model on ``sample`` rows at most, drawn by a hash of their ids, and empty the index."""
        total = max(1, vectors.count())
        drawn = vectors.where(F.pmod(F.xxhash64(item), F.lit(1_000_000)) < max(1, min(1_000_000, sample * 1_000_000 // total))).select(F.col("embedding").cast("array<double>").alias("v"))
        rows = [r["v"] for r in (drawn if total > sample else vectors.select(F.col("embedding").cast("array<double>").alias("v"))).limit(2 * sample).collect() if r["v"] and None not in r["v"]]
        width = max((len(v) for v in rows), default=1)
        _, units = _units(np.array([v for v in rows if len(v) == width], float).reshape(-1, width))
        if not len(units):
            units = np.eye(1, width)
        number = self.models.numbers()[-1] + 1 if self.models.numbers() else 0
        self.models.create(number, Model.fit(units, cells, min(subspaces, width)).plain())
        at = self.log.last() + 1 if self.log.numbers() else 0
        self._commit(at, {"model": number, "segments": [], "probes": None, "refine": 8})

    def add(self, vectors: DataFrame, item: str = "id") -> None:
        """Add vectors; null and zero ones, and those with nulls or another length, cannot be found and are left out."""
        state = self.state()
        model = self.spark.sparkContext.broadcast(self._model(state))
        kind = vectors.schema[item].dataType
        schema = f"id {kind.simpleString()}, cell int, codes binary, to_centre double, embedding array<double>"
        rows = vectors.select(F.col(item).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["id"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width = model.value.centres.shape[1]
            for batch in batches:
                values = batch.column("embedding").to_pylist()
                at = np.array([k for k, v in enumerate(values) if v is not None and len(v) == width and None not in v], np.int64)
                good, units = _units(np.array([values[k] for k in at], float).reshape(-1, width))
                if not len(units):
                    continue
                at = at[good]
                cell, codes = model.value.encode(units)
                centres = model.value.centres[cell]
                norm = np.sqrt((centres * centres).sum(1))
                to_centre = (units * centres).sum(1) / np.where(norm > 0, norm, np.nan)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(to_centre), batch.column("embedding").take(pa.array(at))], ["id", "cell", "codes", "to_centre", "embedding"])

        path, number = f"segments/{uuid.uuid4().hex}", self.log.last() + 1
        rows.mapInArrow(run, schema).repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/{path}")
        hides = bool(state["segments"])
        if hides:
            rows.select("id").write.parquet(f"{self.path}/{path}-hidden")
        self._commit(number, state | {"segments": [*state["segments"], {"path": path, "kind": "rows", "number": number, "hides": hides}]})
        if len(state["segments"]) >= MOST_SEGMENTS:
            self.merge()

    def delete(self, ids: DataFrame) -> None:
        state, number, path = self.state(), self.log.last() + 1, f"segments/{uuid.uuid4().hex}"
        ids.select("id").distinct().write.parquet(f"{self.path}/{path}")
        self._commit(number, state | {"segments": [*state["segments"], {"path": path, "kind": "gone", "number": number, "hides": True}]})

    def merge(self) -> None:
        """One segment of all rows that are not hidden, codes as they are."""
        state, number, path = self.state(), self.log.last() + 1, f"segments/{uuid.uuid4().hex}"
        rows = self._rows(state, "codes", "to_centre", "embedding")
        if rows is not None:
            rows.repartition("cell").write.partitionBy("cell").parquet(f"{self.path}/{path}")
            self._commit(number, state | {"segments": [{"path": path, "kind": "rows", "number": number, "hides": False}]})

    def clear(self) -> None:
        self._commit(self.log.last() + 1, self.state() | {"segments": []})

    def count(self) -> int:
        rows = self._rows(self.state())
        return 0 if rows is None else rows.count()

    # Search.

    def search(self, queries: DataFrame, k: int, query: str = "query_id", probes: int | None = None, refine: int | None = None) -> DataFrame:
        """query, id, score: the ``k`` best by exact cosine of what the codes let through."""
        state = self.state()
        rows, model = self._rows(state, "codes"), self._model(state)
        types = queries.schema[query].dataType
        if rows is None:
            return queries.select(query, F.lit(None).cast(types).alias("id"), F.lit(0.0).alias("score")).where("false")
        probes = min(probes or state["probes"] or len(model.centres), len(model.centres))
        keep = k * (refine or state["refine"])
        asked = queries.select(F.col(query).alias("q"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
        parts = max(1, -(-asked.count() // BLOCK))
        kind = rows.schema["id"].dataType
        schema, arrow = f"q {types.simpleString()}, id {kind.simpleString()}, cell int, near double", [to_arrow_type(t) for t in (types, kind)]
        found: DataFrame | None = None
        for part in range(parts):
            own = [r for r in asked.where(F.pmod(F.xxhash64("q", F.lit("block")), F.lit(parts)) == part).collect() if len(r["v"]) == model.centres.shape[1] and None not in r["v"]]  # about ``BLOCK`` rows
            good, units = _units(np.array([r["v"] for r in own], float).reshape(-1, model.centres.shape[1]))
            centre, tables = model.tables(units)
            order = np.argsort(-centre, 1, kind="stable")[:, :probes]
            probed = np.zeros(centre.shape, bool)
            np.put_along_axis(probed, order, True, 1)
            shared = self.spark.sparkContext.broadcast(([r["q"] for r, g in zip(own, good, strict=True) if g], np.where(probed, centre, -np.inf), tables))
            cells = np.flatnonzero(probed.any(0)).tolist()

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                names, centre, tables = shared.value
                best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
                for batch in (whole.slice(begin, BLOCK) for whole in batches for begin in range(0, whole.num_rows, BLOCK)):
                    if not names:
                        continue
                    ids, cell = batch.column("id").to_numpy(zero_copy_only=False), batch.column("cell").to_numpy()
                    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    near = centre[:, cell]
                    for j, table in enumerate(tables):
                        near = near + table[:, codes[:, j]]
                    new = (near, np.broadcast_to(ids, near.shape), np.broadcast_to(cell, near.shape))
                    both = new if best is None else tuple(np.concatenate([x, y], 1) for x, y in zip(best, new, strict=True))
                    if both[0].shape[1] > keep:
                        top = np.argpartition(-both[0], keep - 1, 1)[:, :keep]
                        both = tuple(np.take_along_axis(x, top, 1) for x in both)
                    best = both
                if best is not None:
                    row, column = np.nonzero(np.isfinite(best[0]))
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in row], arrow[0]), pa.array(best[1][row, column].tolist(), arrow[1]), pa.array(best[2][row, column].astype(np.int32)), pa.array(best[0][row, column])], ["q", "id", "cell", "near"])

            near = written(top_k(rows.where(F.col("cell").isin(cells)).mapInArrow(run, schema), ["q"], [F.desc("near"), F.asc("id")], keep), "near")
            found = near if found is None else found.unionByName(near)
        exact = self._rows(state, "embedding").join(found.drop("near"), ["id", "cell"]).join(asked, "q")
        scored = exact.select(F.col("q").alias(query), "id", cosine(F.col("v"), F.col("embedding")).alias("score"))
        return top_k(scored, [query], [F.desc(F.round("score", 9)), F.asc("id")], k)

    def search_exact(self, queries: DataFrame, k: int, query: str = "query_id") -> DataFrame:
        """query, id, score as ``nearest`` finds them: the codes find ``k``, then the cells are compared that may hold one as near.

        Copies have equal codes, and of more copies than a search keeps some
        with smaller ids may be left out; so all rows of these cells are compared.
        """
        state = self.state()
        model, first = self._model(state), written(self.search(queries, k, query, probes=4, refine=1).withColumnRenamed(query, "q"), "first")
        rows = self._rows(state, "to_centre", "embedding")
        if rows is None:
            return first.withColumnRenamed("q", query)
        radii = {r["cell"]: r["near"] for r in rows.groupBy("cell").agg(F.min("to_centre").alias("near"), F.max(F.isnan("to_centre")).alias("open")).where("NOT open").collect()}  # as many as cells
        radius = np.arccos(np.clip([radii.get(c, np.nan) for c in range(len(model.centres))], -1, 1))
        rows, width, found = rows.select("id", "cell", F.col("embedding").alias("v")), model.centres.shape[1], None
        for own, mine in blocks(queries, query):
            names, units = sides_of(own).get(width, ([], np.zeros((0, width))))
            open_cells = may_hold(cosines(units, model.centres), radius, last_scores(first.where(mine), names, k))
            near = best_of_block(rows, {width: (names, units)}, k, queries.schema[query].dataType, cells=open_cells)
            found = near if found is None else found.unionByName(near)
        best = written(top_k(found, ["q"], [F.desc("score"), F.asc("id")], k).select("q", "id"), "best")
        asked = queries.select(F.col(query).alias("q"), F.col("embedding").cast("array<double>").alias("asked"))
        return rows.join(best, "id").join(asked, "q").select(F.col("q").alias(query), "id", cosine(F.col("asked"), F.col("v")).alias("score"))

    def recall(self, queries: DataFrame, k: int, query: str = "query_id", true: DataFrame | None = None, **how: int) -> float:
        """Share of the true ``k`` nearest of the questions (``true``, if known) that a search finds."""
        if true is None:
            true = written(nearest(queries, self._rows(self.state(), "embedding"), k, query).select(query, "id"), "true")
        found = self.search(queries, k, query, **how).select(query, "id")
        wanted = true.count()
        return true.join(found, [query, "id"], "left_semi").count() / wanted if wanted else 1.0

    def calibrate(self, k: int = 10, target: float = 0.995, questions: int = 200) -> float:
        """Set the fewest cells and the smallest ``refine`` that reach ``target`` for about ``questions`` stored vectors; the recall reached."""
        state, cells = self.state(), len(self._model(self.state()).centres)
        total = max(1, self.count())
        share = min(1_000_000, max(1, questions * 1_000_000 // total))
        asked = written(self._rows(state, "embedding").where(F.pmod(F.xxhash64("id", F.lit("ask")), F.lit(1_000_000)) < share).select(F.col("id").alias("query_id"), "embedding"), "asked")
        true = written(nearest(asked, self._rows(state, "embedding"), k).select("query_id", "id"), "true")
        for probes, refine in [(p, r) for p in sorted({max(1, cells // 8), max(1, cells // 2), cells}) for r in (4, 16, 64)]:
            reached = self.recall(asked, k, true=true, probes=probes, refine=refine)
            if reached >= target:
                break
        self._commit(self.log.last() + 1, self.state() | {"probes": probes, "refine": refine})
        return reached
