"""Queries through saved indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lexical import LexicalIndex
from ..operators.vectors import VectorIndex
from ..session import shared_dir
from ..sources.derive import Graph
from .catalogue import BM25, query


def index_path(g: Graph) -> str:
    return f"{shared_dir(g.spark)}/loomgraph/{g.spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"


def _questions(g: Graph) -> DataFrame:
    return g.table("benchmark").withColumnRenamed("item_id", "query_id")


@query(BM25, graph_views=False)
def lexical_search(g: Graph) -> DataFrame:
    """The ten best texts for each question, from an index that got all documents in three appends, by language."""
    index, docs = LexicalIndex(g.spark, index_path(g)), g.table("documents")
    for part in (F.col("lang") == "en", F.col("lang").isin("fr", "de"), ~F.coalesce(F.col("lang"), F.lit("")).isin("en", "fr", "de")):
        index.append(docs.where(part), item="doc_id", text="text")
    return index.search(_questions(g), k=10).select("query_id", "id", F.round("score", 6).alias("score"))


CHANGED = "changed AS (SELECT doc_id, CASE WHEN source = 'src2' THEN source || ' ' || lang ELSE text END AS text FROM documents WHERE source <> 'src1')"


@query(BM25.replace("WITH toks", f"WITH {CHANGED}, toks").replace("FROM documents)", "FROM changed)").replace("FROM documents),", "FROM changed),"), graph_views=False)
def lexical_after_changes(g: Graph) -> DataFrame:
    """The same after the texts of one source were deleted and those of another replaced, without a rebuild, then merged."""
    index, docs = LexicalIndex(g.spark, index_path(g)), g.table("documents")
    index.append(docs, item="doc_id", text="text")
    index.delete(docs.where("source = 'src1'").select(F.col("doc_id").alias("id")))
    index.append(docs.where("source = 'src2'").select("doc_id", F.concat_ws(" ", "source", "lang").alias("text")), item="doc_id", text="text")
    index.merge()
    return index.search(_questions(g), k=10).select("query_id", "id", F.round("score", 6).alias("score"))


NEAREST = """WITH kept AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 3), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, id, list_cosine_similarity(q, v) AS score FROM q, kept)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s) WHERE n <= 10"""


def _upkeep(g: Graph) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors in two additions, after the vectors of one label were deleted, opened anew; and the questions."""
    rows = g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    index = VectorIndex(g.spark, index_path(g))
    index.fit(rows)
    index.add(rows.where("label < 5"))
    index.add(rows.where("label >= 5 OR label IS NULL"))
    index.delete(rows.where("label = 3").select("id"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return VectorIndex(g.spark, index.path), asked


@query(NEAREST, graph_views=False)
def vector_upkeep(g: Graph) -> DataFrame:
    """The ten nearest, proven by the cells' radii, so that they are what comparing all vectors finds."""
    index, asked = _upkeep(g)
    return index.search_exact(asked, 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def vector_recall(g: Graph) -> DataFrame:
    """Recall after calibration on stored vectors, measured on the questions."""
    index, asked = _upkeep(g)
    own = index.calibrate()
    state = index.state()
    return g.spark.createDataFrame([(state["probes"], state["refine"], float(own), float(index.recall(asked, 10)))], "probes long, refine long, calibrated double, recall double")
