"""A BM25 index in segments, with block maxima, appends, deletions and merges.

A segment holds the postings of some texts in blocks of up to ``BLOCK`` ids, best
first, each with its greatest term frequency and smallest length, which bound
what the block can add to a score; and the texts' own token counts by id.

A search reads few blocks and finds what reading all would:

1. The best block of each question's three strongest tokens gives some texts,
   which are scored exactly; the k-th best score is a floor.
2. Tokens whose bounds together stay below the floor can find no text by
   themselves.  Of each other token the blocks are read whose bound, with the
   best that all other tokens of the question can add, reaches the floor.
3. The texts in these blocks are scored exactly, by their own counts.

A new segment, or a deletion, is a commit of its own and touches no other.  A
later text of an id hides the earlier one; counts of tokens and lengths are kept
as sums over commits, so hidden texts leave the statistics at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from ..sources.log import CommitLog, Conflict
from .ranking import top_k
from .search import tokens

BLOCK = 128
#: A token's postings are dealt into slices of about this many, so that no task sorts a whole frequent token.
SLICE = 1 << 20
#: Postings that a task sorts, and characters whose tokens a task counts, in memory.
POSTINGS = 1 << 19
CHARACTERS = 1 << 22
#: Numbers of a matrix of questions, or texts, by tokens; more questions than fit are scored by joins.
MATRIX = 1 << 22
SEED_TOKENS = 3
MOST_SEGMENTS = 12
_EPSILON = 1e-7


def _weight(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / avgdl))


def _products(asked: pa.Table, avgdl: float, k1: float, b: float):
    """Scores of texts (id, dl, token, tf and the questions qs that each is scored for), as products of matrices by token."""
    questions, words = (pc.unique(asked[c].combine_chunks()) for c in ("q", "token"))
    idf = np.zeros((len(words), len(questions)))
    idf[pc.index_in(asked["token"], words).to_numpy(), pc.index_in(asked["q"], questions).to_numpy()] = asked["idf"].to_numpy()
    most = max(1, MATRIX // len(words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, most):
                rows = batch.slice(begin, most)
                column = pc.index_in(rows["token"].flatten(), words)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                row = pc.list_parent_indices(rows["token"]).to_numpy()[known]
                tf, dl = rows["tf"].flatten().to_numpy(zero_copy_only=False)[known], rows["dl"].to_numpy()
                weights = np.zeros((rows.num_rows, len(words)))
                weights[row, column.drop_null().to_numpy()] = tf / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                text = pc.list_parent_indices(rows["qs"])
                found = (weights @ idf)[text.to_numpy(), pc.index_in(rows["qs"].flatten(), questions).to_numpy()]
                out = pa.RecordBatch.from_arrays([rows["qs"].flatten(), rows["id"].take(text), pa.array(found)], names=["q", "id", "score"])
                yield out.filter(pa.array(found > 0))

    return score


class LexicalIndex:
    """An index below ``path``; k1 and b are those of all searches."""

    def __init__(self, spark: SparkSession, path: str, k1: float = 1.2, b: float = 0.75):
        self.spark, self.path, self.k1, self.b = spark, path.rstrip("/"), k1, b
        self.log = CommitLog(spark, f"{self.path}/_log")

    # Segments.

    def segments(self) -> list[dict[str, Any]]:
        return self.log.read(self.log.last()) if self.log.numbers() else []

    def _commit(self, number: int, segments: list[dict[str, Any]]) -> None:
        if not self.log.create(number, segments):
            raise Conflict(f"another writer has changed {self.path}")

    def _read(self, kind: str, segments: list[dict[str, Any]]) -> DataFrame | None:
        """Rows of one kind of all segments, with the segment's number."""
        found: DataFrame | None = None
        for segment in segments:
            if kind in segment["holds"]:
                rows = self.spark.read.parquet(f"{self.path}/{segment['path']}/{kind}").withColumn("segment", F.lit(segment["number"]))
                found = rows if found is None else found.unionByName(rows)
        return found

    def _texts(self, segments: list[dict[str, Any]]) -> DataFrame:
        """id, dl, counts of the texts that are not hidden."""
        rows, hidden = self._read("texts", segments), self._read("hidden", segments)
        if hidden is not None:
            last = hidden.groupBy("id").agg(F.max("segment").alias("until"))
            rows = rows.join(last, "id", "left").where("until IS NULL OR segment >= until").drop("until")
        return rows.drop("segment")

    def _new(self, number: int, segments: list[dict[str, Any]], texts: DataFrame | None, gone: DataFrame | None) -> dict[str, Any]:
        """Write a segment of ``texts`` (id, dl, counts) that hides the texts of the ids of ``gone``."""
        path = f"segments/{uuid.uuid4().hex}"
        at, holds, changes, n, dl = f"{self.path}/{path}", [], None, 0, 0
        if gone is not None and segments:
            old = written(self._texts(segments).join(gone.select("id").distinct(), "id", "left_semi"), "old")
            old.select("id").write.parquet(f"{at}/hidden")
            holds.append("hidden")
            less = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, dl = n - less[0], dl - less[1]
            changes = old.select(F.explode("counts.token").alias("token"), F.lit(-1).cast("long").alias("df"))
        if texts is not None:
            texts.write.parquet(f"{at}/texts")
            holds += ["texts", "blocks"]
            texts = self.spark.read.parquet(f"{at}/texts")
            more = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, dl = n + more[0], dl + more[1]
            postings = texts.select("id", F.col("dl").cast("int").alias("dl"), F.explode("counts").alias("c")).select("id", "dl", "c.token", "c.tf")
            own = written(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "df")
            changes = own if changes is None else changes.unionByName(own)
            # As few tokens as there are slices; all others are one slice, so postings are shuffled once, to where they are sorted and written.
            split = own.where(F.col("df") > SLICE).select("token", F.ceil(F.col("df") / SLICE).cast("long").alias("slices"))
            sliced = postings.join(F.broadcast(split), "token", "left").withColumn("slice", F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1).cast("long")))).drop("slices")
            tasks = 1 + (own.agg(F.sum("df")).first()[0] or 0) // POSTINGS
            best = Window.partitionBy("token", "slice").orderBy(F.desc(_weight(F.col("tf"), F.col("dl"), F.lit(more[1] / max(more[0], 1) or 1.0), self.k1, self.b)), "id")
            numbered = sliced.repartition(tasks, "token", "slice").withColumn("block", F.floor((F.row_number().over(best) - 1) / BLOCK).cast("int"))
            blocks = numbered.groupBy("token", "slice", "block").agg(F.collect_list("id").alias("ids"), F.max("tf").alias("tf"), F.min("dl").cast("long").alias("dl"), F.count(F.lit(1)).alias("n"))
            blocks.sortWithinPartitions("token").write.parquet(f"{at}/blocks")
        if changes is not None:
            changes.groupBy("token").agg(F.sum("df").alias("df")).write.parquet(f"{at}/terms")
            holds.append("terms")
        return {"number": number, "path": path, "holds": holds, "n": n, "dl": dl}

    def append(self, docs: DataFrame, item: str = "id", text: str = "content") -> None:
        """Add texts; a null text has no tokens, and of rows with one id the greatest text counts."""
        given = docs.select(F.col(item).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        tasks = 1 + (given.agg(F.sum(F.length("t"))).first()[0] or 0) // CHARACTERS
        # A text is shuffled once; its tokens are counted where it then is.
        rows = given.repartition(tasks, "id").groupBy("id").agg(F.max("t").alias("t"))
        counted = rows.select("id", F.explode_outer(tokens(F.col("t"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        held = F.col("token").isNotNull()
        texts = counted.groupBy("id").agg(F.coalesce(F.sum(F.when(held, F.col("tf"))), F.lit(0)).cast("long").alias("dl"), F.collect_list(F.when(held, F.struct("token", "tf"))).alias("counts"))
        segments = self.segments()
        number = self.log.last() + 1 if segments else 0
        self._commit(number, [*segments, self._new(number, segments, texts, given)])
        if len(segments) >= MOST_SEGMENTS:
            self.merge()

    def delete(self, ids: DataFrame) -> None:
        """Texts of ``ids`` (id) are found no more."""
        segments = self.segments()
        if segments:
            number = self.log.last() + 1
            self._commit(number, [*segments, self._new(number, segments, None, ids)])

    def merge(self) -> None:
        """One segment of all texts that are not hidden."""
        segments = self.segments()
        if segments:
            number = self.log.last() + 1
            self._commit(number, [self._new(number, [], self._texts(segments), None)])

    def clear(self) -> None:
        """No texts at all."""
        if self.log.numbers():
            self._commit(self.log.last() + 1, [])

    def count(self) -> int:
        return sum(s["n"] for s in self.segments())

    # Search.

    def _asked(self, queries: DataFrame, query: str, text: str, segments: list[dict[str, Any]]) -> DataFrame:
        """q, token and idf of the tokens that the index holds."""
        n = sum(s["n"] for s in segments)
        asked = queries.select(F.col(query).alias("q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
        df = self._read("terms", segments).join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return written(asked.join(df, "token").select("q", "token", idf.alias("idf")), "asked")

    def _scored(self, pairs: DataFrame, asked: DataFrame, texts: DataFrame, avgdl: float) -> DataFrame:
        """q, id, score of different pairs (q, id), from the texts' own counts."""
        size = asked.agg(F.count_distinct("q").alias("q"), F.count_distinct("token").alias("token")).first()
        if 0 < size["q"] * size["token"] <= MATRIX:
            near = texts.join(pairs.groupBy("id").agg(F.collect_list("q").alias("qs")), "id")
            kinds = [pairs.schema[c].dataType.simpleString() for c in ("q", "id")]
            return near.select("id", "dl", "counts.token", "counts.tf", "qs").mapInArrow(_products(asked.toArrow(), avgdl, self.k1, self.b), f"q {kinds[0]}, id {kinds[1]}, score double")
        near = texts.join(pairs.select("id").distinct(), "id", "left_semi").select("id", "dl", F.explode("counts").alias("c")).select("id", "dl", "c.token", "c.tf")
        near = near.join(asked.select("token").distinct(), "token", "left_semi")
        part = F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.lit(avgdl), self.k1, self.b)
        return pairs.join(near, "id").join(asked, ["q", "token"]).groupBy("q", "id").agg(F.sum(part).alias("score"))

    def _plan(self, queries: DataFrame, k: int, query: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, float] | None:
        """Scored texts of the first blocks, blocks to be read (q, key of the block, n), the asked tokens and the mean length."""
        segments = self.segments()
        n = sum(s["n"] for s in segments)
        if not n:
            return None
        avgdl = sum(s["dl"] for s in segments) / n or 1.0
        asked = self._asked(queries, query, text, segments)
        blocks = self._read("blocks", segments)
        key = ["token", "segment", "slice", "block"]
        # The ids of a block are another column; bounds alone are read here.
        bounds = blocks.select(*key, "n", _weight(F.col("tf"), F.col("dl"), F.lit(avgdl), self.k1, self.b).alias("w")).join(asked.select("token").distinct(), "token", "left_semi")
        bounds = written(asked.join(bounds, "token").select("q", *key, "n", (F.col("idf") * F.col("w")).alias("most")), "bounds")
        strongest = bounds.groupBy("q", "token").agg(F.max("most").alias("best"))
        lead = top_k(strongest, ["q"], [F.desc("best"), F.asc("token")], SEED_TOKENS)
        first = top_k(bounds.join(lead.select("q", "token"), ["q", "token"]), ["q", "token"], [F.desc("most"), F.asc("segment"), F.asc("slice"), F.asc("block")], -(-k // BLOCK))
        seeds = written(self._scored(self._ids(first, blocks), asked, self._texts(segments), avgdl), "seeds")
        floor = top_k(seeds, ["q"], [F.desc("score"), F.asc("id")], k).groupBy("q").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("found"))
        floor = floor.select("q", F.when(F.col("found") >= k, F.col("last")).alias("floor"))
        rising = Window.partitionBy("q").orderBy("best", "token")  # the tokens of one question
        terms = strongest.select("q", "token", "best", F.sum("best").over(rising).alias("upto"), F.sum("best").over(Window.partitionBy("q")).alias("all"))
        terms = terms.join(floor, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - _EPSILON)
        read = bounds.join(terms, ["q", "token"]).where("upto >= floor AND most + all - best >= floor")
        return seeds, written(read.select("q", *key, "n").unionByName(first.select("q", *key, "n")).distinct(), "read"), asked, avgdl

    def _ids(self, wanted: DataFrame, blocks: DataFrame) -> DataFrame:
        """q and id of all texts in blocks."""
        key = ["token", "segment", "slice", "block"]
        return wanted.select("q", *key).join(blocks.select(*key, "ids"), key).select("q", F.explode("ids").alias("id")).distinct()

    def search(self, queries: DataFrame, query: str = "query_id", text: str = "text", k: int = 20) -> DataFrame:
        """query, id, score: the ``k`` best texts of each question; ties go to the smallest id."""
        plan = self._plan(queries, k, query, text)
        if plan is None:
            kind = queries.schema[query].dataType
            return queries.select(F.col(query), F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score")).where("false")
        _, read, asked, avgdl = plan
        segments = self.segments()
        found = self._scored(self._ids(read, self._read("blocks", segments)), asked, self._texts(segments), avgdl)
        return top_k(found.withColumnRenamed("q", query), [query], [F.desc(F.round("score", 9)), F.asc("id")], k)

    def reads(self, queries: DataFrame, query: str = "query_id", text: str = "text", k: int = 20) -> DataFrame:
        """query, postings of its tokens, and how many of them a search reads."""
        plan = self._plan(queries, k, query, text)
        _, read, asked, _ = plan
        whole = asked.join(self._read("blocks", self.segments()).groupBy("token").agg(F.sum("n").alias("n")), "token").groupBy("q").agg(F.sum("n").alias("postings"))
        return whole.join(read.groupBy("q").agg(F.sum("n").alias("read")), "q").select(F.col("q").alias(query), "postings", "read")
