"""Breaks and chunks of texts as lists against the forms by rows."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions.providers import letter_embedding, letter_similarities
from loomgraph.functions.scores import cosine
from loomgraph.operators import ranking, structure
from loomgraph.plans import catalogue, texts
from loomgraph.sources.derive import Graph


def test_lists_like_rows(spark):
    r = random.Random(4)
    sentence = lambda: "".join(r.choice("abcdeé ж1.") for _ in range(r.randint(0, 9)))
    rows = [(k, [sentence() for _ in range(r.randint(0, 30))]) for k in range(60)] + [(99, None), (98, ["", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>")
    lists = docs.select("doc_id", "s", F.transform(letter_similarities("s"), lambda x: F.round(x, 9)).alias("m"))
    lists = lists.select("doc_id", "s", "m", ranking.breaks_in(F.col("m")).alias("b"))
    got = {(x["doc_id"], x["idx"] + 1): (x["c"]["similarity"], x["c"]["is_break"]) for x in lists.select("doc_id", F.posexplode(F.arrays_zip(F.col("m").alias("similarity"), F.col("b").alias("is_break"))).alias("idx", "c")).collect()}
    v = docs.select("doc_id", F.posexplode("s").alias("idx", "t")).withColumn("v", letter_embedding(F.col("t")))
    v = v.withColumn("before", F.lag("v").over(Window.partitionBy("doc_id").orderBy("idx"))).where("idx > 0")
    wanted = ranking.semantic_breaks(v.select("doc_id", "idx", F.round(F.coalesce(cosine(F.col("before"), F.col("v")), F.lit(0.0)), 9).alias("similarity")))
    wanted = {(x["doc_id"], x["idx"]): (x["similarity"], x["is_break"]) for x in wanted.collect()}
    assert len(wanted) > 500 and got == wanted
    sizes = F.transform("s", lambda x: F.char_length(x))
    cut = lists.where("size(s) > 0").select("doc_id", F.posexplode(structure.chunks_of(sizes, F.col("b"), 20, 8, 3)).alias("idx", "c")).select("doc_id", "idx", "c.*")
    parts = lists.select("doc_id", F.posexplode(F.arrays_zip(sizes.alias("n_tokens"), F.concat(F.array(F.lit(False)), "b").alias("is_break"))).alias("idx", "p")).where("p.n_tokens IS NOT NULL").select("doc_id", "idx", "p.*")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, structure.semantic_chunks(parts, 20, 8, 3).collect()))


def test_texts_are_not_shuffled(spark):
    g = Graph(spark, "/root/testdata/sf0.001")
    for made in (catalogue.semantic_breaks(g), texts.sentence_chunks(g)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
