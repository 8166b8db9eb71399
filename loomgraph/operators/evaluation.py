"""Retrieval metrics over judged runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.providers import call_model
from ..functions.scores import answer_type, base_level, overall, retrieval_probability, status_of
from .enrichment import judged_scores


def metrics(runs: DataFrame, judged: DataFrame, ks: Sequence[int] = (1, 3, 5, 10, 20)) -> DataFrame:
    """query_id, k, recall, precision, mrr, ndcg.

    ``runs`` has query_id, item_id, rank (from 1); ``judged`` has query_id,
    item_id and relevance (over 0: relevant).  Precision divides by k even if
    fewer were retrieved; queries without a relevant item score 0.
    """
    cuts = runs.sparkSession.createDataFrame([(int(k),) for k in ks], "k int")
    relevant = judged.where("relevance > 0").select("query_id", "item_id", F.col("relevance").cast("double").alias("rel"))
    ideal = F.transform(F.col("rels"), lambda r, i: r / F.log2(i + 2.0))
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"), F.sort_array(F.collect_list("rel"), asc=False).alias("rels"))  # one query's judgements
    hits = runs.join(relevant, ["query_id", "item_id"])
    queries = runs.select("query_id").distinct().join(wanted, "query_id", "left").join(F.broadcast(cuts))  # a handful of cuts
    at_k = hits.join(F.broadcast(cuts), F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count_distinct("item_id").alias("found"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    first = hits.groupBy("query_id").agg((1.0 / F.min("rank")).alias("mrr"))
    best = F.aggregate(F.slice(ideal, F.lit(1), F.col("k")), F.lit(0.0), lambda a, x: a + x)
    found = F.coalesce("found", F.lit(0))
    return queries.join(at_k, ["query_id", "k"], "left").join(first, "query_id", "left").select(
        "query_id", "k", F.coalesce(F.try_divide(found, "n_rel"), F.lit(0.0)).alias("recall"), (found / F.col("k")).alias("precision"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"), F.coalesce(F.try_divide("dcg", best), F.lit(0.0)).alias("ndcg"),
    )


def averaged(per_query: DataFrame) -> DataFrame:
    return per_query.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "ndcg")], F.count(F.lit(1)).alias("n_queries"))


def run_golden(golden: DataFrame, search: Callable[[DataFrame], DataFrame], most: int | None = None, ks: Sequence[int] = (1, 3, 5, 10, 20)) -> tuple[DataFrame, DataFrame]:
    """Metrics by query and their means, of a batch search over golden queries (query, relevant_chunk_ids).

    ``search`` takes (query_id, text) and gives (query_id, item_id, rank);
    queries without a result are left out of the means.
    """
    asked = golden.withColumn("query_id", F.sha2("query", 256))
    if most is not None:
        asked = asked.orderBy("query_id").limit(most)
    runs = search(asked.select("query_id", F.col("query").alias("text")))
    judged = asked.select("query_id", F.explode("relevant_chunk_ids").alias("item_id"), F.lit(1.0).alias("relevance"))
    each = metrics(runs, judged, ks)
    return each, averaged(each)


def judge(answers: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Judged answers: ``answers`` has question, expected, answer and url; adds answer_type, the four scores and overall."""
    prompt = F.concat_ws("\n", F.lit("QUESTION"), "question", F.lit("EXPECTED"), "expected", F.lit("ANSWER"), "answer")
    said = call_model(answers.withColumn("prompt", prompt).withColumnRenamed("answer", "given"), generate)
    scored = said.withColumn("_s", judged_scores(F.col("answer"))).withColumn("answer_type", answer_type(F.col("given"), F.col("url")))
    parts = [F.col(f"_s.{n}") for n in ("source_match", "key_info_match", "relevance", "no_contradiction")]
    out = scored.select(*[F.col("given").alias("answer") if c == "answer" else F.col(c) for c in answers.columns], "answer_type", *[p.alias(n) for p, n in zip(parts, ("source_match", "key_info_match", "relevance", "no_contradiction"), strict=True)])
    return out.withColumn("overall", overall(F.col("answer_type"), [F.col(n) for n in ("source_match", "key_info_match", "relevance", "no_contradiction")]))


def summary(judged: DataFrame) -> DataFrame:
    """One row: questions, mean scores, and the share of answers of 0.7 and more."""
    names = ("source_match", "key_info_match", "relevance", "no_contradiction", "overall")
    return judged.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names], F.round(F.avg((F.col("overall") >= 0.7).cast("double")), 6).alias("good_share"))


def by_answer_type(judged: DataFrame) -> DataFrame:
    return judged.groupBy("answer_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 6).alias("overall"))


def activation_table(ages: DataFrame, decay: float = 0.5) -> DataFrame:
    """Base level, retrieval probability and status for histories (id, history, now), to set thresholds by."""
    level = base_level(F.col("history"), F.col("now"), decay)
    return ages.select("id", level.alias("level"), retrieval_probability(level).alias("probability"), status_of(level).alias("status"))
