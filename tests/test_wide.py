from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import ranking


def test_long_lists_like_short_ones(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), "id", F.when(F.col("id") % 17 > 0, F.col("id") * 7 % 11).cast("double").alias("score"))
    order = [F.desc("score"), F.asc("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = ranking.ranked_wide(rows, ["source"], order)
        assert sorted(map(str, wide.collect())) == sorted(map(str, ranking.ranked(rows, ["source"], order).collect()))
        assert "hashpartitioning(source, _part" in wide._jdf.queryExecution().executedPlan().toString().replace("#", " ").replace("source ", "source").translate(str.maketrans("", "", "0123456789L"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
