"""Graph views over the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of lineitem for which a task finds the pairs of parts.
LINES = 200_000


class Graph:
    """Lazy frames; each is a projection or one join of base tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._tasks: int | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tasks(self) -> int:
        """For the pairs of parts; the rows of lineitem are counted once, from the files' footers."""
        if self._tasks is None:
            self._tasks = 1 + self.table("lineitem").count() // LINES
        return self._tasks

    def concepts(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS id",
            "lower(p_name) AS name",
            "p_brand AS brand",
            "element_at(array('tool','resource','action','state','config','error','general'), cast(p_size % 7 AS int) + 1) AS type",
            "CASE WHEN p_partkey % 20 = 0 THEN 'merged' WHEN p_partkey % 3 = 0 THEN NULL ELSE 'active' END AS status",
            "CASE WHEN p_partkey % 2 = 0 THEN p_type END AS enriched_definition",
            "array(lower(p_brand), lower(p_type)) AS aliases",
            "cast(p_size AS bigint) AS activation_count",
            "cast(p_partkey * 37 % 1000 AS double) AS layout_x",
            "cast(p_partkey * 91 % 1000 AS double) AS layout_y",
            "cast(p_partkey % 12 AS int) AS cluster",
        )

    def relations(self) -> DataFrame:
        """Parts that two or more orders have in common, in both directions; tasks grow in number with the lines, not in size."""
        tasks = self.tasks()
        lines = self.memory_concept()
        a, b = lines.alias("a"), lines.alias("b")
        together = a.join(b, F.expr("a.memory_id = b.memory_id AND a.concept_id < b.concept_id")).select(F.col("a.concept_id").alias("x"), F.col("b.concept_id").alias("y"))
        pairs = together.repartition(tasks, "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
        both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("source_id"), F.col("y").alias("target_id")), F.struct(F.col("y").alias("source_id"), F.col("x").alias("target_id")))).alias("e"), "n").select("e.*", "n")
        return both.selectExpr(
            "source_id",
            "target_id",
            "least(1.0D, n / 5.0D) AS weight",
            "n AS co_occurrence_count",
            "element_at(array('is_a','contains','uses','related_to'), cast((source_id + target_id) % 4 AS int) + 1) AS relation_type",
            "(source_id + target_id) % 4 < 2 AS is_semantic",
            "(source_id + target_id) % 4 = 0 AS is_universal",
            "CASE WHEN (source_id + target_id) % 5 = 0 THEN NULL WHEN (source_id + target_id) % 2 = 0 THEN 'domain' ELSE 'world' END AS source_type",
        )

    def memories(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS doc_id",
            "concat(lower(o_orderpriority), ' order ', o_orderkey) AS content",
            "1.0D + least(9.0D, o_totalprice / 50000.0D) AS importance",
            "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deprioritized' ELSE 'archived' END AS status",
            "element_at(array('fact','procedure','relationship'), cast(o_orderkey % 3 AS int) + 1) AS memory_type",
            "o_orderdate AS last_accessed",
            "o_orderdate - INTERVAL 30 DAYS AS created_at",
            "o_orderkey % 7 AS access_count",
            "1.3D + (o_orderkey % 13) * 0.1D AS strength",
            "0.5D + (o_orderkey % 5) * 0.1D AS confidence",
        )

    def memory_concept(self) -> DataFrame:
        return self.table("lineitem").selectExpr("l_orderkey AS memory_id", "l_partkey AS concept_id").repartition(self.tasks(), "memory_id").distinct()

    def memory_document(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS memory_id", "o_custkey AS doc_id")

    def documents(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS id", "c_name AS title", "c_mktsegment AS segment")

    def episodes(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS id",
            "user_id",
            "ts AS created_at",
            "event_type AS behavior_name",
            "concat('d', user_id % 5) AS domain",
            "1.0D + event_id % 10 AS importance",
            "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 + event_id % 4 ELSE 0 END AS success_count",
            "CASE WHEN event_type = 'error' THEN 2L ELSE event_id % 2 END AS failure_count",
        )

    def episode_concept(self) -> DataFrame:
        """Concept 0 does not exist, so some links dangle."""
        return self.table("events").selectExpr("event_id AS episode_id", "cast(get_json_object(props, '$.k') AS bigint) AS concept_id")


#: The same views as common table expressions for DuckDB.
SQL = """
concepts AS (SELECT p_partkey AS id, lower(p_name) AS name, p_brand AS brand,
  ['tool','resource','action','state','config','error','general'][(p_size % 7) + 1] AS type,
  CASE WHEN p_partkey % 20 = 0 THEN 'merged' WHEN p_partkey % 3 = 0 THEN NULL ELSE 'active' END AS status,
  CASE WHEN p_partkey % 2 = 0 THEN p_type END AS enriched_definition, [lower(p_brand), lower(p_type)] AS aliases,
  p_size::BIGINT AS activation_count, (p_partkey * 37 % 1000)::DOUBLE AS layout_x, (p_partkey * 91 % 1000)::DOUBLE AS layout_y, (p_partkey % 12)::INT AS cluster FROM part),
memory_concept AS (SELECT DISTINCT l_orderkey AS memory_id, l_partkey AS concept_id FROM lineitem),
pairs_of AS (SELECT a.concept_id AS x, b.concept_id AS y, count(*) AS n FROM memory_concept a JOIN memory_concept b ON a.memory_id = b.memory_id AND a.concept_id < b.concept_id GROUP BY 1, 2 HAVING count(*) >= 2),
relations AS (SELECT source_id, target_id, least(1.0::DOUBLE, n / 5.0::DOUBLE) AS weight, n AS co_occurrence_count,
  ['is_a','contains','uses','related_to'][((source_id + target_id) % 4)::INT + 1] AS relation_type,
  (source_id + target_id) % 4 < 2 AS is_semantic, (source_id + target_id) % 4 = 0 AS is_universal,
  CASE WHEN (source_id + target_id) % 5 = 0 THEN NULL WHEN (source_id + target_id) % 2 = 0 THEN 'domain' ELSE 'world' END AS source_type
  FROM (SELECT x AS source_id, y AS target_id, n FROM pairs_of UNION ALL SELECT y, x, n FROM pairs_of)),
memories AS (SELECT o_orderkey AS id, o_custkey AS doc_id, lower(o_orderpriority) || ' order ' || o_orderkey AS content,
  1.0::DOUBLE + least(9.0::DOUBLE, o_totalprice / 50000.0::DOUBLE) AS importance,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deprioritized' ELSE 'archived' END AS status,
  ['fact','procedure','relationship'][(o_orderkey % 3)::INT + 1] AS memory_type, o_orderdate AS last_accessed, o_orderdate - INTERVAL 30 DAY AS created_at,
  o_orderkey % 7 AS access_count, 1.3::DOUBLE + (o_orderkey % 13) * 0.1::DOUBLE AS strength, 0.5::DOUBLE + (o_orderkey % 5) * 0.1::DOUBLE AS confidence FROM orders),
memory_document AS (SELECT o_orderkey AS memory_id, o_custkey AS doc_id FROM orders),
docs AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS segment FROM customer),
episodes AS (SELECT event_id AS id, user_id, ts AS created_at, event_type AS behavior_name, 'd' || (user_id % 5) AS domain, 1.0::DOUBLE + event_id % 10 AS importance,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 + event_id % 4 ELSE 0 END AS success_count,
  CASE WHEN event_type = 'error' THEN 2::BIGINT ELSE event_id % 2 END AS failure_count FROM events),
episode_concept AS (SELECT event_id AS episode_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS concept_id FROM events)
"""
