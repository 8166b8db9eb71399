"""From raw documents to packed sequences: five stages over ``documents``.

Each stage takes all rows that the one before kept.  Its result is written as
Parquet to the shared folder and read again, so a lost executor costs one
stage at most.  All stages but the last return the columns of ``documents``;
``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from loomgraph.llm.shared import stored


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document may be left with an empty text."""
    return _recounted(line_dedup.dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds go."""
    return _recounted(suffix_dedup.remove_from_text(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens."""
    # The worker processes also hold what earlier stages left them, so fewer words are kept than when packing runs alone.
    return packing.pack(docs, packing.default_tokenizer(), cached_words=300_000)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", substrings),
    ("best_fit_packing", packed),
]

#: SQL has no tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
