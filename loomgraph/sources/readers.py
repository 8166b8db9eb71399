"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_markdown, doc_type, page_fields, strip_page_fields, title_of
from ..schema import conform, schema_of


def directory(spark: SparkSession, path: str, glob: str = "*.{md,txt,markdown}") -> DataFrame:
    """One document for each file below ``path``; unreadable files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").load(path)
    return documents(files.select(F.col("path").alias("source_path"), F.col("content").cast("string").alias("raw")))


def documents(rows: DataFrame) -> DataFrame:
    """Documents from source_path and raw text, and a title if there is a column of that name; the hash is that of the raw text."""
    kind = doc_type(F.col("source_path"))
    content = F.when(kind == "markdown", clean_markdown(F.col("raw"))).otherwise(F.trim("raw"))
    stem = F.regexp_extract("source_path", r"([^/]+?)(\.[^./]+)?$", 1)
    out = rows.withColumn("doc_type", kind).withColumn("content", content)
    told = F.col("title") if "title" in rows.columns else F.lit(None).cast("string")
    out = out.withColumn("title", F.coalesce(told, F.when(kind == "markdown", title_of(F.col("raw"))).otherwise(stem))).withColumn("source_hash", F.sha2("raw", 256))
    return out.select(F.sha2(F.concat_ws("|", "source_path", "source_hash"), 256).alias("id"), "title", "content", "doc_type", "source_path", "source_hash", F.lit("pending").alias("status"))


def exported_pages(rows: DataFrame) -> DataFrame:
    """Pages (id, raw) of a wiki export: title, url, path and text without the header."""
    return rows.withColumn("_p", page_fields(F.col("raw"))).select("id", "_p.title", "_p.url", "_p.path", strip_page_fields(F.col("raw")).alias("content"))


def evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, url; semicolons if the first line has one, a byte order mark and Russian headers are allowed."""
    first = spark.read.text(path).first()
    separator = ";" if first is not None and ";" in first[0] else ","
    rows = spark.read.csv(path, sep=separator, header=True, multiLine=True, quote='"', escape='"')
    names = {c.replace("\ufeff", "").strip().lower(): c for c in rows.columns}

    def pick(*options: str):
        found = [F.col(f"`{names[o]}`") for o in options if o in names]
        return F.trim(F.coalesce(*found, F.lit("")))

    out = rows.select(pick("question", "вопрос").alias("question"), pick("answer", "ответ").alias("answer"), pick("url", "ссылка", "источник").alias("url"))
    return out.where("question <> ''")


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    schema = "query string, relevant_chunk_ids array<string>, notes string, tags array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return rows.select("query", F.coalesce("relevant_chunk_ids", none).alias("relevant_chunk_ids"), F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("tags", none).alias("tags"))


def write_results(results: DataFrame, path: str, kept: int = 20) -> None:
    """JSON, with the first ``kept`` retrieved ids of each query."""
    results.withColumn("retrieved_ids", F.slice("retrieved_ids", 1, kept)).write.mode("overwrite").json(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    flat = [F.concat_ws(";", c).alias(c) if t.startswith("array") else F.col(c) for c, t in results.dtypes]
    results.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON row beside the results."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row; times as ISO texts, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(texts: DataFrame, table: str, text: str = "json") -> DataFrame:
    """Rows of ``table`` from JSON texts, defaults filled in."""
    rows = texts.select(F.from_json(text, schema_of(table)).alias("r")).select("r.*")
    return conform(rows, table)


def stable_id(prefix: str, *columns: str) -> Column:
    """An id that follows from the row, so that a repeated run gives the same."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256))
