"""Structured Streaming forms of triggers, sessions, counters and ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def importance_windows(events: DataFrame, threshold: float = 150.0) -> DataFrame:
    """Sum of importance in each day, moved by an hour; the same on a stream and a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", "1 hour")
    sums = events.groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.sum(1.0 + F.col("event_id") % 10).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "n", (F.col("total") >= threshold).alias("due"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", "1 hour")
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total_value"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total_value")


def feedback_counters(events: DataFrame) -> DataFrame:
    """Running success and failure counts by behaviour; update or complete mode on a stream."""
    good = F.col("event_type").isin("purchase", "signup")
    return events.groupBy("event_type").agg(F.count_if(good).alias("successes"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count(F.lit(1)).alias("n"))


def fresh_documents(docs: DataFrame, text: str = "text", within: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Documents whose content was not seen within the watermark."""
    hashed = docs.withColumn("source_hash", F.sha2(text, 256))
    return hashed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["source_hash"]) if docs.isStreaming else hashed.dropDuplicates(["source_hash"])


def drain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run until what is there now has been processed; ``apply`` gets each batch and its number, and must bear repeats."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
    return query


def access_history(accesses: DataFrame, keep: int = 100) -> DataFrame:
    """id and its last ``keep`` access times in order, of (id, ts); on a stream the state is the list, and every batch gives the changed ids."""
    if not accesses.isStreaming:
        newest = Window.partitionBy("id").orderBy(F.desc("ts"))
        kept = accesses.select("id", "ts").distinct().withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
        return kept.groupBy("id").agg(F.array_sort(F.collect_list("ts")).alias("history"))
    kind = accesses.schema["id"].dataType.simpleString()

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        for frame in frames:
            seen |= {int(t.value // 1000) for t in frame["ts"]}
        last = sorted(seen)[-keep:]
        state.update((last,))
        yield pd.DataFrame({"id": [key[0]], "history": [last]})

    changed = accesses.select("id", "ts").groupBy("id").applyInPandasWithState(update, f"id {kind}, history array<bigint>", "history array<bigint>", "update", "NoTimeout")
    return changed.select("id", F.transform("history", lambda t: F.timestamp_micros(t)).alias("history"))
