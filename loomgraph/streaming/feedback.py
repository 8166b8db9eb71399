"""Feedback and accesses applied to the store as they arrive, each once.

Events (event_id, node, id, ts, kind) say what happened to an episode or a memory:
``positive`` and ``negative`` are feedback, every other kind is an access.  A key's
state is its totals, a list of its last access times, and the events counted so
far.  An event is remembered until the watermark passes its time; after that
Spark drops every copy of it as late.  So deliveries may repeat and come in any
order within the watermark, and the state does not grow with the stream.

The totals that come out are absolute.  Writing a batch twice changes nothing, so
``applied`` may be replayed after a failure, and each batch is one commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import GraphStore

#: An event's columns; rows that lack id, node, event_id or ts count nothing.
EVENT = "event_id bigint, node string, id string, ts timestamp, kind string"
KEY = ["node", "id"]
_OUT = "node string, id string, successes bigint, failures bigint, accesses bigint, last bigint, history array<bigint>"
_STATE = "successes bigint, failures bigint, accesses bigint, last bigint, history array<bigint>, ids array<bigint>, times array<bigint>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Tally(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, as each call to a state is a message: a key costs as many in a batch whatever its events.
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        good, bad, used, last, times, ids, ats = self.state.get() or (0, 0, 0, 0, [], [], [])
        before = good + bad + used
        times, ids, ats, seen = list(times), list(ids), list(ats), set(ids)
        fresh: list[int] = []
        for frame in rows:
            for event, at, kind in zip(frame["event_id"], frame["at"], frame["kind"], strict=True):
                if event in seen:
                    continue
                seen.add(event)
                ids.append(int(event))
                ats.append(int(at))
                fresh.append(int(at))
                last = max(last, int(at)) if before or len(fresh) > 1 else int(at)
                if kind == "positive":
                    good += 1
                elif kind == "negative":
                    bad += 1
                else:
                    used += 1
                    times.append(int(at))
            times = sorted(times)[-self.keep :]
        if not fresh:
            return
        self.handle.registerTimer(max(fresh) // 1000 + 1)
        self.state.update((good, bad, used, last, times, ids, ats))
        yield pd.DataFrame({"node": [key[0]], "id": [key[1]], "successes": [good], "failures": [bad], "accesses": [used], "last": [last], "history": [times]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Forget the events that no copy can come of any more."""
        mark = timerValues.getCurrentWatermarkInMs()
        found = self.state.get()
        if found:
            *totals, ids, ats = found
            kept = [(event, at) for event, at in zip(ids, ats, strict=True) if at // 1000 >= mark]
            if len(kept) < len(ids):
                self.state.update((*totals, [k[0] for k in kept], [k[1] for k in kept]))
        return iter([])

    def close(self) -> None:
        pass


def _whole(events: DataFrame) -> DataFrame:
    known = events.where("event_id IS NOT NULL AND node IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL")
    return known.select("event_id", "node", F.col("id").cast("string").alias("id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("kind", F.lit("access")).alias("kind"))


def tallies(events: DataFrame, within: str = "1 hour", keep: int = 100) -> DataFrame:
    """node, id, successes, failures, accesses, last, history (the last ``keep`` accesses, in order).

    On a table, one row of each key; on a stream, the new totals of each key that a
    batch has changed.  Copies of an event count once: on a table the earliest.
    """
    rows = _whole(events)
    if rows.isStreaming:
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # keeps lists, maps and timers
        out = rows.withWatermark("ts", within).groupBy(*KEY).transformWithStateInPandas(_Tally(keep), _OUT, "Update", "EventTime")
        return out.withColumn("last", F.timestamp_micros("last")).withColumn("history", F.transform("history", lambda t: F.timestamp_micros(t)))
    once = rows.groupBy(*KEY, "event_id").agg(F.min(F.struct("ts", "kind")).alias("e")).select(*KEY, "event_id", "e.*")
    is_access = ~F.col("kind").isin("positive", "negative")
    place = F.row_number().over(Window.partitionBy(*KEY, is_access).orderBy(F.desc("ts"), "event_id"))
    kept = F.when(is_access & (F.col("place") <= keep), F.col("ts"))
    counts = [F.count_if(c).alias(n) for c, n in ((F.col("kind") == "positive", "successes"), (F.col("kind") == "negative", "failures"), (is_access, "accesses"))]
    return once.withColumn("place", place).groupBy(*KEY).agg(*counts, F.max("ts").alias("last"), F.array_sort(F.collect_list(kept)).alias("history"))


def applied(store: GraphStore) -> Callable[[DataFrame, int], None]:
    """What ``drain`` calls with each batch of ``tallies``: episodes get their feedback and memories their accesses, in one commit."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            own = store.begin()
            own.save("episodes", rows.where("node = 'episode'").selectExpr("id", "int(successes) AS success_count", "int(failures) AS failure_count", "last AS last_used"))
            own.save("memories", rows.where("node = 'memory'").selectExpr("id", "accesses AS access_count", "last AS last_accessed", "history AS access_history"))
            own.commit()
        finally:
            rows.unpersist()

    return apply


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
