"""Feedback as a stream against the same events as a table: repeats, any order, late events, replayed batches."""

from __future__ import annotations

import datetime as dt
import random
import time

import pandas as pd

from loomgraph.sources.store import GraphStore
from loomgraph.streaming import events, feedback

START = dt.datetime(2024, 1, 1)


def made(seed, n, first=0):
    r = random.Random(seed)
    kinds = [("episode", "positive"), ("episode", "negative"), ("memory", "access"), ("memory", None)]
    out = []
    for k in range(first, first + n):
        node, kind = r.choice(kinds)
        out.append((k, node, f"k{r.randrange(5)}", START + dt.timedelta(minutes=r.randrange(50)), kind))
    return out


def add(spark, path, rows):
    spark.createDataFrame(rows, feedback.EVENT).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are taken in the order of their times


def plain(rows, keep):
    once = {e[0]: e for e in rows}.values()
    out = {}
    for _, node, key, ts, kind in once:
        good, bad, times, every = out.setdefault((node, key), ([], [], [], []))
        (good if kind == "positive" else bad if kind == "negative" else times).append(ts)
        every.append(ts)
    return {k: (len(g), len(b), len(t), max(e), sorted(t)[-keep:]) for k, (g, b, t, e) in out.items()}


def shown(rows):
    return {(r["node"], r["id"]): (r["successes"], r["failures"], r["accesses"], r["last"], r["history"]) for r in rows}


def test_stream_same_as_table(spark, tmp_path):
    rows = made(1, 120)
    odd = [(None, "memory", "k1", START, "access"), (900, None, "k1", START, "access"), (901, "memory", None, START, "access"), (902, "memory", "k1", None, "access")]
    path = f"{tmp_path}/in"
    add(spark, path, rows[:60] + rows[:10] + odd)
    add(spark, path, rows[60:] + rows[20:50])
    add(spark, path, rows[:30])
    store = GraphStore(spark, f"file://{tmp_path}/store")
    store.setup()
    apply, seen, batches = feedback.applied(store), {}, []

    def twice(batch, number):
        apply(batch, number)
        apply(batch, number)
        seen.update(shown(batch.collect()))
        batches.append(number)

    events.drain(feedback.tallies(feedback.stream_of(spark, path), "2 hours", keep=7), f"{tmp_path}/state", twice, mode="update")
    wanted = plain(rows, 7)
    assert len(batches) >= 3 and seen == wanted
    assert shown(feedback.tallies(spark.read.schema(feedback.EVENT).parquet(path), keep=7).collect()) == wanted
    kept = {("episode", r["id"]): (r["success_count"], r["failure_count"], r["last_used"]) for r in store.read("episodes").collect()}
    assert kept == {k: (v[0], v[1], v[3]) for k, v in wanted.items() if k[0] == "episode"}
    kept = {("memory", r["id"]): (r["access_count"], r["last_accessed"], r["access_history"]) for r in store.read("memories").collect()}
    assert kept == {k: v[2:] for k, v in wanted.items() if k[0] == "memory"}


def test_late_copies_are_not_counted_again(spark, tmp_path):
    """Two days later the first events are forgotten; copies of them, and new events of that time, are late and dropped."""
    early, later = made(2, 40), [(100 + k, "memory", "k0", START + dt.timedelta(days=2, minutes=k), "access") for k in range(3)]
    last = (200, "memory", "k0", START + dt.timedelta(days=3), "access")
    path = f"{tmp_path}/in"
    for part in (early, later, [last], early[:20] + [(300, "memory", "k0", START, "access"), last]):
        add(spark, path, part)
    seen = {}
    stream = feedback.tallies(feedback.stream_of(spark, path), "1 hour", keep=200)
    events.drain(stream, f"{tmp_path}/state", lambda batch, number: seen.update(shown(batch.collect())), mode="update")
    assert seen == plain([*early, *later, last], 200)
    assert feedback.tallies(spark.createDataFrame([], feedback.EVENT)).count() == 0


def test_calls_to_the_state_do_not_grow_with_the_events():
    calls = []

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("timer")

    tally = feedback._Tally(5)
    tally.init(Handle())
    for ids in (range(50), range(25, 75)):
        frame = pd.DataFrame({"event_id": list(ids), "at": [1000 * k for k in ids], "kind": "access"})
        out = next(tally.handleInputRows(("memory", "a"), iter([frame]), None))
    assert out["accesses"][0] == 75 and out["history"][0] == [1000 * k for k in range(70, 75)]
    assert len(calls) == 6
