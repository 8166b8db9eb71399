"""The graph as Parquet tables of layers, under one commit log.

A write adds a layer: the rows that it brings or takes away, dealt into buckets
by a hash of the key.  Readers merge layers, newest first, so an upsert costs
what its rows weigh, not what the table does.  ``compact`` makes one layer of
many.

A commit is a file of the log with the next number.  It names the layers of all
tables, so several tables change at once or not at all, a reader sees one state,
and to roll back is to commit an old state anew.  Creating that file is the one
step that can be won or lost: a writer that comes second takes up the new state
and puts its own layers on top, or fails with ``Conflict`` if the tables that it
replaces or has read have changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import KEYS, TABLES, conform, schema_of
from ..session import written
from .log import CommitLog, Conflict


def last_wins(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``; without one, the greatest by all other columns, as rows have no order of their own."""
    if set(rows.columns) == set(keys):
        return rows.distinct()
    others = [c for c in rows.columns if c not in keys and not rows.schema[c].dataType.typeName() == "map"]
    newest = Window.partitionBy(*keys).orderBy(*([F.desc_nulls_last(order)] if order else []), *[F.desc_nulls_last(c) for c in others or keys])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces the rows of ``old`` with the same key; columns that ``new`` lacks keep their values."""
    new = last_wins(new, keys)
    if set(new.columns) >= set(old.columns):
        return old.join(new, keys, "left_anti").unionByName(new.select(*old.columns))
    mine = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_new"), F.lit(True).alias("_hit"))
    merged = old.join(mine, keys, "full")
    return merged.select(*[F.col(c) if c in keys or c not in new.columns else F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def only_linked(links: DataFrame, left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """Links whose ends both exist."""
    a, b = links.columns[:2]
    ends = links.join(left.select(F.col(left_id).alias(a)), a, "left_semi").join(right.select(F.col(right_id).alias(b)), b, "left_semi")
    return ends.select(*links.columns)


#: Tables that the ends of links are found in.
ENDS = {"relations": ("concepts", "concepts"), "memory_concept": ("memories", "concepts"), "memory_document": ("memories", "documents"), "episode_concept": ("episodes", "concepts"), "episode_memory": ("episodes", "memories")}
BUCKETS = 8
BUCKET_BYTES = 128 << 20
#: Rows of a save for which there is a bucket, and a task that writes it.
BUCKET_ROWS = 1 << 20
#: A table with more layers than this is compacted by the next save.
MOST_LAYERS = 12
_ATTEMPTS = 20
State = dict[str, list[dict]]


def _layer_schema(table: str) -> T.StructType:
    return T.StructType([*schema_of(table).fields, T.StructField("_gone", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass
class Transaction:
    """Changes of several tables that become visible together; reads see what it has written."""

    store: GraphStore
    number: int
    base: State
    state: State
    added: dict[str, list[dict]] = field(default_factory=dict)
    replaced: set[str] = field(default_factory=set)
    used: set[str] = field(default_factory=set)

    def read(self, table: str) -> DataFrame:
        self.used.add(table)
        return self.store._merged(table, self.state[table])

    def _layer(self, table: str, rows: DataFrame, buckets: int = BUCKETS) -> dict:
        """Write ``rows`` (the columns of the table and _gone) as a layer."""
        path = f"data/{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", _bucket(KEYS[table], buckets)).repartition(2 * buckets, "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.store.root}/{path}")
        return {"path": path, "buckets": buckets}

    def _add(self, table: str, layer: dict) -> None:
        self.state[table] = [*self.state[table], layer]
        self.added.setdefault(table, []).append(layer)

    def write(self, table: str, rows: DataFrame) -> None:
        """``rows`` take the place of the table."""
        layer = self._layer(table, conform(rows, table).withColumn("_gone", F.lit(False)))
        self.replaced.add(table)
        self.added[table], self.state[table] = [layer], [layer]

    def save(self, table: str, rows: DataFrame) -> None:
        """Upsert.  Missing columns keep their values, rows that change nothing are not written, links need both ends."""
        keys = KEYS[table]
        if table in ENDS:
            for key, end in zip(keys, ENDS[table], strict=True):
                rows = rows.join(self.read(end).select(F.col("id").alias(key)), key, "left_semi")
        given = [c for c in rows.columns if c in schema_of(table).names]
        new = written(last_wins(rows.select(*given), keys), f"new-{table}")
        buckets = max(BUCKETS, -(-new.count() // BUCKET_ROWS))  # counted from the files' footers
        if self.state[table]:
            wanted = new.select(*keys)
            old = self.store._merged(table, self.state[table], wanted)
            kept = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
            both = new.join(kept, keys, "left")
            filled = both.select(*given, *[F.col(f"_old.{c}").alias(c) for c in old.columns if c not in given], "_old")
            names = [c for c in old.columns if c not in keys]
            changed = conform(filled, table, ("_old",)).where(F.col("_old").isNull() | ~F.struct(*names).eqNullSafe(F.col("_old")))
            out = changed.drop("_old")
        else:
            out = conform(new, table)
        self._add(table, self._layer(table, out.withColumn("_gone", F.lit(False)), buckets))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows that match ``keys`` on all of its columns go."""
        old = self.store._merged(table, self.state[table])
        gone = old.join(keys.distinct(), keys.columns, "left_semi").select(*old.columns)
        self._add(table, self._layer(table, gone.withColumn("_gone", F.lit(True))))

    def clear(self) -> None:
        for table in self.state:
            self.replaced.add(table)
            self.added[table], self.state[table] = [], []

    def commit(self) -> int:
        """The number of the commit.  Layers on top of tables that others have changed stay; what was replaced or read must not have changed."""
        for _ in range(_ATTEMPTS):
            if self.store.log.create(self.number + 1, self.state):
                self.number += 1
                return self.number
            self.number, latest = self.store.latest()
            for table in self.replaced | self.used:
                if latest[table] != self.base[table]:
                    raise Conflict(f"another writer has changed {table}")
            self.base = latest
            self.state = {t: self.added.get(t, []) if t in self.replaced else [*latest[t], *self.added.get(t, [])] for t in latest}
        raise Conflict("too many writers")


class GraphStore:
    """Named tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_log")

    def _state(self, number: int) -> State:
        found = self.log.read(number)
        return {table: found.get(table, []) for table in TABLES}

    def latest(self) -> tuple[int, State]:
        number = self.log.last()
        return number, self._state(number)

    # Layers.

    def _rows(self, table: str, layer: dict, keys: DataFrame | None = None) -> DataFrame:
        """One layer, or what it holds of ``keys``, read from their buckets alone if these are few."""
        rows = self.spark.read.schema(_layer_schema(table)).parquet(f"{self.root}/{layer['path']}")
        if keys is not None:
            rows = rows.withColumn("_b", F.col("_bucket"))
            asked = keys.select(*keys.columns, _bucket(KEYS[table], layer["buckets"]).alias("_b"))
            rows = rows.join(asked, [*keys.columns, "_b"], "left_semi").drop("_b")
        return rows.drop("_bucket")

    def _merged(self, table: str, layers: Sequence[dict], keys: DataFrame | None = None) -> DataFrame:
        """Rows of all layers, the newest of each key; with ``keys`` (the key columns) those alone."""
        columns, names = KEYS[table], schema_of(table).names
        if not layers:
            return self.spark.createDataFrame([], schema_of(table))
        newest: DataFrame | None = None
        for number, layer in enumerate(layers[1:], 1):
            rows = self._rows(table, layer, keys).withColumn("_layer", F.lit(number))
            newest = rows if newest is None else newest.unionByName(rows)
        first = self._rows(table, layers[0], keys)
        if newest is None:
            return first.where("NOT _gone").select(*names)
        rest = [c for c in newest.columns if c not in columns and c != "_layer"]
        last = newest.groupBy(*columns).agg(F.max_by(F.struct(*rest), "_layer").alias("_row")).select(*columns, "_row.*")
        # Layers on top are small beside the first, so Spark can broadcast their keys and leave it unshuffled.
        return first.join(last.select(*columns), columns, "left_anti").unionByName(last.select(*first.columns)).where("NOT _gone").select(*names)

    # What users call.

    def setup(self) -> None:
        """Empty tables where there are none."""
        if not self.log.numbers():
            self.log.create(0, {table: [] for table in TABLES})

    def exists(self, table: str) -> bool:
        return table in TABLES and bool(self.log.numbers())

    def version(self) -> int:
        return self.latest()[0]

    def begin(self) -> Transaction:
        number, state = self.latest()
        return Transaction(self, number, state, dict(state))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._merged(table, (self._state(version) if version is not None else self.latest()[1])[table])

    def _retried(self, change) -> int:
        """Begin anew as often as others have changed what the change has read."""
        for attempt in range(_ATTEMPTS):
            own = self.begin()
            change(own)
            try:
                return own.commit()
            except Conflict:
                if attempt == _ATTEMPTS - 1:
                    raise
        raise AssertionError

    def write(self, table: str, rows: DataFrame) -> int:
        """``rows`` take the place of the table; ``Conflict`` if another writer changes it meanwhile."""
        own = self.begin()
        own.write(table, rows)
        return own.commit()

    def save(self, table: str, rows: DataFrame) -> int:
        """Upsert of nodes or links in a commit of its own."""
        number = self._retried(lambda own: own.save(table, rows))
        return self.compact(table) if len(self._state(number)[table]) > MOST_LAYERS else number

    def delete(self, table: str, keys: DataFrame) -> int:
        return self._retried(lambda own: own.delete(table, keys))

    def compact(self, table: str) -> int:
        """One layer without what is gone, in buckets by its size; if others change the table meanwhile, nothing is done."""
        own = self.begin()
        size = 0
        for layer in own.state[table]:
            at, files = self.log.files(f"{self.root}/{layer['path']}")
            size += files.getContentSummary(at).getLength()
        layer = own._layer(table, own.read(table).withColumn("_gone", F.lit(False)), max(BUCKETS, -(-size // BUCKET_BYTES)))
        own.replaced.add(table)
        own.added[table], own.state[table] = [layer], [layer]
        try:
            return own.commit()
        except Conflict:
            return self.version()

    def vacuum(self, keep: int = 100) -> int:
        """Delete layers that none of the last ``keep`` commits names, and older commits; how many layers went.  No writer may be at work."""
        commits = self.log.numbers()
        named = {layer["path"] for n in commits[-keep:] for layers in self._state(n).values() for layer in layers}
        gone = 0
        for table in TABLES:
            at, files = self.log.files(f"{self.root}/data/{table}")
            for x in files.listStatus(at) if files.exists(at) else []:
                if f"data/{table}/{x.getPath().getName()}" not in named:
                    gone += bool(files.delete(x.getPath(), True))
        for n in commits[:-keep]:
            self.log.remove(n)
        return gone

    def get(self, table: str, ids: list[str]) -> DataFrame:
        """Rows by id, whatever their status, read from the buckets of these ids."""
        return self._merged(table, self.latest()[1][table], self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string"))

    def delete_episode(self, episode_id: str) -> bool:
        """The episode and its edges, in one commit; False if there is none."""
        gone = self.spark.createDataFrame([(episode_id,)], "id string")
        found = not self.get("episodes", [episode_id]).isEmpty()

        def change(own: Transaction) -> None:
            own.delete("episodes", gone)
            for table in ("episode_concept", "episode_memory", "episode_crystallized"):
                own.delete(table, gone.withColumnRenamed("id", "episode_id"))

        if found:
            self._retried(change)
        return found

    def pending_documents(self, limit: int = 100) -> DataFrame:
        return self.read("documents").where("status = 'pending'").orderBy("created_at", "id").limit(limit)

    def clear(self) -> None:
        own = self.begin()
        own.clear()
        own.commit()

    def backup(self) -> int:
        """The number of the present state; nothing is copied, as layers never change."""
        return self.version()

    def rollback(self, version: int) -> int:
        """Lossless and for all tables at once: the state of ``version`` is committed anew."""
        number, _ = self.latest()
        state = self._state(version)
        while not self.log.create(number + 1, state):
            number, _ = self.latest()
        return number + 1

    def query(self, sql: str, **args: object) -> DataFrame:
        """SQL with named parameters over the tables as views, all of one state."""
        number, _ = self.latest()
        for table in TABLES:
            self.read(table, number).createOrReplaceTempView(table)
        return self.spark.sql(sql, args=args)
