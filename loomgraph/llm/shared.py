"""Folders that all executors share, and small helpers for Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, codec: str = "snappy") -> DataFrame:
    """Like ``stored``, laid out so that joins and groups by ``keys`` need no further shuffle."""
    spark = df.sparkSession
    name = f"loomgraph_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{name}"
    df.write.option("path", path).option("compression", codec).bucketBy(int(buckets), *keys).saveAsTable(name)
    return spark.table(name)


def discard(table: DataFrame) -> None:
    """Delete the files of a frame of ``bucketed`` or ``stored`` from which all results have been written."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that this worker process has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def plain(docs: DataFrame, added: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns _c0, _c1, ... that clash with nothing, and these names by the old ones; columns named as ``added`` go."""
    names = {c: f"_c{k}" for k, c in enumerate(c for c in docs.columns if c not in added)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without gaps, and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
