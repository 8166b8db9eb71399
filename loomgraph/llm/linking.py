"""Connected components and all-pairs work inside clusters, without a hot task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Members of a cluster that stand in one tile side.
CHUNK = 128


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, for nodes a, b of ``edges`` (long).

    Every node takes its smallest neighbour as parent, parents are followed to
    the trees' roots, trees become nodes, and so on until no edge is left.
    Each round is written to the shared folder.  Self-loops are left out, so a
    node without another neighbour has no row.
    """
    left = stored(_tidy(edges), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        parent = stored(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = stored(parent.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "parents")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        of_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = stored(_tidy(left.join(of_b, "b").join(of_a, "a", "left").select(F.coalesce("ra", "a").alias("a"), F.col("rb").alias("b"))), "edges")
        if found is None:
            found = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = found.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(parent)
            found = stored(found.groupBy("node").agg(F.min("root").alias("root")), "roots")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select("root").distinct().select(F.col("root").alias("node"), "root")
    return found.unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def tiles(members: DataFrame, cluster: str, member: str, chunk: int = CHUNK) -> DataFrame:
    """``members`` with low, high and side: a cluster is cut into chunks, and each pair of chunks is a tile.

    Any two members of a cluster meet in exactly one tile: in (c, c) if they
    share chunk c, else with one of them on side 0 and the other on side 1.
    """
    sizes = members.groupBy(F.col(cluster).alias("_c")).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_n"))
    joined = members.join(sizes, members[cluster] == sizes["_c"]).drop("_c")
    joined = joined.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    joined = joined.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    joined = joined.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other")).withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    return joined.drop("_own", "_other", "_n")


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of each group; many groups share a Python call chain, as most hold two or three rows.

    The groups must be bounded, as those of ``tiles`` are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        out: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [0]
            if batch.num_rows > 1:
                change = np.zeros(batch.num_rows - 1, bool)
                for k in keys:
                    column = batch.column(k).to_numpy(zero_copy_only=False)
                    change |= column[1:] != column[:-1]
                edges += (np.flatnonzero(change) + 1).tolist()
            edges.append(batch.num_rows)
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if rest and a == 0 and any(rest[-1].column(k)[-1] != part.column(k)[0] for k in keys) or rest and a > 0:
                    if (made := work(pa.Table.from_batches(rest))) is not None:
                        out.append(made)
                    rest = []
                rest.append(part)
            if len(out) >= 256:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if rest and (made := work(pa.Table.from_batches(rest))) is not None:
            out.append(made)
        if out and (table := pa.Table.from_batches(out).combine_chunks()).num_rows:
            yield table.to_batches()[0]

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each row reaches."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(reach, root[None, :], n).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def count_links(side: np.ndarray, within: bool, linked: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> pa.RecordBatch | None:
    """Rows (member, links, root) of a tile from its matrix of links; ``links`` weighs each partner by its copies."""
    linked = linked & (~np.eye(len(ids), dtype=bool) if within else side[:, None] != side[None, :])
    links = linked @ copies
    some = np.flatnonzero(links)
    if not len(some):
        return None
    order = np.argsort(ids, kind="stable")
    roots = np.empty(len(ids), np.int64)
    roots[order] = ids[order][local_roots(linked[np.ix_(order, order)])]
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(roots[some])], ["member", "links", "root"])


LINK_SCHEMA = "member long, links long, root long"
