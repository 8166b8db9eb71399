"""Near-duplicate vectors by NN-descent over a neighbour graph.

Equal vectors are one class.  Neighbour lists of ``NEIGHBOURS`` classes start
from buckets of random hyperplanes and are refined by joining neighbours of
neighbours until hardly an entry at the threshold is new.  List entries at the
threshold make clusters.  A list whose last entry is still at the threshold is
saturated and may hide links, so the search is repeated with lists of classes
outside the own cluster, which joins clusters, until no list is saturated.  All
pairs of a cluster are compared in double precision, tile by tile, and only
counted.  An audit compares a sample of vectors with all others and averages
the share of links found over vectors, those with few links also on their own;
if either is under ``TARGET_RECALL`` the search goes on with twice the buckets,
and if the last attempt fails, all pairs are compared.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and neither do rows with a null vec_id.  Vectors
of different lengths never link.  Repeated vectors link with each other, and
different vectors may share a vec_id.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import CHUNK, LINK_SCHEMA, by_group, components, count_links, tiles
from .shared import stored

THRESHOLD = 0.9
NEIGHBOURS, TABLES, MOST_TABLES = 8, 12, 256
MISSED = 0.01  # share of pairs at the threshold that no table puts in one bucket
FINE = 16  # more signs, which subdivide hot buckets
FEW = 0.01  # share of new entries at the threshold that ends the rounds
BUCKET = 24  # members that a bucket holds on average
REVERSE = 64  # reverse neighbours that meet in one local join
AUDITED, TARGET_RECALL, ATTEMPTS = 2_000, 0.99, 3
SLACK = 1e-4  # lists are made in single precision
BLOCK, ROWS = 8_192, 512  # sides of the matrices that compare all pairs

NEAR_SCHEMA = "member long, ids array<long>, sims array<float>"


def cleaned(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, digest and unit vector (doubles); both null if the vector can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, units = [], []
            for x in batch.column("x").to_pylist():
                v = np.array(x if x is not None and None not in x else [], float) + 0.0  # no minus zero
                length = np.sqrt(v @ v) if len(v) and np.isfinite(v).all() else 0.0
                good = bool(length) and np.isfinite(length)
                digests.append(blake2b(v.tobytes(), digest_size=16).digest() if good else None)
                units.append((v / length).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "digest", "unit"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).mapInArrow(run, "vec_id long, digest binary, unit binary")


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), float).reshape(len(parts), -1)


def _top(table: pa.Table) -> pa.RecordBatch | None:
    """Each member's nearest others outside its cluster among all given ones."""
    n = table.num_rows
    ids, clusters = table["member"].to_numpy(), table["cluster"].to_numpy()
    if n < 2 or (clusters == clusters[0]).all():
        return None
    x = _vectors(table["unit"]).astype(np.float32)
    sims = x @ x.T
    sims[clusters[:, None] == clusters[None, :]] = -2
    count = min(NEIGHBOURS, n - 1)
    best = np.argpartition(-sims, count - 1, axis=1)[:, :count]
    near = np.take_along_axis(sims, best, 1)
    other = near > -1.5
    offsets = pa.array(np.concatenate([[0], np.cumsum(other.sum(1))]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(a[other], k)) for a, k in ((ids[best], pa.int64()), (near, pa.float32()))]
    return pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["member", "ids", "sims"])


def _merge(table: pa.Table) -> pa.RecordBatch:
    best: dict[int, float] = {}
    for ids, sims in zip(table["ids"].to_pylist(), table["sims"].to_pylist(), strict=True):
        for i, s in zip(ids, sims, strict=True):
            best[i] = max(s, best.get(i, -2.0))
    top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:NEIGHBOURS]
    return pa.RecordBatch.from_arrays([table["member"].combine_chunks()[:1], pa.array([[i for i, _ in top]], pa.list_(pa.int64())), pa.array([[s for _, s in top]], pa.list_(pa.float32()))], ["member", "ids", "sims"])


def _bits(count: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, count / BUCKET)))))


def _tables(count: int, threshold: float) -> int:
    """Tables of which one puts a pair at the threshold in one bucket, up to a share of MISSED."""
    apart = 1 - (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** _bits(count)
    wanted = np.ceil(np.log(MISSED) / np.log(apart)) if apart > 0 else TABLES
    return int(np.clip(wanted, TABLES, MOST_TABLES))


def _buckets(classes: DataFrame, count: int, tables: int, seed: int) -> DataFrame:
    """table, bucket, fine and member; a bucket's number holds the signs of random projections, fine those of FINE more."""
    bits = _bits(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            units, members = batch.column("unit").to_pylist(), batch.column("member").to_numpy()
            sizes = np.array([len(u) // 8 for u in units])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * (bits + FINE)))
                signs = np.frombuffer(b"".join(units[i] for i in own), float).reshape(len(own), -1) @ planes[size] > 0
                signs = signs.reshape(len(own), tables, bits + FINE)
                numbers = signs[:, :, :bits] @ (1 << np.arange(bits, dtype=np.int64)) + (int(size) << 44)
                fine = (signs[:, :, bits:] @ (1 << np.arange(FINE, dtype=np.int64))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(numbers.ravel()), pa.array(fine.ravel()), pa.array(np.repeat(members[own], tables))], ["table", "bucket", "fine", "member"])

    return classes.select("member", "unit").mapInArrow(run, "table int, bucket long, fine int, member long")


def _started(classes: DataFrame, count: int, tables: int, seed: int) -> DataFrame:
    """Lists from buckets; a hot bucket is subdivided by more signs, so that close pairs stay together, and what is still hot is dealt into chunks."""
    rows = stored(_buckets(classes, count, tables, seed), "buckets")
    chunks = F.ceil(F.count(F.lit(1)) / CHUNK).cast("int")
    hot = rows.groupBy("table", "bucket").agg(chunks.alias("n")).where("n > 1")
    rows = rows.join(hot, ["table", "bucket"], "left").withColumn("part", F.when(F.col("n") > 1, F.pmod("fine", F.pow(F.lit(2), F.least(F.ceil(F.log2("n")), F.lit(FINE))).cast("int"))).otherwise(0)).drop("n", "fine")
    still = rows.groupBy("table", "bucket", "part").agg(chunks.alias("n")).where("n > 1")
    rows = rows.join(still, ["table", "bucket", "part"], "left").withColumn("chunk", F.when(F.col("n") > 1, F.pmod(F.xxhash64("member", "table"), F.col("n"))).otherwise(0).cast("int"))
    rows = rows.join(classes.select("member", "cluster", "unit"), "member").drop("n")
    return by_group(rows, ["table", "bucket", "part", "chunk"], _top, NEAR_SCHEMA)


def _refined(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """One local join: the neighbours of each class, and the classes that it neighbours, are compared with each other."""
    links = stored(lists.select(F.col("member").alias("center"), F.explode("ids").alias("member")), "neighbours")
    back = links.select(F.col("member").alias("center"), F.col("center").alias("member"))
    chunks = back.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / REVERSE).cast("int").alias("n"))
    back = back.join(chunks, "center").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("n")).cast("int")).drop("n")
    forth = links.join(chunks, "center", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
    met = forth.select("center", "chunk", "member").unionByName(back.select("center", "chunk", "member")).distinct()
    met = met.join(classes.select("member", "cluster", "unit"), "member")
    found = by_group(met, ["center", "chunk"], _top, NEAR_SCHEMA)
    return by_group(found.unionByName(lists), ["member"], _merge, NEAR_SCHEMA)


def _verify(threshold: float):
    def work(table: pa.Table) -> pa.RecordBatch | None:
        x = _vectors(table["unit"])
        return count_links(table["side"].to_numpy(), table["low"][0] == table["high"][0], x @ x.T >= threshold, table["member"].to_numpy(), table["copies"].to_numpy())

    return work


def _exact(classes: DataFrame, count: int, threshold: float) -> DataFrame:
    """The links of all pairs: each block of classes is sent to all others; row counts grow with the classes, comparisons with their square."""
    parts = max(1, -(-count // BLOCK))
    found: DataFrame | None = None
    for part in range(parts):
        block = classes.where(F.pmod(F.xxhash64("member", F.lit("block")), F.lit(parts)) == part).select("member", "copies", "unit").collect()  # about BLOCK rows
        sides = {}
        for size in {len(r["unit"]) for r in block}:
            own = [r for r in block if len(r["unit"]) == size]
            sides[size // 8] = np.array([r["member"] for r in own]), np.array([r["copies"] for r in own]), np.frombuffer(b"".join(r["unit"] for r in own), float).reshape(len(own), -1)
        shared = classes.sparkSession.sparkContext.broadcast(sides)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                members, units = batch.column("member").to_numpy(), batch.column("unit").to_pylist()
                sizes = np.array([len(u) // 8 for u in units])
                for size in np.unique(sizes):
                    every = np.flatnonzero(sizes == size)
                    if size not in shared.value:
                        continue
                    ids, copies, vectors = shared.value[size]
                    for at in range(0, len(every), ROWS):
                        own = every[at : at + ROWS]
                        hit = np.frombuffer(b"".join(units[i] for i in own), float).reshape(len(own), -1) @ vectors.T >= threshold
                        hit &= members[own][:, None] != ids[None, :]
                        links = hit @ copies
                        rows, columns = np.flatnonzero(links), np.flatnonzero(hit.any(0))
                        if not len(rows):
                            continue
                        hit = hit[np.ix_(rows, columns)]
                        a, b = members[own][rows], ids[columns]
                        top = np.iinfo(np.int64).max
                        left, right = a, b
                        while True:  # the smallest member that each one reaches here
                            new = np.minimum(left, np.where(hit, right[None, :], top).min(1))
                            right = np.minimum(right, np.where(hit, new[:, None], top).min(0))
                            if (new == left).all():
                                break
                            left = new
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([links[rows], np.zeros(len(b), np.int64)])), pa.array(np.concatenate([left, right]))], ["member", "links", "root"])

        linked = stored(classes.select("member", "unit").mapInArrow(run, LINK_SCHEMA), "links")
        shared.destroy()
        found = linked if found is None else found.unionByName(linked)
    return found


def _audit(classes: DataFrame, counts: DataFrame, count: int, threshold: float) -> float:
    """Share of a sampled class's links, found by comparing it with all classes, that the search has found.

    The mean over sampled classes that have links, or over those of few links if that is less.
    """
    sample = classes.where(F.pmod(F.xxhash64("member", F.lit("audit")), F.lit(1_000_000)) < max(1, AUDITED * 1_000_000 // count)).select("member", "unit").collect()  # AUDITED rows
    if not sample:
        return 1.0
    sides = {}
    for size in {len(r["unit"]) for r in sample}:
        own = [r for r in sample if len(r["unit"]) == size]
        sides[size // 8] = np.array([r["member"] for r in own]), np.frombuffer(b"".join(r["unit"] for r in own), float).reshape(len(own), -1)
    shared = classes.sparkSession.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {size: np.zeros(len(ids), np.int64) for size, (ids, _) in shared.value.items()}
        for batch in batches:
            members, copies, units = batch.column("member").to_numpy(), batch.column("copies").to_numpy(), batch.column("unit").to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            for size, (ids, vectors) in shared.value.items():
                every = np.flatnonzero(sizes == size)
                for at in range(0, len(every), ROWS):
                    own = every[at : at + ROWS]
                    hit = np.frombuffer(b"".join(units[i] for i in own), float).reshape(len(own), -1) @ vectors.T >= threshold
                    totals[size] += copies[own] @ (hit & (members[own][:, None] != ids[None, :]))
        for size, (ids, _) in shared.value.items():
            some = totals[size] > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(totals[size][some])], ["member", "links"])

    truth = classes.mapInArrow(run, "member long, links long").groupBy("member").agg(F.sum("links").alias("truth"))
    each = truth.join(counts, "member", "left").select("truth", (F.least("truth", F.coalesce("links", F.lit(0))) / F.col("truth")).alias("share"))
    row = each.agg(F.avg("share").alias("all"), F.avg(F.when(F.col("truth") <= NEIGHBOURS, F.col("share"))).alias("few")).first()
    return min((x for x in row if x is not None), default=1.0)


def _hits(lists: DataFrame, threshold: float) -> DataFrame:
    """Ends a, b of the list entries at the threshold."""
    entries = lists.select("member", F.explode(F.arrays_zip("ids", "sims")).alias("e")).where(F.col("e.sims") >= threshold - SLACK)
    return entries.select(F.col("member").alias("a"), F.col("e.ids").alias("b"))


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links (other vectors linked), component_id (smallest vec_id reached by links) for each row."""
    rows = stored(cleaned(vectors, vec_id, embedding), "vectors")
    usable = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL")
    # A class has a number of its own, as different vectors may share a vec_id.
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    classes = stored(classes.withColumn("member", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    owners = classes.select("member", F.col("member").alias("cluster"))
    edges: DataFrame | None = None
    tables, seed, failed = _tables(max(1, count), threshold), 0, 0
    while True:
        placed = stored(classes.select("member", "unit").join(owners, "member"), "placed")
        near = stored(by_group(_started(placed, max(1, count), tables, seed), ["member"], _merge, NEAR_SCHEMA), "lists")
        before = _hits(near, threshold).count()
        while True:
            near = stored(_refined(near, placed), "lists")
            after = _hits(near, threshold).count()
            if after <= before * (1 + FEW):
                break
            before = after
        fresh = _hits(near, threshold)
        edges = stored(fresh if edges is None else edges.unionByName(fresh), "edges")
        clusters = stored(components(edges).select(F.col("node").alias("member"), F.col("root").alias("cluster")), "clusters")
        owners = classes.select("member").join(clusters, "member", "left").select("member", F.coalesce("cluster", "member").alias("cluster"))
        seed += 1
        if not near.where((F.size("ids") >= NEIGHBOURS) & (F.array_min("sims") >= threshold - SLACK)).isEmpty():
            continue  # saturated lists; every such search joins clusters
        cut = tiles(clusters.join(classes, "member").select("cluster", "member", "copies", "unit"), "cluster", "member")
        linked = stored(by_group(cut.select("cluster", "low", "high", "side", "member", "copies", "unit"), ["cluster", "low", "high"], _verify(threshold), LINK_SCHEMA), "links")
        counts = stored(linked.groupBy("member").agg(F.sum("links").alias("links")), "counts")
        if _audit(classes, counts, max(1, count), threshold) >= TARGET_RECALL:
            break
        failed += 1
        if failed == ATTEMPTS:
            linked = _exact(classes, count, threshold)
            counts = stored(linked.groupBy("member").agg(F.sum("links").alias("links")), "counts")
            break
        tables *= 2
    roots = components(linked.select(F.col("member").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    known = classes.select("digest", "member", "copies", "least").join(roots, "member", "left").join(counts, "member", "left")
    known = stored(known.select("digest", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")), "known")
    smallest = known.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(smallest, "root", "left").select("digest", F.coalesce("component", "least").alias("component"), "n")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
