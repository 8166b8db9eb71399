"""Source divergence audit: how far the sources of a language are apart, and by which terms.

Every language keeps the V terms that ``min_docs`` or more of its documents
hold.  A group is a (language, source) that occurs; a term with count c has
there p = 1 + floor(SCALE * (c + 2) / (N + 2V)), N being the sum of the group's
counts.  The value of two shares p, q is f = floor((p - q)^2 / (p + q)), and two
groups are as far apart as the sum of f over all V terms.  All of it is exact
integer arithmetic.

The sum is not taken over V terms.  A pair starts at V times the f of two zero
counts; what differs from that comes from postings alone:

* terms of one of the two sources: f depends only on the count and on the other
  group's share of a zero, so a histogram of counts by group is enough;
* terms of both: postings of one term meet in a tile of ``TILE`` x ``TILE``
  sources and a slice of the terms.  A task adds its corrections up and emits
  one number for each pair that has any, so pairs are never rows by term.

Counting needs one shuffle, of what each task has already added up.  No group,
term or language is held whole by one task: tiles and slices bound what meets.

Edge cases: null text, language and source count as ''.  A group without terms
still has its pairs.  V = 0 gives values of 0 and no terms.  Repeated rows count
as documents of their own.  Other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks, release, stored, utf8
from .words import ASCII_LOWER, byte_class, word_spans

SCALE = 1_000_000_000
TILE = 256
SLICE_ROWS = 50_000
#: Tables of groups up to this size are broadcast.
BROADCAST_BYTES = 32 << 20
_HELD_ROWS = 1 << 19
_BLOCK = 4 << 20
_LETTER = byte_class((0x61, 0x7A), (0x80, 0xFF))
_NAMES = ["lang", "source", "term", "c", "d"]


def _tally(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, occurrences, documents; a row with a null term for each group."""
    data, offsets = utf8(batch.column("text"))
    data = ASCII_LOWER[data]
    begin, end, text = word_spans(data, offsets, _LETTER)
    letters = np.ascontiguousarray(data[_LETTER[data]])
    at = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
    code, terms = np.asarray(words.indices).astype(np.int64), words.dictionary
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group = np.asarray(lang.indices).astype(np.int64) * max(len(source.dictionary), 1) + np.asarray(source.indices)
    span = max(len(terms), 1)
    in_doc, tf = np.unique(text * span + code, return_counts=True)
    key, which = np.unique(group[in_doc // span] * span + in_doc % span, return_inverse=True)
    c = np.zeros(len(key), np.int64)
    np.add.at(c, which, tf)
    d = np.bincount(which, minlength=len(key))
    groups = np.unique(group)
    of = np.concatenate([key // span, groups])
    columns = [
        lang.dictionary.take(pa.array(of // max(len(source.dictionary), 1))),
        source.dictionary.take(pa.array(of % max(len(source.dictionary), 1))),
        pa.concat_arrays([terms.take(pa.array(key % span)).cast(pa.string()), pa.nulls(len(groups), pa.string())]),
        pa.array(np.concatenate([c, np.zeros(len(groups), np.int64)])),
        pa.array(np.concatenate([d, np.zeros(len(groups), np.int64)])),
    ]
    return pa.table(columns, names=_NAMES)


def _added(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(_NAMES[:3]).aggregate([("c", "sum"), ("d", "sum")])
    return found.select(["lang", "source", "term", "c_sum", "d_sum"]).rename_columns(_NAMES)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallies of a task, added up as long as they fit in ``_HELD_ROWS``."""
    held: list[pa.Table] = []
    for batch in blocks(batches, "text", _BLOCK):
        held.append(_tally(batch))
        if sum(t.num_rows for t in held) > _HELD_ROWS:
            held = [_added(held)]
            if held[0].num_rows > _HELD_ROWS // 2:
                yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held:
        yield from _added(held).to_batches(max_chunksize=1 << 16)
    held.clear()
    release()


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exact beyond 64 bits."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(2)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _both(tile: int):
    def run(table: pa.Table) -> pa.Table:
        """Corrections of a tile for terms that two sources share: one row for each pair with any."""
        first = lambda name: table.column(name)[0].as_py()
        low, high = first("low") * tile, first("high") * tile
        term = np.asarray(table.column("term").combine_chunks().dictionary_encode().indices).astype(np.int64)
        number, p, zero = (np.array(table.column(n)) for n in ("number", "p", "p0"))
        order = np.lexsort((number, term))
        term, number, p, zero = term[order], number[order], p[order], zero[order]
        total = np.zeros((tile, tile), np.int64)
        # Each posting of the lower block meets the later postings of its term, those of the upper block alone.
        asks = np.flatnonzero(number < low + tile)
        stop = np.searchsorted(term, term[asks], "right")
        start = np.maximum(asks + 1, np.searchsorted(term * (1 << 32) + number, term[asks] * (1 << 32) + high))
        count = np.maximum(stop - start, 0)
        ends = np.cumsum(count)
        at = 0
        while at < len(asks):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            n = count[at:to]
            a = np.repeat(asks[at:to], n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:to], n)
            value = _f(p[a], p[b]) - _f(p[a], zero[b]) - _f(zero[a], p[b]) + _f(zero[a], zero[b])
            np.add.at(total, (number[a] - low, number[b] - high), value)
            at = to
        a, b = np.nonzero(total)
        return pa.table({"lang": pa.array([first("lang")] * len(a), pa.string()), "a": pa.array(a + low, pa.int64()), "b": pa.array(b + high, pa.int64()), "value": pa.array(total[a, b])})

    return run


def _small(df: DataFrame, rows: int, bytes_a_row: int = 200) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top_terms: int = 10, tile: int = TILE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: see the module.

    Part ``pair``: every other source of the language with its distance.  Part
    ``term``: the ``top_terms`` terms that lift the source most above its language.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    by_term = Window.partitionBy("lang", "term")
    tallies = texts.mapInArrow(_tallies, "lang string, source string, term string, c long, d long")
    # One exchange by language and term serves the sums, the documents of a term and its count in the language.
    counts = tallies.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    counts = counts.select("lang", "source", "term", "c", F.sum("d").over(by_term).alias("docs"), F.sum("c").over(by_term).alias("all_c"), (F.col("source") == F.min("source").over(by_term)).alias("head"))
    postings = stored(counts.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"), "postings")

    has = F.col("term").isNotNull()
    groups = postings.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("term").alias("terms"), F.count_if(has & F.col("head")).alias("heads"))
    in_lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", "n", F.sum("heads").over(in_lang).alias("v"), F.sum("n").over(in_lang).alias("lang_n"), F.sum("terms").over(in_lang).alias("lang_terms"),
        (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long").alias("number"), F.count("*").over(in_lang).alias("sources"),
    )
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n") + 2 * F.col("v"))))
    groups = stored(groups.select("*", F.floor(F.col("number") / tile).cast("int").alias("tile"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles")), "groups")
    n_groups = groups.count()

    known = postings.where(has).join(_small(groups, n_groups), ["lang", "source"])
    shares = known.withColumn("p", _share(F.col("c"), F.col("n") + 2 * F.col("v")))

    # Pairs of groups, a before b: the higher tile is looked up by its number, so that no key holds a whole language.
    later = groups.select("lang", F.col("tile").alias("at"), F.col("number").alias("b"), F.col("p0").alias("q0"))
    of_pair = lambda df: df.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(_small(later, n_groups), ["lang", "at"]).where("number <> b")
    base = of_pair(groups.select("lang", "number", "p0", "v", "tiles")).where("number < b")
    base = base.select("lang", F.col("number").alias("a"), "b", (F.col("v") * F.coalesce(_apart(F.col("p0"), F.col("q0")), F.lit(0))).alias("value"))
    histogram = shares.groupBy("lang", "number", "p", "p0", "tiles").agg(F.count("*").alias("times"))
    one = of_pair(histogram).withColumn("value", F.col("times") * (_apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q0")))).where("value <> 0")
    one = one.select("lang", F.least("number", "b").alias("a"), F.greatest("number", "b").alias("b"), "value")
    mine, other = F.col("tile"), F.col("other")
    tiled = shares.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    slices = F.ceil(F.col("lang_terms") / slice_rows).cast("long")
    tiled = tiled.select("lang", F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"), F.pmod(F.xxhash64("term"), slices).alias("slice"), "term", "number", "p", "p0")
    both = tiled.groupBy("lang", "low", "high", "slice").applyInArrow(_both(tile), "lang string, a long, b long, value long")
    pairs = base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    named = groups.select("lang", "number", "source")
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("z"))
    pairs = pairs.select("lang", "value", "z.x", "z.y")
    pairs = pairs.join(_small(named.withColumnRenamed("number", "x"), n_groups), ["lang", "x"])
    pairs = pairs.join(_small(named.select("lang", F.col("number").alias("y"), F.col("source").alias("item")), n_groups), ["lang", "y"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))

    q = _share(F.col("all_c"), F.col("lang_n") + 2 * F.col("v"))
    terms = shares.withColumn("q", q).where((F.col("p") > F.col("q")) & (F.col("c") > 0))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)


ORACLE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT row_number() OVER () AS id, * FROM d), t AS (SELECT id, lang, source, unnest(w) AS term FROM n),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL), l AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL), m AS (SELECT lang, sum(c) AS n FROM l GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.c + 2)) // (m.n + 2 * v.v) AS q FROM l JOIN m USING (lang) JOIN v USING (lang)),
z AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p > q),
o AS (SELECT * FROM y UNION ALL SELECT * FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
