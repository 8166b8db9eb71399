"""Substring dedup by hashing lines, sentences and paragraphs.

A text is cut into pieces at line breaks and behind ``.``, ``!`` or ``?`` with
a blank.  A unit is a run of pieces that begins with any piece that has a word
and is as short as it can be with at least ``min_words`` words: a long line or
sentence alone, else a paragraph of several.  So units overlap, and a passage
is met wherever it begins.  A unit is normalised (lower case, white space as
one blank, ends stripped) and digested to 128 bits.  The earliest unit of each
digest by (doc_id, piece number) stays; what later ones cover goes.

Words are runs of anything but ASCII white space.  Runs of fewer than
``MIN_WORDS`` words recur in unrelated texts (license and boilerplate lines) and
stay; ``min_words=1`` removes every repeated piece.

Edge cases: null texts have no unit.  A unit that recurs in its own document
goes too; of a text that repeats one piece, the first stays.  Rows that share a
doc_id share a rank, so their equal units at one place both stay; rows are told
apart by their text.  Null doc_ids come last, and share a rank.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .shared import blocks, plain, stored

MIN_WORDS = 20
#: Spans that may be broadcast; beyond it texts and spans meet by a shuffle.
BROADCAST_SPANS = 1_000_000
UNIT_SCHEMA = "digest binary, doc_id long, tag long, unit long, start long, stop long"
_SENTENCE = re.compile(r"([.!?]) ")


def pieces(text: str) -> list[str]:
    """Parts of a text, each followed by one character that separates it from the next."""
    return _SENTENCE.sub("\\1\x01", text).replace("\n", "\x01").split("\x01")


def runs(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Number of the first piece, start, stop (in characters) and normalised bytes of each unit."""
    parts, places, at = [], [], 0
    for number, piece in enumerate(pieces(text)):
        if words := piece.lower().encode("utf-8", "surrogatepass").split():
            parts.append(words)
            places.append((number, at, at + len(piece)))
        at += len(piece) + 1
    end = size = 0
    for first, words in enumerate(parts):
        while size < min_words and end < len(parts):
            size += len(parts[end])
            end += 1
        if size < min_words:
            return
        yield places[first][0], places[first][1], places[end - 1][2], b" ".join(w for part in parts[first:end] for w in part)
        size -= len(words)


def _tag(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Digest and place (in characters, stop exclusive) of each unit; tag is a hash of the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            rows: list[list] = [[] for _ in range(6)]
            for key, tag, value in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                for number, start, stop, normal in runs(value or "", min_words):
                    for column, x in zip(rows, (blake2b(normal, digest_size=16).digest(), key, tag, number, start, stop), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, [pa.binary(), *[pa.int64()] * 5], strict=True)], ["digest", "doc_id", "tag", "unit", "start", "stop"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _tag(text).alias("tag"), F.col(text).alias("text")).mapInArrow(cut, UNIT_SCHEMA)


def duplicates(found: DataFrame) -> DataFrame:
    """Units that go, with the doc_id and start of the unit that stays.

    The first of each digest is aggregated before the shuffle and written, so
    that the join back stands between two exchanges, and AQE splits a digest
    that many units share.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "unit")
    place = F.struct(rank.alias("rank"), "start")
    first = stored(found.groupBy("digest").agg(F.min(place).alias("first"), F.max(rank).alias("last")).where("first.rank < last").select("digest", "first"), "firsts")
    later = found.join(first, "digest").where(rank > F.col("first.rank"))
    return later.select("doc_id", "tag", "unit", "start", "stop", F.col("first.rank.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def remove(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that stays and n_removed, n_chars_removed, removed (start and stop of each longest run in the text as it was).

    These replace columns of the same names.
    """
    rows, names = plain(docs, ("n_removed", "n_chars_removed", "removed"))
    spans = stored(gone.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_gone")), "spans")  # one document's units
    size = spans.agg(F.sum(F.size("_gone"))).first()[0] or 0
    rows = rows.withColumn("_own", _tag(names[text]))
    joined = rows.join(F.broadcast(spans) if size <= BROADCAST_SPANS else spans, F.col(names[doc_id]).cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tag")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, merged = [], []
            for value, found in zip(batch.column(names[text]).to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                done: list[dict] = []
                for x in found or ():
                    if done and x["start"] <= done[-1]["stop"]:
                        done[-1]["stop"] = max(done[-1]["stop"], x["stop"])
                    else:
                        done.append(dict(x))
                if done:
                    edges = [0, *(e for x in done for e in (x["start"], x["stop"])), len(value)]
                    value = "".join(value[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                texts.append(value)
                merged.append(done)
            columns = [pa.array(texts, pa.string()) if n == names[text] else batch.column(n) for n in names.values()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], [*names.values(), "_removed"])

    schema = StructType([StructField(n, docs.schema[c].dataType) for c, n in names.items()]).add("_removed", ArrayType(StructType().add("start", "long").add("stop", "long")))
    out = joined.select(*names.values(), "_gone").mapInArrow(cut, schema)
    chars = F.aggregate("_removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], F.size("_removed").cast("long").alias("n_removed"), chars.alias("n_chars_removed"), F.col("_removed").alias("removed"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Remove repeated units; the digests are written once to the shared folder."""
    found = stored(units(docs, doc_id, text, min_words), "units")
    return remove(docs, duplicates(found), doc_id, text)
