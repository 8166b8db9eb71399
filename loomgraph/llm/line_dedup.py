"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line's tokens are the different lower-case words (runs of anything but ASCII
white space) of the line, as hashes of 56 bits, ordered by rarity.  Two lines
match if the Jaccard similarity of their token sets is 0.8 or more.  A line
goes if an earlier line, by (doc_id, line number), matches it, whether that
line stays or not; lines without a word stay.

Rarity is the magnitude of a word's count in all texts.  Counts are held in a
table of at most ``MOST_BUCKETS`` hash buckets, more for larger inputs; words
that share a bucket count together.  Any fixed order gives the same matches; a
better one gives fewer candidates.  The join:

* lines with equal sets are one; the first of them stands for all;
* a match shares a token within the first ``n - ceil(0.8 n) + 1`` (prefix
  filter), has similar size (length filter), has enough tokens left from the
  first shared one on (positional filter), and few bits of its own in a bitmap
  of 128, in which each token turns one bit over;
* words that stand alone in the corpus have no partner and are left out;
* a token of fewer than ``HOT`` occurrences is a key of its own, so a line meets
  fewer than ``HOT`` others there.  Where the first shared token is a more
  frequent one, a match shares a second one within one token more, as frequent
  or more; such pairs of tokens are the keys;
* lines are first held against early lines of two tokens of ``WARM`` or more
  occurrences, or one for each ``WARM_TEXT`` bytes of all texts if that is more
  (the first and the last in the prefix), and the most similar of
  these are verified; then again for all tokens of crowds.  That
  settles groups of like lines without pairing them; what is left meets all
  earlier lines.

Edge cases: null texts have no line.  Rows that share a doc_id share its
ranks: none of their lines with one number is earlier than another, so these
do not remove each other.  Null doc_ids are never removed from and remove
nothing.  An empty table gives no rows.  Two different words of compared lines
count as one with a chance of 2^-56; two rows that share a doc_id and have
different lines of one number are taken for one line with a chance of 2^-32.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, plain, stored

SPACES = "\t\x0b\x0c\r"  # white space inside a line besides the blank
MOST_BUCKETS, BUCKET_TEXT = 1 << 24, 128  # counters, and bytes of text for each while there are fewer
WARM, HOT = 64, 4096  # occurrences of tokens that get representatives, and that make keys in pairs only
WARM_TEXT = 1 << 21  # so that the share of such tokens does not grow with the texts
SALTS, NEAREST = 16, 4  # representatives of a key, and how many of a line's are verified
CROWD_TEXT = 512  # a token is a crowd's if it occurs as often as the root of the number of parts of so many bytes
#: Bytes of keys that may be broadcast, at 32 a line; beyond it they are joined by shuffle.
BROADCAST_BYTES, LINE_BYTES = 64 << 20, 32


def _rank(count: Column | int) -> Column | int:
    """Magnitude in seven bits, about three steps for each doubling; 0 is a single occurrence."""
    if isinstance(count, int):
        return min(127, int(3.2 * np.log2(count)))
    return F.least(F.lit(127), F.floor(3.2 * F.log2(count))).cast("int")


def _broadcast(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() * LINE_BYTES <= BROADCAST_BYTES else rows


def _blanks(lower: str) -> Column:
    """A text with blanks as the only white space in its lines."""
    odd = reduce(or_, [F.contains(F.col(lower), F.lit(c)) for c in SPACES])
    return F.when(odd, F.translate(F.col(lower), SPACES, " " * len(SPACES))).otherwise(F.col(lower))


def _at(line: Column, t: Column) -> Column:
    """Line number and 32 bits of the lower-case line, which tell lines of one number apart."""
    return F.shiftleft(line.cast("bigint"), 32).bitwiseOR(F.xxhash64(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, at and lower-case line t with blanks as its only white space; lines without a word are left out."""
    lower = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.lower(F.col(text)).alias("t"))
    rows = lower.select("doc", F.posexplode(F.split(_blanks("t"), "\n")).alias("line", "t"))
    return rows.where(F.trim("t") != "").select("doc", _at(F.col("line"), F.col("t")).alias("at"), "t")


def _hashes(line: Column) -> Column:
    """The different words of a line, in 64 bits each."""
    words = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))  # one blank: split without a regular expression
    return F.array_remove(words, F.xxhash64(F.lit("")))


def _eight(hashed: Column, buckets: int) -> Column:
    """The place of the long integer that has a hash's bucket: its first bits."""
    return F.shiftrightunsigned(hashed, 67 - (buckets.bit_length() - 1)).cast("int")


def _lane(hashed: Column) -> Column:
    """Bits by which that integer is moved to have the rank in its first byte."""
    return hashed.bitwiseAND(F.lit(56)).cast("int")


def ranks(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int, int, int]:
    """One row with the rank of each bucket, eight in a long integer; the number of buckets; and the occurrences that make a token warm and a crowd's."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = min(MOST_BUCKETS, 1 << max(10, (size // BUCKET_TEXT).bit_length()))
    words = lines(docs, doc_id, text).select(F.explode(F.split("t", " ")).alias("w")).where("w <> ''")
    hashed = F.xxhash64("w")
    bucket = F.shiftleft(_eight(hashed, buckets), 3).bitwiseOR(F.lit(7) - F.shiftright(_lane(hashed), 3))
    counts = words.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # At most MOST_BUCKETS numbers reach the driver, in slices of 1,024 buckets.
    packed = counts.select(F.shiftright("b", 10).alias("slice"), F.shiftleft(F.col("b").bitwiseAND(F.lit(1023)), 7).bitwiseOR(_rank(F.col("n"))).alias("v"))
    table = np.zeros(buckets, np.uint8)
    for row in packed.groupBy("slice").agg(F.collect_list("v").alias("v")).collect():
        v = np.array(row["v"], np.int32)
        table[row["slice"] * 1024 + (v >> 7)] = v & 127
    found = docs.sparkSession.createDataFrame([(table.view("<i8").tolist(),)], "ranks array<bigint>", verifySchema=False)
    crowd = max(WARM, isqrt(size // CROWD_TEXT))
    return stored(found, "ranks"), buckets, min(crowd, max(WARM, size // WARM_TEXT)), crowd


def token_sets(rows: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (doc, at, t) with the sorted tokens s of t: seven bits of rank, 56 of the hash."""

    def ordered(h: Column) -> Column:
        rank = F.call_function("shiftleft", F.get("ranks", _eight(h, buckets)), _lane(h)).bitwiseAND(F.lit(127 << 56))
        return rank.bitwiseOR(F.shiftrightunsigned(h, 8))

    return rows.withColumn("ranks", table.scalar()).select("doc", "at", F.sort_array(F.transform(_hashes(F.col("t")), ordered)).alias("s"))


def _needed(n: Column) -> Column:
    """Tokens of a set of n that any match has."""
    return F.floor((4 * n + 4) / 5).cast("int")


def _prefix(n: Column) -> Column:
    return n - _needed(n) + 1


def _bits(tokens: Column, half: bool) -> Column:
    """A bitmap of 64 bits, of which each token turns one over; ``half``: only tokens of one half do, so both make a bitmap of 128."""

    def turned(bits: Column, x: Column) -> Column:
        own = F.shiftright(x, 6).bitwiseAND(F.lit(1)) if half else F.lit(1).cast("bigint")
        return bits.bitwiseXOR(F.call_function("shiftleft", own, x.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(tokens, F.lit(0).cast("bigint"), turned)


def _prefixed(docs: DataFrame, table: DataFrame, buckets: int, warm: int, crowd: int, doc_id: str, text: str) -> DataFrame:
    """doc, at, row, a, b (the set's hashes), n, bits0, bits1, and of the prefix with one token more: ends of its unique, rare, thin and cold tokens, and the tokens behind the unique ones."""

    def below(count: int) -> Column:
        return F.size(F.filter("p", lambda x: x < (_rank(count) << 56)))

    sets = token_sets(lines(docs, doc_id, text), table, buckets).select("doc", "at", "s", F.size("s").alias("n"))
    # Sets of fewer than four tokens match none but their equals.
    sets = sets.select("doc", "at", "s", "n", F.when(F.col("n") >= 4, F.slice("s", 1, _prefix(F.col("n")) + 1)).alias("p"))
    return sets.select(
        "doc",
        "at",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("s").alias("a"),
        F.xxhash64(F.lit("set"), "s").alias("b"),
        "n",
        *[F.when(F.col("n") >= 4, _bits(F.col("s"), k == 1)).alias(f"bits{k}") for k in (0, 1)],
        below(2).alias("unique"),
        below(warm).alias("rare"),
        below(crowd).alias("thin"),
        below(HOT).alias("cold"),
        # Four bytes of a token do: a clash adds a candidate.
        F.transform(F.filter("p", lambda x: x >= (1 << 56)), lambda x: F.hash(x)).alias("tokens"),
    )


def _keys(sets: DataFrame, columns: list[str]) -> DataFrame:
    """key, i (place of the key's first token) and ``columns`` for all keys of each set."""
    size, prefix = F.size("tokens"), _prefix(F.col("n"))
    own = F.greatest(F.lit(0), F.least(F.col("cold"), prefix) - F.col("unique"))
    singles = sets.where(own > 0).select(F.posexplode(F.slice("tokens", 1, own)).alias("j", "key"), "unique", *columns)
    hot = sets.where((F.col("unique") + size - F.col("cold") >= 2) & (prefix > F.col("cold")))
    hot = hot.select(F.slice("tokens", F.col("cold") - F.col("unique") + 1, size).alias("h"), "cold", prefix.alias("prefix"), *columns)
    hot = hot.select(F.posexplode(F.slice("h", 1, F.col("prefix") - F.col("cold"))).alias("j", "first"), "h", "cold", *columns).where(F.size("h") >= F.col("j") + 2)
    hot = hot.select("first", F.explode(F.slice("h", F.col("j") + 2, F.size("h"))).alias("second"), (F.col("cold") + F.col("j")).alias("i"), *columns)
    return singles.select("key", (F.col("unique") + F.col("j")).alias("i"), *columns).unionByName(hot.select(F.hash("first", "second").alias("key"), "i", *columns))


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c == "key" else side + c) for c in rows.columns])


def _after(a: str, b: str) -> Column:
    """Is the line of side ``a`` later than that of ``b``?"""
    return (F.col(f"{a}doc") > F.col(f"{b}doc")) | ((F.col(f"{a}doc") == F.col(f"{b}doc")) & (F.shiftright(f"{a}at", 32) > F.shiftright(f"{b}at", 32)))


def _apart() -> Column:
    x, y = ([F.col(f"{side}bits{k}") for k in (0, 1)] for side in "xy")
    other = x[1].bitwiseXOR(y[1])
    return F.bit_count(other) + F.bit_count(x[0].bitwiseXOR(y[0]).bitwiseXOR(other))


def _alike(nx: Column, ny: Column) -> Column:
    """Length filter and bitmap filter; J >= 4/5 is 9 * overlap >= 4 * (nx + ny), or at most a ninth of nx + ny tokens in one set alone.

    Each of those accounts for one differing bit at most.
    """
    return (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx) & (9 * _apart() <= nx + ny)


def _verified(pairs: DataFrame, docs: DataFrame, table: DataFrame, buckets: int, doc_id: str, text: str) -> DataFrame:
    """doc, at of the later line of each pair (doc, at, doc0, at0) whose similarity is 0.8 or more, as a table."""
    wanted = stored(pairs.select("doc", "at").unionByName(pairs.select(F.col("doc0").alias("doc"), F.col("at0").alias("at"))).distinct(), "wanted")
    own = docs.join(_broadcast(wanted.select("doc").distinct()), F.col(doc_id).cast("long") == F.col("doc"), "left_semi")
    found = lines(own, doc_id, text).join(_broadcast(wanted), ["doc", "at"], "left_semi")
    sets = every = stored(token_sets(found, table, buckets), "sets")
    if sets.select("doc", "at").distinct().count() < sets.count():  # only rows that share a doc_id need a shuffle of sets
        sets = stored(every.dropDuplicates(["doc", "at"]), "sets")
    first = sets.select(F.col("doc").alias("doc0"), F.col("at").alias("at0"), F.col("s").alias("s0"))
    both = pairs.join(sets, ["doc", "at"]).join(first, ["doc0", "at0"])
    shared = F.size(F.array_intersect("s", "s0"))
    gone = stored(both.where(9 * shared >= 4 * (F.size("s") + F.size("s0"))).select("doc", "at").distinct(), "gone")
    for used in {id(t): t for t in (wanted, every, sets)}.values():
        discard(used)
    return gone


def _nearest(open_: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """doc, at, doc0, at0: for each line of ``open_`` the most similar of some early lines that share a key with it in ``rows``."""
    columns = ["doc", "at", "n", "bits0", "bits1"]
    early = rows.groupBy("key", F.pmod(F.xxhash64("doc", "at", "key", F.lit(seed)), F.lit(SALTS)).alias("salt")).agg(F.min(F.struct(*columns)).alias("y"))
    met = _sided(open_, "x").join(early.select("key", *[F.col(f"y.{c}").alias(f"y{c}") for c in columns]), "key").where(_alike(F.col("xn"), F.col("yn")) & _after("x", "y"))
    near = F.slice(F.sort_array(F.collect_set(F.struct(_apart().alias("apart"), "ydoc", "yat"))), 1, NEAREST)  # of 2 * SALTS lines
    best = met.groupBy(F.col("xdoc").alias("doc"), F.col("xat").alias("at")).agg(near.alias("y")).select("doc", "at", F.explode("y").alias("y"))
    return best.select("doc", "at", F.col("y.ydoc").alias("doc0"), F.col("y.yat").alias("at0"))


def later_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and at (line number and 32 bits of the line) of each line that goes."""
    table, buckets, few, crowd = ranks(docs, doc_id, text)
    placed = stored(_prefixed(docs, table, buckets, few, crowd, doc_id, text), "prefixes")
    # Lines whose set an earlier line has; the others are one for each set.
    first = placed.groupBy("a", "b").agg(F.min(F.struct("doc", "at", "row")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("a", "b", "first")
    again = stored(placed.select("doc", "at", "row", "a", "b").join(stored(first, "firsts"), ["a", "b"]).where("row <> first.row").select("doc", "at", "row", F.col("first.doc").alias("ydoc"), F.col("first.at").alias("yat")), "again")
    sets = placed.where("size(tokens) > 0").join(_broadcast(again.select("row")), "row", "left_anti")
    # Against some early lines of frequent tokens.
    start = F.greatest(F.col("rare"), F.col("unique")) - F.col("unique")
    count = _prefix(F.col("n")) - F.col("unique") - start
    ends = F.array_distinct(F.array(F.get("tokens", start), F.get("tokens", start + count - 1)))
    warm = stored(sets.where(count > 0).select(F.explode(ends).alias("key"), "doc", "at", "n", "bits0", "bits1"), "warm")
    pairs = stored(_nearest(warm, warm, 0), "pairs")
    discard(warm)
    gone = _verified(pairs, docs, table, buckets, doc_id, text)
    # Again, for tokens of crowds and against other early lines, as long as that settles many.
    first_thick = F.greatest(F.col("thin"), F.col("unique"))
    thick = sets.where(_prefix(F.col("n")) > first_thick).select(F.explode(F.slice("tokens", first_thick - F.col("unique") + 1, _prefix(F.col("n")) - first_thick)).alias("key"), "doc", "at", "n", "bits0", "bits1")
    among, seed = stored(thick, "thick"), 1
    while True:
        pairs = stored(_nearest(among.join(_broadcast(gone), ["doc", "at"], "left_anti"), among, seed), "pairs")
        asked = pairs.select("doc", "at").distinct().count()
        more = _verified(pairs, docs, table, buckets, doc_id, text) if asked else pairs.select("doc", "at")
        gone, seed = gone.unionByName(more), seed + 1
        if more.count() * 10 < asked or not asked:
            break
    discard(among)
    # Lines that this leaves, against all earlier lines.  Both sides read one exchange: its input is a table, both use all columns, and no condition is on one side alone, as it would be moved below it.
    settled = _broadcast(gone).select("doc", "at", F.lit(0).alias("open"))
    columns = ["doc", "at", "n", "bits0", "bits1", "open"]
    sets = stored(sets.join(settled, ["doc", "at"], "left").select(*columns[:-1], F.coalesce("open", F.lit(1)).alias("open"), "unique", "cold", "tokens"), "sets")
    # Size, place and openness in one long integer.
    packed = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("bigint"), 1)).bitwiseOR(F.col("open").cast("bigint"))
    keyed = _keys(sets, columns).select("key", "doc", "at", "bits0", "bits1", packed.alias("p"))
    discard(placed)
    # A match is met at the first token that both have; what they share stands from there on.
    (xn, xi, xopen), (yn, yi, yopen) = ((F.shiftright(p, 32), F.shiftright(p.bitwiseAND(F.lit(0xFFFFFFFF)), 1), p.bitwiseAND(F.lit(1))) for p in (F.col("xp"), F.col("yp")))
    wanted = (xopen + yopen > yopen) & (9 * F.least(xn - xi, yn - yi) >= 4 * (xn + yn)) & _alike(xn, yn) & _after("x", "y")
    pairs = _sided(keyed, "x").join(_sided(keyed, "y"), "key").where(wanted).select(F.col("xdoc").alias("doc"), F.col("xat").alias("at"), F.col("ydoc").alias("doc0"), F.col("yat").alias("at0")).distinct()
    pairs = stored(pairs, "pairs")
    discard(sets)
    gone = stored(gone.unionByName(_verified(pairs, docs, table, buckets, doc_id, text)), "gone")
    # From the sets back to all their lines.
    matched = gone.select(F.col("doc").alias("ydoc"), F.col("at").alias("yat"), F.lit(True).alias("matched"))
    renamed = again.select(F.col("doc").alias("xdoc"), F.col("at").alias("xat"), "ydoc", "yat").join(matched, ["ydoc", "yat"], "left")
    return gone.unionByName(renamed.where(F.coalesce("matched", F.lit(False)) | _after("x", "y")).select(F.col("xdoc").alias("doc"), F.col("xat").alias("at"))).distinct()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines that stay, and n_lines_removed (which replaces a column of that name); a text may become empty."""
    rows, names = plain(docs, ("n_lines_removed",))
    found = stored(later_matches(rows, names[doc_id], names[text]), "later")
    gone = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("at").alias("_gone"))  # one document's lines
    if found.count() * LINE_BYTES <= BROADCAST_BYTES:  # texts need not be shuffled
        gone = F.broadcast(gone)
    joined = rows.join(gone, F.col(names[doc_id]).cast("long") == F.col("_doc"), "left")
    joined = joined.withColumn("_lower", F.when(F.col("_gone").isNotNull(), F.lower(names[text])))
    joined = joined.withColumn("_clean", F.split(_blanks("_lower"), "\n")).withColumn("_lines", F.split(names[text], "\n"))
    stays = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: ~F.array_contains("_gone", _at(i, F.get("_clean", i))))
    joined = joined.withColumn("_stays", F.when(F.col("_gone").isNotNull(), stays))
    kept = F.array_join(F.transform("_stays", lambda i: F.get("_lines", i)), "\n")
    new = F.when(F.col("_stays").isNull(), F.col(names[text])).otherwise(kept)
    removed = F.coalesce(F.size("_lines") - F.size("_stays"), F.lit(0)).cast("long")
    return joined.select(*[(new if c == text else F.col(n)).alias(c) for c, n in names.items()], removed.alias("n_lines_removed"))
