"""Quality rules: a threshold table compiled into one native projection.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  All signals are Column expressions;
nothing leaves the JVM.

Edge cases: a null or empty text has no words, so every count is 0 and
``base_failed`` is true.  Repeated rows are judged alike.  Input columns with
the names of the signals are not read; ``quality_signals`` works on the text
alone and puts its own columns behind the ones asked for in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the languages that the corpus holds.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der die ein eine es für im ist mit nicht sich sie und von zu "
    "con del el está las los no para pero por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= ratio <= high``; a null bound is open."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


#: Ratios are compared by multiplication, so no division by zero can occur.
DEFAULT_RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def quality_signals(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (all long).

    A word is repeated if a window of three words that holds it occurs twice
    or more in the text.  Windows are compared by a 64-bit hash of their words.
    """
    kept = [f"_k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # Each later step refers to an array twice or more, so that Catalyst keeps it as a column instead of evaluating it in a lambda.
    step = base.select(
        *kept,
        F.array_remove(F.split("_t", SPACE + "+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_l"),
        (F.char_length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    step = step.select(
        *kept,
        "word_chars",
        "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform(
            F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
        ).alias("_g"),
    )
    fixed = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop_words"]
    step = step.select(
        *kept,
        *fixed,
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    same = lambda a, b: F.coalesce(F.get("_s", a)["h"] == F.get("_s", b)["h"], F.lit(False))
    step = step.select(
        *kept,
        *fixed,
        F.sort_array(F.transform(F.filter("_s", lambda x, j: same(j, j - 1) | same(j, j + 1)), lambda x: x["i"])).alias("_p"),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    # Catalyst would push filters on the signals below the arrays and evaluate these in the lambdas above, once for each
    # word; it does not push any through a projection that is not deterministic.  This zero is one in name only.
    none = F.floor(F.rand(0)).cast("long")
    return step.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *fixed, F.coalesce(covered, none).alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compile_rules(rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """One boolean over the signals: no rule of the table is broken."""
    verdict = F.lit(True)
    for rule in rules:
        top, bottom = F.col(rule.top), F.col(rule.bottom)
        if rule.low is not None:
            verdict &= top >= rule.low * bottom
        if rule.high is not None:
            verdict &= top <= rule.high * bottom
    return verdict


def judge(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Signals with ``base_failed`` and ``kept`` for each row."""
    return quality_signals(docs, text, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, in one projection and filter (no join)."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    judged = judge(plain, names[docs.columns.index(text)], names, rules).where("kept")
    return judged.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


ORACLE_CTE = """
q_words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM {table}),
q_at AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q_words)),
q_twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM q_at) WHERE n > 1),
q_repeat AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_twice) GROUP BY doc_id),
q_signals AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_words LEFT JOIN q_repeat USING (doc_id)),
q_judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_signals),
q_rules AS (
  SELECT *, NOT base_failed AND {verdict} AS kept FROM q_judged)
"""


def oracle_cte(table: str = "documents", rules: Sequence[Rule] = DEFAULT_RULES) -> str:
    """The same as common table expressions; ``q_rules`` has the result.  doc_id must be unique."""
    tests = [f"{r.top} >= {r.low} * {r.bottom}" for r in rules if r.low is not None] + [f"{r.top} <= {r.high} * {r.bottom}" for r in rules if r.high is not None]
    return ORACLE_CTE.format(table=table, stops=", ".join(f"'{w}'" for w in STOP_WORDS), verdict=" AND ".join(tests) or "true")
