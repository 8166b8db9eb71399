"""Stems of Russian words by the published suffix-stripping rules.

The rules are an ordered list of rewritings, so that they run as native
expressions, one replacement a step, and as SQL alike.  An ending counts only
after the word's first vowel (region RV), a derivational one only in region R2.
Of the endings of one step the longest counts.  A step that has done its work
leaves a mark at the end, which keeps the other endings of the group from
matching.  Words without a Russian vowel stay as they are.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The endings of the published algorithm.  Those of a group named
# AFTER_A count after "а" or "я" only, which stay.
GERUND = "ив ивши ившись ыв ывши ывшись".split()
GERUND_AFTER_A = "в вши вшись".split()
REFLEXIVE = "ся сь".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = "ивш ывш ующ".split()
PARTICIPLE_AFTER_A = "ем нн вш ющ щ".split()
VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
VERB_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE = "ейш ейше".split()
DERIVATIONAL = "ост ость".split()

VOWELS = "аеиоуыэюя"
MARK = "\u0001"
_RV = f"[^{VOWELS}]*[{VOWELS}].*?"
_R2 = f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]+[{VOWELS}]+[^{VOWELS}].*?"


def _any(endings: list[str]) -> str:
    return f"(?:{'|'.join(endings)})"


def _group(free: list[str], after_a: list[str], then: str = "") -> str:
    return f"^({_RV}){_any(free)}{then}$|^({_RV}[ая]){_any(after_a)}{then}$"


#: Pattern, and how many of its groups are kept; the mark follows them if the third value says so.
STEPS: list[tuple[str, int, bool]] = [
    (_group(GERUND, GERUND_AFTER_A), 2, True),
    (f"^({_RV}){_any(REFLEXIVE)}$", 1, False),
    (f"{_group(PARTICIPLE, PARTICIPLE_AFTER_A, _any(ADJECTIVE))}|^({_RV}){_any(ADJECTIVE)}$", 3, True),
    (_group(VERB, VERB_AFTER_A), 2, True),
    (f"^({_RV}){_any(NOUN)}$", 1, True),
    (f"^(.*){MARK}$", 1, False),
    (f"^({_RV})и$", 1, False),
    (f"^({_R2}){_any(DERIVATIONAL)}$", 1, False),
    (f"^({_RV}){_any(SUPERLATIVE)}$", 1, True),
    (f"^({_RV}н)н{MARK}?$", 1, True),
    (f"^({_RV})ь$", 1, False),
    (f"^(.*){MARK}$", 1, False),
]


def stem(word: Column) -> Column:
    """The stem of a word in lower case; null gives null."""
    word = F.translate(word, "ё", "е")
    for pattern, groups, marked in STEPS:
        word = F.regexp_replace(word, pattern, "".join(f"${k + 1}" for k in range(groups)) + (MARK if marked else ""))
    return word


def stem_all(words: pa.Array) -> pa.Array:
    """The same for an array of words."""
    words = pc.replace_substring(words.cast(pa.string()), "ё", "е")
    for pattern, groups, marked in STEPS:
        words = pc.replace_substring_regex(words, pattern, "".join(f"\\{k + 1}" for k in range(groups)) + (MARK if marked else ""))
    return words


@F.arrow_udf(ArrayType(StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """The stems of lists of words; of the words of a batch each different one is cut once."""
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    different = tokens.flatten().dictionary_encode()
    found = stem_all(different.dictionary).take(different.indices)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0)
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
    return pa.ListArray.from_arrays(ends, found, mask=pc.is_null(tokens))


def stem_sql(word: str) -> str:
    """The same as an expression of DuckDB over the expression ``word``."""
    word = f"translate({word}, 'ё', 'е')"
    for pattern, groups, marked in STEPS:
        word = f"regexp_replace({word}, '{pattern}', '" + "".join(f"\\{k + 1}" for k in range(groups)) + f"{MARK if marked else ''}')"
    return word
