"""Fill-in-middle transformation: each Arrow batch is a DuckDB view, and SQL does the rest.

A text is cut into units, which together are the text.  Two numbers drawn from
a hash of the seed and the id say where the middle begins and ends; two more
say whether the text is changed at all, and in which order the parts go:

* ``plain``: the text as it is;
* ``psm``: prefix mark, prefix, suffix mark, suffix, middle mark, middle;
* ``spm``: suffix mark, suffix, prefix mark, prefix, middle mark, middle.

There is no shuffle, and Python sees no single row.  A worker holds one slice
of a batch (about ``SLICE_BYTES`` of text, or one longer text) and its units.

Edge cases: a null text counts as empty, and an empty text stays plain, as does
one that holds a mark.  A null id is drawn as an empty string.  Rows with one id
are cut alike; repeated rows stay.  Other columns of the input are not read, so
their names cannot clash.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks

SLICE_BYTES = 4 << 20
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Marks:
    """Marks of the parts.  All begin with one character that stands nowhere else in them, so no mark can arise where parts meet."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        heads = {m[:1] for m in marks}
        if len(heads) != 1 or "" in heads or any(m[0] in m[1:] for m in marks) or any(a is not b and b.startswith(a) for a in marks for b in marks):
            raise ValueError(f"marks must share a first character that they hold once, and none may begin another: {marks}")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(table: str, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Marks = Marks(), unit: str = UNIT, with_text: bool = True) -> str:  # noqa: B008
    """DuckDB SQL over ``table`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 [, output]."""
    p, s, m = map(_quoted, (marks.prefix, marks.suffix, marks.middle))
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_quoted(unit)}) AS u,
         sha256({_quoted(f"{seed}:")} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {table}),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, {number(0)} % (len(u) + 1) AS x, {number(1)} % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR {number(2)} % 100 >= {int(percent)} THEN 'plain'
              WHEN {number(3)} % 100 < {int(spm_percent)} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (
  SELECT doc_id, t, n, form,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, CAST(least(x, y) AS BIGINT)), '') END AS a,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, CAST(least(x, y) AS BIGINT) + 1, CAST(greatest(x, y) AS BIGINT)), '') END AS b,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, CAST(greatest(x, y) AS BIGINT) + 1, n), '') END AS c FROM drawn),
put AS (
  SELECT doc_id, n, form, CAST(length(a) AS BIGINT) AS prefix_chars, CAST(length(b) AS BIGINT) AS middle_chars,
         CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || a || {s} || c || {m} || b ELSE {s} || c || {p} || a || {m} || b END AS output FROM parts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN substr(split_part(output, {s}, 1), {len(marks.prefix) + 1}) || split_part(output, {m}, 2) || split_part(split_part(output, {s}, 2), {m}, 1)
              ELSE split_part(split_part(output, {p}, 2), {m}, 1) || split_part(output, {m}, 2) || substr(split_part(output, {p}, 1), {len(marks.suffix) + 1}) END) AS restored_sha256{", output" if with_text else ""}
FROM put"""


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Marks = Marks(), unit: str = UNIT, with_text: bool = True  # noqa: B008
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256 [, output] for each row.

    ``percent`` of the texts are cut, of which ``spm_percent`` put the suffix
    first.  ``restored_sha256`` is the hash of the text rebuilt from output and form.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * with_text
    sql = transform_sql("batch", seed, percent, spm_percent, marks, unit, with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as connection:
            for batch in blocks(batches, "text", SLICE_BYTES):
                connection.register("batch", pa.Table.from_batches([batch]))
                found = connection.sql(sql).to_arrow_table()
                connection.unregister("batch")
                yield from found.select(names).to_batches()

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_text
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:  # noqa: B008
    """The text behind an output of ``transform``, as a native expression."""
    p, s, m = marks.prefix, marks.suffix, marks.middle
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substr(body, F.lit(len(marks.prefix) + 1)), s, 1), middle, F.substring_index(body, s, -1))
    spm = F.concat(F.substring_index(body, p, -1), middle, F.substring_index(F.substr(body, F.lit(len(marks.suffix) + 1)), p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


#: The contract in SQL of another build: parts are joined by position, and the text is rebuilt from them.
ORACLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS i, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS j, t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 50 AS plain FROM k),
l AS (SELECT doc_id, t, n, plain, h4 % 100 < 80 AS spm, list_sum(list_transform(u[:i], lambda x: length(x))) AS a, list_sum(list_transform(u[:j], lambda x: length(x))) AS b FROM c),
p AS (SELECT doc_id, t, n, plain, spm, coalesce(a, 0)::BIGINT AS a, coalesce(b, 0)::BIGINT AS b FROM l),
o AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM p)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
