"""Rows that share an id and differ, in any order of rows: nothing is lost, and rows stay apart."""

from __future__ import annotations

import pytest

from loomgraph.llm import embedding_dedup, line_dedup, ngram_join, substring_dedup, suffix_dedup

A, B = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
ROWS = [(1, A), (1, B), (2, A + " z"), (3, B + " z"), (4, "another text of its own")]


@pytest.fixture(params=["forth", "back"])
def table(spark, request):
    return spark.createDataFrame(ROWS if request.param == "forth" else ROWS[::-1], "doc_id long, text string")


def test_lines(table):
    got = {(r["doc_id"], r["text"], r["n_lines_removed"]) for r in line_dedup.dedup(table).collect()}
    assert got == {(1, A, 0), (1, B, 0), (2, "", 1), (3, "", 1), (4, ROWS[4][1], 0)}


def test_lines_of_one_place(spark):
    """Of two rows with one id, only that whose line an earlier document has loses it."""
    rows = [(0, A), (1, A + "\n" + B), (1, B + "\nan ending")]
    for r in (rows, rows[::-1]):
        got = {(x["doc_id"], x["text"]) for x in line_dedup.dedup(spark.createDataFrame(r, "doc_id long, text string")).collect()}
        # B stands at line 0 and at line 1 of document 1; the later of the two goes.
        assert got == {(0, A), (1, ""), (1, B + "\nan ending")}


def test_ngrams(table):
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(table).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


def test_ngrams_keep_first(spark):
    """Document 5 has two texts, of which one is a copy of another document's."""
    rows = [(1, A), (5, A), (5, B)]
    kept = {tuple(r) for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {(1, A), (5, B)}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.0, 0.0, 1.0])]
    for r in (rows, rows[::-1]):
        got = sorted((q["vec_id"], q["n_links"], q["component_id"]) for q in embedding_dedup.link(spark.createDataFrame(r, "vec_id long, embedding array<double>")).collect())
        assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [1.0, 0.1 * k], 7, "x") for k in range(4)]
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, member int, unit string")).collect()
    assert sorted((q["vec_id"], q["n_links"]) for q in got) == [(0, 3), (1, 3), (2, 3), (3, 3)]


def test_units(table):
    got = {(r["doc_id"], r["text"]) for r in substring_dedup.dedup(table, min_words=20).collect()}
    assert got == set(ROWS)  # no unit recurs, as the lines differ by a word


def test_units_of_one_id(spark):
    rows = [(0, A), (5, A), (5, B)]
    got = {(r["doc_id"], r["text"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, A), (5, ""), (5, B)}


def test_suffixes(table):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove(table).collect())
    assert got == sorted((i, len(t), 0 if i in (1, 4) else len(t) - 2) for i, t in ROWS)


