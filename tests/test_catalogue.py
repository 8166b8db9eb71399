"""Every query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    got = ordered(tuple(r[c] for c in columns) for r in found.collect())
    for a, b in zip(got, ordered(tuple(r[p] for p in places) for r in wanted.fetchall()), strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in b) else a == b


def test_entry(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["id", "sources", "fused", "score"]
    assert 0 < rows.count() <= 20


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_all_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
