"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, compare
from gavel.plans import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
# Queries without SQL: a fit over 64 components.
ROWS_ONLY = {"head_training"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_registry():
    assert set(SQL) == set(QUERIES) - ROWS_ONLY
    assert QUERIES.items() <= entry_point.queries().items()
    assert SQL.items() <= entry_point.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    outcome = compare(spark, duck, name, SF_DIR)
    assert outcome.startswith(("ok", "rows-only")), outcome
    assert " 0 rows" not in outcome


def test_entry(spark):
    assert entry_point.entry(spark).count() == 3
