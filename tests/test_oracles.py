"""Every registered query against its DuckDB statement, or for rows where it has none."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as spark_entry
from tests.oracle_check import TABLES, differences, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck: duckdb.DuckDBPyConnection, name: str):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(ours) > 0
    if name in ORACLES:
        assert differences(ours, duck.execute(ORACLES[name]).df()) == ""


def test_each_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert "lineitem" in TABLES


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"label", "predicted_0", "predicted_1"}
