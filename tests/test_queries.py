"""Every registered query of the engine against its DuckDB check on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from chromaloom.plans import registry
from chromaloom.plans.adapters import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, CHECKS = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.6g}" if isinstance(value, int | float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(canonical(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_check(spark, database, name):
    frame = QUERIES[name](spark, DATA)
    found = database.execute(CHECKS[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_without_check_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
