"""Every query with SQL gives the rows its SQL gives in DuckDB."""

import math

import duckdb
import pytest

from pressgauge.plans.catalog import QUERIES
from pressgauge.plans.oracle import SQL

TABLES = ["documents", "labels", "pages", "benchmark", "conversations", "events"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([repr([plain(row[i]) for i in order]) for row in rows])


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    want = table_of([c[0] for c in found.description], found.fetchall())
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == want
