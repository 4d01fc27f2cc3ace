"""Every query with SQL against DuckDB on the smallest data set."""

import duckdb
import pytest

from workload import derived as D
from workload.check import rows_of
from workload.oracle import SQL
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in D.TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    expected = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_every_operator_has_a_query():
    wanted = {"s": 10, "f": 8, "j": 10, "a": 20, "w": 7, "t": 6, "u": 4, "d": 6, "x": 13, "r": 8, "v": 8, "c": 4, "e": 2}
    have = {name.split("_")[0] for name in QUERIES}
    assert [f"{p}{i}" for p, n in wanted.items() for i in range(1, n + 1) if f"{p}{i}" not in have] == []
