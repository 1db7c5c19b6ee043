"""Comparison of a query with its SQL counterpart."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = os.environ.get("DAYBOOK_TESTDATA", "/root/testdata")


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def assert_same(df, con, sql: str) -> int:
    """Same column names, types and rows in any order; the number of rows."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(row[n] for n in names) for row in df.collect()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows.sort(key=key)
    expected.sort(key=key)
    assert len(rows) == len(expected), f"{len(rows)} rows instead of {len(expected)}"
    for got, want in zip(rows, expected):
        assert got == want
        assert [type(v) for v in got] == [type(v) for v in want]
    assert_same_types(df, con, sql, names)
    return len(rows)


# The SQL name of each Spark type the queries return.
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE"}


def assert_same_types(df, con, sql, names):
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name in names:
        spark_type = df.schema[name].dataType.simpleString()
        assert SQL_TYPES.get(spark_type, spark_type.upper()) == described[name], name
