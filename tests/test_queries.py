"""Every registered query against its SQL on the small tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidewell.workbook.base import NAMES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return repr(int(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def table(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [dict(zip(columns, r)) for r in result.fetchall()]
    assert table(rows, sorted(columns)) == table(expected, sorted(columns))


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
    assert abs(sum(r["share_pct"] for r in rows) - 100) < 1e-6
