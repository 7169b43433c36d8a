"""Every query with SQL gives the SQL's rows on the smallest data; every other runs."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_has_a_query():
    assert not SQL.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    if name in SQL:
        got = duck.execute(SQL[name])
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns)
        order = sorted(cols)
        want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in got.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == want
    else:
        assert len(df.columns) == len(set(df.columns))


def test_entry(spark):
    assert {r.metric for r in entry.entry(spark).collect()} >= {"ctr", "coverage", "ranking_quality"}
