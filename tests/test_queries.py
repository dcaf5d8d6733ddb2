"""Every query with SQL gives DuckDB's rows."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__
from sliceloom import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    out = duck.execute(sql)
    have = [d[0] for d in out.description]
    assert sorted(have) == names
    theirs = sorted(repr([plain(r[have.index(n)]) for n in names]) for r in out.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect()) == theirs


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    same(spark, duck, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
