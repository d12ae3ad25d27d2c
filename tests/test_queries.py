import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_like_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    if sql := entry.oracle_sql().get(name):
        out = con.sql(sql)
        assert sorted(out.columns) == names
        at = [out.columns.index(c) for c in names]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
