"""Every query with SQL gives DuckDB's rows on sf0.001; the others run."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(k for k in entry.queries() if not re.match(r"op\d+_", k) and k != "pipeline")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver's tables are not here")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    want = duck.sql(sql)
    columns, expected = want.columns, want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    order = [columns.index(c) for c in got.columns]
    key = lambda r: repr(r)
    assert sorted((plain(r) for r in rows), key=key) == sorted((plain(tuple(r[i] for i in order)) for r in expected), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver's tables are not here")
def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["a", "b", "translation_id", "ty", "tx", "score"]
    assert got.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
