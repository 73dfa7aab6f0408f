"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from docweave.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return "none"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()
