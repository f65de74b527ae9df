"""Every query with SQL against DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from pairlens.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    if name not in ORACLES:
        assert columns
        return
    r = duck.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert rows == sorted([tuple(plain(x[i]) for i in at) for x in r.fetchall()], key=repr)
