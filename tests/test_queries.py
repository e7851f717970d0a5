"""Every core query with SQL gives what DuckDB gives on the same tables; the others run."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from millrace import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [{k: norm(v) for k, v in r.asDict().items()} for r in df.collect()]
    if name in catalog.SQL:
        cur = duck.execute(catalog.SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        want = [dict(zip(cols, map(norm, r))) for r in cur.fetchall()]
        key = lambda r: repr(sorted(r.items()))
        assert sorted(map(key, rows)) == sorted(map(key, want))


def test_sql_has_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
