"""Every query with SQL gives what DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from codeloom import plans

ORACLES = plans.all_oracles()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


def _cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, data, name):
    got = plans.all_queries()[name](spark, data)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(tuple(_cell(r[c]) for c in columns) for r in got.collect())
    order = [want.columns.index(c) for c in columns]
    b = sorted(tuple(_cell(r[i]) for i in order) for r in want.fetchall())
    assert a == b


def test_names_and_sql_agree():
    assert set(ORACLES) <= set(plans.all_queries())
