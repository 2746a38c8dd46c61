"""Every registered query with a SQL counterpart gives the same rows at the smallest scale."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from rivulet.plans import registry

DIR = "/root/testdata/sf0.001"


def rows(frame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    made = registry.queries()[name](spark, DIR).toPandas()
    if (sql := registry.oracle_sql().get(name)) is not None:
        want = duck.execute(sql).df()
        assert sorted(made.columns) == sorted(want.columns)
        assert rows(made) == rows(want)
