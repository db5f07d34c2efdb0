"""Every registered query against its SQL, over whole small tables."""

import glob
import os
import re

import duckdb
import pandas as pd
import pytest

from chronoloom import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
plans.load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if hasattr(v, "__iter__") and not isinstance(v, str | bytes | bytearray | dict):
        return str([plain(x) for x in v])
    if isinstance(v, float) or (hasattr(v, "dtype") and v.dtype.kind == "f"):
        return re.sub(r"\.0$", "", repr(round(float(v), 9)))
    if isinstance(v, bool) or (hasattr(v, "dtype") and v.dtype.kind == "b"):
        return str(bool(v))
    return str(v)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, DATA).toPandas(), con.execute(plans.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0
