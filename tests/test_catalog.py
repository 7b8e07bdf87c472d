"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else v if isinstance(v, (str, bool)) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(rows(got)) > 0
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
