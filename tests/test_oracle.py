"""Every registered query with SQL equals DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from placerec import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = pd.to_numeric(df[c]).astype(float) if df[c].dtype.kind in "iufb" else df[c].astype(str)
    return df.sort_values(list(df.columns), na_position="first", kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    a, b = Q[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    if len(a):
        pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert Q[name](spark, SF).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
