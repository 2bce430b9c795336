"""Every registered corpus query runs over its table; those with SQL equal DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from placerec.llm import registry

SF = "/root/testdata/sf0.001"
ROWS = {"op4_exact_topk": None, "op11_source_divergence": None, "op7_token_counts": None, "op8_url_filter": "pages"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs_and_equals_its_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    if (of := ROWS.get(name, "documents")) is not None:
        assert len(got) == con.execute(f"SELECT count(*) FROM {of}").fetchone()[0]
    if sql := registry.oracle_sql().get(name):
        want = con.execute(sql).df()
        by = sorted(got.columns)
        assert by == sorted(want.columns)
        sort = lambda d: d[by].sort_values(by).reset_index(drop=True)
        pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False, atol=1e-9)
    if name == "op10_quality_classifier":
        import zlib

        assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
        assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
