import os

import pytest

import __spark_entry__
from panelkiln.plans import stored

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["panel_build", "rank_minmax_scaled", "asof_release_lag", "dm_matrix", "turnover", "ols3_forecast", "decile_table", "full_evaluation", "ridge_sparse_grid", "walk_forward_ridge", "rank_pct_spread", "pls", "glm_spline_1f", "nn_linear_step", *stored.QUERIES])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{file}')")
    con.execute(f"CREATE TABLE want AS {__spark_entry__.oracle_sql()[name]}")
    found = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM want").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
