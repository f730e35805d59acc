import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["family_results_read_back", "all_reports_read_back", "walk_forward_ridge", "walk_forward_ols"])
def test_the_panel_is_built_once(spark, monkeypatch, name):
    """Every build of a panel scans the orders for its macros and its factors."""
    from panelkiln.sources import tables

    writes = []
    kept = tables.stored

    def stored(df):
        writes.append(df._jdf.queryExecution().optimizedPlan().toString().count("lineitem") or df._jdf.queryExecution().optimizedPlan().toString().count("l_suppkey"))
        return kept(df)

    monkeypatch.setattr(tables, "stored", stored)
    monkeypatch.setattr("panelkiln.plans.runs.stored", stored, raising=False)
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(n > 0 for n in writes) == 1 and "l_suppkey" not in plan
