import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.operators import boosting, neural
from panelkiln.operators import evaluate as E

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    draw = np.random.default_rng(8)
    x = np.round(draw.normal(size=(250, 3)) + 0.5, 2)
    y = x[:, 0] - np.abs(x[:, 1]) + 0.1 * draw.normal(size=250)
    rows = [(None if k % 50 == 0 else float(r[0]), float(r[1]), float(r[2]), float(t), "kept") for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, feature string").repartition(3).cache()


def models(df):
    return [
        neural.Network(FEATURES, {"a": (0.3, 2.0), "b": (-0.5, 1.0), "c": (0.0, 0.7)}, neural._start([5, 4], 3, 1)), neural.Network(FEATURES, {c: (0.0, 1.0) for c in FEATURES}, neural._start([], 3, 2)),
        boosting.boosted_huber(df, FEATURES, "y", stages=6, rate=0.4, leaf=15, bins=16),
    ]


def test_ablations_equal_scoring_of_copied_rows(df):
    for model in models(df):
        want = {r.feature: r for r in E.rescored_importance(model, df, "y", FEATURES).collect()}
        found = {r.feature: r for r in E.ablation_importance(model, df, "y").collect()}
        assert set(found) == set(FEATURES)
        for c in FEATURES:
            assert found[c].baseline_r2 == pytest.approx(want[c].baseline_r2) and found[c].ablated_r2 == pytest.approx(want[c].ablated_r2) and found[c].importance == pytest.approx(want[c].importance)


def test_groups_fall_together(df):
    for model in models(df):
        zero = df.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
        want = model.predict(zero).agg(E.oos_r2("y", "forecast").alias("r")).head().r
        found = E.ablation_importance(model, df, "y", {"two": ["a", "b"], "none": []}).collect()
        assert {r.feature: r.ablated_r2 for r in found} == {"two": pytest.approx(want), "none": pytest.approx(found[0].baseline_r2)}


def test_rows_are_read_once_and_missing_targets_count(df):
    model = models(df)[0]
    plan = E.ablation_importance(model, df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Generate explode(array(," not in plan
    missing = df.withColumn("y", F.when(F.col("b") > 0, F.col("y")))
    assert all(r.baseline_r2 is None and r.importance is None for r in E.ablation_importance(model, missing, "y").collect())
    assert E.ablation_importance(model, df.limit(0), "y").where("baseline_r2 IS NOT NULL").count() == 0
