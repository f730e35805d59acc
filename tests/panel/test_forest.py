import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from panelkiln.operators import forest as R
from panelkiln.operators import trees
from panelkiln.operators.evaluate import oos_r2

FEATURES = ["a", "b", "c", "d"]
PLAIN = {"numTrees": 2, "maxDepth": 4, "minInstancesPerNode": 5, "featureSubsetStrategy": "all", "subsamplingRate": 1.0, "bootstrap": False}


@pytest.fixture(scope="module")
def sample(spark):
    draw = np.random.default_rng(7)
    x = draw.integers(0, 20, (900, 4)) / 4
    y = np.where(x[:, 0] > 2, 1.0, -0.5) + 0.3 * x[:, 1] * (x[:, 2] > 1) + 0.5 * draw.normal(size=900)
    rows = [(k, *map(float, r), float(t), "train" if k < 600 else "validation") for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, split string")
    return df.withColumn("d", F.when(F.col("id") % 7 > 0, F.col("d"))).repartition(3).cache()


def forecasts(model, df):
    return np.array([r.forecast for r in model.predict(df).orderBy("id").collect()])


def test_without_draws_a_forest_is_that_of_sparks_learner(sample):
    train = sample.where("split = 'train'")
    own = trees.random_forest(train, FEATURES, "y", **PLAIN)
    other = trees._fit(RandomForestRegressor(seed=1, **PLAIN), train, FEATURES, "y")
    assert isinstance(own, R.Forest) and len(set(forecasts(own, sample))) > 10
    assert np.allclose(forecasts(own, sample), forecasts(other, sample), atol=1e-9)


def test_with_draws_a_forest_is_that_of_plain_numpy(sample, monkeypatch):
    """One block, its draws and the tried features as the module gives them; trees grown row by row."""
    train = sample.where("split = 'train'").coalesce(1)
    settings = {"numTrees": 4, "maxDepth": 3, "minInstancesPerNode": 4, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.5, "bootstrap": True}
    model = R.grown(train, FEATURES, "y", [settings], seed=5)[0]
    rows = sorted((r.a, r.b, r.c, r.d or 0.0, r.y) for r in train.collect())
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["x0", "x1", "x2", "x3", "y"])

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(R, "TaskContext", Context)
    blocks = list(R._packed(model.edges)(iter([batch])))
    assert len(blocks) == 1
    bins, y = np.frombuffer(blocks[0].column(1)[0].as_py(), np.uint8).reshape(4, -1), np.array([r[-1] for r in rows])
    want = np.zeros(len(rows))
    for t in range(4):
        drawn, often = R._drawn(5, t, 0, len(rows), 0.5, True)
        weight = np.zeros(len(rows))
        weight[drawn] = often

        def grow(own, level, node, t=t, weight=weight):
            w, g = weight[own], y[own]
            want[own] += (w @ g) / max(w.sum(), 1) / 4 if level == 3 else 0.0
            if level == 3:
                return
            best, parts = 1e-9, None
            for i in R._tried(5, t, level, 4, 2)[node]:
                for cut in range(len(model.edges[i])):
                    left = bins[i][own] <= cut
                    a, b = w[left].sum(), w[~left].sum()
                    if min(a, b) >= 4:
                        gain = a * b / (a + b) * ((w[left] @ g[left]) / a - (w[~left] @ g[~left]) / b) ** 2
                        if gain > best * (1 + 1e-10):
                            best, parts = gain, (own[left], own[~left])
            if parts is None:
                want[own] += (w @ g) / max(w.sum(), 1) / 4
            else:
                grow(parts[0], level + 1, 2 * node)
                grow(parts[1], level + 1, 2 * node + 1)

        grow(np.arange(len(rows)), 0, 0)
    assert np.allclose(model.forecasts(bins, [3])[0], want) and len(set(np.round(want, 9))) > 20


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out


def test_depths_of_a_grid_are_one_forest(spark, sample):
    """Settings that differ in depth only take no passes of their own, and give what they give alone."""
    train, validation = sample.where("split = 'train'"), sample.where("split = 'validation'")
    grid = [{**PLAIN, "numTrees": 6, "maxDepth": d, "featureSubsetStrategy": s, "subsamplingRate": 0.5, "bootstrap": True} for d in (1, 2, 4) for s in ("sqrt", "50")]
    many, (best, curve) = jobs(spark, "six settings", lambda: trees.random_forest_grid(train, validation, FEATURES, "y", grid))
    few, _ = jobs(spark, "two settings", lambda: trees.random_forest_grid(train, validation, FEATURES, "y", grid[4:]))
    assert many <= few
    curve = curve.orderBy("grid_index").collect()
    assert [(r.max_depth, r.max_features) for r in curve] == [(g["maxDepth"], g["featureSubsetStrategy"]) for g in grid]
    alone = trees.random_forest(train, FEATURES, "y", **grid[2])
    assert alone.predict(validation).agg(oos_r2("y", "forecast")).head()[0] == pytest.approx(curve[2].validation_r2, abs=1e-12)
    top = max(curve, key=lambda r: r.validation_r2)
    assert best.depth == top.max_depth and best.predict(validation).agg(oos_r2("y", "forecast")).head()[0] == pytest.approx(top.validation_r2, abs=1e-12)


def test_further_passes_change_no_tree(sample, monkeypatch):
    train, two = sample.where("split = 'train'"), [PLAIN, {**PLAIN, "featureSubsetStrategy": "sqrt", "maxDepth": 2}]
    one = R.grown(train, FEATURES, "y", two)
    monkeypatch.setattr(R, "MOST_BYTES", 20_000)
    assert len(R._passes([R._Tree(i, i, 4, 5, 4, 1.0, False) for i in range(4)], 3, 20)) == 4
    again = R.grown(train, FEATURES, "y", two)
    for a, b in zip(one, again, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)


def test_draws():
    own, often = R._drawn(1, 2, 3, 400_000, 0.5, True)
    weight = np.zeros(400_000)
    weight[own] = often
    assert abs(weight.mean() - 0.5) < 0.01 and abs(weight.var() - 0.5) < 0.01 and abs((weight == 0).mean() - np.exp(-0.5)) < 0.005
    again, _ = R._drawn(1, 2, 3, 400_000, 0.5, True)
    other, _ = R._drawn(1, 2, 4, 400_000, 0.5, True)
    assert (own == again).all() and len(np.intersect1d(own, other)) < 0.45 * len(own)
    once, often = R._drawn(-1, 0, 0, 1000, 0.3, False)
    assert 200 < len(once) < 400 and (often == 1).all()
    assert {tuple(r) for k in range(50) for r in R._tried(k, 0, 1, 3, 2).tolist()} == {(0, 1), (0, 2), (1, 2)}
    assert [R.tried_features(s, 6, 300) for s in ("all", "sqrt", "log2", "onethird", "auto", "50", "4", "0.5")] == [6, 3, 3, 2, 2, 6, 4, 3]


def test_odd_inputs(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (None, 2.0), (3.0, None), (4.0, float("nan"))], "a double, y double")
    model = trees.random_forest(rows, ["a"], "y", numTrees=3, maxDepth=2, minInstancesPerNode=1, bootstrap=False)
    assert [r.forecast for r in model.predict(rows).collect()] == [2.0] * 5 and (model.cut >= len(model.edges[0])).all()
    stump = trees.random_forest(rows, ["a"], "y", numTrees=1, maxDepth=0, bootstrap=False)
    assert [r.forecast for r in stump.predict(rows).collect()] == [2.0] * 5
    with pytest.raises(ValueError, match="no training rows"):
        trees.random_forest(rows.where("y IS NULL"), ["a"], "y")
    deep = trees.random_forest(rows.na.fill(0.0), ["a"], "y", numTrees=1, maxDepth=12, minInstancesPerNode=1)
    assert isinstance(deep, trees.Forecaster)
