import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer

from panelkiln.operators import boosting, linear, neural, trees, vector_models
from panelkiln.plans import stages

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def df(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 2))
    y = x[:, 0] - np.abs(x[:, 1]) + 0.1 * draw.normal(size=300)
    parts = ["train"] * 200 + ["validation"] * 50 + ["test"] * 50
    return spark.createDataFrame([(k, float(a), float(b), float(t), s) for k, ((a, b), t, s) in enumerate(zip(x, y, parts, strict=True))], "id long, a double, b double, y double, split string").cache()


def forecasts(df):
    return {r.id: r.f for r in df.select("id", "f").collect()}


@pytest.mark.parametrize("family", ["ridge", "pls", "glm", "rf"])
def test_saved_families_give_the_same_forecasts(df, tmp_path, family):
    steps = Pipeline(stages=[SQLTransformer(statement="SELECT *, a * 2 AS c FROM __THIS__"), stages.PanelRegressor(family=family, features=["a", "b", "c"], target="y", split="split", output="f")])
    fitted = steps.fit(df)
    fitted.save(f"{tmp_path}/fitted")
    steps.save(f"{tmp_path}/steps")
    want = forecasts(fitted.transform(df))
    assert len(want) == 300 and forecasts(PipelineModel.load(f"{tmp_path}/fitted").transform(df)) == want
    again = Pipeline.load(f"{tmp_path}/steps").fit(df)
    assert {k: round(v, 9) for k, v in forecasts(again.transform(df)).items()} == {k: round(v, 9) for k, v in want.items()}


def test_states_of_all_other_models(df):
    train = df.where("split = 'train'")
    models = [
        boosting.boosted_huber(train, FEATURES, "y", stages=3, rate=0.3, leaf=20, bins=8), neural.Network(FEATURES, {"a": (0.1, 2.0), "b": (0.0, 1.0)}, neural._start([3], 2, 1)),
        linear.Linear(("a",), (0.5,), 1.0),
    ]
    for model in models:
        back = stages.from_state(json.loads(json.dumps(stages.to_state(model))))
        assert forecasts(back.predict(df, "f")) == forecasts(model.predict(df, "f"))
    v = vector_models.VectorLinear("v", (0.5, -1.0), 2.0)
    assert stages.from_state(json.loads(json.dumps(stages.to_state(v)))).coefficients == (0.5, -1.0)
    with pytest.raises(TypeError):
        stages.to_state(trees.regression_tree(train, FEATURES, "y", 2, 5))


def test_unknown_families_are_refused(df):
    with pytest.raises(ValueError, match="family is one of"):
        stages.PanelRegressor(family="nothing", features=FEATURES, target="y").fit(df)


def test_gap_bounds_the_distance_from_the_least_loss():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 3))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = x @ [0.5, 0.0, -0.2] + 0.2 * draw.standard_t(2, 200)
    l1, l2, xi = 0.02, 0.01, 0.3

    def sums(b, a):
        u = y - a - x @ b
        v = np.clip(u, -xi, xi)
        return np.array([*(x.T @ v), v.sum(), v @ y, v @ v, (v * u - v * v / 2).sum()])

    b, a = np.zeros(3), y.mean()
    for _ in range(5_000):
        s = sums(b, a)
        a += 0.3 * s[3] / 200
        b = b + 0.3 * (s[:3] / 200 - l2 * b)
        b = np.sign(b) * np.maximum(np.abs(b) - 0.3 * l1, 0)
    least, gap = linear.duality_gap(sums(b, a), 200, y.mean(), b, l1, l2, xi)
    assert -1e-12 <= gap < 1e-9
    for other in (np.zeros(3), b + 0.1, np.array([1.0, -1.0, 0.5])):
        loss, gap = linear.duality_gap(sums(other, 0.1), 200, y.mean(), other, l1, l2, xi)
        assert gap >= loss - least - 1e-12
    _, gap = linear.duality_gap(sums(b, a), 200, y.mean(), b, l1, 0.0, xi)
    assert gap >= -1e-12
