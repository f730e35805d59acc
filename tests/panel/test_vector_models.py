import datetime as dt
import resource

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelkiln.operators import features as X
from panelkiln.operators import linear, walk_forward
from panelkiln.operators import vector_models as V
from panelkiln.operators.splits import rolling_year_splits


def numpy_ridge(x, y, alpha):
    s = np.where(x.std(axis=0) > 1e-7, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / s
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return b, y.mean() - b @ x.mean(axis=0)


def mixed_table(spark, x, y):
    """Every other row as a dense vector; a row without vector and one without target."""
    rows = [(k, Vectors.dense(r) if k % 2 else Vectors.sparse(len(r), [int(i) for i in np.flatnonzero(r)], [float(v) for v in r[r != 0]]), float(t)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (900, None, 1.0), (901, Vectors.dense(x[0]), None)], _schema())


def _schema():
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    return StructType([StructField("id", LongType()), StructField("v", VectorUDT()), StructField("y", DoubleType())])


@pytest.fixture(scope="module")
def sample(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(180, 12)) * (draw.random((180, 12)) < 0.4)
    x[:, 7] = 0.0
    x[:, 8] = 3.0
    y = x @ draw.normal(size=12) + draw.normal(size=180)
    return mixed_table(spark, x, y), x, y


def test_both_ways_equal_numpy_ridge_on_dense_and_sparse_rows(sample):
    df, x, y = sample
    by_products = V.ridge_of_vectors(df, "v", "y", (0.1, 10.0))
    by_steps, left = V.conjugate_ridge(df, "v", "y", (0.1, 10.0), tolerance=1e-13)
    for i, alpha in enumerate((0.1, 10.0)):
        b, a = numpy_ridge(x, y, alpha)
        for fit in (by_products[i], by_steps[i]):
            assert np.allclose(fit.coefficients, b, atol=1e-8) and fit.intercept == pytest.approx(a, abs=1e-8)
    assert max(left) <= 1e-13
    found = {r.id: r.forecast for r in by_products[1].predict(df).collect()}
    assert all(found[k] == pytest.approx(a + b @ x[k], abs=1e-8) for k in range(180)) and found[900] is None


def test_vector_products_equal_those_of_plain_columns(spark, sample):
    df, x, y = sample
    plain = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], [*(f"c{i}" for i in range(12)), "y"])
    assert np.allclose(V.gram_of_vectors(df, "v", "y").cells, linear.gram(plain, [f"c{i}" for i in range(12)], "y").cells)


def test_six_thousand_features_in_little_memory(spark):
    draw = np.random.default_rng(6)
    n, p = 600, 6_000
    at = np.array([np.sort(draw.choice(p, 20, replace=False)) for _ in range(n)])
    values = draw.normal(size=(n, 20))
    y = values.sum(axis=1) + draw.normal(size=n)
    df = spark.createDataFrame([(k, Vectors.sparse(p, at[k].tolist(), values[k].tolist()), float(y[k])) for k in range(n)], _schema())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    fits, left = V.conjugate_ridge(df, "v", "y", (10.0, 1000.0), tolerance=1e-11)
    assert max(left) <= 1e-11 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    x = np.zeros((n, p))
    x[np.arange(n)[:, None], at] = values
    s = np.where(x.std(axis=0) > 1e-7, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / s
    for fit, alpha in zip(fits, (10.0, 1000.0), strict=True):
        b = z.T @ np.linalg.solve(z @ z.T + alpha * np.eye(n), y - y.mean()) / s  # the dual form
        assert np.allclose(fit.coefficients, b, atol=1e-8)
    with pytest.raises(ValueError, match="more than"):
        V.gram_of_vectors(df, "v", "y")


def test_models_take_the_built_feature_vector(spark):
    draw = np.random.default_rng(7)
    rows = [(k, dt.date(2000, 1, 31), float(draw.normal()), float(draw.normal()), 2.0, int(k % 3), float(draw.normal())) for k in range(90)]
    panel = spark.createDataFrame(rows, "permno long, month date, a double, b double, macro_m double, sic2 int, y double")
    builder = X.FeatureBuilder(["a", "b"], ["macro_m"], industry="sic2")
    built = builder.transform(panel)
    assert V.width(built, "features") == builder.n_features == 2 + 2 + 6
    best, curve = V.ridge_grid_of_vectors(built.where("permno < 60"), built.where("permno >= 60"), "features", "y", (1.0, 100.0))
    assert curve.count() == 2 and best.predict(built).where("forecast IS NULL").count() == 0


def test_no_rows_is_an_error(sample):
    with pytest.raises(ValueError, match="no training rows"):
        V.ridge_of_vectors(sample[0].where("id < 0"), "v", "y")
    with pytest.raises(ValueError, match="no training rows"):
        V.conjugate_ridge(sample[0].where("y IS NULL"), "v", "y")


def years(spark):
    draw = np.random.default_rng(8)
    rows = [(k, dt.date(y, m, 28), float(draw.normal()), None if k == 3 else float(draw.normal()), float(draw.normal()) + 0.1 * k) for y in range(2000, 2008) for m in (1, 7) for k in range(9)]
    return spark.createDataFrame([*rows, (77, None, 1.0, 1.0, 1.0)], "permno long, month date, a double, b double, y double")


@pytest.mark.parametrize("expanding", [False, True])
def test_folds_equal_refits_on_their_own_rows(spark, expanding):
    panel, alphas = years(spark), (0.0, 5.0, 50.0)
    splits = rolling_year_splits(2000, 2007, train=3, validation=2, test=1, expanding=expanding)
    forecasts, choices = walk_forward.walk_forward(panel, splits, ["a", "b"], "y", alphas)
    found = {(r.fold, r.permno, r.month): r.forecast for r in forecasts.collect()}
    chosen = {r.fold: r for r in choices.collect()}
    assert len(chosen) == 3 and len(found) == 3 * 18
    for fold, s in enumerate(splits):
        rows = {p: panel.where(F.col("month").between(F.lit(a), F.lit(b))) for p, a, b in s.bounds()}
        g = linear.gram(rows["train"], ["a", "b"], "y")
        fits = [linear.ridge(g, a) if a else linear.ols(g) for a in alphas]
        scores = [rows["validation"].agg((1 - F.sum((F.col("y") - f.expression()) ** 2) / F.sum(F.col("y") ** 2)).alias("r")).head().r for f in fits]
        best = int(np.argmax(scores))
        assert chosen[fold].alpha == alphas[best] and chosen[fold].validation_r2 == pytest.approx(scores[best]) and chosen[fold].train_rows == rows["train"].count()
        assert all(found[(fold, r.permno, r.month)] == pytest.approx(r.f) for r in rows["test"].withColumn("f", fits[best].expression()).collect())


def test_one_scan_serves_all_folds(spark, monkeypatch):
    panel, seen = years(spark), []
    inner = walk_forward.yearly_grams
    monkeypatch.setattr(walk_forward, "yearly_grams", lambda *a, **k: seen.append(1) or inner(*a, **k))
    few, many = (rolling_year_splits(2000, last, train=2, validation=1, test=1) for last in (2004, 2007))
    for splits in (few, many):
        walk_forward.walk_forward(panel, splits, ["a"], "y", (1.0,))
    assert len(many) > len(few) and len(seen) == 2  # one pass each


def test_windows_that_cut_years_are_refused(spark):
    splits = rolling_year_splits(2000, 2007, train=3, validation=2, test=1)
    broken = [type(splits[0])(splits[0].train_start, dt.date(2002, 6, 30), *(d for _, a, b in splits[0].bounds()[1:] for d in (a, b)))]
    with pytest.raises(ValueError, match="whole years"):
        walk_forward.walk_forward(years(spark), broken, ["a"], "y")
