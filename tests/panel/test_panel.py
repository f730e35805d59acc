import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkiln.functions.nulls import nan_to_null
from panelkiln.operators import evaluate as E
from panelkiln.operators import features as X
from panelkiln.operators import boosting, linear, neural, trees
from panelkiln.operators import panel as P
from panelkiln.operators import portfolio as Q
from panelkiln.operators.splits import apply_rolling, apply_split, make_split, rolling_year_splits
from panelkiln.plans import runs
from panelkiln.sources import schema, tables

M = [dt.date(2000, 1, 31), dt.date(2000, 2, 29), dt.date(2000, 3, 31), dt.date(2000, 4, 30)]


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_ranks_with_ties_nulls_and_single_values(spark):
    df = frame(spark, [(1, "a", 3.0), (2, "a", 1.0), (3, "a", None), (4, "a", 1.0), (5, "b", 7.0), (6, "c", None)], "permno long, month string, x double")
    pct = {r.permno: r.x for r in X.rank_columns(df, ["x"]).collect()}
    assert [pct[k] for k in (1, 2, 3, 4, 5, 6)] == [1.0, 0.0, None, 0.0, 1.0, None]  # -1 + 2 * rank share
    scaled = {r.permno: r.x for r in X.rank_columns(df, ["x"], scale="minmax").collect()}
    assert [scaled[k] for k in (1, 2, 3, 4, 5, 6)] == [1.0, -0.5, None, -0.5, None, None]


def test_ranks_equal_pandas(spark):
    r = random.Random(3)
    rows = [(k, f"m{r.randrange(4)}", r.choice([None, *map(float, range(8))]), r.choice([None, 0.5, 1.5])) for k in range(300)]
    found = X.rank_columns(frame(spark, rows, "permno long, month string, x double, y double"), ["x", "y"]).toPandas().set_index("permno").sort_index()
    p = pd.DataFrame(rows, columns=["permno", "month", "x", "y"]).set_index("permno").sort_index()
    expected = p.groupby("month")[["x", "y"]].rank(pct=True) * 2 - 1
    assert np.allclose(found[["x", "y"]].astype(float), expected, equal_nan=True)


def test_rank_plan_has_one_exchange(spark):
    df = frame(spark, [(1, "a", 1.0, 2.0, 3.0)], "permno long, month string, x double, y double, z double")
    plan = X.rank_columns(df, ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


@pytest.mark.parametrize("n", [1, 2, 7, 12, 100])
def test_deciles(spark, n):
    rows = [(k, "m", float(k * 7 % n)) for k in range(n)] + [(1000, "m", None), (1001, None, 1.0)]
    found = {r.permno: r.bucket for r in Q.assign_deciles(frame(spark, rows, "permno long, month string, forecast double")).collect()}
    assert found[1000] is None and found[1001] is None
    if n == 1:
        assert found[0] is None
    else:
        ranks = pd.Series([r[2] for r in rows[:n]]).rank(method="first")
        assert [found[k] for k in range(n)] == [int(b) + 1 for b in pd.qcut(ranks, 10, labels=False)]
    if n == 12:
        assert sorted(v for v in found.values() if v) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10]


def test_value_weighted_returns_and_spread(spark):
    rows = [("m", 1, 0.1, 1.0), ("m", 1, None, 5.0), ("m", 1, 0.3, 1.0), ("m", 10, None, 2.0), ("m", None, 1.0, 1.0), ("n", 1, 0.5, 0.0)]
    p = Q.value_weighted(frame(spark, rows, "month string, bucket int, r double, w double"), "r", "w")
    found = {(x.month, x.bucket): x.portfolio_return for x in p.collect()}
    assert found[("m", 1)] == pytest.approx(0.4 / 7) and found[("m", 10)] == 0.0 and found[("n", 1)] is None and len(found) == 3
    assert {x.month: x.long_short for x in Q.long_short(p).collect()} == {"m": pytest.approx(-0.4 / 7), "n": None}


def test_measures(spark):
    df = frame(spark, [(1.0, 0.5, None), (-1.0, -0.5, 1.0), (2.0, 1.5, 1.0)], "y double, f double, g double")
    row = df.agg(E.oos_r2("y", "f").alias("a"), E.oos_r2("y", "g").alias("b"), E.mse("y", "f").alias("c"), E.mae("y", "f").alias("d"), Q.sharpe(F.col("y")).alias("e"), Q.sharpe(F.lit(1.0)).alias("g"), E.t_stat(F.col("y")).alias("t")).head()
    y = np.array([1.0, -1.0, 2.0])
    assert row.a == pytest.approx(0.875) and row.b is None and row.c == row.d**2 == 0.25 and row.g is None
    assert row.e == pytest.approx(math.sqrt(12) * y.mean() / y.std(ddof=1)) and row.t == pytest.approx(y.mean() / (y.std(ddof=1) / math.sqrt(3)))
    assert df.limit(1).agg(Q.sharpe(F.col("y")).alias("s"), E.t_stat(F.col("y")).alias("t")).head() == (None, None)


def test_newey_west(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 60)
    found = E.newey_west(frame(spark, [(k, float(v)) for k, v in enumerate(x)], "month long, diff double"), "diff", lags=3).head()
    u = x - x.mean()
    s = u @ u + 2 * sum((1 - k / 4) * (u[k:] @ u[:-k]) for k in (1, 2, 3))
    assert found.dm_stat == pytest.approx(x.mean() / math.sqrt(s / 60**2)) and found.n_months == 60


def raw(spark):
    returns = [(1, M[0], 0.1, 5.0), (1, M[1], 0.2, 6.0), (1, M[3], 0.3, 7.0), (2, M[0], 0.1, None), (2, M[1], 0.4, 2.0), (2, M[2], float("nan"), 2.0), (3, M[2], 0.2, 1.0), (3, M[3], 0.5, 1.0)]
    chars = [(1, 200001, 1.0), (1, 200002, 2.0), (2, 200001, 3.0), (2, 200002, 1.0), (3, 200003, None)]
    return {
        "stock_returns": frame(spark, returns, "permno long, month date, ret double, me double"), "stock_characteristics": frame(spark, chars, "permno long, yyyymm int, x double"),
        "industry_dummies": frame(spark, [(1, M[0], 3, 1.0)], "permno long, month date, sic2 int, sic2_3 double"),
        "welch_goyal_macros": frame(spark, [(200000 + k, 0.01, *[float(k)] * 8) for k in (1, 2, 4)], "yyyymm int, rf_welch_goyal double, dp double, ep double, bm double, ntis double, tbl double, tms double, dfy double, svar double"),
        "fama_french_factors": frame(spark, [(200001, *[0.5] * 7)], "yyyymm int, rf double, mktrf double, smb double, hml double, rmw double, cma double, umd double"),
    }


def test_panel(spark):
    found = {(r.permno, r.month): r for r in P.build_panel(raw(spark)).collect()}
    # 1: the row of February has no next month; 2: February's lead is NaN; 3: no characteristic.
    assert set(found) == {(1, M[0]), (2, M[0])}
    one, two = found[(1, M[0])], found[(2, M[0])]
    assert one.ret_excess_lead1 == pytest.approx(0.19) and one.macro_dp == 1.0 and one.sic2_3 == 1.0 and one.rf_ff == 0.5
    assert two.ret_excess_lead1 == pytest.approx(0.39) and two.market_equity == 0.0 and two.sic2_3 == 0.0 and two.sic2 is None
    assert P.build_panel(raw(spark), missing="median").count() == 3 and P.build_panel(raw(spark), rows=1).head().permno == 1
    empty = {k: v.limit(0) for k, v in raw(spark).items()}
    assert P.build_panel(empty).count() == 0


def test_stored_by_asset_the_panel_needs_no_exchange_of_a_long_table(spark, tmp_path):
    key, tables_of = "spark.sql.requireAllClusterKeysForCoPartition", raw(spark)
    before = spark.conf.get(key)
    tables.write_bucketed(tables_of, "asset_store", str(tmp_path), buckets=3)
    try:
        panel = P.build_panel(tables.read_bucketed(spark, "asset_store"))
        plan = panel._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        assert sorted(map(repr, panel.collect())) == sorted(map(repr, P.build_panel(tables_of).select(panel.columns).collect()))
    finally:
        spark.conf.set(key, before)
        for name in tables.RAW_TABLES:
            spark.sql(f"DROP TABLE asset_store_{name}")


def test_median_and_release_lag(spark):
    df = frame(spark, [(1, M[0], 1.0), (2, M[0], None), (3, M[0], 4.0), (1, M[1], None)], "permno long, month date, x double")
    assert {(r.permno, r.month): r.x for r in P.median_impute(df, ["x"]).collect()} == {(1, M[0]): 1.0, (2, M[0]): 2.5, (3, M[0]): 4.0, (1, M[1]): None}
    lagged = P.release_lag(frame(spark, [(1, m) for m in M], "permno long, month date"), frame(spark, [(1, M[0], 9.0), (1, M[1], 8.0), (2, M[0], 7.0)], "permno long, month date, v double"), ["v"], 2)
    assert [r.v_lag2 for r in lagged.orderBy("month").collect()] == [None, None, 9.0, 8.0]


def test_schema_rules(spark, tmp_path):
    panel = P.build_panel(raw(spark))
    with pytest.raises(ValueError, match="permno, ret_excess_lead1"):
        schema.validate(panel.drop("permno", "ret_excess_lead1"))
    assert schema.roles(panel)["characteristics"] == ["x"] and schema.roles(panel)["dummies"] == ["sic2_3"] and len(schema.roles(panel)["macros"]) == 8
    with pytest.raises(ValueError):
        schema.choose_columns(panel, ["nothing"])
    with pytest.raises(ValueError):
        schema.select_features(panel, ["nothing"])
    with pytest.raises(ValueError):
        schema.require_unique(panel.union(panel), "permno", "month")
    path = str(tmp_path)
    tables.write_manifest(panel, f"{path}/manifest", interactions=X.industry_interactions(panel, ["x"]))
    manifest = tables.read_manifest(spark, f"{path}/manifest", panel)
    assert manifest["characteristics"] == ["x"] and schema.select_features(panel, manifest=manifest)[0] == "x"
    tables.write_panel(panel, f"{path}/panel")
    assert tables.load_panel(spark, f"{path}/panel").count() == 2
    raw(spark)["stock_characteristics"].withColumn("x", F.col("x") * 5).write.parquet(f"{path}/chars")
    tables.ranked_copy(spark, f"{path}/chars", f"{path}/ranked")
    with pytest.raises(ValueError, match="ranked already"):
        tables.ranked_copy(spark, f"{path}/ranked", f"{path}/again")
    with pytest.raises(ValueError, match="same"):
        tables.ranked_copy(spark, f"{path}/chars", f"{path}/chars/")
    tables.write_results(panel.select("permno"), panel.agg(F.count("*").alias("n")), f"{path}/results")
    tables.write_family_results("ols", panel.agg(F.count("*").alias("n")), panel.select("month"), panel.select("permno"), path)
    tables.write_reports({"model_r2": panel.select("permno")}, path)
    assert spark.read.option("header", True).csv(f"{path}/model_r2").columns == ["permno"]


def test_splits(spark):
    with pytest.raises(ValueError):
        make_split("rolling")
    split = make_split(train_start="2000-01-01", train_end="2000-01-31", validation_start="2000-02-01", validation_end="2000-02-29", test_start="2000-03-01", test_end="2000-12-31")
    df = frame(spark, [(m,) for m in M], "month date")
    assert [r.split for r in apply_split(df, split).orderBy("month").collect()] == ["train", "validation", "test", "test"]
    with pytest.raises(ValueError, match="validation"):
        apply_split(df.where("month <> DATE'2000-02-29'"), split)
    folds = rolling_year_splits(1957, 2016)
    assert len(folds) == 30 and folds[0].train_end.year == 1974 and folds[-1].test_end.year == 2016
    assert rolling_year_splits(1957, 2016, expanding=True)[-1].train_start.year == 1957
    assert apply_rolling(df, rolling_year_splits(1998, 2001, 1, 1, 1)).select("fold", "split").distinct().count() == 2


def test_interactions(spark):
    panel = frame(spark, [(1, M[0], 2.0, None, 3.0, 5), (2, M[0], 0.0, 4.0, 1.0, None)], "permno long, month date, a double, b double, macro_m double, sic2 int")
    assert X.macro_interactions(panel, ["a"], ["macro_m"]).orderBy("permno").head()["a__x__macro_m"] == 6.0
    long = X.industry_interactions(panel, ["a", "b"]).collect()
    assert [(r.permno, r.feature, r.value) for r in long] == [(1, "a__x__sic2_5", 2.0)]
    with pytest.raises(ValueError):
        X.industry_interactions(panel, [])
    built = X.FeatureBuilder(["a", "b"], ["macro_m"], industry="sic2")
    row = built.transform(panel).orderBy("permno").head().features.toArray()
    assert row.tolist() == [2.0, 0.0, 6.0, 0.0, 2.0, 0.0] and built.n_features == 6
    assert X.interaction_names(["a", "b"], ["s1", "s2"], True) == ["a__x__s1", "b__x__s1", "a__x__s2", "b__x__s2"]


@pytest.fixture(scope="module")
def sample(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(0, 1, (900, 4)) * [1, 2, 0.5, 1] + [0, 3, 0, 1]
    y = x @ [0.5, -0.3, 0.0, 0.0] + 0.2 + draw.normal(0, 0.3, 900)
    rows = [(k, M[k % 4], *map(float, v), float(t), 1.0 + k % 3, ("train", "train", "validation", "test")[k % 4]) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = frame(spark, rows, "permno long, month date, x0 double, x1 double, x2 double, x3 double, y double, market_equity double, split string").cache()
    train = np.array([k % 4 < 2 for k in range(900)])
    return df, x[train], y[train], np.array([1.0 + k % 3 for k in range(900)])[train]


FEATURES = ["x0", "x1", "x2", "x3"]


def test_linear_models_equal_numpy(sample):
    df, x, y, w = sample
    g = linear.gram(df.where("split = 'train'"), FEATURES, "y")
    z, n = (x - x.mean(0)) / x.std(0), len(y)
    design = np.column_stack([np.ones(n), x])
    assert np.allclose([linear.ols(g).intercept, *linear.ols(g).coefficients], np.linalg.lstsq(design, y, rcond=None)[0])
    assert np.allclose(linear.ols(g, intercept=False).coefficients, np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(np.array(linear.ridge(g, 50.0).coefficients) * x.std(0), np.linalg.solve(z.T @ z + 50 * np.eye(4), z.T @ (y - y.mean())))
    weighted = linear.ols(linear.gram(df.where("split = 'train'"), FEATURES, "y", "market_equity"))
    assert np.allclose([weighted.intercept, *weighted.coefficients], np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0])
    full = np.array(linear.ols(g).coefficients)
    assert np.allclose(linear.pls(g, 4).coefficients, full) and np.allclose(linear.pcr(g, 4, 0.0).coefficients, full)
    assert np.allclose(linear.group_lasso(g, [[0, 1], [2, 3]], 0.0).coefficients, full, atol=1e-6)
    sparse = linear.group_lasso(g, [[0], [1], [2], [3]], 0.1).coefficients
    assert sparse[2] == sparse[3] == 0 and sparse[0] > 0.2
    best, curve = linear.ridge_grid(g, df.where("split = 'validation'"), "y")
    rows = curve.orderBy("grid_index").collect()
    top = max(r.validation_r2 for r in rows)
    assert np.allclose(best.coefficients, linear.ridge(g, next(r.alpha for r in rows if r.validation_r2 == top)).coefficients)
    collinear = linear.ols(linear.gram(df.where("split = 'train'").withColumn("x4", F.col("x0") * 2), [*FEATURES, "x4"], "y"))
    assert collinear.coefficients[0] + 2 * collinear.coefficients[4] == pytest.approx(full[0])


def test_elastic_net_huber_equals_a_long_run(sample):
    df, x, y, _ = sample
    z, xi, alpha = (x - x.mean(0)) / x.std(0), float(y.std()), 0.05
    b, a, step = np.zeros(4), y.mean(), 0.2
    for _ in range(20000):
        u = np.clip(y - a - z @ b, -xi, xi)
        a += step * u.mean()
        b = b + step * (z.T @ u / len(y) - alpha * 0.5 * b)
        b = np.sign(b) * np.maximum(np.abs(b) - step * alpha * 0.5, 0)
    fit = linear.elastic_net_huber(df.where("split = 'train'"), FEATURES, "y", alpha=alpha, xi=None, tolerance=1e-13)
    assert np.allclose(np.array(fit.coefficients) * x.std(0), b, atol=1e-5)


def r2_of(model, df):
    return model.predict(df.where("split = 'test'")).agg(E.oos_r2("y", "forecast")).head()[0]


def test_nonlinear_models_find_the_signal(sample):
    df = sample[0]
    train, validation = df.where("split = 'train'"), df.where("split = 'validation'")
    assert r2_of(trees.regression_tree(train, FEATURES, "y", 4, 10), df) > 0.4
    assert r2_of(trees.random_forest(train, FEATURES, "y", numTrees=15, maxDepth=5, minInstancesPerNode=5), df) > 0.4
    assert r2_of(boosting.boosted_huber(train, FEATURES, "y", stages=8, rate=0.5, leaf=5), df) > 0.4
    net = neural.train_network(train, validation, FEATURES, "y", [16], epochs=40, batch=150, rate=0.03)
    assert r2_of(net, df) > 0.6
    ssd = {r.feature: r.ssd for r in net.ssd(df).collect()}
    assert ssd["x0"] > 3 * ssd["x2"] and set(ssd) == set(FEATURES)
    assert r2_of(runs.glm_spline(train, FEATURES, "y"), df) > 0.6


def test_runs_and_test_rows_stay_out_of_training(sample):
    df = sample[0]
    fits = {"ols": runs.models()["ols"], "ridge": runs.models()["ridge"]}
    predictions, metrics = runs.run_models(df, fits, FEATURES, "y")
    assert {r.model: r.test_rows for r in metrics.collect()} == {"ols": 225, "ridge": 225} and predictions.count() == 900
    shuffled = df.withColumn("y", F.when(F.col("split") == "test", -F.col("y")).otherwise(F.col("y")))
    other, _ = runs.run_models(shuffled, fits, FEATURES, "y")
    assert predictions.select("permno", "forecast", "model").exceptAll(other.select("permno", "forecast", "model")).count() == 0
    out = runs.evaluate_on_test(predictions.join(df.select("permno", "market_equity"), "permno"), "y")
    assert out["metrics"].count() == 2 and out["deciles"].count() == 20 and out["spread"].count() == 2
    ensemble = runs.seed_ensemble([predictions.where("model = 'ols'"), predictions.where("model = 'ridge'")])
    assert ensemble.count() == 450 and ensemble.head().n_runs == 2


def test_custom_models_and_prepared_data(spark, sample, tmp_path):
    df = sample[0]
    own = lambda train, validation, test, target, features, config, seed: (test.withColumn("forecast", F.lit(config["value"])), train.agg(F.count("*").alias("n")))
    predictions, metrics = runs.run_custom(own, df, FEATURES, "y", {"value": 0.5})
    assert predictions.count() == 225 and metrics.head().n == 450
    with pytest.raises(ValueError, match="forecast"):
        runs.run_custom(lambda train, validation, test, *rest: (test, None), df, FEATURES, "y")
    split = make_split(train_start="2000-01-01", train_end="2000-01-31", validation_start="2000-02-01", validation_end="2000-02-29", test_start="2000-03-01", test_end="2000-12-31")
    train, validation, test, builder = runs.prepare_model_data(df, split, {"characteristics": FEATURES, "macros": [], "dummies": []})
    assert (train.count(), validation.count(), test.count(), builder.n_features) == (225, 225, 450, 4)
    block = X.interaction_vector(df.withColumn("sic2", F.col("permno") % 3), FEATURES)
    tables.write_interactions(block, f"{tmp_path}/block")
    assert spark.read.parquet(f"{tmp_path}/block").head().interactions.size == 12


def test_importance_of_linear_terms(sample):
    df = sample[0]
    model = linear.ols(linear.gram(df.where("split = 'train'"), FEATURES, "y"))
    rows = {r.feature: r for r in E.drop_importance(model.predict(df), "y", "forecast", model.terms()).collect()}
    without = linear.Linear(("x1", "x2", "x3"), model.coefficients[1:], model.intercept)
    row = E.importance_row("x0", model.predict(df), without.predict(df), "y", "forecast").head()
    assert rows["x0"].importance == pytest.approx(row.importance) and rows["x0"].importance > 0.1


def test_turnover_and_windows(spark):
    rows = [(1, M[0], 1, 1.0), (2, M[0], 1, 1.0), (1, M[1], 1, 3.0), (3, M[1], 1, 1.0), (1, M[3], 1, 1.0)]
    found = Q.turnover(frame(spark, rows, "permno long, month date, bucket int, market_equity double")).collect()
    assert [(r.month, r.turnover) for r in found] == [(M[1], 0.5)]
    assert nan_to_null(frame(spark, [(float("nan"),)], "x double")).head().x is None


def test_rescored_importance_of_a_tree(spark):
    rows = spark.createDataFrame([(float(k % 2), float(k % 7), float(k % 2)) for k in range(200)] + [(None, 1.0, 0.0)], "a double, b double, y double")
    model = trees.regression_tree(rows, ["a", "b"], "y", depth=2, leaf=1)
    found = {r.feature: r for r in E.rescored_importance(model, rows, "y", ["a", "b"]).collect()}
    assert found["a"].baseline_r2 == 1.0 and found["a"].importance == 1.0 and found["b"].importance == 0.0
    assert E.rescored_importance(model, rows.limit(0), "y", ["a", "b"]).count() == 0
