"""Fitting, stacking and evaluating several models on one split panel."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.operators import boosting, linear, neural, trees
from panelkiln.operators.evaluate import calibrated, information_coefficient, mae, mse, oos_r2
from panelkiln.operators.features import FeatureBuilder, assemble, spline_basis, spline_knots
from panelkiln.operators.panel import first_rows
from panelkiln.operators.portfolio import assign_deciles, long_short, sharpe, value_weighted
from panelkiln.operators.splits import TimeSplit, apply_split
from panelkiln.sources.schema import roles
from panelkiln.sources.tables import stored

OLS3 = ("mvel1", "bm", "mom12m")


class Model(Protocol):
    """Anything fitted that adds a forecast column."""

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame: ...


#: train, validation, features, target to a fitted model.
Fit = Callable[[DataFrame, DataFrame, list[str], str], Model]


class SparkEstimator:
    """Any pyspark.ml estimator as a model of this library; numeric and vector features become one vector column."""

    def __init__(self, estimator: Estimator, features: list[str]):
        self.estimator, self.features, self.model = estimator, features, None

    def _assembled(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        vectors = [c for c in self.features if kinds[c] == "vector"]
        return assemble(df, [c for c in self.features if c not in vectors], vectors, "__features")

    def fit(self, train: DataFrame, target: str) -> SparkEstimator:
        rows = self._assembled(train.where(F.col(target).isNotNull())).withColumn("__label", F.col(target))
        self.model = self.estimator.copy({self.estimator.featuresCol: "__features", self.estimator.labelCol: "__label"}).fit(rows)
        return self

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        return self.model.transform(self._assembled(df)).withColumn(output, F.col("prediction")).drop("prediction", "__features")


class _Splined:
    def __init__(self, inner: linear.Linear, features: list[str], knots: dict[str, list[float]]):
        self.inner, self.features, self.knots = inner, features, knots

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        wide = spline_basis(df, self.features, self.knots)
        return self.inner.predict(wide, output).select(*df.columns, output)


def glm_spline(train: DataFrame, features: list[str], target: str, n_knots: int = 3, penalty: float = 1e-3, knots: dict[str, list[float]] | None = None) -> _Splined:
    """Quadratic splines of every feature with a group penalty that drops whole features; knots at quantiles, or as given."""
    knots = knots or spline_knots(train, features, n_knots)
    names = [n for c in features for n in (c, *(f"{c}_sq{i}" for i in range(len(knots[c]))))]
    groups = [[k for k, n in enumerate(names) if n == c or n.startswith(f"{c}_sq")] for c in features]
    fit = linear.group_lasso(linear.gram(spline_basis(train, features, knots), names, target), groups, penalty)
    return _Splined(fit, features, knots)


def models(small: tuple[str, ...] = OLS3) -> dict[str, Fit]:
    """The named model families with their settings."""
    def by_gram(f) -> Fit:
        return lambda train, _, features, target: f(linear.gram(train, features, target))

    def network(widths: list[int]) -> Fit:
        return lambda train, validation, features, target: neural.train_network(train, validation, features, target, widths)

    return {
        "ols": by_gram(linear.ols), "ols3": lambda train, _, features, target: linear.ols(linear.gram(train, [c for c in features if c in small], target)), "ridge": by_gram(linear.ridge),
        "enet_huber": lambda train, _, features, target: linear.elastic_net_huber(train, features, target), "pcr": by_gram(linear.pcr), "pls": by_gram(linear.pls),
        "glm": lambda train, _, features, target: glm_spline(train, features, target), "rf": lambda train, _, features, target: trees.random_forest(train, features, target),
        "gbrt_huber": lambda train, _, features, target: boosting.boosted_huber(train, features, target), **{k: network(w) for k, w in neural.WIDTHS.items()},
    }


def fit_and_predict(name: str, fit: Fit, panel: DataFrame, features: list[str], target: str) -> DataFrame:
    """Validation and test rows of a split panel with the model's forecast and name."""
    train, validation = panel.where("split = 'train'"), panel.where("split = 'validation'")
    model = fit(train, validation, features, target)
    return model.predict(panel.where("split <> 'train'")).withColumn("model", F.lit(name))


def run_models(panel: DataFrame, fits: dict[str, Fit], features: list[str], target: str, keys: tuple[str, ...] = ("month", "permno")) -> tuple[DataFrame, DataFrame]:
    """Long predictions (keys, target, forecast, model, split) and one row of metrics for each model."""
    out = None
    for name, fit in fits.items():
        part = fit_and_predict(name, fit, panel, features, target).select(*keys, F.col(target), F.col("forecast").cast("double").alias("forecast"), "model", "split")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no models")
    return out, model_metrics(out, target)


def model_metrics(predictions: DataFrame, target: str) -> DataFrame:
    """model, test_rows, test_oos_r2, validation_oos_r2 from stacked predictions, one aggregate."""
    by_split = predictions.groupBy("model", "split").agg(F.count("*").alias("n"), oos_r2(target, "forecast").alias("r2"))
    def of(split: str, column: str):
        return F.max(F.when(F.col("split") == split, F.col(column)))

    return by_split.groupBy("model").agg(F.coalesce(of("test", "n"), F.lit(0)).alias("test_rows"), of("test", "r2").alias("test_oos_r2"), of("validation", "r2").alias("validation_oos_r2"))


def seed_ensemble(runs: list[DataFrame], keys: tuple[str, ...] = ("month", "permno")) -> DataFrame:
    """The mean forecast of several runs."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy(*keys).agg(F.avg("forecast").alias("forecast"), F.count("*").alias("n_runs"))


def evaluate_on_test(predictions: DataFrame, target: str, weight: str = "market_equity", by: tuple[str, ...] = ("model",)) -> dict[str, DataFrame]:
    """Raw and calibrated R2, MSE, MAE and mean IC on test rows, the decile table and the spread's performance, and the predictions.

    The predictions are stored first: all results read them from there, so that what they are made from is made once.
    """
    predictions = stored(predictions)
    both = calibrated(predictions, target, "forecast", by=by).where("split = 'test'")
    metrics = both.groupBy(*by).agg(*(f(target, c).alias(f"{n}_{k}") for k, c in (("raw", "forecast"), ("calibrated", "calibrated")) for n, f in (("r2", oos_r2), ("mse", mse), ("mae", mae))))
    metrics = metrics.join(information_coefficient(both, target, "forecast", by=by), list(by))
    # Buckets are formed inside each model and month: the pair is one partition key.
    cell = both.withColumn("__cell", F.concat_ws("/", *by, F.col("month").cast("string")))
    portfolios = value_weighted(assign_deciles(cell, date="__cell"), target, weight, (*by, "month", "bucket"))
    deciles = portfolios.groupBy(*by, "bucket").agg(F.avg("portfolio_return").alias("mean_return"), sharpe(F.col("portfolio_return")).alias("sharpe"))
    spread = long_short(portfolios, by=(*by, "month")).groupBy(*by).agg(F.avg("long_short").alias("mean_spread"), sharpe(F.col("long_short")).alias("sharpe"))
    return {"metrics": metrics, "deciles": deciles, "spread": spread, "predictions": predictions}


def run_custom(function: Callable, panel: DataFrame, features: list[str], target: str, config: dict | None = None, seed: int = 1, keys: tuple[str, ...] = ("month", "permno")) -> tuple[DataFrame, DataFrame]:
    """A user's own `function(train, validation, test, target, features, config, seed)` on the three parts of a split panel.

    It returns predictions with the keys, the target and a forecast, and any metrics. The keys are checked.
    """
    parts = (panel.where(F.col("split") == p) for p in ("train", "validation", "test"))
    predictions, metrics = function(*parts, target, features, config or {}, seed)
    if missing := sorted({*keys, target, "forecast"} - set(predictions.columns)):
        raise ValueError(f"predictions lack {', '.join(missing)}")
    return predictions, metrics


def prepare_model_data(panel: DataFrame, split: TimeSplit, manifest: dict[str, list[str]] | None = None, sample_rows: int | None = None, interactions: bool = True, industry: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, FeatureBuilder]:
    """train, validation and test rows of a panel and the builder of their feature vectors."""
    rows = apply_split(panel if sample_rows is None else first_rows(panel, sample_rows), split)
    own = manifest or roles(panel)
    builder = FeatureBuilder(own["characteristics"], own["macros"], own["dummies"], interactions, industry)
    train, validation, test = (rows.where(F.col("split") == p) for p in ("train", "validation", "test"))
    return train, validation, test, builder
