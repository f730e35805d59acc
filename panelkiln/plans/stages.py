"""The model families as pipeline stages that can be fitted, saved and read back.

A fitted stage keeps what its forecasts need: Spark's own models as Spark saves them, every other family as one JSON text
of names and numbers, whose size is that of the model.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.operators import boosting, forest, linear, neural, trees, vector_models
from panelkiln.plans import runs


def to_state(model) -> dict[str, Any]:
    """A fitted model as names and numbers; Spark's own models are not among them."""
    if isinstance(model, linear.Linear):
        return {"kind": "linear", "features": list(model.features), "coefficients": list(model.coefficients), "intercept": model.intercept}
    if isinstance(model, vector_models.VectorLinear):
        return {"kind": "vector", "column": model.column, "coefficients": list(model.coefficients), "intercept": model.intercept}
    if isinstance(model, neural.Network):
        return {"kind": "network", "features": list(model.features), "scale": {c: list(v) for c, v in model.scale.items()}, "weights": [w.tolist() for w in model.weights]}
    if isinstance(model, boosting.BoostedTrees):
        t = model.trees
        grown = {"depth": t.depth, "feature": t.feature.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist()}
        return {"kind": "boosted", "features": list(model.features), "edges": [e.tolist() for e in model.edges], "start": model.start, "rate": model.rate, "trees": grown, "loss": model.loss}
    if isinstance(model, forest.Forest):
        return {"kind": "forest", "features": list(model.features), "edges": [e.tolist() for e in model.edges], "depth": model.depth, "feature": model.feature.tolist(), "cut": model.cut.tolist(), "value": model.value.tolist()}
    if isinstance(model, runs._Splined):
        return {"kind": "spline", "inner": to_state(model.inner), "features": model.features, "knots": model.knots}
    raise TypeError(f"{type(model).__name__} can't be saved")


def from_state(s: dict[str, Any]):
    if s["kind"] == "linear":
        return linear.Linear(tuple(s["features"]), tuple(s["coefficients"]), s["intercept"])
    if s["kind"] == "vector":
        return vector_models.VectorLinear(s["column"], tuple(s["coefficients"]), s["intercept"])
    if s["kind"] == "network":
        return neural.Network(s["features"], {c: tuple(v) for c, v in s["scale"].items()}, [np.array(w) for w in s["weights"]])
    if s["kind"] == "boosted":
        t = s["trees"]
        inner, leaves = (1 << t["depth"]) - 1, 1 << t["depth"]
        grown = boosting.Trees(t["depth"], np.array(t["feature"], np.int64).reshape(-1, inner), np.array(t["cut"], np.int64).reshape(-1, inner), np.array(t["value"], float).reshape(-1, leaves))
        return boosting.BoostedTrees(s["features"], [np.array(e) for e in s["edges"]], s["start"], s["rate"], grown, s["loss"])
    if s["kind"] == "forest":
        inner = (1 << s["depth"]) - 1
        return forest.Forest(s["features"], [np.array(e) for e in s["edges"]], s["depth"], *(np.array(s[c], np.int64).reshape(-1, inner) for c in ("feature", "cut")), np.array(s["value"], float).reshape(-1, 2 * inner + 1))
    if s["kind"] == "spline":
        return runs._Splined(from_state(s["inner"]), s["features"], s["knots"])
    raise ValueError(f"unknown kind {s['kind']}")


class _Settings(Params):
    """family: a name of `runs.models`; split: the column that marks rows as train or validation."""

    family = Param(Params._dummy(), "family", "model family", typeConverter=TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature columns", typeConverter=TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "target column", typeConverter=TypeConverters.toString)
    split = Param(Params._dummy(), "split", "column that marks the parts; without it all rows train", typeConverter=TypeConverters.toString)
    output = Param(Params._dummy(), "output", "forecast column", typeConverter=TypeConverters.toString)


class PanelRegressor(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Any model family as an estimator. Validation rows, where the split column marks some, serve early stopping."""

    @keyword_only
    def __init__(self, *, family: str = "ols", features: list[str] | None = None, target: str = "ret_excess_lead1", split: str = "", output: str = "forecast"):
        super().__init__()
        self._setDefault(family="ols", target="ret_excess_lead1", split="", output="forecast")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PanelRegressionModel:
        families, name = runs.models(), self.getOrDefault("family")
        if name not in families:
            raise ValueError(f"family is one of {', '.join(families)}")
        column = self.getOrDefault("split")
        train, validation = (dataset.where(F.col(column) == p) for p in ("train", "validation")) if column else (dataset, dataset.limit(0))
        fitted = families[name](train, validation, self.getOrDefault("features"), self.getOrDefault("target"))
        return self._copyValues(PanelRegressionModel(fitted))


class PanelRegressionModel(Model, _Settings, MLReadable, MLWritable):
    """A fitted family; `fitted` is the library's own model."""

    def __init__(self, fitted=None):
        super().__init__()
        self._setDefault(output="forecast")
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset, self.getOrDefault("output"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: PanelRegressionModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        fitted, spark = self.instance.fitted, self.sparkSession
        own = isinstance(fitted, trees.Forecaster)
        state = {"kind": "spark", "features": fitted.features, "class": f"{type(fitted.model).__module__}.{type(fitted.model).__name__}"} if own else to_state(fitted)
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")
        if own:
            fitted.model.save(f"{path}/inner")


class _Reader(MLReader):
    def __init__(self, kind: type[PanelRegressionModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> PanelRegressionModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.kind.__module__}.{self.kind.__name__}")
        state = json.loads(self.sparkSession.read.text(f"{path}/state", wholetext=True).head()[0])
        fitted = trees.Forecaster(DefaultParamsReader.loadParamsInstance(f"{path}/inner", self.sparkSession), state["features"]) if state["kind"] == "spark" else from_state(state)
        out = self.kind(fitted)
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out
