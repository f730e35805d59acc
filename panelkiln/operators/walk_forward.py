"""Refits along the years: every fold of a walk-forward from one pass over the panel.

Sums of products add up over years. The pass sums them by year, a fold's training and validation sums are those of its
years, and each fold is fitted and its penalty chosen from them on the driver, without another look at the rows. Forecasts come from a join with a row of
coefficients for each fold and test year. The driver holds a matrix of sums for each calendar year, of at most MOST_FEATURES features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.nulls import zero
from panelkiln.operators.linear import Gram, Linear, ols, ridge
from panelkiln.operators.splits import TimeSplit

MOST_FEATURES = 500


def _year_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            years = batch.column(width).to_numpy()
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
            for year in np.unique(years).tolist():
                own = x[years == year]
                totals[year] = totals.get(year, 0.0) + own.T @ own
        for year, total in totals.items():
            at = np.flatnonzero(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), year, np.int32)), pa.array(at), pa.array(total.ravel()[at])], ["year", "cell", "v"])

    return run


def yearly_grams(panel: DataFrame, features: list[str], target: str, date: str = "month") -> dict[int, np.ndarray]:
    """By year the sums over rows with a date and a target of (1, features, target) times itself."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    width = len(features) + 2
    known = panel.where(F.col(target).isNotNull() & F.col(date).isNotNull())
    rows = known.select(F.lit(1.0).alias("c"), *(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y"), F.year(date).alias("year"))
    sums = rows.mapInArrow(_year_batches(width), "year int, cell long, v double").groupBy("year", "cell").agg(F.sum("v").alias("v")).toArrow()
    years, cells, values = (c.to_numpy() for c in sums.columns)
    out = {}
    for year in np.unique(years).tolist():
        own = np.zeros(width * width)
        own[cells[years == year]] = values[years == year]
        out[year] = own.reshape(width, width)
    return out


def _sum(grams: dict[int, np.ndarray], first: int, last: int) -> np.ndarray | None:
    own = [g for year, g in grams.items() if first <= year <= last]
    return sum(own) if own else None


def validation_r2(fit: Linear, cells: np.ndarray | None) -> float | None:
    """1 - SSE / sum of squared targets, from the products alone; None without validation rows or variation."""
    if cells is None or cells[-1, -1] == 0:
        return None
    b = np.array([fit.intercept, *fit.coefficients, -1.0])
    return float(1 - b @ cells @ b / cells[-1, -1])


def walk_forward(panel: DataFrame, splits: list[TimeSplit], features: list[str], target: str, alphas: tuple[float, ...] = (0.0,), date: str = "month") -> tuple[DataFrame, DataFrame]:
    """Test rows with fold and forecast, and what each fold chose: fold, alpha, validation_r2, train_rows.

    An alpha of 0 is least squares. Of several alphas a fold takes the one with the best validation R2, the first of equals. Folds
    are windows of whole years; one without training rows has no forecasts. A row in the test years of several folds gets one row for each.
    """
    for s in splits:
        if any((d.month, d.day) != (1, 1) for _, d, _ in s.bounds()) or any((d.month, d.day) != (12, 31) for _, _, d in s.bounds()):
            raise ValueError("walk-forward windows are whole years")
    grams = yearly_grams(panel, features, target, date)
    rows, choices = [], []
    for fold, s in enumerate(splits):
        train = _sum(grams, s.train_start.year, s.train_end.year)
        if train is None:
            continue
        held, g = _sum(grams, s.validation_start.year, s.validation_end.year), Gram(tuple(features), train)
        fits = [ridge(g, a) if a else ols(g) for a in alphas]
        scores = [validation_r2(f, held) for f in fits]
        best = max(range(len(fits)), key=lambda i: (scores[i] is not None, scores[i] or 0.0, -i))
        choices.append((fold, float(alphas[best]), scores[best], int(round(g.n))))
        rows += [(fold, year, float(alphas[best]), fits[best].intercept, list(fits[best].coefficients)) for year in range(s.test_start.year, s.test_end.year + 1)]
    spark = panel.sparkSession
    fitted = spark.createDataFrame(rows, "fold int, __year int, alpha double, __intercept double, __b array<double>")
    total = F.col("__intercept")
    for i, c in enumerate(features):
        total = total + F.col("__b")[i] * zero(c)
    joined = panel.withColumn("__year", F.year(date)).join(F.broadcast(fitted), "__year")  # a row for each fold and test year
    forecasts = joined.withColumn("forecast", total).drop("__year", "__intercept", "__b")
    return forecasts, spark.createDataFrame(choices, "fold int, alpha double, validation_r2 double, train_rows long")
