"""Forecast evaluation. Every measure is one aggregate, grouped by model where several are stacked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.nulls import divide, zero
from panelkiln.functions.ordering import cut, exact_quantiles

#: Forecasts that a task makes at once.
_ABLATION_CELLS = 1 << 21


def oos_r2(actual: str, forecast: str, benchmark: float | str = 0.0) -> Column:
    """1 - SSE / SSE of the benchmark; NULL if any actual or forecast is missing."""
    y, f = F.col(actual), F.col(forecast)
    b = F.col(benchmark) if isinstance(benchmark, str) else F.lit(benchmark)
    whole = F.count("*") == F.count(y - f - b * 0)
    return F.when(whole, 1 - divide(F.sum((y - f) * (y - f)), F.sum((y - b) * (y - b))))


def mse(actual: str, forecast: str) -> Column:
    return F.avg((F.col(actual) - F.col(forecast)) * (F.col(actual) - F.col(forecast)))


def mae(actual: str, forecast: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(forecast)))


def weighted_loss(actual: str, forecast: str, weight: str) -> Column:
    """Sum of weighted squared errors over the number of rows."""
    u = F.col(actual) - F.col(forecast)
    return F.sum(F.col(weight) * u * u) / F.count("*")


def information_coefficient(df: DataFrame, actual: str, forecast: str, date: str = "month", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over months of the correlation across assets."""
    monthly = df.groupBy(*by, date).agg(F.corr(actual, forecast).alias("ic"))
    return monthly.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_months"))


def calibration(df: DataFrame, actual: str, forecast: str, fit_on: str = "split = 'validation'", by: tuple[str, ...] = ()) -> DataFrame:
    """Slope and intercept of actual on forecast over the rows that `fit_on` selects."""
    return df.where(fit_on).groupBy(*by).agg(F.regr_slope(actual, forecast).alias("slope"), F.regr_intercept(actual, forecast).alias("intercept"))


def calibrated(df: DataFrame, actual: str, forecast: str, fit_on: str = "split = 'validation'", by: tuple[str, ...] = (), output: str = "calibrated") -> DataFrame:
    """Forecasts on the line fitted on validation rows."""
    line = F.broadcast(calibration(df, actual, forecast, fit_on, by))  # a row for each model
    joined = df.join(line, list(by)) if by else df.crossJoin(line)
    return joined.withColumn(output, F.col("intercept") + F.col("slope") * F.col(forecast)).drop("slope", "intercept")


def loss_difference(actual: str, a: str, b: str) -> Column:
    """Squared error of a less that of b."""
    y = F.col(actual)
    return (y - F.col(a)) * (y - F.col(a)) - (y - F.col(b)) * (y - F.col(b))


def t_stat(value: Column) -> Column:
    """Mean over its standard error; NULL for fewer than two values or none that differ."""
    return divide(F.avg(value), F.stddev_samp(value) / F.sqrt(F.count(value).cast("double")))


def newey_west(series: DataFrame, value: str, date: str = "month", lags: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, long-run standard error with Bartlett weights and their ratio, for each group's series of one row a month."""
    group = Window.partitionBy(*(by or (F.lit(1),)))
    order = group.orderBy(date)
    centred = series.where(F.col(value).isNotNull()).withColumn("__u", F.col(value) - F.avg(value).over(group))
    products = centred.select(*by, value, "__u", *((F.col("__u") * F.lag("__u", k).over(order)).alias(f"__p{k}") for k in range(1, lags + 1)))
    variance = F.sum(F.col("__u") * F.col("__u"))
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__p{k}"), F.lit(0.0))
    n = F.count(value).cast("double")
    out = products.groupBy(*by).agg(F.avg(value).alias("mean_diff"), F.count(value).alias("n_months"), F.when(variance > 0, F.sqrt(variance / (n * n))).alias("nw_se"))
    return out.withColumn("dm_stat", divide(F.col("mean_diff"), F.col("nw_se")))


def dm_pairs(predictions: DataFrame, actual: str, keys: tuple[str, str] = ("permno", "month")) -> DataFrame:
    """model_a, model_b, month, diff: the mean error difference of every pair of models in each month.

    Models are put side by side in one map a key, so that pairs need no self-join of the predictions.
    """
    asset, date = keys
    errors = predictions.groupBy(asset, date).agg(F.array_sort(F.collect_list(F.struct("model", ((F.col(actual) - F.col("forecast")) * (F.col(actual) - F.col("forecast"))).alias("e")))).alias("m"))
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.model AS model_a, y.model AS model_b, x.e - y.e AS d))))")
    return errors.select(date, F.explode(pairs).alias("p")).groupBy("p.model_a", "p.model_b", date).agg(F.avg("p.d").alias("diff"))


def dm_matrix(predictions: DataFrame, actual: str, lags: int = 12, keys: tuple[str, str] = ("permno", "month")) -> DataFrame:
    return newey_west(dm_pairs(predictions, actual, keys), "diff", keys[1], lags, ("model_a", "model_b"))


def drop_importance(df: DataFrame, actual: str, forecast: str, terms: dict[str, Column]) -> DataFrame:
    """feature, baseline_r2, ablated_r2, importance: R2 lost when a term leaves a linear forecast; all terms in one pass.

    terms: name to what it adds to the forecast (the raw coefficient times the predictor, or a sum for a group).
    """
    y, f = F.col(actual), F.col(forecast)
    sums = df.agg(F.sum(y * y).alias("y2"), F.sum((y - f) * (y - f)).alias("base"), *(F.sum((y - f + t) * (y - f + t)).alias(f"e_{i}") for i, t in enumerate(terms.values())))
    rows = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(f"e_{i}").alias("e")) for i, k in enumerate(terms)))
    long = sums.select("y2", "base", F.explode(rows).alias("r"))
    base, ablated = 1 - divide(F.col("base"), F.col("y2")), 1 - divide(F.col("r.e"), F.col("y2"))
    return long.select("r.feature", base.alias("baseline_r2"), ablated.alias("ablated_r2"), (base - ablated).alias("importance"))


def importance_row(feature: str, baseline: DataFrame, ablated: DataFrame, actual: str, forecast: str) -> DataFrame:
    """The same for any model: its forecasts before and after the feature was set to 0."""
    a, b = (x.agg(oos_r2(actual, forecast).alias(n)) for x, n in ((baseline, "baseline_r2"), (ablated, "ablated_r2")))
    both = a.crossJoin(b)  # one row each
    return both.select(F.lit(feature).alias("feature"), "baseline_r2", "ablated_r2", (F.col("baseline_r2") - F.col("ablated_r2")).alias("importance"))


def rescored_importance(model, panel: DataFrame, target: str, features: list[str]) -> DataFrame:
    """feature, baseline_r2, ablated_r2, importance of any fitted model: its forecasts are made anew with the feature set to 0.

    Each row is scored once as it is and once for each feature, all in one plan and one aggregate.
    """
    long = panel.withColumn("__without", F.explode(F.array(F.lit(""), *map(F.lit, features))))
    changed = long.select(*(F.when(F.col("__without") == c, 0.0).otherwise(F.col(c)).alias(c) if c in features else F.col(c) for c in long.columns))
    scored = model.predict(changed, "__forecast").groupBy("__without").agg(oos_r2(target, "__forecast").alias("r2")).agg(F.map_from_entries(F.collect_list(F.struct("__without", "r2"))).alias("r2"))
    each = scored.select(F.element_at("r2", F.lit("")).alias("baseline_r2"), F.explode("r2").alias("feature", "ablated_r2")).where("feature <> ''")
    return each.select("feature", "baseline_r2", "ablated_r2", (F.col("baseline_r2") - F.col("ablated_r2")).alias("importance"))


def ablation_importance(model, panel: DataFrame, target: str, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """The same for networks and boosted trees, by feature or by named groups of features, without a copied row.

    Each row is read once and scored for all ablations together by the model's `ablated`; tasks add up the squared errors. As with
    `oos_r2` the measures are NULL if a target is missing.
    """
    names = list(groups) if groups else list(model.features)
    columns = [[model.features.index(c) for c in (groups[n] if groups else [n])] for n in names]
    p, k = len(model.features), len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + 1)
        for batch in batches:
            for s in range(0, batch.num_rows, max(1, _ABLATION_CELLS // k)):
                part = batch.slice(s, max(1, _ABLATION_CELLS // k))
                y = part.column(p).to_numpy(zero_copy_only=False)
                raw = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(p)], axis=1)
                errors = model.ablated(raw, columns) - y[:, None]
                total += np.append((errors * errors).sum(axis=0), (y * y).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), pa.array(total)], ["cell", "v"])

    rows = panel.select(*(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(model.features)), F.coalesce(F.col(target).cast("double"), F.lit(float("nan"))).alias("y"))
    sums = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("sums"))
    def of(cell: Column) -> Column:
        return F.element_at("sums", cell.cast("long"))

    def r2(cell: Column) -> Column:
        return F.nanvl(1 - divide(of(cell), of(F.lit(k))), F.lit(None).cast("double"))

    entries = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(i + 1).alias("i")) for i, n in enumerate(names)))
    each = sums.where(F.size("sums") > 0).select("sums", F.explode(entries).alias("e")).select("e.feature", r2(F.lit(0)).alias("baseline_r2"), r2(F.col("e.i")).alias("ablated_r2"))
    return each.select("feature", "baseline_r2", "ablated_r2", (F.col("baseline_r2") - F.col("ablated_r2")).alias("importance"))


def sample_summary(panel: DataFrame, date: str = "month", asset: str = "permno", industry: str = "sic2") -> DataFrame:
    monthly = panel.groupBy(date).agg(F.count("*").alias("n"), F.countDistinct(industry).alias("k"))
    whole = panel.agg(F.count("*").alias("n_rows"), F.countDistinct(asset).alias("n_assets"), F.min(date).alias("first_month"), F.max(date).alias("last_month"))
    return whole.crossJoin(monthly.agg(F.avg("n").alias("mean_assets"), F.avg("k").alias("mean_industries"), F.count("*").alias("n_months")))  # one row each


def missing_rates(panel: DataFrame, columns: list[str], families: dict[str, str] | None = None) -> DataFrame:
    """feature (and family), missing_rate."""
    rates = panel.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit((families or {}).get(c, "all")).alias("family"), F.col(c).alias("missing_rate")) for c in columns))
    return rates.select(F.explode(rows).alias("r")).select("r.*")


def distribution(panel: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """feature, n, mean, sd and exact percentiles: one pass for all columns, without a group's values in one task."""
    held = cut(panel.select(*columns))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(i).alias("i"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")) for i, c in enumerate(columns)))
    stats = held.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    found = stats.join(exact_quantiles(held, columns, shares), F.col("i") == F.col("__column"), "left")
    return found.select("feature", "n", "mean", "sd", *(F.col("__q")[i].alias(f"p{round(100 * s)}") for i, s in enumerate(shares)))


def r2_to_sharpe(sharpe: Column, r2: Column) -> Column:
    """The Sharpe ratio that a forecast of this R2 can reach from one of a constant position."""
    return F.sqrt(divide(sharpe * sharpe + r2, 1 - r2))


def sign_restricted(panel: DataFrame, target: str, predictor: str, sign: int, date: str = "month", asset: str = "permno", least: int = 12) -> DataFrame:
    """Recursive one-predictor forecasts of a target that is known one row later.

    At each row the regression uses the asset's earlier rows only. A slope of the wrong sign, or none, gives the mean of
    the earlier targets instead, and so do fewer than `least` earlier rows. An asset's first row has no forecast.
    """
    past = Window.partitionBy(asset).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    slope, level = F.regr_slope(target, predictor).over(past), F.avg(target).over(past)
    rows = panel.select("*", slope.alias("__b"), F.regr_intercept(target, predictor).over(past).alias("__a"), level.alias("hist_mean"))
    rows = rows.withColumn("__n", F.count("*").over(past))
    fitted = F.when((F.col("__n") >= least) & (F.col("__b") * sign > 0), F.col("__a") + F.col("__b") * F.col(predictor)).otherwise(F.col("hist_mean"))
    return rows.withColumn("restricted", fitted).drop("__a", "__b", "__n")
