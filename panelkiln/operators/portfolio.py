"""Forecast-sorted portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.nulls import divide
from panelkiln.functions.ordering import positions
from panelkiln.functions.ranks import quantile_bucket


def assign_deciles(panel: DataFrame, forecast: str = "forecast", date: str = "month", asset: str = "permno", buckets: int = 10, output: str = "bucket", spread: bool = False) -> DataFrame:
    """Equal-frequency buckets of the forecasts of each month; ties in the order of the assets.

    With `spread` a month of any size goes over all tasks instead of one.
    """
    if not spread:
        return panel.withColumn(output, F.when(F.col(date).isNotNull(), quantile_bucket(forecast, date, asset, buckets)))
    known = F.col(date).isNotNull() & F.col(forecast).isNotNull()
    placed = positions(panel.withColumn("__known", known), [date, "__known"], [forecast, asset], "__place", "__size")
    steps = ((F.col("__place") - 1) * buckets + F.col("__size") - 2) / F.nullif(F.col("__size") - 1, F.lit(0))
    bucket = F.when(F.col("__known") & (F.col("__size") > 1), F.greatest(F.lit(1), F.floor(steps).cast("int")))
    return placed.withColumn(output, bucket).drop("__known", "__place", "__size")


def value_weighted(panel: DataFrame, ret: str, weight: str, by: tuple[str, ...] = ("month", "bucket")) -> DataFrame:
    """Sum of return times weight over the sum of weights; missing returns leave their weight in. Null groups go."""
    for c in by:
        panel = panel.where(F.col(c).isNotNull())
    total = F.coalesce(F.sum(F.col(ret) * F.col(weight)), F.lit(0.0))
    return panel.groupBy(*by).agg(divide(total, F.sum(weight)).alias("portfolio_return"))


def long_short(portfolios: DataFrame, top: int = 10, bottom: int = 1, by: tuple[str, ...] = ("month",)) -> DataFrame:
    """The top bucket's return less the bottom one's; NULL where one is missing."""
    def of(k: int) -> Column:
        return F.max(F.when(F.col("bucket") == k, F.col("portfolio_return")))

    return portfolios.groupBy(*by).agg((of(top) - of(bottom)).alias("long_short"))


def sharpe(returns: Column, periods: int = 12) -> Column:
    """Annualised; NULL if the returns do not vary or are fewer than two."""
    return F.sqrt(F.lit(float(periods))) * divide(F.avg(returns), F.stddev_samp(returns))


def decile_performance(portfolios: DataFrame, by: tuple[str, ...] = (), periods: int = 12) -> DataFrame:
    """Mean, annualised volatility and Sharpe ratio of each bucket."""
    r = F.col("portfolio_return")
    return portfolios.groupBy(*by, "bucket").agg(F.avg(r).alias("mean_return"), (F.stddev_samp(r) * periods**0.5).alias("volatility"), sharpe(r, periods).alias("sharpe"))


def monotonicity(performance: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of adjacent buckets whose mean rises, and the correlation of bucket and mean."""
    order = Window.partitionBy(*(by or (F.lit(1),))).orderBy("bucket")  # ten rows for each group
    step = performance.withColumn("rise", (F.col("mean_return") > F.lag("mean_return").over(order)).cast("double"))
    return step.groupBy(*by).agg(F.avg("rise").alias("share_rising"), F.corr("bucket", "mean_return").alias("bucket_corr"))


def turnover(panel: DataFrame, weight: str = "market_equity", date: str = "month", asset: str = "permno") -> DataFrame:
    """Half the sum of changes of portfolio weights from one month to the next, by month and bucket.

    An asset's weight in a bucket is 0 where it is not held. The previous month is the one right before by calendar.
    """
    held = panel.where(F.col("bucket").isNotNull()).select(asset, date, "bucket", F.col(weight).alias("w"))
    held = held.withColumn("w", divide(F.col("w"), F.sum("w").over(Window.partitionBy(date, "bucket"))))
    before = held.select(asset, F.last_day(F.add_months(date, 1)).alias(date), "bucket", F.col("w").alias("w_before"))
    both = held.join(before, [asset, date, "bucket"], "full")
    known = held.select(date, "bucket").distinct().join(before.select(date, "bucket").distinct(), [date, "bucket"])
    change = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w_before", F.lit(0.0)))
    return both.join(known, [date, "bucket"], "left_semi").groupBy(date, "bucket").agg((F.sum(change) / 2).alias("turnover"))


def timing(forecast: Column, k: float = 1.0, cap: float = 1.5) -> Column:
    """A position that grows with the forecast, without shorts and with leverage up to the cap."""
    return F.least(F.greatest(k * forecast, F.lit(0.0)), F.lit(cap))


def positive_part(forecast: Column) -> Column:
    return F.greatest(F.lit(0.0), forecast)
