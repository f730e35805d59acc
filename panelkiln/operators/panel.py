"""The model panel: one row for each asset and month, with the next month's excess return as its target.

Two exchanges of the long tables: the lead needs all rows of an asset, and the characteristics join needs asset and
month. Tables with one row a month are small by nature (700 rows for 60 years) and left to Spark's size-checked
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkiln.functions.nulls import nan_to_null
from panelkiln.functions.ordering import cut, exact_quantiles, positions
from panelkiln.sources.schema import MACROS, raw_characteristics

FACTORS = ("rf", "mktrf", "smb", "hml", "rmw", "cma", "umd")


def yyyymm(date: str = "month") -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def market_equity(price: str = "prc", shares: str = "shrout") -> Column:
    """Prices may be negative (bid-ask means)."""
    return F.abs(F.col(price)) * F.col(shares)


def sic2(code: str = "siccd") -> Column:
    return F.floor(F.col(code) / 100).cast("int")


def one_hot(df: DataFrame, column: str = "sic2", codes: list[int] | None = None, prefix: str = "sic2_") -> DataFrame:
    """A 0/1 column for each code (all that occur, if none are given), in one projection."""
    if codes is None:
        codes = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(10_001).collect())
        if len(codes) > 10_000:
            raise ValueError("more than 10000 codes")
    return df.select("*", *(F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)).alias(f"{prefix}{c}") for c in codes))


def with_targets(returns: DataFrame, macros: DataFrame, factors: DataFrame) -> DataFrame:
    """Excess returns and their lead; rows whose asset has no row in the very next month go.

    The lead sees every return row, also those that later joins drop.
    """
    rows = returns.withColumn("month", F.last_day(F.to_date("month")))
    rows = rows.withColumn("yyyymm", yyyymm())
    rows = rows.join(macros.select("yyyymm", "rf_welch_goyal"), "yyyymm", "left")
    rows = rows.join(factors.select("yyyymm", F.col("rf").alias("rf_ff"), *FACTORS[1:]), "yyyymm", "left")
    ahead = Window.partitionBy("permno").orderBy("month")
    rows = rows.withColumn("ret_excess", F.col("ret") - F.col("rf_welch_goyal"))
    rows = rows.select("*", F.lead("ret_excess").over(ahead).alias("ret_excess_lead1"), F.lead("month").over(ahead).alias("next_month"))
    return rows.where(F.col("next_month") == F.last_day(F.add_months("month", 1)))


def drop_incomplete(panel: DataFrame, characteristics: list[str], target: str = "ret_excess_lead1", missing: str = "drop", date: str = "month") -> DataFrame:
    """Rows without target go; rows with a missing characteristic go too, or get its median of the month."""
    panel = panel.where(F.col(target).isNotNull())
    if missing == "drop":
        return panel.na.drop(subset=characteristics)
    if missing != "median":
        raise ValueError("missing is drop or median")
    return median_impute(panel, characteristics, date)


def median_impute(panel: DataFrame, columns: list[str], date: str = "month") -> DataFrame:
    """Missing values get the median of their month, found in one range exchange of all columns and joined back on the month.

    The panel is stored once and read from there, so that it isn't built anew for each use.
    """
    panel = cut(panel)
    found = exact_quantiles(panel.where(F.col(date).isNotNull()), columns, (0.5,), [date])
    medians = found.groupBy(date).agg(*(F.max(F.when(F.col("__column") == i, F.col("__q")[0])).alias(f"__{c}") for i, c in enumerate(columns)))
    filled = panel.join(medians, date, "left")
    return filled.select(*(F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in panel.columns))


def build_panel(raw: dict[str, DataFrame], missing: str = "drop", rows: int | None = None) -> DataFrame:
    """The panel from the five raw tables. rows: only the first so many in order of month and asset."""
    returns, chars, industry, macros, factors = (nan_to_null(raw[k]) for k in ("stock_returns", "stock_characteristics", "industry_dummies", "welch_goyal_macros", "fama_french_factors"))
    names = raw_characteristics(chars)
    panel = with_targets(returns, macros, factors)
    panel = panel.join(chars, ["permno", "yyyymm"])
    codes = industry.withColumn("yyyymm", yyyymm()).drop("month")
    panel = panel.join(codes, ["permno", "yyyymm"], "left")
    panel = panel.join(macros.select("yyyymm", *(F.col(m).alias(f"macro_{m}") for m in MACROS)), "yyyymm", "left")
    panel = panel.withColumnsRenamed({"me": "market_equity"})
    panel = drop_incomplete(panel, names, missing=missing)
    fill = [c for c in panel.columns if c == "market_equity" or c.startswith(("sic2_", "macro_"))]
    panel = panel.na.fill(0.0, fill)
    return panel if rows is None else first_rows(panel, rows)


def first_rows(panel: DataFrame, rows: int, date: str = "month", asset: str = "permno") -> DataFrame:
    """The first rows by month and asset; Spark keeps only the best so many of each partition."""
    return panel.orderBy(date, asset).limit(rows)


def release_lag(panel: DataFrame, releases: DataFrame, values: list[str], months: int, asset: str = "permno", date: str = "month") -> DataFrame:
    """Each row gets the latest values whose date is at least `months` before its own (NULL if there is none).

    Both tables are stacked and sorted by asset and time once; a running last value takes the place of a range join, so
    an asset with long histories multiplies nothing.
    """
    moved = releases.select(F.col(asset), F.last_day(F.add_months(date, months)).alias("__at"), F.lit(0).alias("__kind"), F.struct(*values).alias("__value"))
    rows = panel.select(F.col(asset), F.last_day(F.col(date)).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(moved.schema["__value"].dataType).alias("__value"), F.struct(*panel.columns).alias("__row"))
    both = rows.unionByName(moved, allowMissingColumns=True)
    so_far = Window.partitionBy(asset).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__value", ignorenulls=True).over(so_far)).where("__kind = 1")
    return found.select("__row.*", *(F.col(f"__last.{v}").alias(f"{v}_lag{months}") for v in values))


def huber(residual: Column, xi: float) -> Column:
    """u^2 up to xi, 2 xi |u| - xi^2 beyond."""
    return F.when(F.abs(residual) <= xi, residual * residual).otherwise(2 * xi * F.abs(residual) - xi * xi)


def by_size(panel: DataFrame, n: int = 1000, weight: str = "market_equity", date: str = "month", asset: str = "permno", spread: bool = False) -> DataFrame:
    """The n largest and the n smallest assets of each month, marked top and bottom (top if both).

    With `spread` a month of any size goes over all tasks instead of one.
    """
    down, up = F.col(weight).desc_nulls_last(), F.col(weight).asc_nulls_last()
    if spread:
        ranked = panel
        for name, order in (("__down", down), ("__up", up)):
            ranked = positions(ranked, [date], [order, asset], name, "__size").drop("__size")
    else:
        ranked = panel.select("*", *(F.row_number().over(Window.partitionBy(date).orderBy(order, asset)).alias(name) for name, order in (("__down", down), ("__up", up))))
    side = F.when(F.col("__down") <= n, "top").when(F.col("__up") <= n, "bottom")
    return ranked.withColumn("side", side).where("side IS NOT NULL").drop("__down", "__up")


def by_period(panel: DataFrame, year: int = 2000, date: str = "month") -> DataFrame:
    return panel.withColumn("period", F.when(F.year(date) < year, "pre").otherwise("post"))


def by_sector(panel: DataFrame, industry: str = "sic2") -> DataFrame:
    """Financials are the two-digit codes 60 to 67."""
    return panel.withColumn("sector", F.when(F.col(industry).between(60, 67), "financial").otherwise("other"))


def by_regime(panel: DataFrame, macro: str = "macro_svar", date: str = "month") -> DataFrame:
    """high and low months, split at the median of the monthly macro series."""
    monthly = panel.groupBy(date).agg(F.max(macro).alias("__m"))
    middle = monthly.agg(F.median("__m").alias("__middle"))
    marked = monthly.crossJoin(F.broadcast(middle)).select(date, F.when(F.col("__m") > F.col("__middle"), "high").otherwise("low").alias("regime"))  # one row on the right
    return panel.join(marked, date)
