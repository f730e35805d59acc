"""Missing values: NaN and NULL are one thing here, and division never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float column becomes NULL, in one projection."""
    fix = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in fix else F.col(c) for c in df.columns))


def zero(column: str | Column) -> Column:
    """A number, 0 where it is missing."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL if b is 0."""
    return F.try_divide(a, b)


def plain(column: Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines that add in another order; -0 becomes 0.

    The small shift moves numbers of eight places off the ties, which engines round in different ways.
    """
    return F.round(column + 3e-9, digits) + F.lit(0.0)
