"""Cross-sectional ranks with average ties, from one exchange for any number of columns.

The average rank is half of `rank()` plus the count of values up to and with the current one. Both come from the same
window partition, where counting ties by (date, value) would deal the rows anew for every column.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def average_rank(column: str, by: str) -> Column:
    """1 for the smallest; ties share their mean rank; NULL stays NULL."""
    order = Window.partitionBy(by).orderBy(F.col(column).asc_nulls_last())
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.col(column).isNotNull(), (F.rank().over(order) + F.count(column).over(upto)) / 2)


def count_of(column: str, by: str) -> Column:
    """Values in the group."""
    return F.count(column).over(Window.partitionBy(by))


def rank_pct_scaled(column: str, by: str, low: float = -1.0, high: float = 1.0) -> Column:
    """low + (high - low) * rank / count; the largest value gets `high`."""
    return low + (high - low) * average_rank(column, by) / count_of(column, by)


def rank_minmax_scaled(column: str, by: str) -> Column:
    """2 (rank - 1) / (count - 1) - 1, from -1 to 1; NULL in groups of one value."""
    n = count_of(column, by)
    return F.when(n > 1, 2 * (average_rank(column, by) - 1) / F.nullif(n - 1, F.lit(0)) - 1)


def quantile_bucket(column: str, by: str, tie: str, buckets: int = 10) -> Column:
    """1 .. buckets by equal-frequency edges over first-come ranks (ties by `tie`); NULL if missing or alone."""
    order = Window.partitionBy(by).orderBy(F.col(column).asc_nulls_last(), tie)
    place, n = F.row_number().over(order), count_of(column, by)
    # Integer arithmetic: the ceiling of (place - 1) * buckets / (n - 1), at least 1.
    steps = ((place - 1) * buckets + n - 2) / F.nullif(n - 1, F.lit(0))
    return F.when(F.col(column).isNotNull() & (n > 1), F.greatest(F.lit(1), F.floor(steps).cast("int")))
