"""Places of rows in the order of their group, spread over all tasks.

A window puts a group into one task. Here rows are dealt by ranges of (group, order), so that a group of any size spreads: a running
number within each sorted range, and for each group the rows of the ranges before, give the place. No Python runs. What is numbered is written
to the shared folder once, so that numbers stay what they are when a task is repeated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows written to spark.checkpoint.dir and read back. Only a local session without one gets a temporary folder."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint(eager=True)


def positions(rows: DataFrame, group: list[str], order: list[str | Column], place: str = "place", size: str = "size") -> DataFrame:
    """The rows with their place from 1 in their group, and the group's number of rows. Rows that are equal in `order` come in any order."""
    keys = [*map(F.col, group), *(F.col(c) if isinstance(c, str) else c for c in order)]
    numbered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("__range", F.shiftright("__at", 33))
    parts = numbered.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)  # a row for each range that a group reaches
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(group)), F.col("__range").alias("__of"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(whole).alias(size))
    same = F.col("__range") == F.col("__of")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return numbered.join(shifts, same).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(place), size)


def long_values(rows: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """A row for each value that is not missing: the kept columns, __column (its number) and __value."""
    values = F.array(*(F.col(c).cast("double") for c in columns))
    return rows.select(*keep, F.posexplode(values).alias("__column", "__value")).where("__value IS NOT NULL")


def exact_quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """by, __column (number of the column), __n and __q: exact interpolated quantiles of each column's values in each group.

    All columns and groups share one pass; only the rows next to a wanted place are kept, two for each share.
    """
    by = by or []
    placed = positions(long_values(df, columns, *by), [*by, "__column"], ["__value"], "__place", "__n")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("__n") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares)))
    near = placed.select(*by, "__column", "__value", "__n", "__place", F.explode(wanted).alias("w"))
    low = F.floor("w.at") + 1
    near = near.where((F.col("__place") == low) | (F.col("__place") == F.least(low + 1, F.col("__n"))))
    part = F.col("w.at") - F.floor("w.at")
    share = F.when((F.col("__place") == low) & (low == F.col("__n")), 1.0).when(F.col("__place") == low, 1 - part).otherwise(part)
    each = near.groupBy(*by, "__column", "w.i").agg(F.max("__n").alias("__n"), F.sum(F.col("__value") * share).alias("q"))
    sorted_ = F.array_sort(F.collect_list(F.struct("i", "q")))  # one for each share
    return each.groupBy(*by, "__column").agg(F.max("__n").alias("__n"), F.transform(sorted_, lambda x: x["q"]).alias("__q"))
