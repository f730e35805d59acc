"""Splits by time: six dates, or windows that roll by years."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("train", "validation", "test")


@dataclass(frozen=True)
class TimeSplit:
    """Closed intervals of dates; each part must end before the next one starts."""

    train_start: date
    train_end: date
    validation_start: date
    validation_end: date
    test_start: date
    test_end: date

    def __post_init__(self) -> None:
        if not (self.train_start <= self.train_end < self.validation_start <= self.validation_end < self.test_start <= self.test_end):
            raise ValueError("the parts of a split follow each other")

    def bounds(self) -> list[tuple[str, date, date]]:
        return [(p, getattr(self, f"{p}_start"), getattr(self, f"{p}_end")) for p in PARTS]

    def part(self, column: str = "month") -> Column:
        found = F.lit(None).cast("string")
        for name, start, end in reversed(self.bounds()):
            found = F.when(F.col(column).between(F.lit(start), F.lit(end)), name).otherwise(found)
        return found


def make_split(method: str = "fixed", **dates: date | str) -> TimeSplit:
    if method != "fixed":
        raise ValueError("only fixed splits have dates")
    return TimeSplit(**{k: date.fromisoformat(v) if isinstance(v, str) else v for k, v in dates.items()})


def apply_split(panel: DataFrame, split: TimeSplit, column: str = "month", check: bool = True) -> DataFrame:
    """Rows of the three parts with their part in `split`; an empty part is an error."""
    inside = panel.where(F.col(column).between(F.lit(split.train_start), F.lit(split.test_end))).withColumn("split", split.part(column)).where("split IS NOT NULL")
    if check:
        found = {r[0] for r in inside.select("split").distinct().collect()}
        if empty := [p for p in PARTS if p not in found]:
            raise ValueError(f"empty parts: {', '.join(empty)}")
    return inside


def rolling_year_splits(first_year: int, last_year: int, train: int = 18, validation: int = 12, test: int = 1, expanding: bool = False) -> list[TimeSplit]:
    """A split for each test window that ends by last_year; with `expanding` every training part starts in first_year."""
    splits, at = [], first_year
    while at + train + validation + test - 1 <= last_year:
        a, b, c = at + train, at + train + validation, at + train + validation + test
        splits.append(TimeSplit(date(first_year if expanding else at, 1, 1), date(a - 1, 12, 31), date(a, 1, 1), date(b - 1, 12, 31), date(b, 1, 1), date(c - 1, 12, 31)))
        at += test
    return splits


def split_table(spark: SparkSession, splits: list[TimeSplit]) -> DataFrame:
    rows = [(k, p, start, end) for k, s in enumerate(splits) for p, start, end in s.bounds()]
    return spark.createDataFrame(rows, "fold int, split string, start date, stop date")


def apply_rolling(panel: DataFrame, splits: list[TimeSplit], column: str = "month") -> DataFrame:
    """A row of the panel for each fold and part that it belongs to; the table of windows has a row for each year at most."""
    windows = F.broadcast(split_table(panel.sparkSession, splits))
    return panel.join(windows, F.col(column).between(F.col("start"), F.col("stop"))).drop("start", "stop")
