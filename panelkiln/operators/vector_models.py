"""Linear models on a vector column, dense or sparse: the full feature vector with its industry block.

Up to MOST_FEATURES features one pass sums all products: tasks add up slices of rows as dense blocks, the sums are dealt
by blocks of rows of the product matrix, and the driver holds that matrix. Wider vectors are solved by conjugate
gradients: each step is one pass that multiplies the rows with a direction for every penalty at once, so that memory and what is shuffled
grow with the number of features alone. Both give ridge on population-standardised features with a free intercept.
Rows without target or vector are left out; a forecast is an expression on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.operators.evaluate import oos_r2
from panelkiln.operators.linear import MOST_FEATURES, RIDGE_GRID, Gram, ridge

#: Numbers handled at once inside a task, and rows of the product matrix in a block.
SLICE_CELLS, BLOCK_ROWS = 1 << 21, 64


@dataclass(frozen=True)
class VectorLinear:
    """intercept + coefficients times the vector column."""

    column: str
    coefficients: tuple[float, ...]
    intercept: float

    def expression(self) -> Column:
        v, w = F.unwrap_udt(self.column), F.array(*map(F.lit, self.coefficients))
        dense = F.zip_with(v["values"], w, lambda x, b: x * b)
        sparse = F.zip_with(v["indices"], v["values"], lambda i, x: x * F.get(w, i))
        return F.lit(self.intercept) + F.aggregate(F.when(v["type"] == 1, dense).otherwise(sparse), F.lit(0.0), lambda total, x: total + x)

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        return df.withColumn(output, self.expression())


def width(df: DataFrame, column: str) -> int:
    """Entries of the vectors, from the column's metadata or else from the first one."""
    known = df.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
    if known is None:
        first = df.where(F.col(column).isNotNull()).select(column).head()
        if first is None:
            raise ValueError("no training rows")
        known = first[0].size
    return int(known)


def _rows(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).select(F.unwrap_udt(column).alias("v"), F.col(target).cast("double").alias("y"))


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the rows, and the place and value of each entry."""
    values, indices = vectors.field("values"), vectors.field("indices")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    found = values.flatten().to_numpy(zero_copy_only=False)
    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    if not dense.all():
        at[~np.repeat(dense, sizes)] = indices.flatten().to_numpy(zero_copy_only=False)
    return bounds, at, found


def _slices(bounds: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    start, rows = 0, len(bounds) - 1
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + cells, side="right")) - 1)
        yield start, min(stop, rows)
        start = min(stop, rows)


def _product_batches(p: int):
    """Sums of (1, vector, target) times itself as blocks of rows; what lies left of the diagonal is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 2, p + 2))
        for batch in batches:
            (bounds, at, values), y = _entries(batch.column(0)), batch.column(1).to_numpy()
            step = max(1, SLICE_CELLS // (p + 2))
            for s in range(0, len(y), step):
                e = min(s + step, len(y))
                x = np.zeros((e - s, p + 2))
                x[:, 0], x[:, -1] = 1.0, y[s:e]
                own = slice(bounds[s], bounds[e])
                x[np.repeat(np.arange(e - s), np.diff(bounds[s : e + 1])), at[own] + 1] = values[own]
                total += x.T @ x
        for b in range(0, p + 2, BLOCK_ROWS):
            part = total[b : b + BLOCK_ROWS, b:]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], ["block", "cells"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one sum for each."""
    now, total = None, None
    for batch in batches:
        for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block == now:
                total += np.frombuffer(cells)
                continue
            if now is not None:
                yield _one(now, total)
            now, total = block, np.frombuffer(cells).copy()
    if now is not None:
        yield _one(now, total)


def _one(block: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "cells"])


def gram_of_vectors(train: DataFrame, column: str, target: str) -> Gram:
    """Sums over the rows with a target, for all models of `linear` that take a Gram."""
    p = width(train, column)
    if p > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    blocks = _rows(train, column, target).mapInArrow(_product_batches(p), "block long, cells binary")
    sums = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "block long, cells binary")
    cells = np.zeros((p + 2, p + 2))
    for block, found in sums.toLocalIterator():
        high = min(BLOCK_ROWS, p + 2 - block)
        cells[block : block + high, block:] = np.frombuffer(found).reshape(high, -1)
    cells = np.triu(cells) + np.triu(cells, 1).T
    if cells[0, 0] == 0:
        raise ValueError("no training rows")
    return Gram(tuple(f"{column}_{i}" for i in range(p)), cells)


def _moment_batches(p: int):
    """By feature the sums of x, x^2 and x y; last n and the sums of y and y^2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, 3))
        for batch in batches:
            (bounds, at, x), y = _entries(batch.column(0)), batch.column(1).to_numpy()
            for k, v in enumerate((x, x * x, x * np.repeat(y, np.diff(bounds)))):
                total[:p, k] += np.bincount(at, v, p)
            total[p] += len(y), y.sum(), y @ y
        yield _cells(total)

    return run


def _cells(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["cell", *(f"s{i}" for i in range(total.shape[1]))])


def _step_batches(directions: np.ndarray):
    """X' X times the directions, which are the columns of an array."""
    p, k = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, k))
        for batch in batches:
            bounds, at, x = _entries(batch.column(0))
            for s, e in _slices(bounds, SLICE_CELLS // k):
                own, sizes = slice(bounds[s], bounds[e]), np.diff(bounds[s : e + 1])
                row = np.repeat(np.arange(e - s), sizes)
                for j in range(k):
                    scores = np.bincount(row, x[own] * directions[at[own], j], e - s)
                    total[:, j] += np.bincount(at[own], x[own] * scores[row], p)
        yield _cells(total)

    return run


def _summed(rows: DataFrame, function: Callable, height: int, columns: int) -> np.ndarray:
    names = [f"s{i}" for i in range(columns)]
    found = rows.mapInArrow(function, ", ".join(["cell long", *(f"{c} double" for c in names)])).groupBy("cell").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    out = np.zeros((height, columns))
    out[found.column(0).to_numpy()] = np.stack([found.column(i + 1).to_numpy() for i in range(columns)], axis=1)
    return out


def conjugate_ridge(train: DataFrame, column: str, target: str, alphas: tuple[float, ...] = RIDGE_GRID, tolerance: float = 1e-10, most_steps: int = 500) -> tuple[list[VectorLinear], list[float]]:
    """Ridge for every alpha by conjugate gradients, and the remaining relative residual of each.

    A step is one pass over the cached rows. Alphas that have reached the tolerance stand still; after `most_steps` the rest
    are returned as they are, with their residuals.
    """
    p = width(train, column)
    rows = _rows(train, column, target).cache()
    sums = _summed(rows, _moment_batches(p), p + 1, 3)
    n, y = sums[p, 0], sums[p, 1]
    if n == 0:
        raise ValueError("no training rows")
    mean, level = sums[:p, 0] / n, y / n
    variance = np.maximum(sums[:p, 1] / n - mean * mean, 0)
    scale = np.where(variance > 1e-14 * np.maximum(1, mean * mean), np.sqrt(variance), 1.0)
    right = (sums[:p, 2] - n * mean * level) / scale
    size, penalty = max(float(np.linalg.norm(right)), 1e-300), np.array(alphas)
    beta = np.zeros((p, len(alphas)))
    residual = np.repeat(right[:, None], len(alphas), axis=1)
    direction, squares = residual.copy(), (residual * residual).sum(axis=0)
    for _ in range(most_steps):
        open_ = np.flatnonzero(np.sqrt(squares) > tolerance * size)
        if not len(open_):
            break
        d = direction[:, open_]
        raw = d / scale[:, None]
        product = (_summed(rows, _step_batches(raw), p, len(open_)) - n * np.outer(mean, mean @ raw)) / scale[:, None] + penalty[open_] * d
        length = squares[open_] / (d * product).sum(axis=0)
        beta[:, open_] += length * d
        residual[:, open_] -= length * product
        before, squares[open_] = squares[open_], (residual[:, open_] ** 2).sum(axis=0)
        direction[:, open_] = residual[:, open_] + squares[open_] / before * d
    rows.unpersist()
    fits = [b / scale for b in beta.T]
    return [VectorLinear(column, tuple(map(float, b)), float(level - b @ mean)) for b in fits], list(map(float, np.sqrt(squares) / size))


def ridge_of_vectors(train: DataFrame, column: str, target: str, alphas: tuple[float, ...] = RIDGE_GRID) -> list[VectorLinear]:
    """Ridge for every alpha from one pass, or by conjugate gradients where there are more than MOST_FEATURES features."""
    if width(train, column) > MOST_FEATURES:
        return conjugate_ridge(train, column, target, alphas)[0]
    g = gram_of_vectors(train, column, target)
    return [VectorLinear(column, f.coefficients, f.intercept) for f in (ridge(g, a) for a in alphas)]


def ridge_grid_of_vectors(train: DataFrame, validation: DataFrame, column: str, target: str, alphas: tuple[float, ...] = RIDGE_GRID) -> tuple[VectorLinear, DataFrame]:
    """The fit with the best R2 on validation rows (the first of equals), and the curve grid_index, alpha, validation_r2."""
    fits = ridge_of_vectors(train, column, target, alphas)
    scored = validation.select(target, *(f.expression().alias(f"f{i}") for i, f in enumerate(fits)))
    row = scored.agg(*(oos_r2(target, f"f{i}").alias(f"r{i}") for i in range(len(fits)))).head()
    curve = [(i, float(a), row[i]) for i, a in enumerate(alphas)]
    best = max(curve, key=lambda r: (r[2] is not None, r[2] or 0.0, -r[0]))[0]
    return fits[best], validation.sparkSession.createDataFrame(curve, "grid_index int, alpha double, validation_r2 double")
