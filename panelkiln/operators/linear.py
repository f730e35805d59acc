"""Linear forecasts from one pass over the training rows.

The pass sums the products of all features, the target and a constant: each partition adds up its own block, the blocks
are summed cell by cell in a shuffle, and the driver solves systems of the size of the feature list (MOST_FEATURES).
Missing inputs count as 0. A fitted model is a list of raw coefficients, so forecasts are plain column expressions.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.nulls import zero
from panelkiln.operators.evaluate import oos_r2

MOST_FEATURES = 2000
#: Rows of a task in work that reads its rows again and again.
TASK_ROWS = 1 << 16
RIDGE_GRID = (0.01, 0.1, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5)


@dataclass(frozen=True)
class Linear:
    """intercept + sum of coefficient times feature."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float = 0.0

    def terms(self) -> dict[str, Column]:
        return {c: F.lit(b) * zero(c) for c, b in zip(self.features, self.coefficients, strict=True)}

    def expression(self) -> Column:
        total = F.lit(float(self.intercept))
        for t in self.terms().values():
            total = total + t
        return total

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        return df.withColumn(output, self.expression())


@dataclass(frozen=True)
class Gram:
    """Weighted sums over rows of (1, features, target) times itself."""

    features: tuple[str, ...]
    cells: np.ndarray

    @property
    def n(self) -> float:
        return self.cells[0, 0]

    def means(self) -> tuple[np.ndarray, float]:
        return self.cells[0, 1:-1] / self.n, self.cells[0, -1] / self.n

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """X'X and X'y about the means."""
        x, y = self.means()
        return self.cells[1:-1, 1:-1] - self.n * np.outer(x, x), self.cells[1:-1, -1] - self.n * x * y

    def deviations(self) -> np.ndarray:
        """Population standard deviations; 1 for a constant."""
        variance = np.maximum(np.diag(self.centred()[0]) / self.n, 0)
        x, _ = self.means()
        return np.where(variance > 1e-14 * np.maximum(1, x * x), np.sqrt(variance), 1.0)


def _gram_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width + 1)], axis=1)
            total += (x[:, :width] * x[:, width:]).T @ x[:, :width]
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "v"])

    return run


def gram(train: DataFrame, features: list[str], target: str, weight: str | None = None) -> Gram:
    """Sums over rows with a target."""
    if len(features) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    width = len(features) + 2
    w = zero(weight) if weight else F.lit(1.0)
    rows = train.where(F.col(target).isNotNull()).select(F.lit(1.0).alias("c"), *(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y"), w.cast("double").alias("w"))
    found = rows.mapInArrow(_gram_batches(width), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    cells = np.zeros(width * width)
    cells[found.column(0).to_numpy()] = found.column(1).to_numpy()
    cells = cells.reshape(width, width)
    if cells[0, 0] == 0:
        raise ValueError("no training rows")
    return Gram(tuple(features), cells)


def _from_standard(g: Gram, beta: np.ndarray, scale: np.ndarray, intercept: bool = True) -> Linear:
    """Raw coefficients of a fit on centred and scaled features."""
    raw = beta / scale
    x, y = g.means()
    return Linear(g.features, tuple(map(float, raw)), float(y - raw @ x) if intercept else 0.0)


def ols(g: Gram, intercept: bool = True) -> Linear:
    """Least squares; of the solutions that collinear features leave, the shortest one on standardised features."""
    if not intercept:
        return Linear(g.features, tuple(map(float, np.linalg.lstsq(g.cells[1:-1, 1:-1], g.cells[1:-1, -1], rcond=1e-11)[0])))
    scale = g.deviations()
    xx, xy = g.centred()
    beta = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=1e-11)[0]
    return _from_standard(g, beta, scale)


def ridge(g: Gram, alpha: float = 1.0) -> Linear:
    """Penalty alpha on the coefficients of population-standardised features, none on the intercept."""
    scale = g.deviations()
    xx, xy = g.centred()
    beta = np.linalg.solve(xx / np.outer(scale, scale) + alpha * np.eye(len(scale)), xy / scale)
    return _from_standard(g, beta, scale)


def ridge_grid(g: Gram, validation: DataFrame, target: str, alphas: tuple[float, ...] = RIDGE_GRID) -> tuple[Linear, DataFrame]:
    """The fit with the best R2 on validation rows (the first of equals), and the curve alpha, validation_r2.

    One training pass serves all alphas, and one pass over the validation rows scores them.
    """
    fits = [ridge(g, a) for a in alphas]
    scored = validation.select(target, *(f.expression().alias(f"f{i}") for i, f in enumerate(fits)))
    row = scored.agg(*(oos_r2(target, f"f{i}").alias(f"r{i}") for i in range(len(fits)))).head()
    curve = [(i, float(a), row[i]) for i, a in enumerate(alphas)]
    best = max(curve, key=lambda r: (r[2] is not None, r[2] or 0.0, -r[0]))[0]
    return fits[best], validation.sparkSession.createDataFrame(curve, "grid_index int, alpha double, validation_r2 double")


def pcr(g: Gram, k: int = 50, alpha: float = 1.0) -> Linear:
    """Features scaled but not centred, projected on their first k singular directions, then ridge on those."""
    scale = g.deviations()
    raw = g.cells[1:-1, 1:-1] / np.outer(scale, scale)
    _, vectors = np.linalg.eigh(raw)
    v = vectors[:, ::-1][:, : min(k, len(scale))]
    xx, xy = g.centred()
    inner = v.T @ (xx / np.outer(scale, scale)) @ v
    gamma = np.linalg.solve(inner + alpha * np.eye(v.shape[1]), v.T @ (xy / scale))
    return _from_standard(g, v @ gamma, scale)


def pls(g: Gram, k: int = 15) -> Linear:
    """Partial least squares for one target, from the product sums alone, by deflation."""
    scale = np.sqrt(np.where(g.deviations() == 1.0, 1.0, g.deviations() ** 2 * g.n / max(g.n - 1, 1)))
    xx, xy = g.centred()
    xx, xy = xx / np.outer(scale, scale), xy / scale
    s, w, p, q = xy.copy(), [], [], []
    for _ in range(min(k, len(scale))):
        size = np.linalg.norm(s)
        if size < 1e-10 * max(1.0, np.linalg.norm(xy)):
            break
        r = s / size
        for a, b in zip(w, p, strict=True):
            r = r - a * (b @ r)
        t = r @ xx @ r
        if t < 1e-12 * np.trace(xx):
            break
        load = xx @ r / t
        share = (r @ xy) / t
        w.append(r)
        p.append(load)
        q.append(share)
        s = s - load * share * t
    beta = sum((a * b for a, b in zip(w, q, strict=True)), np.zeros(len(scale)))
    return _from_standard(g, beta, scale)


def group_lasso(g: Gram, groups: list[list[int]], penalty: float, rounds: int = 2000) -> Linear:
    """Least squares on standardised features with a penalty on the length of each group's coefficients (proximal steps)."""
    scale = g.deviations()
    xx, xy = g.centred()
    xx, xy = xx / np.outer(scale, scale) / g.n, xy / scale / g.n
    step = 1.0 / max(float(np.linalg.eigvalsh(xx)[-1]), 1e-12)
    beta, ahead, t = np.zeros(len(scale)), np.zeros(len(scale)), 1.0
    for _ in range(rounds):
        new = ahead - step * (xx @ ahead - xy)
        for group in groups:
            size = np.linalg.norm(new[group])
            new[group] *= max(0.0, 1 - step * penalty * len(group) ** 0.5 / size) if size else 0.0
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, done = new + (t - 1) / t_new * (new - beta), float(np.abs(new - beta).max(initial=0.0))
        beta, t = new, t_new
        if done < 1e-12:
            break
    return _from_standard(g, beta, scale)


def _huber_batches(features: int, center: np.ndarray, scale: np.ndarray, beta: np.ndarray, intercept: float, xi: float):
    """Sums over rows, v being the residual clipped at xi: X'v and v, then v y, v^2 and the Huber loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features + 4)
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(features)], axis=1)
            x, y = (x - center) / scale, batch.column(features).to_numpy(zero_copy_only=False)
            u = y - intercept - x @ beta
            v = np.clip(u, -xi, xi)
            total += [*(x.T @ v), v.sum(), v @ y, v @ v, (v * u - v * v / 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 4)), pa.array(total)], ["cell", "v"])

    return run


def duality_gap(sums: np.ndarray, n: float, y: float, beta: np.ndarray, l1: float, l2: float, xi: float) -> tuple[float, float]:
    """The loss with its penalties, and how far it can lie above the least one.

    The clipped residuals, less their mean and scaled back to at most xi, are a point of the dual problem, whose value bounds the least loss from below.
    """
    xv, v, vy, vv, loss = sums[:-4], sums[-4] / n, sums[-3], sums[-2], sums[-1]
    primal = loss / n + l1 * np.abs(beta).sum() + l2 / 2 * beta @ beta
    s = xi / (xi + abs(v))
    beyond = np.maximum(np.abs(s * xv / n) - l1, 0)
    if l2 == 0 and beyond.any():  # scaled again, so that no feature passes the penalty
        s, beyond = s * l1 / (l1 + float(beyond.max())), beyond * 0
    dual = s * (vy / n - v * y) - s * s * (vv / n - v * v) / 2 - (beyond @ beyond / (2 * l2) if l2 else 0.0)
    return float(primal), float(primal - dual)


def elastic_net_huber(
    train: DataFrame, features: list[str], target: str, alpha: float = 1e-4, l1_ratio: float = 0.5, xi: float | None = 0.1, rounds: int = 2000, tolerance: float = 1e-8
) -> Linear:
    """Minimises the mean Huber loss (half of u^2 up to xi) plus alpha (l1_ratio |b|_1 + (1 - l1_ratio) / 2 |b|_2^2).

    Accelerated proximal gradient on standardised features: each step sums gradients over the cached rows in one job and
    soft-thresholds on the driver; a step that turns back drops its momentum. The same sums bound the distance from the least loss; steps end when it is
    at most `tolerance` of the loss of a constant, with a warning if `rounds` end first. xi: if it is None, the standard deviation of the target.
    """
    g = gram(train, features, target)
    center, scale = g.means()[0], g.deviations()
    xi = xi or float(max(g.cells[-1, -1] / g.n - g.means()[1] ** 2, 1e-18) ** 0.5)
    rows = train.where(F.col(target).isNotNull()).select(*(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y"))
    rows = rows.repartition(max(1, int(-(-g.n // TASK_ROWS)))).cache()
    curvature = float(np.linalg.eigvalsh(g.centred()[0] / np.outer(scale, scale) / g.n)[-1])
    step, k, l1, l2 = 1.0 / max(curvature, 1.0), len(features), alpha * l1_ratio, alpha * (1 - l1_ratio)
    now, ahead, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    now[-1] = ahead[-1] = g.means()[1]
    best, best_loss, first, gap = now, float("inf"), None, float("inf")
    for _ in range(rounds):
        found = rows.mapInArrow(_huber_batches(k, center, scale, ahead[:-1], float(ahead[-1]), xi), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(k + 4)
        for cell, v in found:
            sums[cell] = v
        loss, gap = duality_gap(sums, g.n, g.means()[1], ahead[:-1], l1, l2, xi)
        first = first or max(loss, 1e-300)
        if loss < best_loss:
            best, best_loss = ahead, loss
        if gap <= tolerance * first:
            best = ahead
            break
        grad = -sums[: k + 1] / g.n
        grad[:-1] += l2 * ahead[:-1]
        new = ahead - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if (ahead - new) @ (new - now) > 0:
            t_new, t = 1.0, 1.0
        ahead = new + (t - 1) / t_new * (new - now)
        now, t = new, t_new
    rows.unpersist()
    if gap > tolerance * first:
        warnings.warn(f"the loss may lie {gap / first:.1e} of a constant's above the least one", stacklevel=2)
    raw = best[:-1] / scale
    return Linear(tuple(features), tuple(map(float, raw)), float(best[-1] - raw @ center))


def ssd_importance(model: Linear, df: DataFrame) -> DataFrame:
    """feature, ssd: the sum over rows of squared partial derivatives, which are constants here."""
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(b * b).alias("b2")) for c, b in zip(model.features, model.coefficients, strict=True)))
    return df.agg(F.count("*").alias("n")).select("n", F.explode(rows).alias("r")).select("r.feature", (F.col("r.b2") * F.col("n")).alias("ssd"))
