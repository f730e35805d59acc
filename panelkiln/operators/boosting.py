"""Gradient boosting for the Huber loss on binned features.

Quantiles of each feature (one pass) turn it into a byte. Rows are packed once into blocks of bytes, targets and forecasts, which
every pass reads again. A stage is depth + 1 passes, whatever the number of rows: one for each level of the tree, in which tasks sum counts and
clipped residuals by node, feature and bin, and one for the residuals of the leaves. The sums meet in a shuffle, and the driver
chooses splits from a table of nodes by bins. Leaf residuals are summed by value on a fine scale, from which come the leaf's
median and mean clipped rest, and the clipping point of the next stage as well, so that it takes no pass of its own.

Trees are flat arrays. A pass adds the trees grown since the blocks were last written to their forecasts; every REFRESH stages
the blocks are written anew to the shared folder, so that the plan and the work of a stage stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.nulls import zero
from panelkiln.sources.tables import shared_folder

MOST_BINS, REFRESH = 64, 10
BLOCK_ROWS = 1 << 16
#: Steps of the scale on which residuals are summed.
STEPS = 4096
_BLOCK = "bins binary, y binary, f binary"


@dataclass
class Trees:
    """Complete trees of one depth. feature, cut: by tree and inner node (breadth first); a value goes right if its bin is above the cut. value: by leaf."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray, tree: int) -> np.ndarray:
        return nodes(bins, self.feature[tree], self.cut[tree], self.depth)

    def forecast(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for t in range(len(self.value)):
            total += self.value[t][self.leaves(bins, t)]
        return total


def nodes(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after some levels, counted from 0 in its level."""
    at = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for level in range(levels):
        first = (1 << level) - 1
        if level < 3:  # few nodes: whole columns are compared, which is faster than a look-up for each row
            right = bins[:, feature[first]] > cut[first]
            for k in range(1, 1 << level):
                right = np.where(at == k, bins[:, feature[first + k]] > cut[first + k], right)
        else:
            right = bins[rows, feature[at + first]] > cut[at + first]
        at = 2 * at + right
    return at


@dataclass
class BoostedTrees:
    """start + rate times the sum of the trees."""

    features: list[str]
    edges: list[np.ndarray]
    start: float
    rate: float
    trees: Trees
    loss: list[float] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def ablated(self, raw: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        """Forecasts of rows of raw features, in the first column as they are and then with each group of features set to 0.

        Only the trees that split on a feature of the group are scored again.
        """
        bins, at_zero, t = self.bins(raw), self.bins(np.zeros((1, raw.shape[1])))[0], self.trees
        each = np.stack([t.value[i][t.leaves(bins, i)] for i in range(len(t.value))], axis=1) if len(t.value) else np.zeros((len(raw), 0))
        out, splits = [each.sum(axis=1)], t.cut <= max((len(e) for e in self.edges), default=0)
        for own in groups:
            changed = bins.copy()
            changed[:, own] = at_zero[own]
            again = np.flatnonzero((np.isin(t.feature, own) & splits).any(axis=1))
            out.append(out[0] + sum((t.value[i][t.leaves(changed, i)] - each[:, i] for i in again.tolist()), np.zeros(len(raw))))
        return self.start + self.rate * np.stack(out, axis=1)

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        """One pass over all trees; only the features pass through Python."""
        model = self

        @F.pandas_udf("double")
        def forecast(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(model.start + model.rate * model.trees.forecast(model.bins(columns.to_numpy(np.float64))))

        inputs = F.struct(*(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)))
        return df.withColumn(output, forecast(inputs))


def _value_batches(p: int, most: int):
    """The values of each feature in a task, or the first most + 1 of them, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0)] * p
        for batch in batches:
            for i in range(p):
                if len(found[i]) <= most:
                    found[i] = np.union1d(found[i], batch.column(i).to_numpy(zero_copy_only=False))[: most + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(p), [len(v) for v in found])), pa.array(np.concatenate(found))], ["column", "v"])

    return run


def quantile_edges(train: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 cuts of each feature; values up to a cut lie left of it.

    A feature of at most `bins` values gets every cut, halfway between neighbours; others are cut at quantiles.
    """
    inputs = train.select(*(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)))
    values: list[list[float]] = [[] for _ in features]
    for column, v in inputs.mapInArrow(_value_batches(len(features), bins), "column long, v double").distinct().where("v IS NOT NULL").groupBy("column").agg(F.slice(F.array_sort(F.collect_set("v")), 1, bins + 1)).collect():
        values[column] = v
    many = [i for i, v in enumerate(values) if len(v) > bins]
    shares = [i / bins for i in range(1, bins)]
    row = inputs.agg(*(F.percentile_approx(f"x{i}", shares, 10 * bins) for i in many)).head() if many else []
    edges = [np.array(v[:-1]) + np.diff(v) / 2 for v in values]
    for i, cuts in zip(many, row, strict=True):
        edges[i] = np.unique(np.array(cuts, float))
    return edges


def lower_median(rows: DataFrame, column: str, count: int, low: float, high: float, most: int = 100_000) -> float:
    """The exact value at place (count + 1) // 2 of a column without NULLs, whose values lie between low and high.

    Quantiles within known bounds of error narrow the range until few rows are left of it.
    """
    place, below, left = (count + 1) // 2, 0, count
    while left > most:
        share = (place - below) / left
        a, b = rows.where(F.col(column).between(low, high)).agg(F.percentile_approx(column, [max(0.0, share - 1e-3), min(1.0, share + 1e-3)], 10_000)).head()[0]
        under, within = rows.agg(F.count_if(F.col(column) < a), F.count_if(F.col(column).between(a, b))).head()
        if not under < place <= under + within or (a, b) == (low, high):  # never outside; equal values can't be narrowed
            break
        low, high, below, left = a, b, under, within
        if low == high:
            return low
    found = rows.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(column).collect()
    return float(found[int(np.searchsorted(np.cumsum([n for _, n in found]), place - below))][0])


def _packed(edges: list[np.ndarray], start: float):
    p = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                bins = np.stack([np.searchsorted(edges[i], part.column(i).to_numpy(zero_copy_only=False), side="left") for i in range(p)], axis=1).astype(np.uint8)
                y = part.column(p).to_numpy(zero_copy_only=False)
                yield _block(bins, y, np.full(len(y), start))

    return run


def _block(bins: np.ndarray, y: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (bins, y, f)], ["bins", "y", "f"])


def _blocks(batches: Iterator[pa.RecordBatch], p: int, since: Trees, rate: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """bins, y and the current forecast of each block."""
    for batch in batches:
        for bins, y, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            bins, y = np.asfortranarray(np.frombuffer(bins, np.uint8).reshape(-1, p)), np.frombuffer(y)
            yield bins, y, np.frombuffer(f) + rate * since.forecast(bins)


def _sums(cells: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells), *map(pa.array, sums)], ["cell", "n", "s"])


def _level_batches(p: int, width: int, since: Trees, rate: float, feature: np.ndarray, cut: np.ndarray, level: int, clip: float):
    """Rows and clipped residuals by (node of the level, feature, bin)."""
    size = (1 << level) * p * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(size), np.zeros(size)
        for bins, y, f in _blocks(batches, p, since, rate):
            at, g = nodes(bins, feature, cut, level) * p, np.clip(y - f, -clip, clip)
            for i in range(p):
                cell = (at + i) * width + bins[:, i]
                n += np.bincount(cell, minlength=size)
                s += np.bincount(cell, g, size)
        own = np.flatnonzero(n)
        yield _sums(own, n[own], s[own])

    return run


def _step(r: np.ndarray, scale: float, reach: float) -> np.ndarray:
    """The place of a residual on a scale that is even near 0 and logarithmic beyond `scale`."""
    return np.clip(((np.arcsinh(r / scale) / reach + 1) * (STEPS / 2)).astype(np.int64), 0, STEPS - 1)


def _leaf_batches(p: int, since: Trees, rate: float, feature: np.ndarray, cut: np.ndarray, depth: int, scale: float, reach: float):
    """Rows and residuals by (leaf, place on the scale)."""
    size = (1 << depth) * STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(size), np.zeros(size)
        for bins, y, f in _blocks(batches, p, since, rate):
            r = y - f
            cell = nodes(bins, feature, cut, depth) * STEPS + _step(r, scale, reach)
            n += np.bincount(cell, minlength=size)
            s += np.bincount(cell, r, size)
        own = np.flatnonzero(n)
        yield _sums(own, n[own], s[own])

    return run


def _refresh_batches(p: int, since: Trees, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, f in _blocks(batches, p, since, rate):
            yield _block(bins, y, f)

    return run


def _collected(blocks: DataFrame, function: Callable, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = blocks.mapInArrow(function, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    n, s = np.zeros(size), np.zeros(size)
    cells = found.column(0).to_numpy()
    n[cells], s[cells] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return n, s


def best_splits(n: np.ndarray, s: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of each node (axes: node, feature, bin) with the greatest gain, the first of equals; a node without a gain keeps all rows left."""
    left_n, left_s = np.cumsum(n, axis=2), np.cumsum(s, axis=2)
    right_n, right_s = left_n[:, :, -1:] - left_n, left_s[:, :, -1:] - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_n * right_n / (left_n + right_n) * (left_s / left_n - right_s / right_n) ** 2
    gain[~((left_n >= leaf) & (right_n >= leaf))] = 0.0
    gain = np.round(gain / max(float(gain.max(initial=0.0)), 1e-300), 12)  # sums in another order make no other tree
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    some = flat[np.arange(len(flat)), best] > 0
    width = n.shape[2]
    return np.where(some, best // width, 0), np.where(some, best % width, width)


def _median(n: np.ndarray, mean: np.ndarray) -> float:
    """The weighted lower median of values in order."""
    upto = np.cumsum(n)
    return float(mean[np.searchsorted(upto, upto[-1] / 2)])


def boosted_huber(
    train: DataFrame, features: list[str], target: str, stages: int = 500, rate: float = 0.01, depth: int = 2, leaf: int = 100, quantile: float = 0.9, bins: int = MOST_BINS, seed: int = 1
) -> BoostedTrees:
    """Boosting with the Huber loss, at the preset's settings.

    Each stage clips residuals at the `quantile` of their sizes (1: nothing is clipped), grows a tree on them, and sets a leaf to its median residual plus the mean clipped rest.
    Nothing is drawn: `seed` is there for callers that pass one to every learner. Missing features count as 0. loss holds
    the mean Huber loss of the training rows before each stage, at that stage's clipping point.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins is 2 to 256")
    known = train.where(F.col(target).isNotNull())
    edges, p = quantile_edges(known, features, bins), len(features)
    about = known.agg(F.percentile_approx(F.col(target).cast("double"), [0.25, 0.5, 0.75], 10_000), F.min(target), F.max(target), F.count("*")).head()
    if about[1] is None:
        raise ValueError("no training rows")
    low, _, high = about[0]
    start = lower_median(known.select(F.col(target).cast("double").alias("y")), "y", about[3], float(about[1]), float(about[2]))
    scale = max(high - low, 1e-9 * max(1.0, abs(about[1]), abs(about[2]))) / 2
    reach = float(np.arcsinh(2 * (about[2] - about[1]) / scale)) or 1.0
    spark, folder, tasks = train.sparkSession, shared_folder(train.sparkSession), -(-about[3] // BLOCK_ROWS)
    rows = known.select(*(zero(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(target).cast("double").alias("y"))

    def written(blocks: DataFrame, k: int) -> DataFrame:
        blocks.write.parquet(f"{folder}/blocks-{k}")
        return spark.read.schema(_BLOCK).parquet(f"{folder}/blocks-{k}").coalesce(tasks).cache()

    blocks = written(rows.repartition(tasks).mapInArrow(_packed(edges, float(start)), _BLOCK), 0)
    inner, leaves = (1 << depth) - 1, 1 << depth
    width = max(len(e) for e in edges) + 1
    empty = Trees(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)))
    done, since, losses = empty, empty, []
    whole = np.zeros(inner, np.int64)
    n, s = _collected(blocks, _leaf_batches(p, since, rate, whole, whole + width, depth, scale, reach), leaves * STEPS)
    n, s, values = n.reshape(leaves, STEPS), s.reshape(leaves, STEPS), np.zeros(leaves)
    for k in range(stages):
        # The residuals of the last stage's leaves, moved by their values, are those of this stage.
        some = n > 0
        size, mean = n[some], (s[some] / n[some]) - rate * np.repeat(values, some.sum(axis=1))
        order = np.argsort(np.abs(mean), kind="stable")
        upto = np.cumsum(size[order])
        clip = max(float(np.abs(mean)[order][np.searchsorted(upto, quantile * upto[-1])]), 1e-12 * scale) if quantile < 1 else float("inf")
        losses.append(float((size * np.where(np.abs(mean) <= clip, mean * mean / 2, clip * (np.abs(mean) - clip / 2))).sum() / upto[-1]))
        feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
        for level in range(depth):
            cells = (1 << level) * p * width
            hn, hs = _collected(blocks, _level_batches(p, width, since, rate, feature, cut, level, clip), cells)
            at = slice((1 << level) - 1, (2 << level) - 1)
            feature[at], cut[at] = best_splits(hn.reshape(-1, p, width), hs.reshape(-1, p, width), leaf)
        n, s = _collected(blocks, _leaf_batches(p, since, rate, feature, cut, depth, scale, reach), leaves * STEPS)
        n, s, values = n.reshape(leaves, STEPS), s.reshape(leaves, STEPS), np.zeros(leaves)
        for i in range(leaves):
            own = n[i] > 0
            if own.any():
                size, mean = n[i][own], s[i][own] / n[i][own]
                middle = _median(size, mean)
                values[i] = middle + float((size * np.clip(mean - middle, -clip, clip)).sum() / size.sum())
        grown = Trees(depth, feature[None], cut[None], values[None])
        done, since = _with(done, grown), _with(since, grown)
        if k % REFRESH == REFRESH - 1 and k + 1 < stages:
            before, blocks = blocks, written(blocks.mapInArrow(_refresh_batches(p, since, rate), _BLOCK), k + 1)
            before.unpersist()
            since = empty
    blocks.unpersist()
    return BoostedTrees(list(features), edges, float(start), rate, done, losses)


def _with(trees: Trees, more: Trees) -> Trees:
    return Trees(trees.depth, *(np.concatenate([getattr(trees, x), getattr(more, x)]) for x in ("feature", "cut", "value")))
