"""Random forests of bounded depth on binned features.

Quantiles of each feature turn it into a byte, as in `boosting`. Rows are packed once into blocks of bytes and targets. A level of all trees
is one pass over the blocks, whatever the number of trees: a task sums weights and targets by tree, node, tried feature and bin, the sums of a
tree meet in a shuffle, and its splits are chosen there. The driver gets the splits only.

How often a tree draws a row follows from the seed, the tree and the block, so a pass draws again what the passes before it drew and nothing of it is
stored. A forest holds the mean of every node, so that its first levels are the forest of a lesser depth with the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.nulls import nan_to_null, zero
from panelkiln.operators.boosting import best_splits, quantile_edges
from panelkiln.sources.tables import shared_folder, stored

BINS, BLOCK_ROWS = 32, 1 << 16
#: Nodes are kept as complete trees, up to this depth.
DEEPEST = 10
#: Bytes of sums that a task holds; more trees than fit take further passes.
MOST_BYTES = 128 << 20
SETTINGS = ("numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "subsamplingRate", "bootstrap")


@dataclass
class Forest:
    """feature, cut: by tree and inner node (breadth first); a value goes right if its bin is above the cut. value: by tree and node, the mean of its rows."""

    features: list[str]
    edges: list[np.ndarray]
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def of_depth(self, depth: int) -> Forest:
        inner = (1 << depth) - 1
        return Forest(self.features, self.edges, depth, self.feature[:, :inner], self.cut[:, :inner], self.value[:, : 2 * inner + 1])

    def forecasts(self, bins: np.ndarray, depths: list[int]) -> list[np.ndarray]:
        """The forecasts of rows at each of some depths."""
        rows, out = np.arange(bins.shape[1]), {d: np.zeros(bins.shape[1]) for d in depths}
        for t in range(len(self.value)):
            at = np.zeros(len(rows), np.int64)
            for level in range(max(depths) + 1):
                if level in out:
                    out[level] += self.value[t, (1 << level) - 1 :].take(at)
                if level < max(depths):
                    at = _down(bins, rows, at, level, self.feature[t], self.cut[t])
        return [out[d] / len(self.value) for d in depths]

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        """One pass over all trees; only the features pass through Python."""
        model = self

        @F.pandas_udf("double")
        def forecast(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(model.forecasts(_binned(model.edges, [columns.iloc[:, i].to_numpy(np.float64) for i in range(columns.shape[1])]), [model.depth])[0])

        return df.withColumn(output, forecast(F.struct(*_inputs(self.features))))


def _inputs(features: list[str]) -> list:
    return [F.nanvl(zero(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]


def _binned(edges: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Features by rows."""
    return np.stack([np.searchsorted(e, x, side="left").astype(np.uint8) for e, x in zip(edges, columns, strict=True)])


def _down(bins: np.ndarray, rows: np.ndarray, at: np.ndarray, level: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The nodes of the next level that rows come to, counted from 0 in their level."""
    first = slice((1 << level) - 1, (2 << level) - 1)
    if level == 0:
        return (bins[feature[0]].take(rows) > cut[0]).astype(np.int64)
    x = bins.ravel().take((feature[first] * bins.shape[1]).take(at) + rows)
    return 2 * at + (x > cut[first].take(at))


def _shares(rate: float) -> np.ndarray:
    """The Poisson distribution up to 0, 1, ... draws, in parts of 2 ** 32."""
    upto, k = [], 0
    term = total = exp(-rate)
    while total < 1 - 2.0**-33 and k < 1000:
        upto.append(total)
        k += 1
        term *= rate / k
        total += term
    return np.array(upto) * 2.0**32


def _drawn(seed: int, tree: int, block: int, count: int, rate: float, bootstrap: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that a tree draws, and how often."""
    if not bootstrap and rate >= 1:
        return np.arange(count), np.ones(count)
    draw = np.random.Generator(np.random.SFC64([seed & (2**64 - 1), tree, block]))
    if not bootstrap:
        own = np.flatnonzero(draw.random(count) < rate)
        return own, np.ones(len(own))
    shares, u = _shares(rate), draw.integers(0, 2**32, count, np.uint32)
    own = np.flatnonzero(u >= shares[0])
    return own, 1.0 + np.searchsorted(shares[1:], u.take(own), side="right")


def _tried(seed: int, tree: int, level: int, p: int, k: int) -> np.ndarray:
    """The features that each node of a level tries, in order."""
    nodes = 1 << level
    if k >= p:
        return np.tile(np.arange(p), (nodes, 1))
    return np.sort(np.random.default_rng([seed & (2**64 - 1), tree, level]).random((nodes, p)).argsort(axis=1)[:, :k], axis=1)


def tried_features(strategy: str, p: int, trees: int) -> int:
    """The number of features that a node tries, by the names that Spark's learner knows."""
    named = {"all": p, "sqrt": ceil(sqrt(p)), "log2": max(1, ceil(log2(p))), "onethird": ceil(p / 3), "auto": p if trees == 1 else ceil(p / 3)}
    if strategy in named:
        return named[strategy]
    return min(p, int(strategy)) if strategy.isdigit() else max(1, ceil(float(strategy) * p))


@dataclass
class _Tree:
    """draw: its number in its forest, by which rows are drawn; number: among all trees, by which features are."""

    number: int
    draw: int
    depth: int
    leaf: int
    tried: int
    rate: float
    bootstrap: bool


def _packed(edges: list[np.ndarray]):
    p = len(edges)

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        *x, y = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(p + 1))
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([v.tobytes()], pa.binary()) for v in (_binned(edges, x), y))], ["block", "bins", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(start, BLOCK_ROWS))
                count += held[-1].num_rows
                if count >= BLOCK_ROWS:
                    yield block(number, held)
                    number, held, count = number + 1, [], 0
        if held:
            yield block(number, held)

    return run


def _level_batches(p: int, width: int, seed: int, level: int, trees: list[_Tree], feature: np.ndarray, cut: np.ndarray):
    """Weights and targets by tree, and there by place of the feature among those tried, node of the level and bin."""
    cells = (1 << level) * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = ([np.zeros((t.tried, cells)) for t in trees] for _ in range(2))
        tried = [_tried(seed, t.number, level, p, t.tried) for t in trees]
        for batch in batches:
            for number, bins, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                bins, y, last = np.frombuffer(bins, np.uint8).reshape(p, -1), np.frombuffer(y), None
                for i, t in enumerate(trees):
                    if last != (t.draw, t.rate, t.bootstrap):
                        last = (t.draw, t.rate, t.bootstrap)
                        own, weight = _drawn(seed, t.draw, number, len(y), t.rate, t.bootstrap)
                        goal = weight * y.take(own)
                    at = np.zeros(len(own), np.int64)
                    for k in range(level):
                        at = _down(bins, own, at, k, feature[t.number], cut[t.number])
                    first = at * width
                    for j in range(t.tried):
                        if level == 0 or t.tried == p:
                            x = bins[tried[i][0, j]].take(own)
                        else:
                            x = bins.ravel().take((tried[i][:, j] * bins.shape[1]).take(at) + own)
                        cell = first + x
                        n[i][j] += np.bincount(cell, weight, cells)
                        s[i][j] += np.bincount(cell, goal, cells)
        for i, t in enumerate(trees):
            yield pa.RecordBatch.from_arrays([pa.array([t.number]), *(pa.array([v[i].tobytes()], pa.binary()) for v in (n, s))], ["tree", "n", "s"])

    return run


def _chosen(p: int, width: int, seed: int, level: int, trees: dict[int, _Tree]):
    """Features and cuts of a tree's nodes, the means left and right of them, and the mean of all its rows."""

    def run(sums: pd.DataFrame) -> pd.DataFrame:
        t = trees[int(sums["tree"].iloc[0])]
        n, s = (sum(np.frombuffer(b) for b in sums[c]).reshape(t.tried, -1, width).transpose(1, 0, 2) for c in ("n", "s"))
        place, cut = best_splits(n, s, max(1, t.leaf))
        node = np.arange(1 << level)
        left = np.arange(width) <= cut[:, None]
        ln, ls = (np.where(left, v[node, place], 0.0).sum(axis=1) for v in (n, s))
        rn, rs = (np.where(left, 0.0, v[node, place]).sum(axis=1) for v in (n, s))
        means = np.stack([ls / np.maximum(ln, 1), rs / np.maximum(rn, 1)], axis=1)
        found = {"feature": _tried(seed, t.number, level, p, t.tried)[node, place], "cut": cut, "means": means}
        return pd.DataFrame({"tree": [t.number], **{c: [np.ascontiguousarray(v).tobytes()] for c, v in found.items()}, "whole": [s[:, 0].sum() / max(n[:, 0].sum(), 1)]})

    return run


def _passes(trees: list[_Tree], level: int, width: int) -> list[list[_Tree]]:
    """The trees that grow at a level, by the passes they take; those that draw the same rows are neighbours."""
    out, held = [], 0
    for t in sorted((t for t in trees if max(t.depth, 1) > level), key=lambda t: (t.draw, t.rate, t.bootstrap, t.number)):
        size = 16 * t.tried * width << level
        if not out or held + size > MOST_BYTES:
            out.append([])
            held = 0
        out[-1].append(t)
        held += size
    return out


def grown(train: DataFrame, features: list[str], target: str, forests: list[dict], seed: int = 1) -> list[Forest]:
    """Forests by their settings (see SETTINGS; the names and rules are those of Spark's learner), all in the same passes.

    Forests with the same share of rows draw the same rows, tree by tree. Missing features count as 0.
    """
    spark, p = train.sparkSession, len(features)
    if any(f["maxDepth"] > DEEPEST for f in forests):
        raise ValueError(f"a depth is {DEEPEST} at most")
    known = nan_to_null(train.select(*dict.fromkeys([*features, target]))).where(F.col(target).isNotNull())
    rows = stored(known.select(*_inputs(features), F.col(target).cast("double").alias("y")))
    count = rows.count()
    if not count:
        raise ValueError("no training rows")
    edges = quantile_edges(rows, rows.columns[:-1], BINS)
    width = max(len(e) for e in edges) + 1
    trees = [
        _Tree(0, i, f["maxDepth"], f["minInstancesPerNode"], tried_features(str(f["featureSubsetStrategy"]), p, f["numTrees"]), float(f["subsamplingRate"]), f.get("bootstrap", True))
        for f in forests for i in range(f["numTrees"])
    ]
    for i, t in enumerate(trees):
        t.number = i
    tasks = max(min(-(-count // 8192), 256), -(-count // (1 << 20)))
    # In order, so that the draws depend on rows and not on the order in which a shuffle brings them.
    rows = rows.repartition(tasks).sortWithinPartitions(*rows.columns)
    kind, folder = "block long, bins binary, y binary", shared_folder(spark)
    rows.mapInArrow(_packed(edges), kind).write.parquet(folder)
    blocks = spark.read.schema(kind).parquet(folder)
    deepest = max([1, *(t.depth for t in trees)])
    inner = (1 << deepest) - 1
    feature, cut = np.zeros((len(trees), inner), np.int64), np.full((len(trees), inner), width, np.int64)
    value, alive = np.zeros((len(trees), 2 * inner + 1)), np.ones((len(trees), 1), bool)
    for level in range(deepest):
        nodes = 1 << level
        at, below = slice(nodes - 1, 2 * nodes - 1), slice(2 * nodes - 1, 4 * nodes - 1)
        split = np.zeros((len(trees), nodes), bool)
        value[:, below] = np.repeat(value[:, at], 2, axis=1)
        for own in _passes(trees, level, width):
            sums = blocks.mapInArrow(_level_batches(p, width, seed, level, own, feature, cut), "tree long, n binary, s binary")
            choose = _chosen(p, width, seed, level, {t.number: t for t in own})
            for r in sums.groupBy("tree").applyInPandas(choose, "tree long, feature binary, cut binary, means binary, whole double").collect():
                f, c, means = np.frombuffer(r.feature, np.int64), np.frombuffer(r.cut, np.int64), np.frombuffer(r.means).reshape(nodes, 2)
                split[r.tree] = alive[r.tree] & (c < width)
                if level == 0:
                    value[r.tree, 0] = r.whole
                    value[r.tree, below] = r.whole
                feature[r.tree, at], cut[r.tree, at] = np.where(split[r.tree], f, 0), np.where(split[r.tree], c, width)
                value[r.tree, below] = np.where(split[r.tree][:, None], means, value[r.tree, below].reshape(nodes, 2)).ravel()
        alive = np.repeat(split, 2, axis=1)
    out, first = [], 0
    for f in forests:
        own = slice(first, first + f["numTrees"])
        out.append(Forest(list(features), edges, deepest, feature[own], cut[own], value[own]).of_depth(f["maxDepth"]))
        first += f["numTrees"]
    return out


def forecast_batches(forests: list[tuple[Forest, list[int]]]):
    """The target, and the forecasts of forests at depths, of rows of features and a target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.num_columns - 1
            bins = _binned(forests[0][0].edges, [batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
            found = [v for f, depths in forests for v in f.forecasts(bins, depths)]
            yield pa.RecordBatch.from_arrays([batch.column(p), *map(pa.array, found)], ["y", *(f"f{i}" for i in range(len(found)))])

    return run


def at_depths(rows: DataFrame, target: str, forests: list[tuple[Forest, list[int]]]) -> DataFrame:
    """y and f0, f1, ...: the target and the forecasts of forests that were grown together, at some depths of each, in one pass."""
    inputs = rows.select(*_inputs(forests[0][0].features), F.col(target).cast("double").alias("y"))
    count = sum(len(depths) for _, depths in forests)
    return inputs.mapInArrow(forecast_batches(forests), ", ".join(["y double", *(f"f{i} double" for i in range(count))]))
