"""Feed-forward networks trained by synchronous steps.

Rows are standardised and packed once into blocks on the shared folder, training and validation rows apart. A step of Adam takes a mini-batch from
all blocks: each epoch a hash deals the rows anew to batches of about the wanted size. The result is that of one process that
goes through the same batches.

Steps follow one another, and a batch of usual size is milliseconds of work, less than a job costs. So an epoch is dealt by one shuffle to groups of
consecutive batches (GROUP_BYTES at most), and a task goes through the steps of one group, from the weights and Adam's state that the
group before has left. No task holds more than a group; jobs and bytes of an epoch grow with the rows. A sum over all
validation rows after each epoch decides on early stopping.

A batch that is larger than a group, or holds all rows, is spread instead: tasks sum the gradients of their rows, the sums meet in a shuffle, and the driver moves the weights. Its
first step of an epoch also sums the validation loss of the weights that it starts from. The weights are bounded by MOST_WEIGHTS and
travel in the task's function. Forecasts pass the features alone through Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions.nulls import zero
from panelkiln.operators.features import moments
from panelkiln.sources.tables import shared_folder

MOST_WEIGHTS = 2_000_000
BLOCK_ROWS = 1 << 16
#: Most bytes of rows that a task goes through step by step.
GROUP_BYTES = 1 << 25
_BLOCK = "held boolean, ids binary, x binary, y binary"
WIDTHS = {f"NN{d}": [32] * d for d in range(1, 6)}


def _start(widths: list[int], features: int, seed: int) -> list[np.ndarray]:
    sizes, draw = [features, *widths, 1], np.random.default_rng(seed)
    out: list[np.ndarray] = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        out += [draw.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)]
    return out


def _forward(w: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    layers = [x]
    for k in range(0, len(w), 2):
        z = layers[-1] @ w[k] + w[k + 1]
        layers.append(np.maximum(z, 0) if k + 2 < len(w) else z)
    return layers


def _gradients(w: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Sums over rows of the gradients of the squared errors."""
    layers = _forward(w, x)
    delta = 2 * (layers[-1] - y[:, None])
    out: list[np.ndarray] = []
    for k in range(len(w) - 2, -1, -2):
        out = [layers[k // 2].T @ delta, delta.sum(axis=0), *out]
        delta = (delta @ w[k].T) * (layers[k // 2] > 0)
    return out


def _flat(w: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for x in like:
        out.append(flat[at : at + x.size].reshape(x.shape))
        at += x.size
    return out


def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(features)], axis=1)


def batch_of(ids: np.ndarray, epoch: int, batches: int, seed: int) -> np.ndarray:
    """The batch of each row in an epoch, by a hash of its number."""
    x = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + epoch * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(batches)).astype(np.int64)


def _pack_batches(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(features + 2).to_numpy(zero_copy_only=False)
            x, y, ids = _matrix(batch, features), batch.column(features).to_numpy(zero_copy_only=False), batch.column(features + 1).to_numpy()
            for kind in (False, True):
                own = np.flatnonzero(held == kind)
                for s in range(0, len(own), BLOCK_ROWS):
                    at = own[s : s + BLOCK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), *(pa.array([np.ascontiguousarray(v[at]).tobytes()], pa.binary()) for v in (ids, x, y))], ["held", "ids", "x", "y"])

    return run


def _step_batches(w: list[np.ndarray], epoch: int, batches: int, number: int, seed: int):
    """Gradient sums of a mini-batch, its rows, and in an epoch's first batch the squared errors and rows held for validation."""
    size = sum(x.size for x in w)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 3)
        for table in rows:
            for held, ids, x, y in zip(*(table.column(i).to_pylist() for i in range(4)), strict=True):
                y = np.frombuffer(y)
                x = np.frombuffer(x).reshape(len(y), -1)
                if held:
                    if number == 0:
                        total[-2:] += ((_forward(w, x)[-1][:, 0] - y) ** 2).sum(), len(y)
                    continue
                own = np.flatnonzero(batch_of(np.frombuffer(ids, np.int64), epoch, batches, seed) == number)
                if len(own):
                    total[:size] += _flat(_gradients(w, x[own], y[own]))
                    total[size] += len(own)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "v"])

    return run


@dataclass
class _Adam:
    """Weights and Adam's moments; a step takes mean gradients of a batch."""

    now: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    def move(self, g: np.ndarray, rate: float) -> None:
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.now = self.now - rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def _dealt(epoch: int, batches: int, group: int, seed: int):
    """The rows of a block by group of batches: group, then first row number of the block, batches, features and targets."""

    def run(block) -> Iterator[tuple[int, tuple]]:
        ids, y = np.frombuffer(block.ids, np.int64), np.frombuffer(block.y)
        x, number = np.frombuffer(block.x).reshape(len(y), -1), batch_of(ids, epoch, batches, seed)
        order = np.argsort(number, kind="stable")
        at = np.searchsorted(number[order], np.arange(0, batches + group, group))
        for k in range(len(at) - 1):
            own = order[at[k] : at[k + 1]]
            if len(own):
                yield k, (int(ids[0]), number[own].astype(np.int32).tobytes(), x[own].tobytes(), y[own].tobytes())

    return run


def _group_steps(state: _Adam, like: list[np.ndarray], decay: np.ndarray, rate: float):
    """Adam's state after the steps of a group of batches."""

    def run(pieces: Iterator[tuple[int, tuple]]) -> list[_Adam]:
        own, found = replace(state), sorted((p for _, p in pieces), key=lambda p: p[0])
        if not found:
            return [own]
        number, x, y = (np.concatenate([np.frombuffer(p[i], t) for p in found]) for i, t in ((1, np.int32), (2, float), (3, float)))
        order = np.argsort(number, kind="stable")
        x, y = x.reshape(len(y), -1)[order], y[order]
        ends = np.flatnonzero(np.diff(number[order], append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own.move(_flat(_gradients(_shaped(own.now, like), x[a:b], y[a:b])) / (b - a) + decay * own.now, rate)
        return [own]

    return run


def _held_loss(w: list[np.ndarray]):
    """First row number, squared errors and rows of a block held for validation."""

    def run(block) -> tuple[int, float, int]:
        y = np.frombuffer(block.y)
        error = _forward(w, np.frombuffer(block.x).reshape(len(y), -1))[-1][:, 0] - y
        return int(np.frombuffer(block.ids, np.int64)[0]), float(error @ error), len(y)

    return run


@dataclass(frozen=True)
class Network:
    features: list[str]
    scale: dict[str, tuple[float, float]]
    weights: list[np.ndarray]

    def _inputs(self, df: DataFrame):
        return [((zero(c) - self.scale[c][0]) / self.scale[c][1]).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]

    def predict(self, df: DataFrame, output: str = "forecast") -> DataFrame:
        w, k = self.weights, len(self.features)

        @F.pandas_udf("double")
        def forecast(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(_forward(w, columns.to_numpy(np.float64).reshape(-1, k))[-1][:, 0])

        return df.withColumn(output, forecast(F.struct(*self._inputs(df))))

    def inputs(self, raw: np.ndarray) -> np.ndarray:
        scale = np.array([self.scale[c] for c in self.features]).reshape(-1, 2)
        return (raw - scale[:, 0]) / scale[:, 1]

    def ablated(self, raw: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        """Forecasts of rows of raw features, in the first column as they are and then with each group of features set to 0.

        Only what the group adds to the first layer is taken out of it.
        """
        x, w = self.inputs(raw), self.weights
        at_zero = self.inputs(np.zeros((1, raw.shape[1])))[0]
        first = x @ w[0] + w[1]
        out = []
        for own in [[], *groups]:
            z = first - (x[:, own] - at_zero[own]) @ w[0][own]
            out.append(z[:, 0] if len(w) == 2 else _forward(w[2:], np.maximum(z, 0))[-1][:, 0])
        return np.stack(out, axis=1)

    def ssd(self, df: DataFrame) -> DataFrame:
        """feature, ssd: sum over rows of the squared derivative by each raw feature."""
        w, k = self.weights, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                layers = _forward(w, _matrix(batch, k))
                slope = np.ones((batch.num_rows, 1))
                for j in range(len(w) - 2, -1, -2):
                    slope = slope @ w[j].T
                    if j:
                        slope = slope * (layers[j // 2] > 0)
                total += (slope * slope).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["cell", "v"])

        sums = df.select(*self._inputs(df)).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
        names = F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(self.scale[c][1]).alias("sd")) for c in self.features))
        return sums.select(names[F.col("cell").cast("int")].alias("r"), "v").select("r.feature", (F.col("v") / (F.col("r.sd") * F.col("r.sd"))).alias("ssd"))


def packed_blocks(net: Network, train: DataFrame, validation: DataFrame, target: str) -> tuple[DataFrame, int]:
    """The standardised rows with a target as blocks on the shared folder, and the number of training rows."""
    spark = train.sparkSession
    parts = [df.where(F.col(target).isNotNull()).select(*net._inputs(df), F.col(target).cast("double").alias("y"), F.lit(held).alias("held")) for df, held in ((train, False), (validation, True))]
    both = parts[0].unionByName(parts[1])
    count = {r.held: r.n for r in both.groupBy("held").agg(F.count("*").alias("n")).collect()}
    tasks, path = max(1, -(-sum(count.values()) // BLOCK_ROWS)), f"{shared_folder(spark)}/blocks"
    numbered = both.repartition(tasks).select(*(f"x{i}" for i in range(len(net.features))), "y", F.monotonically_increasing_id().alias("id"), "held")
    numbered.mapInArrow(_pack_batches(len(net.features)), _BLOCK).write.parquet(path)
    return spark.read.schema(_BLOCK).parquet(path).coalesce(tasks).cache(), count.get(False, 0)


def _spread_epoch(blocks: DataFrame, state: _Adam, like: list[np.ndarray], decay: np.ndarray, epoch: int, batches: int, rate: float, seed: int, first_only: bool) -> Iterator[float | None]:
    """The steps of an epoch, a job each; first yields the validation loss of the weights before it."""
    size = len(state.now)
    for number in range(1 if first_only else batches):
        sums = np.zeros(size + 3)
        found = blocks.mapInArrow(_step_batches(_shaped(state.now, like), epoch, batches, number, seed), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        sums[found.column(0).to_numpy()] = found.column(1).to_numpy()
        if number == 0:
            yield sums[-2] / sums[-1] if sums[-1] else None
        if sums[size]:  # a hash may leave a small batch empty
            state.move(sums[:size] / sums[size] + decay * state.now, rate)


def _grouped_epoch(blocks: RDD, held: RDD, state: _Adam, like: list[np.ndarray], decay: np.ndarray, epoch: int, batches: int, rate: float, seed: int, first_only: bool, group: int) -> Iterator[float | None]:
    """The same by groups of batches, one after another."""
    sums = sorted(held.map(_held_loss(_shaped(state.now, like))).collect()) if epoch else []
    rows = sum(n for _, _, n in sums)
    yield sum(e for _, e, _ in sums) / rows if rows else None
    if first_only:
        return
    groups = -(-batches // group)
    dealt = blocks.flatMap(_dealt(epoch, batches, group, seed)).partitionBy(groups, int)
    for k in range(groups):
        state.__dict__.update(blocks.context.runJob(dealt, _group_steps(replace(state), like, decay, rate), [k])[0].__dict__)


def adam(net: Network, blocks: DataFrame, rows: int, epochs: int, patience: int, rate: float, l2: float, batch: int, seed: int) -> Network:
    """The weights with the best validation loss; without validation rows those of the last epoch."""
    like, batches = net.weights, max(1, round(rows / batch))
    decay = _flat([l2 * (w.ndim == 2) * np.ones_like(w) for w in like])
    now = _flat(like)
    state, best, best_loss, since = _Adam(now, np.zeros_like(now), np.zeros_like(now)), now, float("inf"), 0
    group = int(GROUP_BYTES / (8 * (len(net.features) + 1) * max(1, rows / batches))) if batches > 1 else 0
    if group:
        trained, held = (blocks.where(f"held = {kind}").select("ids", "x", "y").rdd for kind in ("false", "true"))
    for epoch in range(epochs + 1):
        settings = (state, like, decay, epoch, batches, rate, seed, epoch == epochs)
        work, before = _grouped_epoch(trained, held, *settings, group) if group else _spread_epoch(blocks, *settings), state.now
        loss = next(work)
        if epoch:
            if loss is None or loss < best_loss - 1e-12:
                best, best_loss, since = before, loss or best_loss, 0
            elif (since := since + 1) >= patience:
                break
        for _ in work:  # the steps
            pass
    return Network(net.features, net.scale, _shaped(best, like))


def train_network(
    train: DataFrame, validation: DataFrame, features: list[str], target: str, widths: list[int] | None = None, epochs: int = 100, patience: int = 5, rate: float = 1e-3, l2: float = 1e-4,
    batch: int = 4096, seed: int = 1,
) -> Network:
    """ReLU layers of the given widths; stops when `patience` epochs brought no better validation loss."""
    net = Network(features, moments(train, features), _start(WIDTHS["NN3"] if widths is None else widths, len(features), seed))
    if sum(w.size for w in net.weights) > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    blocks, rows = packed_blocks(net, train, validation, target)
    if not rows:
        raise ValueError("no training rows")
    fitted = adam(net, blocks, rows, epochs, patience, rate, l2, batch, seed)
    blocks.unpersist()
    return fitted
