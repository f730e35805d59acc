"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct buckets (2 ** BITS of them) of its words, its word pairs and its pairs with one word
between. FTRL-proximal (per-coordinate learning rates, L1 and L2 terms) is fitted on at most `most_rows` labelled rows,
chosen by a hash of their doc_id. That bound is the only sample: every text is scored. The model is fitted in one task,
since a feature's gradients must meet before L1 is applied; beside it FOLDS models, each without one part of the rows, score
the rows they have not seen, and a logistic curve through those scores calibrates the model (slope and intercept).
L1 leaves few weights, which go to the tasks as two arrays of at most MOST_WEIGHTS entries; of more, the smallest are
left out.

Null texts and texts without words get the score of the intercept. Rows without doc_id are scored and never learned
from, as are rows without label; a doc_id with several labels counts as toxic if one of them says so, one with several
texts teaches by the least of them. Without any labelled row, or with labels of one class only, every score is the share
of toxic rows (0 without rows). Other columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import bounded_rows, crc_mod, cut, map_batches, returning, table
from panelkiln.llm.textops import ALPHANUMERIC, Words, mix, pieces, utf8

BITS = 22
MOST_ROWS = 24_000
MOST_WEIGHTS = 1_000_000
EPOCHS = 4
FOLDS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.3
#: Partitions over which the hash deals the models 0 to FOLDS one by one.
TASKS = 7
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Weights:
    """Buckets (sorted) with a weight other than 0, their weights, and the intercept."""

    buckets: np.ndarray
    values: np.ndarray
    intercept: float


def occurrences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word, pair and skip pair; a feature that repeats comes repeatedly."""
    h, doc = words.hashes, words.docs()
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], 41)
        skip = mix(h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:], 42)
    two, three = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    return np.concatenate([doc, doc[:-1][two], doc[:-2][three]]), (np.concatenate([h, pair[two], skip[three]]) >> _SHIFT).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order."""
    doc, bucket = occurrences(Words(data, offsets, ALPHANUMERIC))
    both = np.unique((doc << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


def learned(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray | None = None, l1: float = L1, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of FTRL-proximal over the rows that are `seen` (all, if it is None).

    Rows hold distinct buckets, of which 1 << BITS, the intercept, has no L1. Each row is replaced by the places of its
    buckets in what is returned, so that the rows are held once.

    A gradient is less than 1, so a feature of at most l1 / EPOCHS rows keeps the weight 0 and has no part in any other:
    such features are left out before.
    """
    seen = np.arange(len(rows)) if seen is None else seen
    counts = np.zeros((1 << BITS) + 1, np.int32)
    for k in seen.tolist():
        counts[rows[k]] += 1
    counts[-1] *= int(l1) + 1
    buckets = np.flatnonzero(counts * EPOCHS > l1)
    buckets = buckets[np.argsort(-counts[buckets], kind="stable")]  # features of many rows lie together
    number = np.full((1 << BITS) + 1, -1, np.int32)
    number[buckets] = np.arange(len(buckets))
    for k, row in enumerate(rows):
        own = number[row]
        rows[k] = own[own >= 0]
    del counts, number
    z, n, w = np.zeros(len(buckets)), np.zeros(len(buckets)), np.zeros(len(buckets))
    limit = np.where(buckets == 1 << BITS, 0.0, l1)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in seen[order.permutation(len(seen))].tolist():
            at = rows[k]
            old, have = w[at], n[at]
            g = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, old.sum())))) - labels[k]
            root = np.sqrt(have + g * g)
            now = z[at] + g - (root - np.sqrt(have)) / ALPHA * old
            z[at], n[at] = now, have + g * g
            most = limit[at]
            w[at] = np.where(np.abs(now) <= most, 0.0, -(now - np.copysign(most, now)) / ((BETA + root) / ALPHA + L2))
    return buckets, w


def calibration(totals: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (0.1 to 10) and intercept of the logistic curve through unseen rows' totals, by Newton steps."""
    slope, intercept = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * totals + intercept, -35, 35)))
        r = p * (1 - p) + 1e-9
        gradient = np.array([((p - labels) * totals).sum() + (slope - 1) * 0.01, (p - labels).sum() + intercept * 0.01])
        curve = np.array([[(r * totals * totals).sum() + 0.01, (r * totals).sum()], [(r * totals).sum(), r.sum() + 0.01]])
        step = np.linalg.solve(curve, gradient)
        slope, intercept = float(np.clip(slope - step[0], 0.1, 10)), float(np.clip(intercept - step[1], -35, 35))
        if np.abs(step).max() < 1e-9:
            break
    return slope, intercept


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows kind, at, value, label: weights of model 0; totals of the rows that another model has not seen.

    Rows come sorted by model. Their number is bounded by contract; their buckets are kept, not their texts.
    """

    def fitted_rows(model: int, rows: list[np.ndarray], labels: list[float], folds: list[int]) -> pa.RecordBatch:
        label, fold = np.array(labels), np.array(folds)
        seen = np.flatnonzero(fold != model - 1)
        buckets, w = learned(rows, label, seen)
        if model == 0:
            at = np.flatnonzero((w != 0) | (buckets == 1 << BITS))
            columns = [buckets[at].astype(np.int64), w[at], np.zeros(len(at))]
        else:
            rest = np.flatnonzero(fold == model - 1)
            columns = [rest, np.array([w[rows[k]].sum() for k in rest], float), label[rest]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), model, np.int32)), *(pa.array(x) for x in columns)], ["model", "at", "value", "label"])

    now, rows, labels, folds = None, [], [], []
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 19):
            doc, bucket = features(*utf8(piece.column(0)))
            bounds = np.searchsorted(doc, np.arange(piece.num_rows + 1)).tolist()
            for k, (label, fold, model) in enumerate(zip(*(piece.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if model != now and rows:
                    yield fitted_rows(now, rows, labels, folds)
                    rows, labels, folds = [], [], []
                now = model
                rows.append(np.append(bucket[bounds[k] : bounds[k + 1]], 1 << BITS).astype(np.int32))
                labels.append(label)
                folds.append(fold)
    if rows:
        yield fitted_rows(now, rows, labels, folds)


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Weights:
    """Weights from the texts of labelled rows. labels: doc_id, label (0 or 1); both tables are joined on doc_id."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).head()
    if n > most_rows:
        known = known.orderBy("place", "doc_id").limit(most_rows)
    texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))
    fold = F.pmod(F.shiftright("place", 7), F.lit(FOLDS)).cast("int")
    models = F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))
    dealt = texts.select("text", F.col("label").cast("double").alias("label"), fold.alias("fold"), models.alias("model"), "place", "doc_id")
    dealt = dealt.repartition(TASKS, "model").sortWithinPartitions("model", "place", "doc_id").select("text", "label", "fold", "model")
    none = not n or toxic in (0, n)
    rows = [] if none else bounded_rows(cut(map_batches(dealt, returning(_train_batches), "model int, at long, value double, label double")), most_rows + (1 << BITS) + 1, "weights and calibration rows")
    if not rows:
        share = toxic / n if n else 0.0
        return Weights(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))) if 0 < share < 1 else 35.0 * np.sign(share - 0.5))
    unseen = np.array([r[2:] for r in rows if r[0]], float).reshape(-1, 2)
    slope, intercept = calibration(unseen[:, 0], unseen[:, 1])
    own = sorted((r[1], r[2]) for r in rows if r[0] == 0)
    bucket, weight = np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own]) * slope
    intercept += float(weight[bucket == 1 << BITS].sum())
    most = np.sort(np.argsort(-np.abs(weight[bucket < 1 << BITS]), kind="stable")[:MOST_WEIGHTS])
    return Weights(bucket[most], weight[most], intercept)


def scores(data: np.ndarray, offsets: np.ndarray, weights: Weights) -> np.ndarray:
    """Probabilities of toxicity."""
    total = np.full(len(offsets) - 1, weights.intercept)
    if len(weights.buckets):
        lookup = np.zeros(1 << BITS, np.float32)
        lookup[weights.buckets] = weights.values
        doc, bucket = occurrences(Words(data, offsets, ALPHANUMERIC))
        hit = np.flatnonzero(lookup[bucket])
        both = np.unique((doc[hit] << BITS) | bucket[hit])
        total += np.bincount(both >> BITS, lookup[both & ((1 << BITS) - 1)], len(total))
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def _score_batches(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                found = scores(*utf8(piece.column(0)), weights)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found)], [*piece.schema.names, "__score"])

    return run


def score(documents: DataFrame, weights: Weights) -> DataFrame:
    """`documents` with toxicity (double, 0 to 1); a column of that name is replaced."""
    names = [c for c in documents.columns if c != "toxicity"]
    inner = documents.select(F.col("text").alias("__text"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(names) if c != "text"))
    done = map_batches(inner, returning(_score_batches(weights)), ", ".join(f"{c} {kind}" for c, kind in [*inner.dtypes, ("__score", "double")]))
    return done.select(*((F.col("__text") if c == "text" else F.col(f"__{i}")).alias(c) for i, c in enumerate(names)), F.col("__score").alias("toxicity"))


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(False))


def fitted(spark: SparkSession, documents: DataFrame, sf_dir: str) -> Weights:
    """Weights from the labels table, its held-out rows left out."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return fit(documents, labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out fifth."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(documents, fitted(spark, documents, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
