import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkiln.operators import boosting as B

FEATURES = ["a", "b", "c"]


def sample(spark, n=1500, seed=2):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) + 0.4 * np.abs(x[:, 1]) + 0.3 * draw.standard_t(2, n)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5), x, y


def plain(x, y, edges, stages, rate, depth, leaf, quantile):
    """The same boosting row by row in numpy, with exact medians and quantiles."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    f, losses = np.full(len(y), np.sort(y)[(len(y) - 1) // 2]), []
    for _ in range(stages):
        r = y - f
        size = np.sort(np.abs(r))
        clip = size[int(np.ceil(quantile * len(y))) - 1]
        losses.append(np.where(np.abs(r) <= clip, r * r / 2, clip * (np.abs(r) - clip / 2)).mean())
        g, parts = np.clip(r, -clip, clip), [np.arange(len(y))]
        for _ in range(depth):
            grown = []
            for own in parts:
                best = (0.0, None)
                for i, e in enumerate(edges):
                    for c in range(len(e)):
                        left = bins[own, i] <= c
                        if left.sum() >= leaf and (~left).sum() >= leaf:
                            gain = left.sum() * (~left).sum() / len(own) * (g[own[left]].mean() - g[own[~left]].mean()) ** 2
                            if gain > best[0] * (1 + 1e-10):
                                best = (gain, left)
                grown += [own] if best[1] is None else [own[best[1]], own[~best[1]]]
            parts = grown
        for own in parts:
            middle = np.sort(r[own])[(len(own) - 1) // 2]
            f[own] += rate * (middle + np.clip(r[own] - middle, -clip, clip).mean())
    return f, losses


def test_boosting_equals_plain_numpy(spark):
    df, x, y = sample(spark)
    model = B.boosted_huber(df, FEATURES, "y", stages=25, rate=0.2, leaf=40, bins=16)
    f, losses = plain(x, y, model.edges, 25, 0.2, 2, 40, 0.9)
    assert np.allclose(model.loss, losses, rtol=2e-3) and model.loss[-1] < 0.75 * model.loss[0]
    found = {(r.a, r.b, r.c): r.forecast for r in model.predict(df).collect()}
    own = np.array([found[tuple(r)] for r in x])
    assert np.abs(own - f).mean() < 0.01 and np.corrcoef(own, f)[0, 1] > 0.999


def test_blocks_written_anew_change_nothing(spark, monkeypatch):
    df, _, _ = sample(spark, 400)
    one = B.boosted_huber(df, FEATURES, "y", stages=7, rate=0.3, leaf=10, bins=8)
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "BLOCK_ROWS", 90)  # several blocks and tasks
    two = B.boosted_huber(df, FEATURES, "y", stages=7, rate=0.3, leaf=10, bins=8)
    assert (one.trees.feature == two.trees.feature).all() and (one.trees.cut == two.trees.cut).all() and np.allclose(one.trees.value, two.trees.value)


def test_missing_values_constants_and_small_leaves(spark):
    df = spark.createDataFrame([(None, 1.0, 0.5), (1.0, 1.0, 0.25), (2.0, 1.0, None), (float("nan"), 1.0, 0.75)], "a double, b double, y double")
    model = B.boosted_huber(df.where("a IS NULL OR NOT isnan(a)"), ["a", "b"], "y", stages=3, leaf=100)
    assert (model.trees.cut >= 1).all()  # no leaf could hold 100 rows: nothing is split
    assert [r.forecast is not None for r in model.predict(df).collect()] == [True] * 4
    with pytest.raises(ValueError, match="no training rows"):
        B.boosted_huber(df.where("y > 5"), ["a"], "y")
    with pytest.raises(ValueError, match="bins"):
        B.boosted_huber(df, ["a"], "y", bins=1000)


def test_few_values_get_every_cut_and_the_start_is_the_exact_median(spark):
    """A value too rare for a quantile, and more rows than the sketch of a quantile keeps."""
    df = spark.range(0, 300_000, 1, 6).select((F.col("id") % 3 + F.when(F.col("id") % 1000 == 7, 10).otherwise(0)).cast("double").alias("a"), (F.hash("id") / 1e6).alias("b"))
    edges = B.quantile_edges(df, ["a", "b"], 64)
    assert edges[0].tolist() == [0.5, 1.5, 6.0, 10.5, 11.5] and len(edges[1]) == 63
    values = np.sort([r.b for r in df.select("b").collect()])
    for most in (100_000, 50):
        assert B.lower_median(df, "b", 300_000, values[0], values[-1], most) == values[149_999]
    assert B.lower_median(df.withColumn("b", F.lit(2.0)), "b", 300_000, 1.0, 3.0, 50) == 2.0
    model = B.boosted_huber(df, ["a"], "b", stages=1)
    assert model.start == values[149_999]


def test_a_quantile_of_one_clips_nothing(spark):
    """The far value lies in a leaf of negative median: its distance from that is larger than any residual."""
    df = spark.createDataFrame([(0.0, -3.0)] * 6 + [(0.0, 50.0)] + [(1.0, 1.0)] * 8, "a double, y double")
    model = B.boosted_huber(df, ["a"], "y", stages=1, rate=1.0, leaf=2, quantile=1.0)
    found = {r.a: r.forecast for r in model.predict(df).distinct().collect()}
    assert found[0.0] == pytest.approx(32 / 7) and found[1.0] == pytest.approx(1.0)


def test_a_pass_scores_few_trees(spark, monkeypatch):
    """Trees that the blocks' forecasts do not hold yet are scored in every pass over the rows."""
    seen, plain_batches = [], B._level_batches
    monkeypatch.setattr(B, "_level_batches", lambda p, width, since, *rest: (seen.append(len(since.value)), plain_batches(p, width, since, *rest))[1])
    B.boosted_huber(sample(spark, 200)[0], FEATURES, "y", stages=14, leaf=10, bins=8)
    assert len(seen) == 28 and max(seen) < 10
    draw = np.random.default_rng(1)
    bins, feature, cut = draw.integers(0, 9, (200, 3)).astype(np.uint8), draw.integers(0, 3, 31), draw.integers(0, 9, 31)
    want = []
    for row in bins:
        at = 0
        for level in range(5):
            at = 2 * at + int(row[feature[at + (1 << level) - 1]] > cut[at + (1 << level) - 1])
        want.append(at)
    assert B.nodes(bins, feature, cut, 5).tolist() == want
