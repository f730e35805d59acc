import numpy as np
import pytest

from panelkiln.operators import neural as N


def sample(spark, n=700):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(n, 2))
    y = np.maximum(x[:, 0], 0) - 0.5 * x[:, 1] + 0.1 * draw.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), float(t), k % 4 == 0) for k, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, held boolean")
    return df.where("NOT held"), df.where("held")


def single_process(net, ids, x, y, xv, yv, epochs, rate, l2, batch, seed):
    """Adam over the same batches, in one process."""
    w = [v.copy() for v in net.weights]
    m, v, step, batches = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w], 0, max(1, round(len(y) / batch))
    best, best_loss = None, np.inf
    for epoch in range(epochs):
        number = N.batch_of(ids, epoch, batches, seed)
        for b in range(batches):
            own = number == b
            layers = [x[own]]
            for k in range(0, len(w), 2):
                z = layers[-1] @ w[k] + w[k + 1]
                layers.append(z if k + 2 == len(w) else np.maximum(z, 0))
            delta, g = 2 * (layers[-1] - y[own][:, None]) / own.sum(), []
            for k in range(len(w) - 2, -1, -2):
                g = [layers[k // 2].T @ delta + l2 * w[k], delta.sum(axis=0), *g]
                delta = (delta @ w[k].T) * (layers[k // 2] > 0)
            step += 1
            for k in range(len(w)):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        loss = ((N._forward(w, xv)[-1][:, 0] - yv) ** 2).mean()
        if loss < best_loss:
            best, best_loss = [k.copy() for k in w], loss
    return best


@pytest.mark.parametrize("block_rows", [1 << 16, 100])
def test_steps_equal_one_process_with_the_same_batches(spark, monkeypatch, block_rows):
    monkeypatch.setattr(N, "BLOCK_ROWS", block_rows)
    train, held = sample(spark)
    net = N.Network(["a", "b"], {"a": (0.1, 2.0), "b": (0.0, 1.0)}, N._start([6, 5], 2, 3))
    blocks, rows = N.packed_blocks(net, train, held, "y")
    parts = {kind: [np.concatenate([np.frombuffer(r[c], t) for r in blocks.where(f"held = {kind}").collect()]) for c, t in (("ids", np.int64), ("x", float), ("y", float))] for kind in ("false", "true")}
    (ids, x, y), (_, xv, yv) = parts["false"], parts["true"]
    assert rows == len(y) == 525 and len(set(ids.tolist())) == rows
    found = N.adam(net, blocks, rows, 6, 99, 0.02, 1e-3, 120, 7)
    want = single_process(net, ids, x.reshape(-1, 2), y, xv.reshape(-1, 2), yv, 6, 0.02, 1e-3, 120, 7)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(found.weights, want, strict=True))


@pytest.mark.parametrize("group_bytes", [0, 100 * 24, 1 << 25])
def test_groups_of_batches_change_nothing_and_take_few_jobs(spark, monkeypatch, group_bytes):
    """0: spread over tasks; 100 rows: groups of four batches; else one group."""
    train, held = sample(spark)
    net = N.Network(["a", "b"], {"a": (0.1, 2.0), "b": (0.0, 1.0)}, N._start([6], 2, 3))
    blocks, rows = N.packed_blocks(net, train, held, "y")
    want = N.adam(net, blocks, rows, 2, 99, 0.02, 1e-3, 25, 7)
    monkeypatch.setattr(N, "GROUP_BYTES", group_bytes)
    spark.sparkContext.setJobGroup(f"groups-{group_bytes}", "steps of a network")
    found = N.adam(net, blocks, rows, 2, 99, 0.02, 1e-3, 25, 7)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups-{group_bytes}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(found.weights, want.weights, strict=True))
    assert jobs > 2 * 21 if group_bytes == 0 else jobs <= 2 * (1 + -(-21 // (4 if group_bytes < 10_000 else 21)))


def test_batches_are_dealt_anew_each_epoch():
    ids = np.arange(4000)
    one, two = (N.batch_of(ids, e, 8, 1) for e in (0, 1))
    assert np.abs(np.bincount(one) - 500).max() < 100 and 300 < (one == two).sum() < 700


def test_early_stopping_and_missing_values(spark):
    train, held = sample(spark, 200)
    fit = N.train_network(train, held, ["a", "b"], "y", [4], epochs=8, rate=0.05, batch=50, patience=2)
    rows = spark.createDataFrame([(None, 1.0, "x"), (2.0, None, "y")], "a double, b double, forecast string").drop("forecast")
    assert [r.forecast is not None for r in fit.predict(rows).collect()] == [True, True] and fit.predict(train.limit(0)).count() == 0
    alone = N.train_network(train, held.limit(0), ["a", "b"], "y", [4], epochs=2, batch=50)
    assert np.isfinite(N._flat(alone.weights)).all()
    with pytest.raises(ValueError, match="no training rows"):
        N.train_network(train.limit(0), held, ["a", "b"], "y", [4])


def test_plan_of_a_forecast_keeps_other_columns_in_the_jvm(spark):
    train, _ = sample(spark, 20)
    net = N.Network(["a", "b"], {"a": (0.0, 1.0), "b": (0.0, 1.0)}, N._start([3], 2, 1))
    plan = net.predict(train)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
