from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphprop.operators import learn, metrics, network
from graphprop.operators.network import EPSILON, Adam, Network, Training


def rows_of(spark, n=90, d=3, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, d)), rng.integers(0, classes, n)
    x[np.arange(n), y % d] += 2.5
    return x, y, spark.createDataFrame([(k, [float(v) for v in x[k]], int(y[k])) for k in range(n)], "node long, vec array<double>, y int").repartition(5)


def dense_loss(net, x, y, step=0, seed=0, dropout=0.0, nodes=None):
    """The mean loss of one batch, all rows in one matrix."""
    for k in range(net.hidden):
        z = x @ net.weight[k] + net.bias[k]
        z = (z - z.mean(0)) / np.sqrt(z.var(0) + EPSILON) * net.scale[k] + net.shift[k]
        x = np.maximum(z, 0)
        if dropout:
            x = x * network.kept_units(nodes, x.shape[1], k, step, seed, dropout)
    z = x @ net.weight[-1] + net.bias[-1]
    z = z - z.max(1, keepdims=True)
    return -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean()


@pytest.mark.parametrize(("layers", "dropout"), [([3, 3], 0.0), ([3, 4, 3], 0.0), ([3, 5, 4, 3], 0.4)])
def test_gradients_are_those_of_the_dense_loss(spark, layers, dropout):
    x, y, df = rows_of(spark)
    net = Network.new(layers, 3)
    g, loss, n, _ = network.gradient(net, df, 5, 11, dropout)
    of = lambda v: dense_loss(net.moved(v), x, y, 5, 11, dropout, np.arange(len(y)))
    at, eps = net.flat(), 1e-5
    slope = np.array([(of(at + eps * e) - of(at - eps * e)) / (2 * eps) for e in np.eye(len(at))])
    assert n == len(y) and loss == pytest.approx(of(at), abs=1e-12)
    assert np.abs(g - slope).max() < 1e-7


def test_a_step_equals_a_dense_one(spark):
    """The same arithmetic in one matrix, written out for one hidden layer."""
    x, y, df = rows_of(spark)
    net = Network.new([3, 4, 3], 5)
    n = len(y)
    z = x @ net.weight[0] + net.bias[0]
    sd = np.sqrt(z.var(0) + EPSILON)
    unit = (z - z.mean(0)) / sd
    a = np.maximum(unit * net.scale[0] + net.shift[0], 0)
    p = np.exp(a @ net.weight[1] + net.bias[1])
    d = (p / p.sum(1, keepdims=True) - np.eye(3)[y]) / n
    up = (d @ net.weight[1].T) * (a > 0)
    dz = net.scale[0] / sd * (up - up.mean(0) - unit * (up * unit).mean(0))
    want = np.concatenate([v.ravel() for v in (x.T @ dz, a.T @ d, dz.sum(0), d.sum(0), (up * unit).sum(0), up.sum(0))])
    g, *_ = network.gradient(net, df)
    assert np.abs(g - want).max() < 1e-12
    assert np.abs(Adam(0.1).step(net.flat(), g) - (net.flat() - 0.1 * g / (np.abs(g) + 1e-8))).max() < 1e-9


def test_units_are_dropped_by_share_and_independently():
    kept = network.kept_units(np.arange(20_000), 8, 0, 1, 7, 0.3) > 0
    sd = np.sqrt(0.3 * 0.7 / 20_000)
    assert np.abs(kept.mean(0) - 0.7).max() < 5 * sd
    for other in (network.kept_units(np.arange(20_000), 8, 0, 2, 7, 0.3), network.kept_units(np.arange(20_000), 8, 1, 1, 7, 0.3), np.roll(kept, 1, 0), np.roll(kept, 1, 1)):
        assert abs((kept & (other > 0)).mean() - 0.49) < 0.01


def test_training_keeps_the_best_epoch_and_goes_on_from_it(spark, tmp_path):
    _, _, df = rows_of(spark, 240)
    train, held = df.where("node % 4 <> 0"), df.where("node % 4 = 0")
    got = network.fit(train, held, Network.new([3, 8, 3]), Training(epochs=8, batches=2, rate=0.05, dropout=0.1, patience=3))
    held_losses = [b for _, b in got.losses]
    assert got.best == int(np.argmin(held_losses)) and network.loss_of(got.network, held) == pytest.approx(min(held_losses), abs=1e-12)
    assert metrics.accuracy(network.predicted(got.network, held)).first().accuracy > 0.8
    learn.save_arrays(spark, got.network.arrays(), f"{tmp_path}/net")
    back = Network.of_arrays(learn.load_arrays(spark, f"{tmp_path}/net"))
    assert (back.flat() == got.network.flat()).all() and all((a == b).all() for a, b in zip(back.mean + back.var, got.network.mean + got.network.var, strict=True))
    on = network.fit(train, held, back, Training(epochs=1, batches=2, rate=0.001))
    assert on.losses[0][1] < got.losses[0][1]


def test_steps_do_not_work_against_the_memory(spark):
    _, _, df = rows_of(spark, 120)
    net = network.fit(df, df, Network.new([3, 3], 1), Training(epochs=6, batches=1, rate=0.1)).network
    other = df.withColumn("y", (F.col("y") + 1) % 3)
    cfg = Training(epochs=3, batches=1, rate=0.05)
    free, bound = network.fit(other, other, net, cfg).network, network.fit(other, other, net, cfg, memory=df).network
    assert network.loss_of(bound, df) < network.loss_of(free, df)
    g, reference = np.array([1.0, -2.0]), np.array([0.0, 1.0])
    assert abs(network.projected(g, reference) @ reference) < 1e-12 and (network.projected(-g, reference) == -g).all()


def test_empty_null_and_single_rows(spark):
    schema = "node long, vec array<double>, y int"
    none, net = spark.createDataFrame([], schema), Network.new([2, 3, 2])
    assert network.gradient(net, none)[2] == 0 and network.fit(none, none, net).network is net
    assert network.loss_of(net, none) == float("inf") and network.predicted(net, none).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 1), (3, [1.0, None], 1), (4, [0.0, 1.0], None)], schema)
    got = network.fit(odd, none, net, Training(epochs=2, batches=3))
    assert np.isfinite(got.network.flat()).all() and got.best >= 0
    assert {(r.node, r.y) for r in network.predicted(net, odd).collect()} == {(1, 0), (4, None)}
    one = spark.createDataFrame([(1, [1.0, 2.0], 1)], schema)
    assert np.isfinite(network.gradient(net, one)[0]).all()
