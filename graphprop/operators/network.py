"""A perceptron with batch normalisation, ReLU and dropout, trained by Adam on mini-batches that Spark sums.

A layer is linear, normalised over the batch, cut at 0 and thinned; the last is
linear, and its log-softmax is scored by the negative log-likelihood. Rows are
(node long, vec array<double>, y int); rows with a null in ``vec`` or ``y``
take no part. A row's batch is a hash of its node, written once as a folder of
its own, so that a step reads its batch only; epochs take the batches in
changing orders.

The moments of a batch are sums over its rows, and so are the two sums that a
normalisation needs on the way back, so a step over H hidden layers is 2 H
jobs: one for each layer's moments and one for each layer's gradients. Tasks
send one block of sums each, which are added in a tree; the driver and the
closures hold what the architecture bounds, never rows. Dropout is a hash of
(seed, step, layer, node, unit): a task that runs again drops the same units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprop.operators.etl import hash_order
from graphprop.tables import Scratch

#: Added to a variance before its root, and the weight of a batch in the running moments.
EPSILON, MOMENTUM = 1e-5, 0.1

#: Adam's decays and the constant of its denominator.
DECAY, DECAY_SQUARED, TINY = 0.9, 0.999, 1e-8


@dataclass
class Network:
    """Weights and biases of H + 1 linear layers; scale, shift and running moments of H normalisations."""

    weight: list[np.ndarray]
    bias: list[np.ndarray]
    scale: list[np.ndarray]
    shift: list[np.ndarray]
    mean: list[np.ndarray]
    var: list[np.ndarray]

    @classmethod
    def new(cls, layers: list[int], seed: int = 20159) -> Network:
        """Uniform weights and biases within one over the root of a layer's inputs."""
        rng = np.random.default_rng(seed)
        near = [1 / np.sqrt(n) for n in layers[:-1]]
        return cls(
            [rng.uniform(-s, s, (a, b)) for s, a, b in zip(near, layers, layers[1:], strict=False)],
            [rng.uniform(-s, s, b) for s, b in zip(near, layers[1:], strict=True)],
            [np.ones(n) for n in layers[1:-1]], [np.zeros(n) for n in layers[1:-1]], [np.zeros(n) for n in layers[1:-1]], [np.ones(n) for n in layers[1:-1]],
        )

    @property
    def hidden(self) -> int:
        return len(self.scale)

    def trained(self) -> list[np.ndarray]:
        """The arrays that gradients move, in a fixed order."""
        return [*self.weight, *self.bias, *self.scale, *self.shift]

    def moved(self, flat: np.ndarray, mean: list[np.ndarray] | None = None, var: list[np.ndarray] | None = None) -> Network:
        """A network whose trained arrays hold ``flat``."""
        out, at = [], 0
        for a in self.trained():
            out.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        n, h = len(self.weight), self.hidden
        return Network(out[:n], out[n : 2 * n], out[2 * n : 2 * n + h], out[2 * n + h :], self.mean if mean is None else mean, self.var if var is None else var)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.trained()])

    def arrays(self) -> dict[str, np.ndarray]:
        """All arrays by name, for ``learn.save_arrays``."""
        return {f"{name}{k}": a for name in ("weight", "bias", "scale", "shift", "mean", "var") for k, a in enumerate(getattr(self, name))}

    @classmethod
    def of_arrays(cls, arrays: dict[str, np.ndarray]) -> Network:
        return cls(*[[arrays[f"{name}{k}"] for k in range(len([a for a in arrays if a.startswith(name)]))] for name in ("weight", "bias", "scale", "shift", "mean", "var")])


def kept_units(nodes: np.ndarray, units: int, layer: int, step: int, seed: int, share: float) -> np.ndarray:
    """(row, unit): 1 / (1 - share) where a unit stays and 0 where it is dropped, by rounds of multiply and fold."""
    if share <= 0:
        return np.ones((len(nodes), units))
    with np.errstate(over="ignore"):
        x = nodes.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + (np.arange(units, dtype=np.uint64) + np.uint64((layer + 1) << 32))[None] * np.uint64(0xD1B54A32D192ED03) + np.uint64((step * 2654435761 + seed) % (1 << 63))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)) >= np.uint64(int(share * (1 << 53)))) / (1.0 - share)


def _linear(net: Network, x: np.ndarray, nodes: np.ndarray, moments: list[tuple[np.ndarray, np.ndarray]], upto: int, drop: tuple[int, int, float] | None):
    """The linear output of layer ``upto``, and of each layer before it (input, normalised, unit weights)."""
    passed = []
    for k in range(upto):
        mean, var = moments[k]
        unit = (x @ net.weight[k] + net.bias[k] - mean) / np.sqrt(var + EPSILON)
        raised = net.scale[k] * unit + net.shift[k]
        open_ = (raised > 0).astype(float)
        if drop is not None:
            open_ = open_ * kept_units(nodes, raised.shape[1], k, drop[0], drop[1], drop[2])
        passed.append((x, unit, open_))
        x = raised * open_
    return x @ net.weight[upto] + net.bias[upto], x, passed


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), batch.column(2).to_numpy()


def _summed(rows: DataFrame, of_block: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``of_block`` (nodes, vectors, classes) over all rows: one block of sums a task, added in a tree, in a fixed order."""

    def first(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(size)
        for block in _blocks(batches):
            total += of_block(*block)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def again(batches):
        import pyarrow as pa

        total, low = np.zeros(size), None
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, low = total + np.frombuffer(sums), part if low is None else min(low, part)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    parts = rows.select("node", "vec", "y").mapInArrow(first, "part int, sums binary")
    fan = max(1, int(np.sqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    added = parts.repartition(fan, F.col("part") % fan).sortWithinPartitions("part").mapInArrow(again, "part int, sums binary")
    total = np.zeros(size)
    for r in sorted(added.collect(), key=lambda r: r["part"]):
        total = total + np.frombuffer(r["sums"])
    return total


def _clean(rows: DataFrame) -> DataFrame:
    vec = F.col("vec").cast("array<double>")
    return rows.select(F.col("node").cast("long").alias("node"), vec.alias("vec"), F.col("y").cast("int").alias("y")).where(F.col("node").isNotNull() & F.col("y").isNotNull() & F.col("vec").isNotNull() & ~F.exists(vec, lambda v: v.isNull()))


def gradient(net: Network, rows: DataFrame, step: int = 0, seed: int = 7, dropout: float = 0.0) -> tuple[np.ndarray, float, int, list[tuple[np.ndarray, np.ndarray]]]:
    """Of one batch (node, vec, y): the gradient of the mean loss as ``Network.flat`` orders it, the loss, the rows and each layer's moments.

    An empty batch has gradient and loss 0.
    """
    drop, moments, n = (step, seed, dropout) if dropout > 0 else None, [], 0
    classes = net.weight[-1].shape[1]
    for k in range(net.hidden):
        width, near, known = net.weight[k].shape[1], net.mean[k], list(moments)

        def spread(nodes, x, y, k=k, near=near, known=known):
            z = _linear(net, x, nodes, known, k, drop)[0] - near  # sums about the running mean lose no digits
            return np.concatenate([[len(z)], z.sum(0), (z * z).sum(0)])

        got = _summed(rows, spread, 1 + 2 * width)
        n = int(got[0])
        if not n:
            return np.zeros(net.flat().size), 0.0, 0, []
        about = got[1 : 1 + width] / n
        moments.append((near + about, np.maximum(got[1 + width :] / n - about * about, 0.0)))
    out = {name: [np.zeros_like(a) for a in getattr(net, name)] for name in ("weight", "bias", "scale", "shift")}
    loss, known_sums = 0.0, {}
    for layer in range(net.hidden - 1, -2 if net.hidden == 0 else -1, -1):
        top = layer == net.hidden - 1
        inputs, width = (net.weight[layer].shape if layer >= 0 else (0, 0))
        last = net.weight[-1].size + classes + 2 if top else 0

        def back(nodes, x, y, layer=layer, top=top, sums=dict(known_sums)):
            z, a, passed = _linear(net, x, nodes, moments, net.hidden, drop)
            logs = _log_softmax(z)
            d = np.exp(logs)
            d[np.arange(len(y)), y] -= 1
            parts = [(a.T @ d).ravel(), d.sum(0), [-logs[np.arange(len(y)), y].sum(), len(y)]] if top else []
            d = d @ net.weight[-1].T
            for k in range(net.hidden - 1, max(layer, 0) - 1, -1):
                a, unit, open_ = passed[k]
                d = d * open_
                if k == layer:
                    parts += [d.sum(0), (d * unit).sum(0), (a.T @ d).ravel(), a.sum(0), (a.T @ unit).ravel()]
                    break
                shift, scale, rows_ = sums[k]
                d = (d - shift / rows_ - unit * (scale / rows_)) * (net.scale[k] / np.sqrt(moments[k][1] + EPSILON)) @ net.weight[k].T
            return np.concatenate(parts)

        got = _summed(rows, back, last + (2 * width + 2 * inputs * width + inputs if layer >= 0 else 0))
        if top:
            out["weight"][-1], out["bias"][-1] = got[: net.weight[-1].size].reshape(net.weight[-1].shape), got[net.weight[-1].size : last - 2]
            loss, n = float(got[last - 2]), int(got[last - 1])
            if not n:
                return np.zeros(net.flat().size), 0.0, 0, []
        if layer >= 0:
            cut = np.cumsum([width, width, inputs * width, inputs])
            shift, scale, met, came, unit_met = np.split(got[last:], cut)
            known_sums[layer] = (shift, scale, n)
            whole = met.reshape(inputs, width) - np.outer(came, shift / n) - unit_met.reshape(inputs, width) * (scale / n)
            out["weight"][layer] = whole * (net.scale[layer] / np.sqrt(moments[layer][1] + EPSILON))
            out["scale"][layer], out["shift"][layer] = scale, shift  # a bias before a normalisation moves nothing: 0
    flat = np.concatenate([a.ravel() for name in ("weight", "bias", "scale", "shift") for a in out[name]])
    return flat / n, loss / n, n, moments


def loss_of(net: Network, rows: DataFrame) -> float:
    """The mean negative log-likelihood of (node, vec, y) by the running moments; infinite without rows."""

    def score(nodes, x, y):
        logs = _log_softmax(_linear(net, x, nodes, list(zip(net.mean, net.var, strict=True)), net.hidden, None)[0])
        return np.array([-logs[np.arange(len(y)), y].sum(), len(y)])

    total, n = _summed(_clean(rows), score, 2)
    return total / n if n else float("inf")


def predicted(net: Network, rows: DataFrame) -> DataFrame:
    """(node, y, predicted, probability) of (node, vec, y), row by row in Arrow batches; the first of equal classes wins. ``y`` may be null."""
    moments = list(zip(net.mean, net.var, strict=True))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                p = np.exp(_log_softmax(_linear(net, x, np.zeros(len(x), np.int64), moments, net.hidden, None)[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p.argmax(1).astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))], ["node", "y", "predicted", "probability"])

    vec = F.col("vec").cast("array<double>")
    usable = rows.where(F.col("vec").isNotNull() & ~F.exists(vec, lambda v: v.isNull()))
    return usable.select(F.col("node").cast("long"), vec, F.col("y").cast("int")).mapInArrow(run, "node long, y int, predicted int, probability array<double>")


@dataclass
class Adam:
    """Running first and second moments of a gradient."""

    rate: float = 0.01
    ridge: float = 0.0
    first: np.ndarray | None = None
    second: np.ndarray | None = None
    steps: int = 0

    def step(self, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.ridge * at
        if self.first is None:
            self.first, self.second = np.zeros_like(at), np.zeros_like(at)
        self.steps += 1
        self.first = DECAY * self.first + (1 - DECAY) * g
        self.second = DECAY_SQUARED * self.second + (1 - DECAY_SQUARED) * g * g
        return at - self.rate * (self.first / (1 - DECAY**self.steps)) / (np.sqrt(self.second / (1 - DECAY_SQUARED**self.steps)) + TINY)


@dataclass(frozen=True)
class Training:
    """``batches`` mini-batches an epoch; training ends when the loss on held rows has not fallen for ``patience`` epochs."""

    epochs: int = 50
    batches: int = 4
    rate: float = 0.01
    ridge: float = 0.0
    dropout: float = 0.0
    patience: int = 10
    seed: int = 7


@dataclass
class Trained:
    """The network of the best epoch, its number, and (training loss, held loss) of each epoch."""

    network: Network
    best: int
    losses: list[tuple[float, float]] = field(default_factory=list)


def _in_batches(rows: DataFrame, cfg: Training, scratch: Scratch) -> list[DataFrame]:
    """The rows of each mini-batch, read from a folder of its own; fewer where a batch got none."""
    at = scratch.path("batches")
    dealt = _clean(rows).withColumn("batch", (hash_order(F.col("node"), F.lit(1).cast("long"), cfg.seed) % cfg.batches).cast("int"))
    # a batch is dealt over as many tasks as the session shuffles to; rows of one node lie together
    dealt.repartition("batch", F.pmod(F.xxhash64("node"), F.lit(64))).write.partitionBy("batch").parquet(at)
    table = rows.sparkSession.read.schema("node long, vec array<double>, y int, batch int").parquet(at)
    return [table.where(F.col("batch") == k).select("node", "vec", "y") for k in range(cfg.batches)]


def projected(g: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """``g`` without the part that works against ``reference``."""
    dot = float(g @ reference)
    return g if dot >= 0 else g - dot / float(reference @ reference) * reference


def fit(train: DataFrame, held: DataFrame, start: Network, cfg: Training = Training(), memory: DataFrame | None = None) -> Trained:
    """Train from ``start`` (a new network, or an earlier one to go on from) and keep the epoch of the least loss on ``held``.

    With ``memory``, rows of what was learnt before, each step is projected so
    that it does not raise their loss: its reference is the mean gradient over
    the memory's batches. An empty ``train`` returns ``start``; without held
    rows the training loss decides.
    """
    scratch = Scratch(train.sparkSession)
    parts, past = _in_batches(train, cfg, scratch), [] if memory is None else _in_batches(memory, cfg, scratch)
    held = scratch.keep(_clean(held), "held")
    net, adam = start, Adam(cfg.rate, cfg.ridge)
    out, least, stale, step = Trained(start, -1), float("inf"), 0, 0
    for epoch in range(cfg.epochs):
        seen, total = 0, 0.0
        for k in np.random.default_rng([cfg.seed, epoch]).permutation(len(parts)):
            step += 1
            g, loss, n, moments = gradient(net, parts[k], step, cfg.seed, cfg.dropout)
            if not n:
                continue
            if past:
                met = [gradient(net, p, step, cfg.seed, cfg.dropout) for p in past]
                rows = sum(m[2] for m in met)
                if rows:
                    g = projected(g, sum(m[0] * m[2] for m in met) / rows)
            mean = [(1 - MOMENTUM) * a + MOMENTUM * m for a, (m, _) in zip(net.mean, moments, strict=True)]
            var = [(1 - MOMENTUM) * a + MOMENTUM * v * n / max(n - 1, 1) for a, (_, v) in zip(net.var, moments, strict=True)]
            net = net.moved(adam.step(net.flat(), g), mean, var)
            seen, total = seen + n, total + loss * n
        if not seen:
            return out
        mine = total / seen
        now = loss_of(net, held)
        out.losses.append((mine, now))
        now = mine if now == float("inf") else now
        if now < least:
            least, stale, out.network, out.best = now, 0, net, epoch
        else:
            stale += 1
            if stale >= cfg.patience:
                break
    return out
