"""Learning on changed and kept nodes: contrastive discriminators, encoders, classifiers, incremental steps.

The contrastive encoder has no nonlinearity, so its discriminator is affine in
the features: logistic regression of changed against kept rows. Classifiers are
Spark ML's multilayer perceptron and multinomial regression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprop.operators.etl import hash_order, numbered
from graphprop.operators.features import permute_rows
from graphprop.tables import Scratch


def bare(model, scratch: Scratch):
    """The model as its file holds it.

    A fitted model keeps a training summary, which holds the session. Tasks get
    the model with all it holds, and a session in which any query was observed
    cannot be serialised.
    """
    at = scratch.path("model")
    model.write().save(at)
    return type(model).load(at)


def vectors(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vec)))


def discriminator(contrastive: DataFrame, ridge: float = 1e-4, rounds: int = 100) -> LogisticRegressionModel:
    """Tell label 1 from label 0 in rows (node, dim, x, label, part); stops early at a small change of the loss."""
    keyed = contrastive.groupBy("node", "label", "part").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).withColumn("vec", F.transform("v", lambda s: s["x"]))
    scratch = Scratch(contrastive.sparkSession)
    rows = scratch.keep(keyed.select("label", "vec"), "rows")  # the fit reads them twice before it holds them
    return bare(LogisticRegression(labelCol="label", regParam=ridge, maxIter=rounds, tol=1e-7).fit(vectors(rows)), scratch)


def permuted_discriminator(features: DataFrame, propagated: DataFrame, seed: int = 7, **kw) -> LogisticRegressionModel:
    """The group discriminator: propagated rows against propagated permuted rows given as ``propagated``."""
    real = features.withColumn("label", F.lit(1)).withColumn("part", F.lit("real"))
    false = permute_rows(propagated, seed).withColumn("label", F.lit(0)).withColumn("part", F.lit("permuted"))
    return discriminator(real.unionByName(false), **kw)


def embed(rows: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """(node, vec): the linear encoder, row by row in Arrow batches."""
    b = np.zeros(weight.shape[1]) if bias is None else bias

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x @ weight + b), pa.list_(pa.float64()))], ["node", "vec"])

    return rows.select("node", F.col("vec").cast("array<double>")).mapInArrow(run, "node long, vec array<double>")


def normalized(rows: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    return rows.withColumn("vec", F.when(norm > 0, F.transform("vec", lambda v: v / norm)).otherwise(F.col("vec")))


def mlp(train: DataFrame, layers: list[int], rounds: int = 100, seed: int = 20159, start: np.ndarray | None = None):
    """A perceptron on (features, y); ``start`` warms it with an earlier model's weights."""
    est = MultilayerPerceptronClassifier(layers=layers, labelCol="y", maxIter=rounds, seed=seed, blockSize=128)
    if start is not None:
        from pyspark.ml.linalg import Vectors

        est = est.setInitialWeights(Vectors.dense(start)) if hasattr(est, "setInitialWeights") else est.copy({est.initialWeights: Vectors.dense(start)})
    return bare(est.fit(train), Scratch(train.sparkSession))


def linear(train: DataFrame, ridge: float = 1e-4, rounds: int = 100) -> LogisticRegressionModel:
    return bare(LogisticRegression(labelCol="y", family="multinomial", regParam=ridge, maxIter=rounds).fit(train), Scratch(train.sparkSession))


def predicted(model, rows: DataFrame) -> DataFrame:
    """(node, y, predicted, probability)."""
    return model.transform(rows).select("node", F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probability"))


def flooded(loss: float, level: float = 0.1) -> float:
    """The loss, turned upwards where it is below ``level``."""
    return abs(loss - level) + level


def project(gradient: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The gradient without the part that works against the reference: unchanged where they agree."""
    dot = float(gradient @ reference)
    if dot >= 0:
        return gradient
    return gradient - dot / float(reference @ reference) * reference


def softmax_gradient(rows: DataFrame, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean gradient and loss of multinomial regression on (vec, y), summed in partitions and then by entry."""
    d, k = weight.shape

    def run(batches):
        import pyarrow as pa

        total, loss, n = np.zeros((d, k)), 0.0, 0
        for batch in batches:
            if len(batch):
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                y = batch.column(1).to_numpy()
                z = x @ weight
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
                p[np.arange(len(y)), y] -= 1
                total += x.T @ p
                n += len(y)
        flat = np.concatenate([total.ravel(), [loss, n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    got = np.zeros(d * k + 2)
    for r in rows.select(F.col("vec").cast("array<double>"), F.col("y").cast("int")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        got[r.i] = r.v
    n = max(got[-1], 1)
    return got[:-2].reshape(d, k) / n, got[-2] / n


def train_incremental(rows: DataFrame, memory: DataFrame, start: np.ndarray, rate: float = 0.5, steps: int = 20, patience: int = 5, level: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Continue from ``start`` on new rows; steps that would raise the memory's loss are projected. The best weights are kept.

    The loss is flooded at ``level``: below it a step climbs instead of falling.
    """
    w, best, losses, stale = start.copy(), start.copy(), [], 0
    for _ in range(steps):
        g, loss = softmax_gradient(rows, w)
        if loss < level:
            g, loss = -g, flooded(loss, level)
        if losses and loss >= min(losses):
            stale += 1
            if stale >= patience:
                break
        else:
            best, stale = w.copy(), 0
        losses.append(loss)
        reference, _ = softmax_gradient(memory, w)
        w = w - rate * project(g.ravel(), reference.ravel()).reshape(w.shape)
    return best, losses


def save_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Weights and reference gradients of one model, a row each: what a later run goes on from. Spark ML's models have their own writers."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def memory_sample(features: DataFrame, changed: DataFrame, seed: int = 7) -> DataFrame:
    """As many unchanged nodes as there are changed ones, by the order of a hash and then of the node; fewer where there are not enough.

    Counts of hashes, coarse and then fine, say at which hash the sample ends.
    What is below it is taken as it is; only the rows of that one hash are
    numbered, range after range.
    """
    scratch = Scratch(features.sparkSession)
    n = changed.count()
    key = hash_order(F.col("node"), F.lit(2).cast("long"), seed)
    kept = scratch.keep(features.select("node").distinct().join(changed, "node", "left_anti").withColumn("_hash", key), "kept")

    def ends_in(rows: DataFrame, cell: Column, want: int) -> tuple[int | None, int]:
        """The cell in which the ``want``-th row lies, or None, and how many of its rows are wanted; there are at most 1,024 cells."""
        for r in sorted(rows.groupBy(cell.alias("cell")).count().collect()):
            if want <= r["count"]:
                return r["cell"], want
            want -= r["count"]
        return None, 0

    if not n:
        return kept.select("node").where(F.lit(False))
    coarse = F.expr("_hash div 1024")
    cell, want = ends_in(kept, coarse, n)
    if cell is None:
        return kept.select("node")
    at, want = ends_in(kept.where(coarse == cell), F.col("_hash"), want)
    last = numbered(kept.where(F.col("_hash") == at).select("node"), [F.col("node")], "_n")
    return kept.where(F.col("_hash") < at).select("node").unionAll(last.where(F.col("_n") < want).select("node"))


def early_stop(loss: Callable[[int], float], rounds: int, patience: int) -> tuple[int, float]:
    """Call ``loss(round)`` until it has not fallen for ``patience`` rounds; the best round and loss."""
    best, at, stale = float("inf"), -1, 0
    for k in range(rounds):
        now = loss(k)
        if now < best:
            best, at, stale = now, k, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return at, best


