"""Classification metrics of (y, predicted) or (y, score) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprop.operators.etl import prefix_sums


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y", "predicted").agg(F.count(F.lit(1)).alias("n"))


def f1_by_class(rows: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, f1) for every class that occurs or is predicted."""
    cell = confusion(rows)
    hit = F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0)
    by = lambda c, name: cell.groupBy(F.col(c).alias("cls")).agg(F.sum("n").alias(name), F.sum(hit).alias(f"_{name}"))
    both = by("y", "real").join(by("predicted", "said"), "cls", "full").fillna(0)
    tp = F.greatest("_real", "_said")
    out = both.select("cls", tp.cast("long").alias("tp"), (F.col("said") - tp).cast("long").alias("fp"), (F.col("real") - tp).cast("long").alias("fn"))
    return out.withColumn("f1", F.coalesce(F.expr("try_divide(2.0D * tp, 2.0D * tp + fp + fn)"), F.lit(0.0)))


def f1(rows: DataFrame) -> DataFrame:
    """One row: macro (mean over classes) and micro (over all decisions)."""
    c = f1_by_class(rows)
    micro = F.coalesce(F.try_divide(2.0 * F.sum("tp"), 2.0 * F.sum("tp") + F.sum("fp") + F.sum("fn")), F.lit(0.0))
    return c.agg(F.avg("f1").alias("macro"), micro.alias("micro"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row: the share of (positive, negative) pairs in the right order, ties counting half."""
    tally = rows.groupBy("score").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") != 1).cast("long")).alias("q"))
    under = prefix_sums(tally, [F.col("score")], "q", "below")
    return under.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def means(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.avg(c).alias(c) for c in columns])


def latest_cells(results: DataFrame, models: list[str]) -> DataFrame:
    """The result table (rows of datasets, columns of models) from (seq, model, dataset, value): the latest value of each cell."""
    last = results.groupBy("dataset", "model").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("dataset").pivot("model", models).agg(F.first("value"))
