"""Feature operators on the long layout (node, dim, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprop.operators.etl import numbered, hash_order


def _scaled(x: Column, mean: Column, sd: Column) -> Column:
    return (x - mean) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0))


def standardize(features: DataFrame, by: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Mean 0 and population deviation 1 in each group of ``by``; a constant group becomes 0."""
    stat = features.groupBy(*by).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return features.join(stat, list(by)).withColumn("x", _scaled(F.col("x"), F.col("_m"), F.col("_s"))).select(*features.columns)


def l2_normalize(features: DataFrame) -> DataFrame:
    """Rows of length 1; an all-zero row stays."""
    norm = features.groupBy("node").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    return features.join(norm, "node").withColumn("x", F.col("x") / F.coalesce(F.nullif("_n", F.lit(0.0)), F.lit(1.0))).select(*features.columns)


def l1_norm(features: DataFrame) -> DataFrame:
    return features.groupBy("dim").agg(F.sum(F.abs("x")).alias("l1"))


def column_sums(features: DataFrame) -> DataFrame:
    """(dim, pos, neg): the sums of the positive and of the negative entries."""
    return features.groupBy("dim").agg(F.sum(F.when(F.col("x") > 0, F.col("x")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("x") < 0, F.col("x")).otherwise(0.0)).alias("neg"))


def permute_rows(features: DataFrame, seed: int = 7) -> DataFrame:
    """Give each node the row of another: nodes in the order of ids get the rows in the order of a hash."""
    nodes = features.select("node").distinct()
    by_id = numbered(nodes, [F.col("node")], "_k")
    by_hash = numbered(nodes, [hash_order(F.col("node"), F.lit(1).cast("long"), seed), F.col("node")], "_k").withColumnRenamed("node", "_from")
    moved = by_id.join(by_hash, "_k").drop("_k")
    rest = features.withColumnRenamed("node", "_from")
    return rest.join(moved, "_from").select(*features.columns)


def drop_columns(features: DataFrame, n_dims: int, share: float, seed: int = 7) -> DataFrame:
    """Zero the ``floor(n_dims * share)`` dimensions of smallest hash."""
    order = sorted(range(n_dims), key=lambda d: ((d * 2654435761 + seed) % 1000003, d))
    gone = order[: int(n_dims * share)]
    return features.withColumn("x", F.when(F.col("dim").isin(gone), 0.0).otherwise(F.col("x"))) if gone else features


def copy_rows(source: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of ``source`` under the new nodes of ``mapping`` (node, new_id)."""
    return source.join(mapping.select("node", "new_id"), "node").select(F.col("new_id").alias("node"), "dim", "x")


def contrastive_set(current: DataFrame, kept: DataFrame, changed: DataFrame) -> DataFrame:
    """Label 1 for current and kept rows, 0 for changed ones; ``part`` tells a node's current row from its kept one."""
    row = lambda df, label, part: df.select("node", "dim", "x", F.lit(label).alias("label"), F.lit(part).alias("part"))
    return row(current, 1, "current").unionByName(row(kept, 1, "kept")).unionByName(row(changed, 0, "changed"))


def packed(features: DataFrame) -> DataFrame:
    """(node, vec): the dimensions in order as one array."""
    return features.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("node", F.transform("v", lambda s: s["x"]).alias("vec"))


def unpacked(rows: DataFrame, vec: str = "vec") -> DataFrame:
    return rows.select("node", F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
