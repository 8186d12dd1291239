"""A stochastic block model as a source: graphs with known communities, and updates as nodes move between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlockModel:
    nodes: int = 10_000
    clusters: int = 2
    in_degree: int = 20
    out_degree: int = 5
    changes: int = 5
    seed: int = 20


def _draw(*parts: Column | int) -> Column:
    """A number below 2^31 from the parts, by a mix that any run repeats."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(1 << 31))


def communities(spark: SparkSession, cfg: BlockModel, t: int = 0) -> DataFrame:
    """(node, y): node mod clusters at first; in each later batch ``changes`` nodes by hash have moved to the next one."""
    node = F.col("id")
    moves = F.lit(0)
    for k in range(1, t + 1):
        # the changes of batch k are the nodes that follow a drawn one
        first = _draw(cfg.seed, k, 17) % cfg.nodes
        moves = moves + (F.pmod(node - first, F.lit(cfg.nodes)) < cfg.changes).cast("int")
    return spark.range(cfg.nodes).select(node.alias("node"), ((node % cfg.clusters + moves) % cfg.clusters).cast("int").alias("y"))


def block_edges(spark: SparkSession, cfg: BlockModel, t: int = 0) -> DataFrame:
    """(src, dst), both directions: about in_degree/2 and out_degree/2 drawn partners inside and outside the own community."""
    c, n = cfg.clusters, cfg.nodes
    label = communities(spark, cfg, t)
    half_in, half_out = max(1, cfg.in_degree // 2), max(1, cfg.out_degree // 2)
    inside = label.select("node", "y", F.explode(F.sequence(F.lit(1), F.lit(half_in))).alias("k"), F.lit(True).alias("own"))
    outside = label.select("node", "y", F.explode(F.sequence(F.lit(1), F.lit(half_out))).alias("k"), F.lit(False).alias("own"))
    drawn = inside.union(outside).withColumn("want", F.when(F.col("own"), F.col("y")).otherwise((F.col("y") + 1 + _draw(F.col("node"), F.col("k"), cfg.seed, 3) % max(c - 1, 1)) % c))
    # partners are drawn by their first community, which all but a few still have
    partner = F.col("want") + c * (_draw(F.col("node"), F.col("k"), F.col("own").cast("int"), cfg.seed) % max(n // c, 1))
    e = drawn.select(F.col("node").alias("src"), partner.cast("long").alias("dst")).where((F.col("dst") < n) & (F.col("src") != F.col("dst")))
    return e.union(e.select("dst", "src")).distinct()


def block_updates(spark: SparkSession, cfg: BlockModel, t: int) -> DataFrame:
    """(batch, src, dst): the toggles from snapshot t-1 to t; every change is logged, insertions and deletions alike."""
    old, new = block_edges(spark, cfg, t - 1), block_edges(spark, cfg, t)
    gone, come = old.join(new, ["src", "dst"], "left_anti"), new.join(old, ["src", "dst"], "left_anti")
    return gone.union(come).select(F.lit(t).alias("batch"), "src", "dst")
