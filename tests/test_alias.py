from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphprop.operators import alias


@pytest.mark.parametrize("size", [4, 1024])
def test_shares_are_the_weights_and_draws_follow_them(spark, size):
    rng = np.random.default_rng(1)
    weight = {(0, d): float(rng.integers(1, 50)) for d in range(1, 41)} | {(d, 0): 2.0 for d in range(1, 41)} | {(1, 2): 6.0}
    bad = [(0, 90, 0.0), (0, 91, -1.0), (0, 92, float("nan")), (0, 93, None), (50, 1, 0.0)]
    # one weight comes in two parallel edges
    rows = [(s, d, w) for (s, d), w in weight.items() if (s, d) != (1, 2)] + [(1, 2, 2.0), (1, 2, 4.0), *bad]
    tables = alias.alias_tables(spark.createDataFrame(rows, "src long, dst long, w double"), size)
    assert (len(tables) > 1) == (size == 4)
    assert size == 1024 or tables[0].where("src = 0").count() > 1
    total = {s: sum(w for (a, _), w in weight.items() if a == s) for s, _ in weight}
    got = {(r.src, r.dst): r.share for r in alias.shares(tables).collect() if r.share > 1e-15}
    assert got.keys() == weight.keys() and all(abs(got[k] - weight[k] / total[k[0]]) < 1e-12 for k in weight)
    n = 40_000
    walks = spark.range(n).select(F.lit(0).cast("long").alias("start"), F.col("id").alias("walk"), F.lit(0).cast("long").alias("node"))
    seen = {r.node: r["count"] for r in alias.weighted_step(walks, tables, 3, 5).groupBy("node").count().collect()}
    chi = sum((seen.get(d, 0) - n * got[0, d]) ** 2 / (n * got[0, d]) for d in range(1, 41))
    assert sum(seen.values()) == n and chi < 39 + 5 * np.sqrt(2 * 39)
    lost = alias.weighted_step(walks.limit(3).withColumn("node", F.lit(50).cast("long")), tables, 0, 5)
    assert [r.node for r in lost.collect()] == [0, 0, 0]


def test_empty_and_equal_weights(spark):
    own, other = alias.columns(np.ones(5))
    assert (own == 5).all() and (other == np.arange(5)).all()
    tables = alias.alias_tables(spark.createDataFrame([], "src long, dst long, w double"))
    assert len(tables) == 1 and alias.shares(tables).count() == 0


def test_shares_of_dyadic_weights_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(s, d, float(rng.integers(0, 20)) + 0.5) for s in range(30) for d in range(1, 5 + 3 * s)] + [(99, 1, 6.5), (99, 2, 249.5)]
    total: dict[int, float] = {}
    for s, _, w in rows:
        total[s] = total.get(s, 0.0) + w
    got = {(r.src, r.dst): r.share for r in alias.shares(alias.alias_tables(spark.createDataFrame(rows, "src long, dst long, w double"))).collect()}
    assert got == {(s, d): w / total[s] for s, d, w in rows}
