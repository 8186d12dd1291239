"""That the registered queries do the whole of their operators' work, at any size."""

from __future__ import annotations

import pytest

from graphprop.operators import propagate
from graphprop.plans.fixtures import Fixture
from graphprop.plans.queries import QUERIES

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


class Begun(Exception):
    pass


@pytest.mark.parametrize("name", ["batch_update", "lazy_update"])
def test_updates_leave_rows_to_push_on_a_large_graph(spark, monkeypatch, name):
    seen = []

    def begin(features, edges, params):
        seen.append(params)
        raise Begun

    monkeypatch.setattr(propagate, "initial_operation", begin)
    with pytest.raises(Begun):
        QUERIES[name](spark, SMALL)
    x = Fixture(spark, LARGE).features()
    limit = propagate.thresholds(x, seen[0].rmax)
    assert propagate.over(propagate.initial_state(x), limit).count() > 0.9 * x.count()


def test_parts_of_arrays_grow_where_they_are_many(spark, monkeypatch):
    from graphprop.sources import arrays
    from graphprop.tables import Scratch

    kept, parts, keep, write = [], [], Scratch.keep, arrays.write_rows
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    monkeypatch.setattr(arrays, "write_rows", lambda rows, path, *a: write(rows, path, *a) or parts.append(len(arrays.parts_of(path))))
    monkeypatch.setattr(arrays, "part_rows", lambda n, least: -(-n // 7), raising=False)
    edges = QUERIES["csr_array_files"](spark, SMALL)
    assert "order" in kept and parts[0] == 7 and parts[1] in (7, 8)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, Fixture(spark, SMALL).graph().collect()))
    monkeypatch.undo()
    assert arrays.part_rows(20_000, 300) == 300 and arrays.part_rows(7_200_000, 300) == -(-7_200_000 // arrays.MOST_PARTS)


def test_both_ways_share_blocks_and_degrees(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphprop.operators import monitor
    from graphprop.operators.dynamic import Graph
    from graphprop.session import Params
    from graphprop.tables import Scratch

    monkeypatch.setattr(propagate, "FEW", 0)
    e = Scratch(spark).keep(spark.createDataFrame([(a, b) for a in range(8) for b in range(8) if (a + b) % 3 or a == b], "src long, dst long"), "edges")
    x = Scratch(spark).keep(spark.range(8).select(F.col("id").alias("node"), F.lit(0).alias("dim"), (F.col("id") - 3.0).alias("x")), "features")
    made, block = [], propagate._block
    monkeypatch.setattr(propagate, "_block", lambda: made.append(1) or block())
    u = spark.createDataFrame([(0, 3), (3, 0), (1, 1)], "src long, dst long")
    after, chosen = monitor.lazy_update(Graph(e, x, propagate.initial_state(x)), u, spark.range(8).select(F.col("id").alias("node")), Params(rmax=0.2))
    assert len(made) == 1 and after.state.count() == 8 and chosen.count() > 0
