"""What must not grow faster than the tables: who moves, and through whom."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphprop.operators import dynamic, etl, propagate, walkindex, walks
from graphprop.plans import fixtures
from graphprop import tables
from graphprop.sources import files
from graphprop.tables import Scratch


def graph(spark, n=60, m=400, seed=3):
    rng = np.random.default_rng(seed)
    e = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    e |= {(b, a) for a, b in e} | {(0, k) for k in range(1, n)} | {(k, 0) for k in range(1, n)}
    return spark.createDataFrame(sorted(e), "src long, dst long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("dims", [1, 4, 19])
@pytest.mark.parametrize("reverse", [False, True])
def test_wide_rounds_equal_the_long_ones(spark, monkeypatch, dims, reverse):
    monkeypatch.setattr(propagate, "ROW", 8)  # node 0 has many rows
    e = graph(spark).unionAll(spark.createDataFrame([(5, 900), (5, 5)], "src long, dst long"))  # 900 has no edges of its own
    rng = np.random.default_rng(1)
    rows = [(n, d, 0.5 * d, float(rng.normal())) for n in [*range(0, 60, 7), 700, 900, None] for d in range(dims) if n is None or (n + d) % 3]
    state = Scratch(spark).keep(spark.createDataFrame(rows, "node long, dim int, pi double, r double"), "state")
    w = propagate.reverse_weights(e) if reverse else propagate.weights(e)
    for rounds in (0, 1, 3):
        want = by_key(propagate.push_all(state, w, 0.2, rounds), "node", "dim")
        got = by_key(propagate.push_all(state, propagate.adjacency(e, reverse), 0.2, rounds), "node", "dim")
        assert set(got) == set(want)
        assert all(got[k].pi == pytest.approx(want[k].pi, abs=1e-12) and got[k].r == pytest.approx(want[k].r, abs=1e-12) for k in want)


def test_one_row_an_edge_moves_whatever_the_dimensions(spark):
    x = spark.range(60).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("dim"), F.lit(1.0).alias("x"))
    wide = propagate._Wide(propagate.initial_state(x), ["pi", "r"], propagate.adjacency(graph(spark)))
    assert wide.rows.count() == 60 and wide.moved("r").count() == 60
    assert propagate.push_all(propagate.initial_state(x.limit(0)), propagate.adjacency(graph(spark)), 0.1, 2).count() == 0


@pytest.mark.parametrize("by_degree", [False, True])
def test_hubs_and_others_are_numbered_alike(spark, by_degree):
    e = graph(spark)
    row = lambda df: sorted(map(tuple, df.collect()))
    want = row(etl._ranged_positions(e.join(etl.degree(e).select(F.col("node").alias("dst"), "deg"), "dst"), ["deg", "dst"] if by_degree else ["dst"]))
    assert row(etl.positions(e, by_degree)) == row(etl.positions(e, by_degree, hub=10)) == want
    if not by_degree:
        chunks = lambda hub: sorted((r.src, r.chunk, r.first, r.deg, tuple(r.dsts)) for r in etl.chunked(e, 8, hub).collect())
        assert chunks(10) == chunks(etl.HUB)
        assert {(s, first + i, d) for s, _, first, _, dsts in chunks(10) for i, d in enumerate(dsts)} == set(want)
        assert {(s, deg) for s, _, _, deg, _ in chunks(10)} == {(r.node, r.deg) for r in etl.degree(e).collect()}


def test_ended_walks_meet_no_neighbours(spark, monkeypatch):
    e, nodes = graph(spark), spark.range(60).select(F.col("id").alias("node"))
    ends = lambda: {tuple(r) for r in walks.stopping_walks(walks.starts(nodes, 5), e, 0.4, trail=True).select("start", "walk", "node", "steps", F.array_sort("trail").cast("string")).collect()}
    whole, taken, step = ends(), [], walks.step
    assert len(whole) == 300
    monkeypatch.setattr(walks, "MANY", 0)  # a job takes one step while more than a sixteenth walk
    monkeypatch.setattr(walks, "step", lambda w, *a: taken.append(w.where("_go").count() == w.count()) or step(w, *a))
    assert ends() == whole and taken[:2] == [True, True]


def test_lists_of_walks_do_not_pass_the_driver(spark):
    e, at = graph(spark), Scratch(spark).path("index")
    near, rest = walks.kept_neighbours(e, Scratch(spark))
    start = walks.starts(spark.range(60).select(F.col("id").alias("node")), 2)
    assert "Broadcast" not in plan(walks.step(start, near, rest, 0, 1))
    walkindex.save(spark.range(60).select(F.col("id").alias("node")), e, 0.5, at)
    assert "Broadcast" not in plan(walkindex.stale(spark, at, spark.range(5).select(F.col("id").alias("node"))))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    f = fixtures.Fixture(spark, "/root/testdata/sf0.001")
    want = sorted(map(tuple, f.pairs().collect()))
    monkeypatch.setattr(fixtures, "tasks", lambda df: tables.tasks(df, 500))
    dealt = f.pairs()
    assert dealt.rdd.getNumPartitions() >= f.table("lineitem").count() // 500
    assert sorted(map(tuple, dealt.collect())) == want


def test_long_lists_of_toggles_are_sorted(spark, monkeypatch):
    e = Scratch(spark).keep(graph(spark), "edges")
    u = e.where("src % 7 = 0").unionAll(spark.createDataFrame([(1, 901), (901, 1)], "src long, dst long"))
    row = lambda df: sorted(map(tuple, df.collect()))
    want = row(dynamic.toggles(e, u))
    monkeypatch.setattr(tables, "LIST_ROWS", 3)
    toggle = Scratch(spark).keep(dynamic.toggles(e, u), "toggles")
    assert row(toggle) == want and {op for _, _, op in want} == {1, -1}
    assert "Broadcast" not in plan(dynamic.apply(e, toggle))


def test_a_state_within_its_thresholds_needs_no_links(spark):
    x = spark.range(60).select(F.col("id").alias("node"), F.lit(0).alias("dim"), F.lit(1.0).alias("x"))
    near, limit = propagate.adjacency(graph(spark)), spark.createDataFrame([(0, 2.0, -2.0)], "dim int, hi double, lo double")
    loop = propagate._Loop(propagate.initial_state(x), near, limit, "dim", 0.2, 5)
    loop.run(propagate._outside())
    assert loop.done().count() == 60 and loop.near is None and "blocks" not in vars(near)
    loop.close()


def test_pushes_along_blocks_equal_those_along_links(spark, monkeypatch):
    monkeypatch.setattr(propagate, "ROW", 8)  # node 0 is in many blocks
    monkeypatch.setattr(propagate, "FEW", 0)
    e = graph(spark).unionAll(spark.createDataFrame([(5, 900)], "src long, dst long"))  # 900 has no edges of its own
    rows = [(n, d, 0.0, float(n % 5 - 2)) for n in range(60) for d in (0, 3) if n % 4]
    state = Scratch(spark).keep(spark.createDataFrame(rows, "node long, dim int, pi double, r double"), "state")
    limit = spark.createDataFrame([(d, 0.05, -0.05) for d in (0, 3)], "dim int, hi double, lo double")
    got = []
    for w in (propagate.weights(e), propagate.adjacency(e)):
        loop = propagate._Loop(state, w, limit, "dim", 0.4, 50)
        loop.run(propagate._outside())
        got.append((by_key(loop.done(), "node", "dim"), [(kind, left) for kind, left, _ in loop.log]))
        loop.close()
    (want, log), (have, same) = got
    assert log == same and {k for k, _ in log} == {"base", "delta"} and set(want) == set(have)
    assert all(have[k].pi == pytest.approx(want[k].pi, abs=1e-12) and have[k].r == pytest.approx(want[k].r, abs=1e-12) for k in want)


def test_the_written_adjacency_makes_its_edges_once(spark, monkeypatch):
    e, nodes, made = graph(spark), spark.range(61).select(F.col("id").alias("node")), []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: made.append(name) or keep(self, df, name))
    at = Scratch(spark).path("csr")
    files.write_csr(e.unionAll(e), nodes, at, self_loops=True)
    assert made.count("edges") == 1
    want = sorted(map(tuple, etl.positions(etl.add_self_loops(e, nodes), by_degree=True).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{at}/indices").select("src", "pos", "dst").collect())) == want


@pytest.mark.parametrize("by_degree, width", [(False, 2), (True, 16)])
def test_packed_rounds_equal_those_of_long_rows(spark, monkeypatch, by_degree, width):
    monkeypatch.setattr(propagate, "ROW", 8)  # node 0 is in many blocks
    monkeypatch.setattr(propagate, "REGION", 7)
    monkeypatch.setattr(propagate, "WIDTH", width)
    monkeypatch.setattr(propagate, "FEW", 0)
    e = graph(spark).unionAll(spark.createDataFrame([(5, 900), (-9, 3), (3, -9)], "src long, dst long"))  # 900 has no edges of its own
    rows = [(n, d, 0.0, float(n % 5 - 2)) for n in [*range(60), 700] for d in (0, 1, 3) if n % 4] + [(None, 0, 0.0, 2.0)]
    state = Scratch(spark).keep(spark.createDataFrame(rows, "node long, dim int, pi double, r double"), "state")
    side = etl.degree(e) if by_degree else spark.createDataFrame([(0, 0.05, -0.05), (3, 0.04, -0.3)], "dim int, hi double, lo double")
    alpha = 0.4 if by_degree else F.when(F.col("dim") == 0, 0.4).otherwise(0.3)
    got = []
    for packs in (propagate.PACKS, 0):
        monkeypatch.setattr(propagate, "PACKS", packs)
        loop = propagate._Loop(state, propagate.adjacency(e), side, "node" if by_degree else "dim", alpha, 50)
        for scale in (0.02, 0.003) if by_degree else (None,):
            loop.run(F.abs(0.6 * F.col("r")) >= F.col("deg") * scale if by_degree else propagate._outside(), scale)
        assert (loop.packed is not None) == (packs == 0)
        got.append((by_key(loop.done(), "node", "dim"), [left for _, left, _ in loop.log]))
        loop.close()
    (want, log), (have, same) = got
    assert log == same and len(log) > 3 and set(want) == set(have)
    assert all(have[k].pi == pytest.approx(want[k].pi, abs=1e-12) and have[k].r == pytest.approx(want[k].r, abs=1e-12) for k in want)


@pytest.mark.parametrize("hub", [10, etl.HUB])
def test_degrees_of_a_symmetric_graph_are_counted_where_edges_meet(spark, monkeypatch, hub):
    e = Scratch(spark).keep(graph(spark), "edges")
    row = lambda df: sorted(map(tuple, df.collect()))
    want = row(etl.positions(e, by_degree=True))
    monkeypatch.setattr(etl, "SORT_ROWS", 100)
    got = etl.positions(e, by_degree=True, hub=hub, symmetric=True)
    assert row(got) == want and "Join" not in plan(etl._with_degrees(e, Scratch(spark), hub)[0])
    assert row(etl.positions(e, by_degree=True, hub=hub)) == want
    if hub == etl.HUB:
        assert got.rdd.getNumPartitions() >= e.count() // 100


def test_few_walks_meet_neighbours_in_memory(spark, monkeypatch):
    e, nodes = Scratch(spark).keep(graph(spark), "edges"), spark.range(60).select(F.col("id").alias("node"))
    deg = Scratch(spark).keep(etl.degree(e), "degrees")
    ends = lambda **kw: {tuple(r) for r in walks.stopping_walks(walks.starts(nodes, 3), e, 0.7, **kw).collect()}
    held, step = [], walks.step
    monkeypatch.setattr(walks, "step", lambda w, near, *a: held.append(near.storageLevel.useMemory) or step(w, near, *a))
    few = ends(deg=deg)
    assert held and all(held)
    held.clear()
    monkeypatch.setattr(walks, "MANY", 0)
    assert ends() == few and not any(held)


def test_a_discriminator_reads_its_rows_once(spark, monkeypatch):
    from graphprop.operators import learn

    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    rows = spark.createDataFrame([(k, d, float(k % 2 + d), k % 2, "p") for k in range(20) for d in range(2)], "node long, dim int, x double, label int, part string")
    learn.discriminator(rows, rounds=3)
    assert "rows" in kept
