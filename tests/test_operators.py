from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from graphprop.operators import dynamic, etl, features, learn, metrics, monitor, propagate, walks
from graphprop.session import Params

P = Params(rmax=1e-9, alpha=0.2)


def edges_df(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def both(pairs, n=None):
    out = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    return out | {(k, k) for k in range(n)} if n else out


def graph(seed=1, n=12, share=0.25):
    rng = np.random.default_rng(seed)
    return n, both({(a, b) for a in range(n) for b in range(a) if rng.random() < share}, n)


def x_df(spark, n, seed=1, dims=2):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(k, d, float(v)) for d in range(dims) for k, v in enumerate(rng.normal(size=n))], "node long, dim int, x double")


def matrix(pairs, n):
    a = np.zeros((n, n))
    for s, t in pairs:
        a[s, t] = 1
    d = np.maximum(a.sum(1), 1e-300) ** -0.5
    return d[:, None] * a * d[None]


def exact(pairs, n, x, alpha):
    return np.linalg.solve(np.eye(n) - (1 - alpha) * matrix(pairs, n), alpha * x)


def dense(df, n, dims=2, value="pi"):
    out = np.zeros((n, dims))
    for r in df.collect():
        out[r.node, r.dim] = r[value]
    return out


def test_push_reaches_the_exact_answer_and_keeps_the_invariant(spark):
    n, e = graph()
    x = x_df(spark, n)
    state = propagate.initial_operation(x, edges_df(spark, e), P)
    assert np.abs(dense(state, n) - exact(e, n, dense(x, n, value="x"), 0.2)).max() < 1e-6
    assert propagate.invariant_error(state, x, edges_df(spark, e), 0.2).first().error < 1e-12
    assert propagate.over(state, propagate.thresholds(x, P.rmax)).count() == 0


@pytest.mark.parametrize("toggled", [[(0, 5), (3, 7), (2, 9)], [], [(0, 5), (0, 5)], [(1, 4), (1, 4), (1, 4)]])
def test_update_equals_starting_anew(spark, toggled):
    n, e = graph(2)
    x = x_df(spark, n)
    g = dynamic.Graph(edges_df(spark, e), x, propagate.initial_operation(x, edges_df(spark, e), P))
    lines = spark.createDataFrame([p for a, b in toggled for p in ((a, b), (b, a))], "src long, dst long")
    after = set(e)
    for a, b in toggled:
        after ^= {(a, b), (b, a)}
    mid, _ = g.repaired(lines, P)
    assert {tuple(r) for r in mid.edges.collect()} == after
    assert propagate.invariant_error(mid.state, x, edges_df(spark, after), 0.2).first().error < 1e-10
    out = g.update(lines, P)
    assert np.abs(dense(out.state, n) - exact(after, n, dense(x, n, value="x"), 0.2)).max() < 1e-6


def test_rounds_write_deltas_once_the_frontier_is_small(spark):
    rng = np.random.default_rng(12)
    n = 150
    e = both({(k, (k + 1) % n) for k in range(n)} | {(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b}, n)
    x = x_df(spark, n)
    w, limit = propagate.weights(edges_df(spark, e)), propagate.thresholds(x, 1e-6)
    loops = []
    for sparse in (0.0, 0.1, 1.0):
        loop = propagate._Loop(propagate.initial_state(x), w, limit, "dim", 0.2, 500)
        loop.SPARSE = sparse
        loop.run(propagate._outside())
        loops.append((loop, dense(loop.done(), n), dense(loop.state, n, value="r")))
        loop.close()
    whole, mixed, deltas = loops
    assert {k for k, *_ in whole[0].log} == {"base"} and {k for k, *_ in deltas[0].log} == {"delta"} and {k for k, *_ in mixed[0].log} == {"base", "delta"}
    for loop, pi, r in loops:
        assert [left for _, left, _ in loop.log] == [left for _, left, _ in whole[0].log]
        assert np.abs(pi - whole[1]).max() < 1e-12 and np.abs(r - whole[2]).max() < 1e-12
        assert all(rows <= 12 * left for kind, left, rows in loop.log if kind == "delta")  # the degree is at most 11 or so


def test_a_hub_gives_through_many_chunks(spark):
    n = 3000
    star = both({(0, k) for k in range(1, n)}, n)
    near, hubs = propagate.links(propagate.weights(edges_df(spark, star)), propagate.Scratch(spark), 100)
    assert [(r.src, r.chunks) for r in hubs.collect()] == [(0, 30)]
    sizes = [len(r.to) for r in near.where("src = 0").collect()]
    assert len(sizes) == 30 and sum(sizes) == n and max(sizes) < 160
    front = spark.createDataFrame([(0, 0, 1.0), (5, 0, -2.0)], "node long, dim int, r double")
    got = propagate.flow(front, near, hubs, 0.5).groupBy("node").agg(F.sum("m").alias("m"))
    want = propagate.step(front.withColumnRenamed("r", "x"), propagate.weights(edges_df(spark, star))).select("node", (F.col("x") / 2).alias("v"))
    assert got.join(want, "node", "full").where("abs(coalesce(m, 0) - coalesce(v, 0)) > 1e-15 or m is null or v is null").count() == 0


def test_a_batch_twice_is_the_identity(spark):
    n, e = graph(3)
    u = edges_df(spark, both({(0, 1), (2, 3), (4, 8)}))
    once = dynamic.apply(edges_df(spark, e), dynamic.toggles(edges_df(spark, e), u))
    twice = dynamic.apply(once, dynamic.toggles(once, u))
    assert {tuple(r) for r in twice.collect()} == e


def test_intervals_follow_toggles(spark):
    rng = np.random.default_rng(3)
    n, last = 9, 6
    init = {(a, b) for a in range(n) for b in range(a, n) if rng.random() < 0.3}
    lines, graphs, now = [], [set(init)], set(init)
    for t in range(1, last):
        for a, b in {tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(8)}:
            times = int(rng.integers(1, 4))
            lines += [(t, *p) for p in {(a, b), (b, a)} for _ in range(times)]
            now = now ^ {(a, b)} if times % 2 else now
        graphs.append(set(now))
    toggles = spark.createDataFrame(lines, "t int, src long, dst long")
    iv = etl.toggled_intervals(edges_df(spark, init), toggles).cache()
    for t, want in enumerate(graphs):
        assert sorted(tuple(r) for r in etl.snapshot_of(iv, t).collect()) == sorted(both(want))
    want = {(t, v): sum(a == v for a, _ in both(g)) for t, g in enumerate(graphs) for v in range(n)}
    assert {(r.t, r.node): r.deg for r in etl.degrees_over_time(iv, last).collect()} == {k: d for k, d in want.items() if d}
    later = spark.createDataFrame([(1, 3, 2), (2, 2, 3), (9, 0, 1)], "batch int, src long, dst long")
    rows = etl.snapshots(edges_df(spark, {(5, 6), (6, 5), (7, 7)}), later, 3).collect()
    assert sorted(tuple(r) for r in rows) == sorted((t, *p) for t in range(3) for p in both({(5, 6)} | ({(2, 3)} if t else set())) | {(7, 7)})


def test_isolated_nodes_and_deletion_to_the_loop(spark):
    e = both({(0, 1), (1, 2)}, 3)  # node 3 has no edge at all
    x = spark.createDataFrame([(k, 0, float(k + 1)) for k in range(4)], "node long, dim int, x double")
    g = dynamic.Graph(edges_df(spark, e), x, propagate.initial_operation(x, edges_df(spark, e), P))
    lines = edges_df(spark, both({(0, 1), (3, 2)}))
    out = g.update(lines, P)
    after = e ^ both({(0, 1), (3, 2)})
    assert propagate.invariant_error(out.state, x, edges_df(spark, after), 0.2).first().error < 1e-10


def test_one_by_one_equals_the_batch(spark):
    n, e = graph(4, 8)
    x = x_df(spark, n, dims=1)
    g = dynamic.Graph(edges_df(spark, e), x, propagate.initial_operation(x, edges_df(spark, e), Params(rmax=1e-6, alpha=0.2)))
    lines = spark.createDataFrame([(1, 0, 5), (2, 5, 0)], "seq long, src long, dst long")
    out = dynamic.update_one_by_one(g, lines, 0, 2, Params(rmax=1e-6, alpha=0.2))
    want = exact(e ^ both({(0, 5)}), n, dense(x, n, 1, "x"), 0.2)
    assert np.abs(dense(out.state, n, 1) - want).max() < 1e-3
    with pytest.raises(ValueError, match="self loops"):
        dynamic.update_one_by_one(g, spark.createDataFrame([(1, 0, 0)], "seq long, src long, dst long"), 0, 1)


def test_selection_is_minimal(spark):
    rng = np.random.default_rng(5)
    rows = [(k, d, float(r), int(r * 1e12 * (1 + k % 3))) for d in range(2) for k, r in enumerate(rng.normal(size=60))]
    mass = spark.createDataFrame(rows, "node long, dim int, r double, e long")
    delta, n = 10.0, 60
    want = set()
    for d in range(2):
        for sign in (1, -1):
            own = sorted(((abs(e), -k) for k, dim, _, e in rows if dim == d and (e > 0) == (sign > 0)), reverse=True)
            budget = np.floor(sum(abs(r) for _, dim, r, e in rows if dim == d and ((r > 0) == (sign > 0))) * delta / n * 1e12 + 0.5)
            left = sum(e for e, _ in own)
            for e, k in own:
                if left <= budget or e == 0:
                    break
                want.add(-k)
                left -= e
    assert {r.node for r in monitor.select(mass, delta, n).collect()} == want
    assert monitor.select(mass, 1e12, n).count() == 0
    assert monitor.select(mass, 0.0, n).count() == len({k for k, *_, e in rows if e})


@pytest.mark.parametrize("ties", [False, True])
def test_selection_equals_a_running_sum(spark, ties):
    rng = np.random.default_rng(4)
    rows = [(k, d, float(s), int(s * (1000 if ties else rng.integers(1, 10**6)))) for k in range(120) for d in range(2) for s in [rng.choice([-1, 0, 1])]]
    got = {r.node for r in monitor.select(spark.createDataFrame(rows, "node long, dim int, r double, e long"), 40.0, 3 * 10**8 if not ties else 16 * 10**10).collect()}
    want, n = set(), 3 * 10**8 if not ties else 16 * 10**10
    for d in range(2):
        for sign in (1, -1):
            own = sorted([(-abs(e), k) for k, dd, _, e in rows if dd == d and e * sign > 0])
            left, budget = -sum(e for e, _ in own), int(np.floor(sum(abs(r) for _, dd, r, _ in rows if dd == d and r * sign > 0) * 40.0 / n * monitor.UNITS + 0.5))
            for e, k in own:
                if left > budget:
                    want.add(k)
                left += e
    assert got == want and 0 < len(got) < 120


def test_memory_sample_equals_a_sort(spark):
    nodes = spark.range(300).select(F.col("id").alias("node"))
    far = nodes.unionAll(nodes.select(F.col("node") + etl.PRIME))  # nodes of equal hashes
    key = lambda k: ((k % etl.PRIME) * (2654435761 % etl.PRIME) % etl.PRIME + 2 * 40503 + 7) % etl.PRIME
    for n in (0, 1, 90, 290):
        changed = nodes.where(F.col("node") < n)
        left = sorted((key(k), k) for k in [*range(n, 300), *range(etl.PRIME, etl.PRIME + 300)])
        got = sorted(r.node for r in learn.memory_sample(far, changed).collect())
        assert got == sorted(k for _, k in left[:n])
    assert learn.memory_sample(nodes, nodes.where("node < 200")).count() == 100


def test_a_sweep_equals_its_runs(spark):
    n, e = graph(3)
    x, runs = x_df(spark, n), [(0.2, 1e-3), (0.2, 1e-6), (0.5, 1e-5), (1.0, 1e-4)]
    got = propagate.sweep(x, edges_df(spark, e), runs)
    got.cache()
    for k, (alpha, rmax) in enumerate(runs):
        own = propagate.initial_operation(x, edges_df(spark, e), Params(alpha=alpha, rmax=rmax))
        for value in ("pi", "r"):
            assert np.abs(dense(got.where(F.col("run") == k), n, value=value) - dense(own, n, value=value)).max() < 1e-12
    assert propagate.sweep(x, edges_df(spark, e), []).count() == 0
    with pytest.raises(ValueError):
        propagate.sweep(x, edges_df(spark, e), [(0.0, 1e-3)])


def test_lazy_update_selects_nodes_near_the_change(spark):
    n, e = graph(6, 20, 0.15)
    x = x_df(spark, n)
    params = Params(rmax=1e-6, alpha=0.2, rbmax=1e-3, delta=1e-3)
    g = dynamic.Graph(edges_df(spark, e), x, propagate.initial_operation(x, edges_df(spark, e), params))
    nodes = spark.range(n).select(F.col("id").alias("node"))
    out, changed = monitor.lazy_update(g, edges_df(spark, both({(0, 9)})), nodes, params)
    assert changed.count() > 0
    assert propagate.invariant_error(out.state, x, out.edges, 0.2).first().error < 1e-10


def test_numbers_are_dense_and_splits_whole(spark):
    n, e = graph(7, 30)
    df = edges_df(spark, {p for p in e if p[0] < p[1]})
    b = etl.batches(df, 4)
    sizes = [r["count"] for r in b.groupBy("batch").count().collect()]
    assert len(set(sizes)) == 1 and len(sizes) == 4 and b.count() <= df.count()
    ptr = {r.node: (r.start, r.deg) for r in etl.csr(edges_df(spark, e), spark.range(n).select(F.col("id").alias("node"))).collect()}
    at = 0
    for k in range(n):
        assert ptr[k][0] == at
        at += ptr[k][1]
    labels = spark.createDataFrame([(k, k % 3) for k in range(300)], "node long, y int")
    split = {r["split"]: r["count"] for r in etl.stratified_split(labels, 0.4, 0.2).groupBy("split").count().collect()}
    assert split == {"train": 120, "val": 60, "test": 120}


def complete(n):
    return {(a, b) for a in range(n) for b in range(n) if a != b}


def far_off(counts, expected):
    """By how many standard deviations the chi-square statistic exceeds its mean."""
    counts, expected = np.asarray(counts, float), np.asarray(expected, float)
    free = len(counts) - 1
    return (((counts - expected) ** 2 / expected).sum() - free) / np.sqrt(2 * free)


@pytest.mark.parametrize("alpha", [0.1, 0.5])
def test_lengths_of_walks_are_geometric(spark, alpha):
    n, first = 30_000, spark.createDataFrame([(3,)], "node long")
    ends = walks.stopping_walks(walks.starts(first, n), edges_df(spark, complete(8)), alpha, seed=4)
    steps = np.array([r.steps for r in ends.collect()])
    assert len(steps) == n
    bins = int(np.log(40 / n) / np.log(1 - alpha))  # the last with at least 40 expected
    law = [n * alpha * (1 - alpha) ** k for k in range(bins)]
    counts = [(steps == k).sum() for k in range(bins)]
    assert far_off([*counts, (steps >= bins).sum()], [*law, n * (1 - alpha) ** bins]) < 4
    assert abs(steps.mean() - (1 - alpha) / alpha) < 4 * np.sqrt(1 - alpha) / alpha / np.sqrt(n)


def test_draws_of_steps_walks_and_purposes_are_independent(spark):
    n, w = 40_000, F.col("id")
    at = lambda walk, step, purpose=walks.WAY, start=5, seed=1: (walks.draw(walk, F.lit(start).cast("long"), step, seed, purpose) % 7).alias("x")
    pairs = {
        "steps": (at(w, 0), at(w, 1)), "walks": (at(w * 2, 3), at(w * 2 + 1, 3)), "purposes": (at(w, 2, walks.COIN), at(w, 2)),
        "starts": (at(w, 0, start=1), at(w, 0, start=2)), "seeds": (at(w, 0), at(w, 0, seed=2)), "ten steps": (at(w, 10), at(w, 11)),
    }
    for name, (a, b) in pairs.items():
        seen = {(r.a, r.b): r["count"] for r in spark.range(n).select(a.alias("a"), b.alias("b")).groupBy("a", "b").count().collect()}
        assert far_off([seen.get((i, j), 0) for i in range(7) for j in range(7)], [n / 49] * 49) < 4, name
    top = spark.range(n).select(F.max(walks.draw(w, w, 0, 1)), F.min(walks.draw(w, w, 0, 1))).first()
    assert walks.RANGE * 0.999 < top[0] < walks.RANGE and 0 <= top[1] < walks.RANGE * 0.001


def test_large_ids_do_not_overflow(spark):
    big = (1 << 62) + 12345
    df = edges_df(spark, {(big, big + 1), (big + 1, big)})
    ends = walks.stopping_walks(walks.starts(spark.createDataFrame([(big,)], "node long"), 50), df, 0.3)
    assert {r.node for r in ends.collect()} <= {big, big + 1} and ends.count() == 50
    assert all(0 <= r.k < etl.PRIME for r in df.select(etl.hash_order(F.col("src"), F.col("dst"), 7).alias("k")).collect())


def test_walk_estimates_lie_within_their_standard_errors(spark):
    alpha, n_walks = 0.1, 20_000
    n, e = graph(9, 12)
    x = x_df(spark, n)
    got = dense(walks.walk_tail(propagate.initial_state(x), edges_df(spark, e), alpha, n_walks), n)
    values, p = dense(x, n, value="x"), matrix(e, n)
    deg = np.array([sum(a == k for a, _ in e) for k in range(n)], float)
    walk = np.sqrt(deg)[:, None] ** -1 * p * np.sqrt(deg)[None]  # D^-1 A
    ends = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * walk)  # from row to column
    z = []
    for d in range(2):
        mass = np.abs(values[:, d]) * np.sqrt(deg)
        q = (mass / mass.sum()) @ ends
        error = mass.sum() / np.sqrt(n_walks) * np.sqrt(q * (1 - q)) / np.sqrt(deg)
        z += list((got[:, d] - exact(e, n, values, alpha)[:, d]) / error)
    assert np.abs(z).max() < 3.5 and np.mean(np.square(z)) < 2


def test_a_hub_lies_in_many_chunks(spark):
    n = 5000
    star = both({(0, k) for k in range(1, n)})
    rows = etl.chunked(edges_df(spark, star), 64).collect()
    hub = sorted((r for r in rows if r.src == 0), key=lambda r: r.chunk)
    assert len(hub) == -(-(n - 1) // 64) and all(len(r.dsts) <= 64 and r.first == 64 * r.chunk and r.deg == n - 1 for r in hub)
    assert [v for r in hub for v in r.dsts] == list(range(1, n))
    place = {(r.src, r.pos): r.dst for r in etl.positions(edges_df(spark, star)).collect()}
    assert len(place) == len(star) and all(place[0, k] == k + 1 for k in range(n - 1))
    ends = walks.fixed_walks(spark.createDataFrame([(0,)], "node long"), edges_df(spark, star), 3000, 1)
    assert len({r.node for r in ends.collect()}) > 2000


def test_walks_are_on_edges_and_stop_where_they_should(spark):
    n, e = graph(8, 10)
    nodes = spark.range(n).select(F.col("id").alias("node"))
    for r in walks.fixed_walks(nodes, edges_df(spark, e), 5, 1).collect():
        assert (r.start, r.node) in e
    x = spark.createDataFrame([(k, 0, float(k == 3)) for k in range(n)], "node long, dim int, x double")
    est = walks.walk_tail(propagate.initial_state(x), edges_df(spark, e), 0.6, 4000)
    assert np.abs(dense(est, n, 1) - exact(e, n, dense(x, n, 1, "x"), 0.6)).max() < 0.05
    pushed = propagate.push_all(propagate.initial_state(x), propagate.weights(edges_df(spark, e)), 0.6, 2)
    cached = walks.cached_tail(pushed, edges_df(spark, e), walks.walk_cache(nodes, edges_df(spark, e), 0.6), 0.6)
    assert np.abs(dense(cached, n, 1) - exact(e, n, dense(x, n, 1, "x"), 0.6)).max() < 0.15
    assert walks.sample_sources(nodes.withColumn("w", F.lit(0.0)), "w", 5, ["node"]).agg(F.sum("times")).first()[0] == 0


def test_push_by_degree_leaves_small_residuals(spark):
    n, e = graph(9, 15)
    x = x_df(spark, n, dims=1)
    walks_n, scales = propagate.scale_schedule(n, 4.0, 0.5, 1e-2)
    assert scales[-1] == 1.0 and sorted(scales, reverse=True) == scales
    s = propagate.push_by_degree(propagate.initial_state(x), edges_df(spark, e), walks_n, scales, P)
    assert propagate.invariant_error(s, x, edges_df(spark, e), 0.2).first().error < 1e-10
    deg = {r.node: r.deg for r in etl.degree(edges_df(spark, e)).collect()}
    assert all(abs(0.8 * r.r * walks_n) < deg[r.node] * (1 + 1e-9) for r in s.collect())


def test_constant_and_zero_features(spark):
    x = spark.createDataFrame([(k, d, v) for k in range(4) for d, v in ((0, 3.0), (1, 0.0), (2, -1.0 - k))], "node long, dim int, x double")
    z = {(r.node, r.dim): r.x for r in features.standardize(x).collect()}
    assert all(z[k, 0] == 0 and z[k, 1] == 0 for k in range(4))
    assert {r.dim: (r.pos, r.neg) for r in features.column_sums(x).collect()}[2] == (0.0, -10.0)
    unit = {(r.node, r.dim): r.x for r in features.l2_normalize(x.where("dim = 1")).collect()}
    assert set(unit.values()) == {0.0}


def test_learning(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(size=4) + (k % 2) * 1.5], k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "node long, vec array<double>, y int")
    for model in (learn.linear(learn.vectors(df)), learn.mlp(learn.vectors(df), [4, 6, 2], 60)):
        assert metrics.accuracy(learn.predicted(model, learn.vectors(df))).first().accuracy > 0.85
    w, losses = learn.train_incremental(df.where("node < 200"), df.where("node >= 200"), np.zeros((5, 2)), steps=12)
    assert losses[-1] < losses[0] and w.shape == (5, 2)
    g, m = np.array([1.0, -2.0]), np.array([0.0, 1.0])
    assert abs(learn.project(g, m) @ m) < 1e-12 and (learn.project(-g, m) == -g).all()
    assert learn.flooded(0.02) == pytest.approx(0.18)
    assert learn.early_stop(lambda k: abs(k - 3), 50, 4) == (3, 0)
    unit = learn.normalized(learn.embed(df, np.eye(4))).first().vec
    assert sum(v * v for v in unit) == pytest.approx(1)


def test_training_goes_on_from_what_was_saved(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=3) + (k % 2) * 3.0], k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "node long, vec array<double>, y int").repartition(3)
    w, losses = learn.train_incremental(df, df, np.zeros((4, 2)), steps=12)
    learn.save_arrays(spark, {"weights": w, "reference": learn.softmax_gradient(df, w)[0]}, f"{tmp_path}/model")
    back = learn.load_arrays(spark, f"{tmp_path}/model")
    assert (back["weights"] == w).all() and back["reference"].shape == w.shape
    _, again = learn.train_incremental(df, df, back["weights"], steps=2)
    assert again[0] < losses[0] / 2
    level = again[0] + 0.2
    held, flood = learn.train_incremental(df, df, back["weights"], rate=0.05, steps=3, level=level)
    assert flood[0] == pytest.approx(2 * level - again[0]) and np.abs(held - w).max() < 1e-9  # the memory lets no step climb
    high, _ = learn.train_incremental(df, df.withColumn("y", 1 - F.col("y")), back["weights"], rate=0.05, steps=3, level=level)
    assert learn.softmax_gradient(df, high)[1] > again[0]


def test_perceptron_starts_from_an_earlier_one(spark):
    df = spark.createDataFrame([(k, [float(k % 2), float(k % 3)], k % 2) for k in range(60)], "node long, vec array<double>, y int")
    first = learn.mlp(learn.vectors(df), [2, 4, 2], 60)
    warm = learn.mlp(learn.vectors(df), [2, 4, 2], 1, start=first.weights.toArray())
    assert metrics.accuracy(learn.predicted(warm, learn.vectors(df))).first().accuracy == 1.0


def test_models_predict_in_a_session_that_has_observed_a_query(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    rows = spark.createDataFrame([(k, k % 2, [float(k % 2), 1.0 + k % 3]) for k in range(40)], "node long, y int, vec array<double>")
    x = learn.vectors(rows)
    for model in (learn.linear(x), learn.mlp(x, [2, 3, 2], rounds=5)):
        assert learn.predicted(model, x).count() == 40


def test_group_discriminator_tells_rows_from_permuted_ones(spark):
    x = spark.createDataFrame([(k, d, (1.0 if k < 10 else 0.0) + 0.1 * d) for k in range(100) for d in range(2)], "node long, dim int, x double")
    model = learn.permuted_discriminator(x.withColumn("x", F.col("x") + 5), x)
    assert learn.predicted(model, learn.vectors(features.packed(x)).withColumn("y", F.lit(0))).where("predicted = 1").count() == 0


def test_a_push_that_does_not_end_raises(spark):
    n, e = graph()
    x = x_df(spark, n)
    with pytest.raises(RuntimeError, match="outside the thresholds after 3 rounds"):
        propagate.initial_operation(x, edges_df(spark, e), Params(rmax=1e-9, alpha=0.2, max_rounds=3))
    empty = propagate.initial_operation(x.where("false"), edges_df(spark, e), P)
    assert empty.count() == 0


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_columns_of_one_sign_end_after_an_update_of_both(spark, sign):
    n, e = graph(5, 10)
    x = spark.createDataFrame([(k, 0, sign * (k % 3)) for k in range(n)], "node long, dim int, x double")
    p = Params(rmax=1e-4, alpha=0.5, max_rounds=40)
    g = dynamic.Graph(edges_df(spark, e), x, propagate.initial_operation(x, edges_df(spark, e), p))
    out = g.update(edges_df(spark, both({(0, 5), (1, 2)})), p)
    after = e ^ both({(0, 5), (1, 2)})
    assert np.abs(dense(out.state, n, 1) - exact(after, n, dense(x, n, 1, "x"), 0.5)).max() < 1e-2
