from __future__ import annotations

import math

import numpy as np
import pytest

from graphprop.llm.neighbours import Forest, _slices, grow, nearest, tuned

SCHEMA = "vec_id long, embedding array<float>, c long, vec string, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def brute(rows, top=20):
    ok = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in ok:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.float64(a), np.float64(b))), i) for i, b in ok if i != q)
            out[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored[:top])]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_small_tables_are_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(90)] + [(200 + k, [1.0, 2.0, 0.0, 1.0]) for k in range(45)]
    assert got(nearest(table(spark, rows))) == brute(rows)


def test_odd_rows_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (5, [1.0, 2.0, 3.0]), (7, [-1.0, 0.5])]
    assert got(nearest(table(spark, rows))) == {0: [(1, 3, 2.0), (2, 7, -1.0)]}
    assert nearest(table(spark, [])).collect() == []
    assert nearest(table(spark, [(20, [1.0])])).collect() == []


def spread(seed, n, groups):
    """Unit vectors: without structure, or around as many centres as ``groups``."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    if groups:
        x = rng.normal(size=(groups, 64))[rng.integers(0, groups, n)] + 0.3 * x
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("group_rows", "sample_rows", "groups"), [(20_000, 4000, 0), (50, 1000, 0), (20_000, 1000, 25)])
def test_recall(spark, group_rows, sample_rows, groups):
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(spread(2, 4000, groups))]
    cfg = Forest(leaf_rows=128, sample_rows=sample_rows, group_rows=group_rows)
    out, want = got(nearest(table(spark, rows), cfg)), brute(rows)
    assert out.keys() == want.keys()
    found = sum(len({i for _, i, _ in out[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 20 * len(want)
    assert all([k for k, _, _ in v] == list(range(1, 21)) for v in out.values())


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out, want = got(nearest(df)), brute(rows)
    assert out.keys() == want.keys()
    assert sum(len({i for _, i, _ in out[q]} & {i for _, i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_work_follows_the_structure():
    work = {}
    for groups in (0, 25, 200):
        x = spread(7, 8000, groups)
        cfg = Forest(leaf_rows=64)
        n_trees, wanted = tuned(grow(x, cfg, len(x)), x, len(x), cfg)
        work[groups] = wanted / len(x)
    assert work[0] <= 1 and work[25] < 0.25 and work[200] < 0.25, work


def test_double_columns_and_equal_products_of_different_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) / 3 for x in rng.integers(-2, 3, 5)]) for k in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    ok = [(i, np.array(v)) for i, v in rows if any(v)]
    for q, found in got(nearest(df)).items():
        a = dict(ok)[q]
        want = sorted((-np.add.reduce(a * b), i) for i, b in ok if i != q)[:20]
        assert [(i, s) for _, i, s in found] == [(i, -s) for s, i in want]


def test_queue_visits_the_own_leaf_first():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    trees = grow(x, Forest(leaf_rows=20), 500)
    for q in x[:20]:
        own = {int(trees.leaves(q[None], t)[0]) for t in range(4)}
        assert own <= set(trees.search(q, 200)) and len(trees.search(q, 1)) == 1


def test_queries_are_filed_in_slices():
    asked = []

    def place(x, ids):
        asked.append(len(x))
        row, leaf = np.repeat(np.arange(len(x)), 700), np.tile(np.arange(700), len(x))
        return row, leaf, ids[row] % 3, -x[:, 0]

    x, ids = np.arange(300.0).reshape(300, 1), np.arange(300) + 7
    pieces = list(_slices(x, ids, place, 2000))
    assert max(len(p[0]) for p in pieces) <= 2000 and max(asked) * 700 <= 2000
    for got_, want in zip((np.concatenate(c) for c in zip(*pieces, strict=True)), (np.repeat(np.arange(300), 700), np.tile(np.arange(700), 300), np.repeat(ids % 3, 700), np.repeat(-x[:, 0], 700)), strict=True):
        assert (got_ == want).all()
    few = list(_slices(x[:2], ids, place, 500))
    assert [len(p[0]) for p in few] == [500, 200, 500, 200]


def test_more_queries_than_a_group_takes(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(400)]
    cfg = Forest(target=1.0, leaf_rows=40, group_queries=6, group_rows=15)
    whole, dealt = got(nearest(table(spark, rows), Forest(target=1.0, leaf_rows=40))), got(nearest(table(spark, rows), cfg))
    assert dealt == whole
