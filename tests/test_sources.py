from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphprop.operators import etl, propagate
from graphprop.session import Params
from graphprop.sources import blockmodel as bm
from graphprop.sources import files
from graphprop.streaming.updates import StateStore, apply_batch, follow


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_text_formats(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n3 1\n1 2\n\n1 2\nx 9\n")
    assert rows(files.commented_edges(spark, f"{tmp_path}/e.txt")) == [(1, 2), (1, 2), (3, 1)]
    (tmp_path / "u.txt").write_text("1 2\n 2\t1 \n1 2\n")
    assert [(r.src, r.dst) for r in files.update_file(spark, f"{tmp_path}/u.txt", 4).orderBy("seq").collect()] == [(1, 2), (2, 1), (1, 2)]
    many = tmp_path / "many"
    many.mkdir()
    for k in range(3):
        (many / f"{k}.txt").write_text("".join(f"{k} {j}\n" for j in range(5)))
    got = files.update_file(spark, str(many)).orderBy("seq").collect()
    assert [(r.seq, r.src, r.dst) for r in got] == [(5 * k + j, k, j) for k in range(3) for j in range(5)]
    (tmp_path / "t.txt").write_text("1 5 2001\n2 3 2002\n")
    t = files.temporal_edges(spark, f"{tmp_path}/t.txt")
    assert rows(t) == [(1, 5, "2001"), (2, 3, "2002")] and files.node_count(t).first().n == 6
    (tmp_path / "p.txt").write_text("[1, 2, 19991231, 'a']\n(2, 1, 20000101, 'b')\nnonsense\n")
    assert rows(files.dated_edges(spark, f"{tmp_path}/p.txt").where("t is not null")) == [(1, 2, 1999), (1, 2, 2000), (2, 1, 1999), (2, 1, 2000)]
    (tmp_path / "l.txt").write_text("(7, 'x', 19990101, 3)\n")
    assert rows(files.dated_labels(spark, f"{tmp_path}/l.txt")) == [(7, 2)]
    (tmp_path / "i.csv").write_text("u,i,label,z\n1,2,0,q\n3,4,1,q\n")
    assert rows(files.interaction_csv(spark, f"{tmp_path}/i.csv")) == [(1, 2, 0), (3, 4, 1)]
    (tmp_path / "q.txt").write_text("4\n\n 5 \nx\n")
    assert rows(files.query_nodes(spark, f"{tmp_path}/q.txt")) == [(4,), (5,)]


def test_binary_formats(spark, tmp_path):
    np.array([1, 2, 0, 0], "<u4").tofile(tmp_path / "el.txt")
    np.array([0, 2, 3, 3, 4], "<u4").tofile(tmp_path / "pl.txt")
    assert rows(files.csr_files(spark, f"{tmp_path}/el.txt", f"{tmp_path}/pl.txt")) == [(0, 1), (0, 2), (1, 0), (3, 0)]
    np.array([1, 2], "<u4").tofile(tmp_path / "el_0.txt")
    np.array([0, 0], "<u4").tofile(tmp_path / "el_1.txt")
    assert rows(files.csr_files(spark, f"{tmp_path}/el_*.txt", f"{tmp_path}/pl.txt")) == [(0, 1), (0, 2), (1, 0), (3, 0)]
    np.array([0, 2, 3, 3, 9], "<u4").tofile(tmp_path / "bad.txt")
    with pytest.raises(Exception, match="shorter than its pointers"):
        files.csr_files(spark, f"{tmp_path}/el.txt", f"{tmp_path}/bad.txt").collect()
    x = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "f_0.npy", x)
    np.save(tmp_path / "f_1.npy", np.asfortranarray(x + 100).astype("f4"))
    got = files.npy_features(spark, f"{tmp_path}/f_*.npy")
    assert rows(got) == sorted([(k, d, float(np.concatenate([x, x + 100])[k, d])) for k in range(8) for d in range(3)], key=repr)
    some = spark.createDataFrame([(5,)], "node long")
    assert rows(files.npy_features(spark, f"{tmp_path}/f_*.npy", some).select("node").distinct()) == [(5,)]
    assert files.npy_features(spark, f"{tmp_path}/f_0.npy", transposed=True).agg(F.max("node")).first()[0] == 2
    with pytest.raises(ValueError, match="not supported"):
        files.npy_header(files.npy_bytes([[1.0]])[:0] + _npy(np.array([1j])))


def _npy(a):
    import io

    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (2, 0), (0, 2)], "src long, dst long")
    nodes = spark.range(4).select(F.col("id").alias("node"))
    files.write_csr(e, nodes, f"{tmp_path}/csr", self_loops=True)
    assert rows(spark.read.parquet(f"{tmp_path}/csr/indptr")) == [(0, 0, 3), (1, 3, 2), (2, 5, 2), (3, 7, 1)]
    assert spark.read.parquet(f"{tmp_path}/csr/indices").count() == 8
    files.write_text_edges(e, f"{tmp_path}/txt")
    assert rows(files.text_edges(spark, f"{tmp_path}/txt")) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    files.write_updates(e.withColumn("batch", F.lit(1)), f"{tmp_path}/upd")
    assert spark.read.parquet(f"{tmp_path}/upd").where("batch = 1").count() == 10
    files.append_metrics(spark, f"{tmp_path}/m", [("a", "sec", 1.0)])
    files.append_metrics(spark, f"{tmp_path}/m", [("b", "sec", 2.0)])
    files.write_vector(e, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2


def test_block_model(spark):
    cfg = bm.BlockModel(nodes=400, clusters=4, in_degree=12, out_degree=4, changes=7)
    e, y = bm.block_edges(spark, cfg), {r.node: r.y for r in bm.communities(spark, cfg).collect()}
    pairs = set(rows(e))
    assert pairs == {(b, a) for a, b in pairs} and all(a != b for a, b in pairs)
    inside = sum(y[a] == y[b] for a, b in pairs) / len(pairs)
    assert 0.6 < inside < 0.95
    moved = {r.node for r in bm.communities(spark, cfg, 1).collect() if r.y != y[r.node]}
    assert len(moved) == 7
    u = set(rows(bm.block_updates(spark, cfg, 1).select("src", "dst")))
    assert u and pairs ^ u == set(rows(bm.block_edges(spark, cfg, 1)))


def test_stream_equals_batches_and_replays_once(spark, tmp_path):
    n = 10
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a == b or abs(a - b) == 1], "src long, dst long")
    x = spark.createDataFrame([(k, 0, float(k % 3)) for k in range(n)], "node long, dim int, x double")
    p = Params(rmax=1e-3, alpha=0.7)
    store = StateStore(spark, f"{tmp_path}/store", x)
    assert store.version() == -1
    store.save(0, e, propagate.initial_operation(x, e, p))
    for k, (a, b) in enumerate([(0, 5), (2, 8)]):
        spark.createDataFrame([(1, a, b), (2, b, a)], "seq long, src long, dst long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = follow(spark, f"{tmp_path}/in", store, f"{tmp_path}/check", p)
    assert q.awaitTermination(300)
    assert store.version() == 2
    g = store.load()
    assert propagate.invariant_error(g.state, x, g.edges, 0.7).first().error < 1e-10
    assert etl.degree(g.edges).where("node = 0").first().deg == 3
    assert not apply_batch(store, e, 0, p)


def test_stream_of_text_files_keeps_the_last_versions(spark, tmp_path):
    n = 8
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a == b or abs(a - b) == 1], "src long, dst long")
    x = spark.createDataFrame([(k, 0, float(k % 3)) for k in range(n)], "node long, dim int, x double")
    p = Params(rmax=1e-3, alpha=0.7)
    store = StateStore(spark, f"{tmp_path}/store", x, versions=2)
    store.save(0, e, propagate.initial_operation(x, e, p))
    (tmp_path / "in").mkdir()
    for k, text in enumerate(["0 5\n\n5 0\n", "  2\t7 \n7 2\n", "0 5\n5 0\n"]):
        (tmp_path / "in" / f"{k}.txt").write_text(text)
    assert follow(spark, f"{tmp_path}/in", store, f"{tmp_path}/check", p, text=True).awaitTermination(300)
    g = store.load()
    assert set(rows(g.edges.select("src", "dst"))) == set(rows(e)) | {(2, 7), (7, 2)}
    assert propagate.invariant_error(g.state, x, g.edges, 0.7).first().error < 1e-10
    for folder in ("edges", "state", "done"):
        assert {q.name for q in (tmp_path / "store" / folder).iterdir() if q.name[0] not in "._"} == {"2", "3"}
    assert not apply_batch(store, e, 2, p)
    with pytest.raises(ValueError):
        StateStore(spark, "x", x, versions=1)
