from __future__ import annotations

import numpy as np
import pytest

from graphprop.sources import arrays


def test_adjacency_is_read_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    deg = rng.integers(0, 9, 400)
    deg[[0, 5, 6, 7, 399]] = 0
    deg[20] = 3000  # a hub over many ranges
    ptr, idx = np.concatenate([[0], np.cumsum(deg)]).astype("<u4"), rng.integers(0, 400, deg.sum()).astype("<u4")
    want = sorted(zip(np.repeat(np.arange(400), deg).tolist(), idx.tolist(), strict=True))
    (tmp_path / "one").mkdir()
    idx.tofile(tmp_path / "one/idx"), ptr.tofile(tmp_path / "one/ptr")
    df = arrays.csr_arrays(spark, f"file://{tmp_path}/one/idx", f"file://{tmp_path}/one/ptr", step=97)
    assert sorted(tuple(r) for r in df.collect()) == want and df.rdd.getNumPartitions() == -(-len(idx) // 97)
    for name, data in (("idx", idx), ("ptr", ptr)):
        (tmp_path / name).mkdir()
        for k, part in enumerate(np.array_split(data, 7)):
            part.tofile(tmp_path / name / f"part-{k}")
    assert sorted(tuple(r) for r in arrays.csr_arrays(spark, f"file://{tmp_path}/idx", f"file://{tmp_path}/ptr", step=500).collect()) == want
    idx[:-1].tofile(tmp_path / "one/short")
    with pytest.raises(Exception, match="the pointers say"):
        arrays.csr_arrays(spark, f"file://{tmp_path}/one/short", f"file://{tmp_path}/one/ptr").collect()
    (tmp_path / "one/odd").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole numbers"):
        arrays.csr_arrays(spark, f"file://{tmp_path}/one/odd", f"file://{tmp_path}/one/ptr").collect()


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f8", "<f4", "<i4", ">i2"])
def test_matrices_are_read_by_ranges(spark, tmp_path, order, kind):
    x = np.array(np.arange(700).reshape(100, 7) * 3, dtype=kind, order=order)
    np.save(tmp_path / "m.npy", x)
    got = {r.node: r.vec for r in arrays.npy_rows(spark, f"file://{tmp_path}/m.npy", step=13).collect()}
    assert got == {k: x[k].astype(float).tolist() for k in range(100)}
    few = spark.createDataFrame([(3,), (50,), (50,), (99,), (500,)], "node long")
    assert {r.node: r.vec for r in arrays.npy_rows(spark, f"file://{tmp_path}/m.npy", few, 10).collect()} == {k: x[k].astype(float).tolist() for k in (3, 50, 99)}


def test_parts_are_written_once_and_stacked(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k), k / 4]) for k in range(500)], "node long, vec array<double>").repartition(6)
    at = f"file://{tmp_path}/out"
    arrays.write_rows(rows, at, rows_per_part=120)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == [f"part-{k:018d}.npy" for k in range(0, 500, 120)]
    whole = np.concatenate([np.load(tmp_path / "out" / n) for n in names])
    assert (whole == [[k, k / 4] for k in range(500)]).all()
    assert sorted((r.node, r.vec) for r in arrays.npy_rows(spark, at, step=33).collect()) == [(k, [float(k), k / 4]) for k in range(500)]
    with pytest.raises(FileExistsError):
        arrays.write_rows(rows, at)
    with pytest.raises(Exception, match="without gaps"):
        arrays.write_rows(rows.where("node <> 7"), f"file://{tmp_path}/gap", rows_per_part=120)
    assert not [p for p in (tmp_path / "gap").iterdir()]
    arrays.write_rows(rows.limit(0), f"file://{tmp_path}/none")
    assert arrays.npy_rows(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "out" / names[0]).write_bytes((tmp_path / "out" / names[0]).read_bytes()[:-3])
    with pytest.raises(Exception, match="cut short"):
        arrays.npy_rows(spark, at).collect()


def test_a_csr_task_knows_the_parts_of_its_range_only(tmp_path):
    rng = np.random.default_rng(2)
    deg = rng.integers(0, 9, 400) * (rng.random(400) < 0.4)
    ptr, idx = np.concatenate([[0], np.cumsum(deg)]).astype("<u4"), rng.integers(0, 400, deg.sum()).astype("<u4")
    for name, x, size in (("indices", idx, 50), ("indptr", ptr, 7)):
        (tmp_path / name).mkdir()
        for a in range(0, len(x), size):
            (tmp_path / name / f"part-{a:06d}.bin").write_bytes(x[a : a + size].tobytes())
    reader = arrays.CsrReader({"indices": str(tmp_path / "indices"), "indptr": str(tmp_path / "indptr"), "step": "64"})
    parts = reader.partitions()
    assert max(len(p.index) for p in parts) <= 3 and max(len(p.pointer) for p in parts) < 20
    got = [(s, d) for p in parts for b in reader.read(p) for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == list(zip(np.repeat(np.arange(400), deg).tolist(), idx.tolist(), strict=True))
