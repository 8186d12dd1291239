"""Readers and writers of the file formats that graphs, features and update batches come in.

Text formats are read with a schema and no inference. Binary formats are read
by ``binaryFile``, so any store that Spark reads will do.
"""

from __future__ import annotations

import ast
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprop.operators.etl import add_self_loops, csr, numbered, positions
from graphprop.tables import Scratch


def edge_lines(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines (value) of a table or stream; empty lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"))


def text_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst`` separated by blanks, as (src, dst); repeated lines stay."""
    return edge_lines(spark.read.text(path))


def commented_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge list with ``#`` headers; lines that do not start with a digit are skipped; sorted by (src, dst)."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    return spark.read.text(path).where(line.rlike(r"^[0-9]+\s+[0-9]+")).select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst")).orderBy("src", "dst")


def update_file(spark: SparkSession, path: str, batch: int = 0) -> DataFrame:
    """(batch, seq, src, dst) of an update file or folder; ``seq`` numbers the lines from 0 without gaps, by file name and place in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select("_file", "_block", "_line", F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"))
    return numbered(rows, [F.col("_file"), F.col("_block"), F.col("_line")], "seq").select(F.lit(batch).alias("batch"), "seq", "src", "dst")


def temporal_edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst t`` lines, as (src, dst, t)."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("long").alias("src"), F.get(parts, F.lit(1)).cast("long").alias("dst"), F.get(parts, F.lit(2)).alias("t"))


def tuple_lines(spark: SparkSession, path: str, columns: list[tuple[str, str, int]]) -> DataFrame:
    """Fields of lines like ``[12, 'a', 19990101]``: (name, type, place). Parsed, never evaluated."""
    inner = F.regexp_replace("value", r"^[\s\[\(]+|[\s\]\),]+$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(k)).try_cast(kind).alias(name) for name, kind, k in columns])


def dated_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tuple lines (src, dst, yyyymmdd, ...), as (src, dst, t) with the year for t, in both directions within a year."""
    rows = tuple_lines(spark, path, [("src", "long", 0), ("dst", "long", 1), ("date", "int", 2)])
    e = rows.select("src", "dst", F.floor(F.col("date") / 10000).cast("int").alias("t"))
    return e.union(e.select("dst", "src", "t")).distinct()


def dated_labels(spark: SparkSession, path: str) -> DataFrame:
    """Tuple lines (node, _, yyyymmdd, class from 1), as (node, y from 0)."""
    return tuple_lines(spark, path, [("node", "long", 0), ("cls", "int", 3)]).select("node", (F.col("cls") - 1).alias("y"))


def interaction_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header and columns u, i, label, as (src, dst, label)."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.select(F.col("u").cast("long").alias("src"), F.col("i").cast("long").alias("dst"), F.col("label").cast("int").alias("label"))


def query_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value").rlike("^[0-9]+$")).select(F.trim("value").cast("long").alias("node"))


def node_count(edges: DataFrame) -> DataFrame:
    """One row: the largest id and 1."""
    return edges.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n"))


# ---- binary ------------------------------------------------------------------


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def csr_files(spark: SparkSession, indices: str, indptr: str) -> DataFrame:
    """Edges (src, dst) from little-endian uint32 ``indices`` and ``indptr`` files.

    Either may be a glob of parts, taken one after the other by name: a file is
    one task and at most 2 GB, so larger arrays come in parts. Numbers of
    pointers and indices that do not fit each other raise.
    """

    def flat_of(path: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path)
        before, total = {}, 0
        for r in files.select("path", "length").orderBy("path").collect():  # one row for each file
            before[r.path] = total
            total += r.length // 4

        def numbers(batches):
            for pdf in batches:
                for name, content in zip(pdf["path"], pdf["content"], strict=True):
                    a = np.frombuffer(content, "<u4").astype(np.int64)
                    for lo in range(0, len(a), 1 << 20):
                        part = a[lo : lo + (1 << 20)]
                        yield pd.DataFrame({"k": before[name] + lo + np.arange(len(part)), "v": part})

        return files.select("path", "content").mapInPandas(numbers, "k long, v long")

    flat, ptr = flat_of(indices), flat_of(indptr)
    ranges = ptr.join(ptr.select((F.col("k") - 1).alias("k"), F.col("v").alias("e")), "k")
    slots = ranges.where("e > v").select(F.col("k").alias("src"), F.explode(F.sequence(F.col("v"), F.col("e") - 1)).alias("k"))
    joined = slots.join(flat, "k", "left")
    return joined.select("src", F.when(F.col("v").isNull(), F.raise_error(F.lit("the index file is shorter than its pointers say")).cast("long")).otherwise(F.col("v")).alias("dst"))


def npy_header(data: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(dtype, fortran order, shape, offset of the data) of an npy file of version 1 or 2; other scalar kinds are refused."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an npy file")
    wide = data[6] >= 2
    size = int.from_bytes(data[8 : 12 if wide else 10], "little")
    at = 12 if wide else 10
    head = ast.literal_eval(data[at : at + size].decode("latin1").strip())
    kind = np.dtype(head["descr"])
    if kind.kind not in "fiub" or kind.itemsize > 8:
        raise ValueError(f"scalars of type {head['descr']} are not supported")
    return kind, bool(head["fortran_order"]), tuple(head["shape"]), at + size


def npy_features(spark: SparkSession, path: str, nodes: DataFrame | None = None, transposed: bool = False) -> DataFrame:
    """(node, dim, x) from an npy matrix, or from parts ``path`` that a glob names, stacked by the order of their names.

    ``transposed`` matrices are (dim, node). ``nodes`` keeps those rows only.
    """

    def rows(batches):
        for pdf in batches:
            for part, content in zip(pdf["part"], pdf["content"], strict=True):
                kind, fortran, shape, at = npy_header(content)
                a = np.frombuffer(content, kind, offset=at).reshape(shape, order="F" if fortran else "C").astype(float)
                a = a.reshape(len(a), -1).T if transposed else a.reshape(len(a), -1)
                for lo in range(0, len(a), 10_000):
                    block = a[lo : lo + 10_000]
                    n, d = block.shape
                    yield pd.DataFrame({"part": part, "node": np.repeat(np.arange(lo, lo + n), d), "dim": np.tile(np.arange(d, dtype=np.int32), n), "x": block.ravel()})

    files = _whole(spark, path).select(F.col("path").alias("part"), "content")
    out = files.mapInPandas(rows, "part string, node long, dim int, x double")
    size = out.groupBy("part").agg((F.max("node") + 1).alias("n")).orderBy("part").collect()  # one row for each file
    before, total = [], 0
    for r in size:
        before.append((r.part, total))
        total += r.n
    offset = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else None
    out = out.select((F.col("node") + offset[F.col("part")]).alias("node"), "dim", "x") if before else out.select("node", "dim", "x")
    return out if nodes is None else out.join(nodes.select("node"), "node", "left_semi")


# ---- sinks -------------------------------------------------------------------


def write_csr(edges: DataFrame, nodes: DataFrame, path: str, self_loops: bool = False) -> None:
    """The compressed adjacency as Parquet: ``indptr`` (node, start, deg) and ``indices`` (src, pos, dst), neighbours by rising degree."""
    own = add_self_loops(edges, nodes) if self_loops else edges.select("src", "dst").distinct()
    # written once: the pointers and the neighbours are both made of them
    own = Scratch(edges.sparkSession).keep(own, "edges")
    csr(own, nodes).write.mode("overwrite").parquet(f"{path}/indptr")
    positions(own, by_degree=True, written=True).write.mode("overwrite").parquet(f"{path}/indices")


def write_text_edges(edges: DataFrame, path: str, both: bool = True) -> None:
    """``src dst`` lines, in both directions on request; each direction once."""
    if both:
        edges = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(path)


def write_updates(batched: DataFrame, path: str) -> None:
    """A folder of ``batch=k`` parts, both directions of each pair."""
    both = batched.select("batch", "src", "dst").union(batched.select("batch", "dst", "src"))
    both.write.mode("overwrite").partitionBy("batch").parquet(path)


def write_vector(rows: DataFrame, path: str) -> None:
    """Append rows as tab-separated lines."""
    rows.write.mode("append").option("sep", "\t").csv(path)


def npy_bytes(rows: list[list[float]]) -> bytes:
    """A small matrix as an npy file, for exchange; large ones stay in Parquet."""
    out = io.BytesIO()
    np.save(out, np.asarray(rows, dtype=float))
    return out.getvalue()


def append_metrics(spark: SparkSession, path: str, rows: list[tuple[str, str, float]]) -> None:
    """Timings and scores (run, name, value), appended."""
    spark.createDataFrame(rows, "run string, name string, value double").coalesce(1).write.mode("append").parquet(path)
