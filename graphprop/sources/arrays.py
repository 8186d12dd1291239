"""Binary arrays read by ranges and written in parts, as Python data sources.

An array may be one file of any size or a folder of parts, taken one after the
other by name. A task reads a range of bytes of it, whatever the files' sizes,
and writes a part of its own, which moves to its name when the job commits. Paths
are those that Arrow opens (local, s3, gs, hdfs); for others ``files`` has
readers by ``binaryFile``.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from graphprop.sources.files import npy_header


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def parts_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the file, or of the parts in the folder, by name; what starts with a dot or underscore is none."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(at, info.size)]
    found = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
    return sorted((x.path, x.size) for x in found)


@dataclass
class Flat:
    """Numbers of one type that lie in parts, each after a head of its own; read by position."""

    path: str
    kind: str
    parts: list[tuple[str, int, int]]  # name, offset of the numbers, how many

    def __post_init__(self):
        self.before = [0]
        for _, _, n in self.parts:
            self.before.append(self.before[-1] + n)

    def __len__(self) -> int:
        return self.before[-1]

    def read(self, a: int, b: int) -> np.ndarray:
        """The numbers from position ``a`` to before ``b``; raises where a file is shorter than it was."""
        fs, out, size = opened(self.path)[0], [], np.dtype(self.kind).itemsize
        k = bisect.bisect_right(self.before, a) - 1
        while a < b and k < len(self.parts):
            name, at, n = self.parts[k]
            lo, hi = a - self.before[k], min(b - self.before[k], n)
            if hi > lo:
                with fs.open_input_file(name) as f:
                    raw = f.read_at((hi - lo) * size, at + lo * size)
                if len(raw) != (hi - lo) * size:
                    raise ValueError(f"{name} is cut short")
                out.append(np.frombuffer(raw, self.kind))
            a, k = max(a, self.before[k + 1]), k + 1
        return np.concatenate(out) if out else np.empty(0, self.kind)


def raw_array(path: str, kind: str) -> Flat:
    """Files of numbers without heads."""
    size = np.dtype(kind).itemsize
    for name, n in parts_of(path):
        if n % size:
            raise ValueError(f"{name} does not hold whole numbers")
    return Flat(path, kind, [(name, 0, n // size) for name, n in parts_of(path)])


@dataclass
class Range(InputPartition):
    first: int
    last: int


def ranges(n: int, step: int) -> list[Range]:
    return [Range(a, min(a + step, n)) for a in range(0, n, step)]


# ---- compressed adjacency ----------------------------------------------------


@dataclass
class CsrRange(Range):
    """A range of the indices with the parts that hold it and its pointers, and the positions where those parts begin."""

    index: list[tuple[str, int, int]]
    index_at: int
    pointer: list[tuple[str, int, int]]
    pointer_at: int


class CsrReader(DataSourceReader):
    """A task takes a range of the indices and finds its sources by searching the pointers.

    The driver lists the parts once and reads each pointer part's first number;
    a task opens the parts of its range only.
    """

    def __init__(self, options):
        self.indices, self.indptr = options["indices"], options["indptr"]
        self.kind, self.pointers = options.get("kind", "<u4"), options.get("pointers", "<u4")
        self.step = int(options.get("step", 4 << 20))

    def partitions(self):
        index, pointer = raw_array(self.indices, self.kind), raw_array(self.indptr, self.pointers)
        if not len(pointer) or int(pointer.read(0, 1)[0]) != 0:
            raise ValueError("the pointers do not start at 0")
        said = int(pointer.read(len(pointer) - 1, len(pointer))[0])
        if said != len(index):
            raise ValueError(f"the pointers say {said} indices, there are {len(index)}")
        starts = [k for k, part in enumerate(pointer.parts) if part[2]]
        firsts = [int(pointer.read(pointer.before[k], pointer.before[k] + 1)[0]) for k in starts]
        if any(a > b for a, b in zip(firsts, firsts[1:], strict=False)):
            raise ValueError("the pointers fall")
        out = []
        for r in ranges(len(index), self.step):
            a, b = bisect.bisect_right(index.before, r.first) - 1, bisect.bisect_left(index.before, r.last)
            lo, hi = bisect.bisect_right(firsts, r.first) - 1, bisect.bisect_left(firsts, r.last)
            first, end = starts[lo], starts[hi] + 1 if hi < len(starts) else len(pointer.parts)
            out.append(CsrRange(r.first, r.last, index.parts[a:b], index.before[a], pointer.parts[first:end], pointer.before[first]))
        return out

    def read(self, partition):
        index, pointer = Flat(self.indices, self.kind, partition.index), Flat(self.indptr, self.pointers, partition.pointer)
        lo, hi = 0, len(pointer) - 1  # the last pointer at or before the range, past nodes without edges
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if int(pointer.read(mid, mid + 1)[0]) <= partition.first else (lo, mid)
        at, node, block = partition.first, lo, 1 << 16
        while at < partition.last:
            ends = pointer.read(node + 1, min(node + 1 + block, len(pointer))).astype(np.int64)
            if (np.diff(ends) < 0).any():
                raise ValueError("the pointers fall")
            upto = int(min(ends[-1], partition.last))
            for a in range(at, upto, 1 << 18):
                b = min(a + (1 << 18), upto)
                src = partition.pointer_at + node + np.searchsorted(ends, np.arange(a, b), "right")
                yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(index.read(a - partition.index_at, b - partition.index_at).astype(np.int64))], ["src", "dst"])
            at, node = max(at, upto), node + len(ends)


class CsrSource(DataSource):
    """Edges (src, dst) from little-endian arrays: options ``indices``, ``indptr``, ``kind``, ``pointers``, and ``step``, the edges of a task."""

    @classmethod
    def name(cls):
        return "csr_arrays"

    def schema(self):
        return "src long, dst long"

    def reader(self, schema):
        return CsrReader(self.options)


def csr_arrays(spark: SparkSession, indices: str, indptr: str, **options: object) -> DataFrame:
    """Edges (src, dst) of a binary adjacency of any size, read by ranges. Pointers that do not fit the indices raise."""
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr_arrays").options(indices=indices, indptr=indptr, **options).load()


# ---- matrices ----------------------------------------------------------------


def npy_matrix(path: str) -> tuple[Flat, bool, list[tuple[int, int]]]:
    """The numbers of an npy file or of npy parts that are stacked, whether they lie column by column, and each part's shape."""
    fs, parts, shapes, seen = opened(path)[0], [], [], set()
    for name, size in parts_of(path):
        with fs.open_input_file(name) as f:
            kind, fortran, shape, at = npy_header(f.read_at(min(size, 1 << 16), 0))
        rows = shape[0] if shape else 1
        width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
        if at + rows * width * kind.itemsize != size:
            raise ValueError(f"{name} is cut short or holds more than its head says")
        parts.append((name, at, rows * width))
        shapes.append((rows, width))
        seen.add((kind.str, fortran and width > 1, width))
    if len(seen) > 1:
        raise ValueError("the parts differ in type, order or width")
    kind, fortran, _ = seen.pop() if seen else ("<f8", False, 0)
    return Flat(path, kind, parts), fortran, shapes


def _wanted(nodes: str | None) -> np.ndarray | None:
    return None if nodes is None else np.array(json.loads(nodes), np.int64)


class NpyReader(DataSourceReader):
    """A task takes a range of rows; of a matrix that lies column by column it reads that range of each column."""

    def __init__(self, options):
        self.path, self.step, self.spans = options["path"], int(options.get("step", 1 << 16)), options.get("spans")

    def partitions(self):
        _, _, shapes = npy_matrix(self.path)
        whole = ranges(sum(n for n, _ in shapes), self.step)
        if self.spans is None:
            return whole
        spans = json.loads(self.spans)
        return [Range(max(r.first, a), min(r.last, b)) for r in whole for a, b in spans if max(r.first, a) < min(r.last, b)]

    def read(self, partition):
        flat, fortran, shapes = npy_matrix(self.path)
        first = 0
        for k, (n, width) in enumerate(shapes):
            lo, hi, base = max(partition.first, first) - first, min(partition.last, first + n) - first, flat.before[k]
            for a in range(lo, hi, 4096):
                b = min(a + 4096, hi)
                if fortran:
                    x = np.stack([flat.read(base + c * n + a, base + c * n + b) for c in range(width)], 1)
                else:
                    x = flat.read(base + a * width, base + b * width).reshape(-1, width)
                values = pa.ListArray.from_arrays(np.arange(0, (b - a) * width + 1, width, dtype=np.int32) if width else np.zeros(b - a + 1, np.int32), pa.array(x.astype(float).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + a, first + b)), values], ["node", "vec"])
            first += n


@dataclass
class Part(WriterCommitMessage):
    names: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    """A task writes its rows, which come sorted and without gaps, as a part named by its first row."""

    def __init__(self, options):
        self.path, self.kind, self.head = options["path"], options.get("kind", "<f8"), options.get("head", "true") == "true"
        self.job = uuid.uuid4().hex

    def _at(self, name: str) -> str:
        return f"{opened(self.path)[1].rstrip('/')}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]):
        first, rows = None, []
        for batch in iterator:
            if batch.num_rows:
                node = batch.column(0).to_numpy()
                if (np.diff(node) != 1).any() or rows and node[0] != first + sum(map(len, rows)):
                    raise ValueError("the rows of a part are not numbered without gaps")
                first = int(node[0]) if first is None else first
                rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(self.kind))
        if first is None:
            return Part([])
        x, own = np.concatenate(rows), f"_{self.job}-{uuid.uuid4().hex}"
        fs = opened(self.path)[0]
        with fs.open_output_stream(self._at(own)) as f:
            if self.head:
                said = f"{{'descr': '{self.kind}', 'fortran_order': False, 'shape': {x.shape}, }}"
                said += " " * (-(len(said) + 11) % 64) + "\n"
                f.write(b"\x93NUMPY\x01\x00" + len(said).to_bytes(2, "little") + said.encode("latin1"))
            f.write(x.tobytes())
        return Part([(own, f"part-{first:018d}.{'npy' if self.head else 'bin'}")])

    def commit(self, messages):
        fs = opened(self.path)[0]
        for m in messages:
            for own, name in m.names if m else []:
                fs.move(self._at(own), self._at(name))
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        """Parts of attempts that did not count."""
        fs, at = opened(self.path)
        for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}"):
                fs.delete_file(x.path)


class ArraySource(DataSource):
    """Rows (node, vec) of npy matrices, or on writing also of arrays without heads."""

    @classmethod
    def name(cls):
        return "npy_arrays"

    def schema(self):
        return "node long, vec array<double>"

    def reader(self, schema):
        return NpyReader(self.options)

    def writer(self, schema, overwrite):
        fs, at = opened(self.options["path"])
        fs.create_dir(at, recursive=True)
        return ArrayWriter(self.options)


#: Runs of wanted rows that are pushed to the reader; more are left to a join.
MOST_SPANS = 10_000


def npy_rows(spark: SparkSession, path: str, nodes: DataFrame | None = None, step: int = 1 << 16) -> DataFrame:
    """(node, vec) from an npy matrix of any size or from parts, read by ranges of rows; ``nodes`` keeps those rows.

    Runs of wanted rows are pushed to the reader where they are few, so that
    what lies between is not read.
    """
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("npy_arrays").option("path", path).option("step", step)
    if nodes is None:
        return reader.load()
    # ids cluster in ranges of the reader's step: one row for each range that is wanted at all
    few = nodes.select(F.floor(F.col("node") / step).alias("k"), "node").groupBy("k").agg(F.min("node").alias("a"), (F.max("node") + 1).alias("b")).orderBy("k").limit(MOST_SPANS + 1).collect()
    if len(few) <= MOST_SPANS:
        reader = reader.option("spans", json.dumps([[r.a, r.b] for r in few]))
    return reader.load().join(nodes.select("node").distinct(), "node", "left_semi")


#: Parts of an array beyond which they grow instead, so that neither files nor tasks grow with the rows.
MOST_PARTS = 512


def part_rows(n: int, least: int) -> int:
    """Rows of a part where ``n`` rows are written or read: ``least``, or more if that would take over ``MOST_PARTS`` parts."""
    return max(least, -(-n // MOST_PARTS))


def write_rows(rows: DataFrame, path: str, kind: str = "<f8", head: bool = True, rows_per_part: int = 1 << 20) -> None:
    """Write rows (node from 0 without gaps, vec of one width) in parts of at most ``rows_per_part``: npy, or bare numbers.

    A folder that holds parts already raises. Without ``head`` the parts one after
    the other are the array's bytes. ``rows`` are read twice, so they are best a
    written table. A part is one task's, by its number.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ArraySource)
    fs, at = opened(path)
    if any(x.base_name.startswith("part-") for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))):
        raise FileExistsError(path)
    n = rows.agg(F.max("node")).first()[0]
    part = F.floor(F.col("node") / rows_per_part).cast("int")
    count = 1 if n is None else n // rows_per_part + 1
    placed = rows.select("node", F.col("vec").cast("array<double>").alias("vec")).repartitionById(count, part).sortWithinPartitions("node")
    placed.write.format("npy_arrays").option("path", path).option("kind", kind).option("head", str(head).lower()).mode("append").save()
