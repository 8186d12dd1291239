"""Propagation: pi = sum_k alpha (1-alpha)^k P^k x with P = D^-1/2 A D^-1/2.

A state is (node, dim, pi, r); any push order keeps
``pi + alpha r = alpha x + (1-alpha) P pi``. Rounds are synchronous: all rows
over the threshold are pushed at once. Fixed-depth forms write a row for each
node and round; loops to a tolerance write what each round changes.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from graphprop.operators.etl import degree
from graphprop.operators.features import column_sums
from graphprop.session import Params
from graphprop.tables import Scratch, listed


def weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with w = 1/sqrt(deg_src deg_dst)."""
    deg = degree(edges)
    s, d = deg.select(F.col("node").alias("src"), F.col("deg").alias("_s")), deg.select(F.col("node").alias("dst"), F.col("deg").alias("_d"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", (1.0 / F.sqrt(F.col("_s").cast("double") * F.col("_d"))).alias("w"))


def kept_weights(edges: DataFrame) -> DataFrame:
    """``weights``, written once: for plans that read them at every step."""
    return Scratch(edges.sparkSession).keep(weights(edges), "weights")


def reverse_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with w = 1/deg_dst: the weights of the reverse push."""
    d = degree(edges).select(F.col("node").alias("dst"), F.col("deg").alias("_d"))
    return edges.join(d, "dst").select("src", "dst", (1.0 / F.col("_d")).alias("w"))


def step(values: DataFrame, w: DataFrame, value: str = "x") -> DataFrame:
    """(node, dim, value): one multiplication by the weights; nodes that get nothing are left out."""
    return values.join(w, values["node"] == w["src"]).groupBy(F.col("dst").alias("node"), "dim").agg(F.sum(F.col(value) * F.col("w")).alias(value))


def initial_state(features: DataFrame) -> DataFrame:
    """pi = 0, r = x."""
    return features.select("node", "dim", F.lit(0.0).alias("pi"), F.col("x").cast("double").alias("r"))


def push_all(state: DataFrame, w: DataFrame | Adjacency, alpha: float, rounds: int) -> DataFrame:
    """``rounds`` rounds that push every row: the series cut after that many terms, and its residual."""
    if isinstance(w, Adjacency):
        return _push_wide(state, w, alpha, rounds)
    for _ in range(rounds):
        moved = step(state.select("node", "dim", F.col("r").alias("m")), w, "m")
        state = state.join(moved, ["node", "dim"], "full").select(
            "node", "dim", (F.coalesce("pi", F.lit(0.0)) + alpha * F.coalesce("r", F.lit(0.0))).alias("pi"), ((1 - alpha) * F.coalesce("m", F.lit(0.0))).alias("r")
        )
    return state


#: Neighbours that a node has in one block, nodes of adjacent ids that share a block, and dimensions in one row of a wide state.
ROW, REGION, WIDTH = 1024, 8192, 16

#: Edges that a task is meant for, and pieces of hubs in one block.
TASK_EDGES, PIECES = 4_000_000, 512

#: Up to this many edges a loop goes along links: a round along blocks costs more to start.
FEW = 1_000_000

#: States of more rows than this are packed for rounds along blocks, and nodes that a part of a packed state is meant for.
PACKS, PART_NODES = 100_000, 50_000

#: Packed rounds after which the shuffle files of earlier ones are let go.
RELEASE = 8


def _block():
    """A function of the edges (_region, src, dst) of one region, which makes one row of them: the sources and their numbers of edges, the distinct targets, and each edge's place among them."""

    def run(edges):
        import pyarrow as pa

        src, dst = edges.column("src").to_numpy(), edges.column("dst").to_numpy()
        order = np.argsort(src, kind="stable")
        sources, counts = np.unique(src[order], return_counts=True)
        targets, at = np.unique(dst[order], return_inverse=True)
        parts = [sources.astype("<i8"), counts.astype("<i4"), targets.astype("<i8"), at.astype("<i4")]
        return pa.table([edges.column("_region").slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["_region", "sources", "counts", "targets", "at"])

    return run


def _summed(key: str, values: list[str], kind):
    """What the rows (node, ``key``, values...) of one region give along its block, summed for each target; null where nothing came. ``kind`` is the Arrow type of ``key``."""

    def run(gives, blocks):
        import pyarrow as pa

        out = []
        if len(gives):
            node = gives.column("node").to_numpy()
            of = pa.array(gives.column(key).to_pylist() if gives.column(key).null_count else gives.column(key).to_numpy(), kind).dictionary_encode("encode")
            keys, codes = of.dictionary, of.indices.to_numpy()
            cols = [(c.to_numpy(), c.is_valid().to_numpy()) for c in (gives.column(v) for v in values)]
            for row in blocks.select(["sources", "counts", "targets", "at"]).to_pylist():
                sources, counts, targets, at = (np.frombuffer(row[k], t) for k, t in (("sources", "<i8"), ("counts", "<i4"), ("targets", "<i8"), ("at", "<i4")))
                place = np.minimum(np.searchsorted(sources, node), len(sources) - 1)
                here = sources[place] == node
                for code in range(len(keys)):
                    mine, sums, came = here & (codes == code), [], []
                    for v, there in cols:
                        take = mine & there
                        held, m = np.zeros(len(sources), bool), np.zeros(len(sources))
                        held[place[take]], m[place[take]] = True, v[take]
                        if held.all():
                            sums.append(np.bincount(at, np.repeat(m, counts), len(targets)))
                            came.append(np.ones(len(targets), bool))
                        else:
                            to = at[np.repeat(held, counts)]
                            sums.append(np.bincount(to, np.repeat(m[held], counts[held]), len(targets)))
                            came.append(np.bincount(to, minlength=len(targets)) > 0)
                    some = np.logical_or.reduce(came)
                    if some.any():
                        label = pa.array([keys[code].as_py()] * int(some.sum()), kind)
                        out.append(pa.table([pa.array(targets[some]), label, *[pa.array(x[some], pa.float64(), mask=~c[some]) for x, c in zip(sums, came, strict=True)]], ["node", key, *values]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), kind, *[pa.float64() for _ in values])], ["node", key, *values])

    return run


class Adjacency:
    """A graph's neighbours in blocks, and its degrees, each written when it is first needed: the weights follow from the degrees.

    Nodes of adjacent ids share a block, so that what they give to one node is
    summed before it is moved; of a node with over ``ROW`` neighbours each
    piece is dealt by a hash. An edge in a block is the place of its target, 4
    bytes. Forward weights are 1/sqrt(deg_src deg_dst), ``reverse`` ones 1/deg_dst;
    the blocks and degrees of both are the same.
    """

    def __init__(self, edges: DataFrame, reverse: bool = False, of: Adjacency | None = None):
        self.edges, self.reverse, self.scratch, self.of = edges.select("src", "dst").where("src is not null"), reverse, Scratch(edges.sparkSession), of

    def turned(self) -> Adjacency:
        """The same graph with the weights of the other way, which shares what is written."""
        return Adjacency(self.edges, not self.reverse, self)

    @cached_property
    def degrees(self) -> DataFrame:
        return self.of.degrees if self.of else self.scratch.keep(degree(self.edges), "degrees")

    @cached_property
    def _sizes(self) -> tuple[int, int]:
        """How many tasks share the blocks, and in how many of these the pieces of hubs are."""
        if self.of:
            return self.of._sizes
        pieces = F.when(F.col("deg") > ROW, F.expr(f"(deg - 1) div {ROW} + 1"))
        edges, hubs = self.degrees.agg(F.coalesce(F.sum("deg"), F.lit(0)), F.coalesce(F.sum(pieces), F.lit(0))).first()
        return max(int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges // TASK_EDGES)), -(-hubs // PIECES)

    @property
    def tasks(self) -> int:
        return self._sizes[0]

    def _piece(self, node: Column, piece: Column) -> Column:
        return (-1 - F.pmod(F.xxhash64(node, piece.cast("long")), F.lit(max(self._sizes[1], 1)))).cast("long")

    def regions(self, node: str, deg: str) -> Column:
        """The blocks that hold edges of a node."""
        pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"({deg} - 1) div {ROW}")), lambda k: self._piece(F.col(node), k))
        return F.when(F.col(deg) > ROW, F.array_distinct(pieces)).otherwise(F.array(F.expr(f"{node} div {REGION}")))

    @cached_property
    def blocks(self) -> DataFrame:
        if self.of:
            return self.of.blocks
        rows, own = self.edges.where("dst is not null"), F.expr(f"src div {REGION}")
        if self._sizes[1]:
            hubs = self.scratch.keep(self.degrees.where(F.col("deg") > ROW).select(F.col("node").alias("src"), F.expr(f"(deg - 1) div {ROW} + 1").alias("_n")), "hubs")
            rows = rows.join(listed(hubs), "src", "left")
            own = F.when(F.col("_n").isNull(), own).otherwise(self._piece(F.col("src"), F.pmod(F.xxhash64("dst"), F.col("_n"))))
        dealt = rows.select(own.alias("_region"), "src", "dst").repartition(self.tasks, "_region")
        return self.scratch.keep(dealt.groupBy("_region").applyInArrow(_block(), "_region long, sources binary, counts binary, targets binary, at binary"), "blocks")

    def multiplied(self, gives: DataFrame, key: str, values: list[str], blocks: DataFrame | None = None) -> DataFrame:
        """(node, ``key``, values...) that rows (node, deg, ``key``, values...) give: a sum for each block, which may be one of many for a target."""
        from pyspark.sql.pandas.types import to_arrow_type

        kind = gives.schema[key].dataType
        schema = StructType([StructField("node", LongType()), StructField(key, kind), *[StructField(v, DoubleType()) for v in values]])
        dealt = gives.select(F.explode(self.regions("node", "deg")).alias("_region"), "node", key, *values).repartition(self.tasks, "_region")
        near = self.blocks.repartition(self.tasks, "_region") if blocks is None else blocks
        return dealt.groupBy("_region").cogroup(near.groupBy("_region")).applyInArrow(_summed(key, values, to_arrow_type(kind)), schema)

    def gives(self, r: Column) -> Column:
        return r if self.reverse else r / F.sqrt(F.col("deg").cast("double"))

    def gets(self, m: Column) -> Column:
        deg = F.col("deg").cast("double")
        return F.when(F.col("deg").isNotNull(), m / (deg if self.reverse else F.sqrt(deg)))


def adjacency(edges: DataFrame, reverse: bool = False) -> Adjacency:
    return Adjacency(edges, reverse)


class _Wide:
    """Rows (node, dim, values...) as one row for a node and up to ``WIDTH`` dimensions, each value a column for each dimension.

    A null stands for a row that is not there. Every node of the graph has its
    row, with its degree. A multiplication moves one row for each edge at most,
    whatever the number of dimensions, and fewer where nodes of adjacent ids
    give to one node.
    """

    def __init__(self, rows: DataFrame, values: list[str], adj: Adjacency):
        spark = rows.sparkSession
        self.adj, self.scratch = adj, Scratch(spark)
        rows = self.scratch.keep(rows.select("node", "dim", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]), "rows")
        dims = sorted((r.dim for r in rows.select("dim").distinct().collect()), key=lambda d: (d is None, d))
        self.width = max(1, min(WIDTH, len(dims)))
        self.places = spark.createDataFrame([(d, k) for k, d in enumerate(dims)], StructType([StructField("dim", rows.schema["dim"].dataType), StructField("_k", IntegerType())]))
        placed = rows.withColumnRenamed("dim", "_d").join(F.broadcast(self.places), F.col("_d").eqNullSafe(F.col("dim")))
        block, at = F.expr(f"cast(_k div {self.width} as int)"), F.col("_k") % self.width
        packed = placed.groupBy("node", block.alias("block")).agg(*[F.sum(F.when(at == k, F.col(v))).alias(f"{v}{k}") for v in values for k in range(self.width)])
        blocks = spark.range(-(-len(dims) // self.width)).select(F.col("id").cast("int").alias("block"))
        grid = adj.degrees.crossJoin(F.broadcast(blocks))
        self.rows = self.scratch.keep(packed.join(grid.hint("merge"), ["node", "block"], "full"), "wide")

    def columns(self, name: str) -> list[str]:
        return [f"{name}{k}" for k in range(self.width)]

    def moved(self, name: str) -> DataFrame:
        """The state with ``_m0``, ...: ``name`` multiplied by the weights, null where nothing came."""
        names = [f"_m{k}" for k in range(self.width)]
        own = [self.adj.gives(F.col(c)).alias(m) for m, c in zip(names, self.columns(name), strict=True)]
        each = self.adj.multiplied(self.rows.where("deg is not null").select("node", "deg", "block", *own).where(F.coalesce(*names).isNotNull()), "block", names)
        sums = each.groupBy("node", "block").agg(*[F.sum(m).alias(m) for m in names])
        got = self.rows.join(sums.hint("merge"), ["node", "block"], "left")
        return got.select(*self.rows.columns, *[self.adj.gets(F.col(f"_m{k}")).alias(f"_m{k}") for k in range(self.width)])

    def put(self, rows: DataFrame) -> None:
        self.rows = self.scratch.replace(rows, "wide")

    def long(self, names: list[str]) -> DataFrame:
        """The rows that are there, (node, dim, names...)."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("_at"), *[F.col(f"{v}{k}").alias(v) for v in names]) for k in range(self.width)]))
        rows = self.rows.select("node", "block", each.alias("_e")).select("node", (F.col("block") * self.width + F.col("_e._at")).alias("_k"), *[F.col(f"_e.{v}").alias(v) for v in names])
        return rows.where(F.col(names[0]).isNotNull()).join(F.broadcast(self.places), "_k").select("node", "dim", *names)


def _there(value: Column, *of: str) -> Column:
    """``value`` where any of the columns is there."""
    return F.when(F.coalesce(*of).isNotNull(), value)


def _push_wide(state: DataFrame, adj: Adjacency, alpha: float, rounds: int) -> DataFrame:
    wide, zero = _Wide(state, ["pi", "r"], adj), F.lit(0.0)
    for _ in range(rounds):
        k = range(wide.width)
        pi = [_there(F.coalesce(f"pi{i}", zero) + alpha * F.coalesce(f"r{i}", zero), f"pi{i}", f"_m{i}").alias(f"pi{i}") for i in k]
        r = [_there((1 - alpha) * F.coalesce(f"_m{i}", zero), f"pi{i}", f"_m{i}").alias(f"r{i}") for i in k]
        wide.put(wide.moved("r").select("node", "block", "deg", *pi, *r))
    return wide.long(["pi", "r"])


def propagate(features: DataFrame, edges: DataFrame, depth: int, alpha: float) -> DataFrame:
    """(node, dim, x): the fixed-depth recurrence h = alpha x + (1-alpha) P h, started from alpha x."""
    first = features.select("node", "dim", (alpha * F.col("x")).alias("b"), (alpha * F.col("x")).alias("x"))
    wide, zero = _Wide(first, ["b", "x"], adjacency(edges)), F.lit(0.0)
    for _ in range(depth):
        k = range(wide.width)
        x = [_there(F.coalesce(f"b{i}", zero) + (1 - alpha) * F.coalesce(f"_m{i}", zero), f"b{i}", f"_m{i}").alias(f"x{i}") for i in k]
        wide.put(wide.moved("x").select("node", "block", "deg", *wide.columns("b"), *x))
    return wide.long(["x"])


def convolve(features: DataFrame, edges: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A graph convolution: one propagation step and a linear map given as rows (dim in) of columns (dim out)."""
    moved = step(features, weights(edges))
    spark = features.sparkSession
    m = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)], "dim int, out int, m double")
    return moved.join(F.broadcast(m), "dim").groupBy("node", F.col("out").alias("dim")).agg(F.sum(F.col("x") * F.col("m")).alias("x"))


def thresholds(features: DataFrame, rmax: float) -> DataFrame:
    """(dim, hi, lo): rmax times the signed column sums; a row is pushed above ``hi`` or below ``lo``.

    A column of one sign has the threshold of that sign on both sides: with 0
    for the other, the least residual of that sign would be pushed for ever.
    """
    pos, neg = F.col("pos"), F.col("neg")
    return column_sums(features).select("dim", (rmax * F.when(pos > 0, pos).otherwise(-neg)).alias("hi"), (rmax * F.when(neg < 0, neg).otherwise(-pos)).alias("lo"))


def _outside() -> Column:
    return (F.col("r") > F.col("hi")) | (F.col("r") < F.col("lo"))


def over(state: DataFrame, limit: DataFrame) -> DataFrame:
    """The rows outside the thresholds: the frontier."""
    return state.join(limit, "dim").where(_outside()).select(*state.columns)


def _give(marked: DataFrame, w: DataFrame, alpha: float) -> DataFrame:
    """The state after the rows marked ``_go`` have given their residual away: what stays and what arrives, in one sum."""
    go, r = F.col("_go"), F.col("r")
    stays = marked.select("node", "dim", F.when(go, F.col("pi") + alpha * r).otherwise(F.col("pi")).alias("pi"), F.when(go, 0.0).otherwise(r).alias("r"))
    given = marked.where(go).select("node", "dim", ((1 - alpha) * r).alias("m"))
    moved = given.join(w, given["node"] == w["src"]).select(F.col("dst").alias("node"), "dim", F.lit(0.0).alias("pi"), (F.col("m") * F.col("w")).alias("r"))
    return stays.unionAll(moved).groupBy("node", "dim").agg(F.sum("pi").alias("pi"), F.sum("r").alias("r"))


def push_round(state: DataFrame, w: DataFrame, limit: DataFrame, alpha: float) -> DataFrame:
    """One synchronous round: rows over the threshold give their residual away."""
    return _give(state.join(limit, "dim").withColumn("_go", _outside()), w, alpha)


#: Neighbours in one row of what a push looks up: a hub takes many rows, in as many groups.
LINKS = 1024


def links(w: DataFrame, scratch: Scratch, size: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """The weights (src, dst, w) as rows (src, chunk, to) of about ``size`` neighbours, and the directory (src, chunks) of nodes with more than one row.

    Which chunk a neighbour is in is a hash of it, so no node's neighbours are
    sorted or held in one task.
    """
    w = scratch.keep(w, "weights")
    hubs = w.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks")).where("chunks > 1")
    hubs = scratch.keep(hubs, "hubs")
    placed = w.join(hubs, "src", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("chunks")).cast("int"), F.lit(0)))
    return scratch.keep(placed.groupBy("src", "chunk").agg(F.collect_list(F.struct("dst", "w")).alias("to")), "links"), hubs


def flow(front: DataFrame, near: DataFrame, hubs: DataFrame | None, alpha: float | Column) -> DataFrame:
    """(node, dim, m): what the rows (node, dim, r) of a frontier give to each neighbour, not summed. ``alpha`` may depend on ``dim``; ``hubs`` is None where no node has a second row."""
    front = front.withColumn("chunks", F.lit(1)) if hubs is None else front.join(hubs.select(F.col("src").alias("node"), "chunks"), "node", "left")
    dealt = front.select("node", "dim", ((1 - alpha) * F.col("r")).alias("m"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("of"))
    met = dealt.join(near, (F.col("node") == F.col("src")) & (F.col("of") == F.col("chunk"))).select("dim", "m", F.explode("to").alias("t"))
    return met.select(F.col("t.dst").alias("node"), "dim", (F.col("m") * F.col("t.w")).alias("m"))


def _tools():
    """What the tasks of packed rounds share, as functions that travel with them: executors need not have this module."""

    def region_of(nodes, size):
        """``node div size``, which cuts towards zero."""
        return np.where(nodes < 0, -(-nodes // size), nodes // size)

    def above(a, b):
        """a > b as Spark has it: NaN is above all numbers."""
        return (a > b) | (np.isnan(a) & ~np.isnan(b))

    def read(row, width):
        """Nodes, degrees (0: no edges), and for each dimension which rows are there, pi and r."""
        nodes, deg = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["deg"], "<i8")
        return nodes, deg, *[np.frombuffer(row[k], t).reshape(width, -1) for k, t in (("there", "?"), ("pi", "<f8"), ("r", "<f8"))]

    def cuts(groups):
        """The runs of equal values, from and to."""
        at = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        return list(zip(at[:-1], at[1:], strict=True)) if len(groups) else []

    return region_of, above, read, cuts


def _pack(width: int):
    """One row of the wide rows (node, deg, pi0, ..., r0, ...) of a part and block of dimensions, by ascending node."""

    def run(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.take(pc.sort_indices(rows.column("node")))
        dense = lambda name: [pc.fill_null(rows.column(f"{name}{k}"), 0.0).to_numpy() for k in range(width)]
        there = np.array([rows.column(f"pi{k}").is_valid().to_numpy() for k in range(width)])
        whole = [pc.fill_null(rows.column(c), 0).to_numpy().astype("<i8") for c in ("node", "deg")]
        parts = [*whole, there, np.array(dense("pi")), np.array(dense("r"))]
        return pa.table([*[rows.column(c).slice(0, 1) for c in ("_part", "block")], *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["_part", "block", "nodes", "deg", "there", "pi", "r"])

    return run


def _unpacked(width: int, dims: list, schema):
    """The rows (node, dim, pi, r) of packed ones; those of the null part have no node."""
    _, _, read, _ = _tools()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                nodes, _, there, pi, r = read(row, width)
                for k in range(min(width, len(dims) - row["block"] * width)):
                    at = there[k]
                    if at.any():
                        n, dim = int(at.sum()), dims[row["block"] * width + k]
                        own = pa.nulls(n, pa.int64()) if row["_part"] is None else pa.array(nodes[at])
                        yield pa.RecordBatch.from_arrays([own, pa.array([dim] * n, schema.field("dim").type), pa.array(pi[k][at]), pa.array(r[k][at])], schema=schema)

    return run


def _given(width: int, rule, alpha: np.ndarray, reverse: bool):
    """What the rows of a packed state that go give: a row for each region of their nodes, one without region for each hub."""
    region_of, _, read, cuts = _tools()

    def run(batches):
        import pyarrow as pa

        names, kinds = ["_region", "node", "hub", "block", "nodes", "m", "held"], [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * 3
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                nodes, deg, there, _, r = read(row, width)
                go = there & rule(r, deg, row["block"])
                at = np.flatnonzero(go.any(0) & (deg > 0))
                own, held, ids = alpha[row["block"]][:, None], go[:, at], nodes[at]
                m = np.where(held, (1 - own) * r[:, at], 0.0)
                if not reverse:
                    m = m / np.sqrt(deg[at].astype(float))
                put = lambda region, node, hub, of: out.append((region, node, hub, row["block"], ids[of].tobytes(), m[:, of].tobytes(), held[:, of].tobytes()))  # noqa: B023, E731
                few = np.flatnonzero(deg[at] <= ROW)
                region = region_of(ids[few], REGION)
                for a, b in cuts(region):
                    put(int(region[a]), None, None, few[a:b])
                for k in np.flatnonzero(deg[at] > ROW).tolist():
                    put(None, int(ids[k]), int(deg[at[k]]), [k])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _passed(width: int, parts: int):
    """What the rows of one region give along its block, summed for each target: a row for each part of the targets."""
    region_of, _, _, cuts = _tools()

    def run(gives, blocks):
        import pyarrow as pa

        out, given = [], {}
        for row in gives.to_pylist():
            given.setdefault(row["block"], []).append(row)
        for row in blocks.to_pylist() if given else ():
            sources, counts, targets, at = (np.frombuffer(row[k], t) for k, t in (("sources", "<i8"), ("counts", "<i4"), ("targets", "<i8"), ("at", "<i4")))
            for block, rows in sorted(given.items()):
                ids = np.concatenate([np.frombuffer(g["nodes"], "<i8") for g in rows])
                m = np.concatenate([np.frombuffer(g["m"], "<f8").reshape(width, -1) for g in rows], 1)
                held = np.concatenate([np.frombuffer(g["held"], "?").reshape(width, -1) for g in rows], 1)
                place = np.minimum(np.searchsorted(sources, ids), len(sources) - 1)
                here = sources[place] == ids
                own, ours = np.zeros((width, len(sources))), np.zeros((width, len(sources)), bool)
                own[:, place[here]], ours[:, place[here]] = m[:, here], held[:, here]
                some = np.flatnonzero(ours.any(0))
                if not len(some):
                    continue
                if len(some) == len(sources):
                    to = at
                else:  # only the edges of the sources that give
                    n = counts[some].astype("i8")
                    to = at[np.repeat(np.cumsum(counts, dtype="i8")[some] - np.cumsum(n), n) + np.arange(n.sum())]
                own, ours, n = own[:, some], ours[:, some], counts[some]
                sums = np.array([np.bincount(to, np.repeat(x, n), len(targets)) for x in own])
                met = np.bincount(to, minlength=len(targets)) > 0
                came = np.array([met if x.all() else np.bincount(to[np.repeat(x, n)], minlength=len(targets)) > 0 for x in ours])
                hit = np.flatnonzero(met)
                part = region_of(targets[hit], REGION) % parts
                order = np.argsort(part, kind="stable")
                hit, part = hit[order], part[order]
                for a, b in cuts(part):
                    of = hit[a:b]
                    out.append((int(part[a]), block, row["_region"], targets[of].tobytes(), sums[:, of].tobytes(), came[:, of].tobytes()))
        cols = zip(*out, strict=True) if out else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["_part", "block", "_region", "nodes", "m", "came"])

    return run


def _next(width: int, rule, alpha: np.ndarray, reverse: bool):
    """The next packed row of a part and block of dimensions from what came, in the order of regions, with how many rows are to go and are there."""
    _, _, read, _ = _tools()

    def run(state, messages):
        import pyarrow as pa

        out, came_rows = [], sorted(messages.to_pylist(), key=lambda g: g["_region"])
        for row in state.to_pylist():
            nodes, deg, there, pi, r = read(row, width)
            go, own = there & rule(r, deg, row["block"]), alpha[row["block"]][:, None]
            pi, left = np.where(go, pi + own * r, pi), np.where(go, 0.0, r)
            m, came = np.zeros(r.shape), np.zeros(r.shape, bool)
            for g in came_rows:
                ids = np.frombuffer(g["nodes"], "<i8")
                place = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
                here = nodes[place] == ids
                m[:, place[here]] += np.frombuffer(g["m"], "<f8").reshape(width, -1)[:, here]
                came[:, place[here]] |= np.frombuffer(g["came"], "?").reshape(width, -1)[:, here]
            by = np.maximum(deg, 1).astype(float)
            r = left + np.where(came & (deg > 0), m / (by if reverse else np.sqrt(by)), 0.0)
            there = there | (came & (deg > 0))
            counts = [int((there & rule(r, deg, row["block"])).sum()), int(there.sum())]
            out.append((row["_part"], row["block"], row["nodes"], row["deg"], there.tobytes(), pi.tobytes(), r.tobytes(), *counts))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        cols = zip(*out, strict=True) if out else [[]] * 9
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["_part", "block", "nodes", "deg", "there", "pi", "r", "left", "rows"])

    return run


class _Packed:
    """A state of a loop along blocks, a row for the nodes of one part and up to ``WIDTH`` dimensions: pi, r and degrees as arrays.

    A round moves the residuals that go to their blocks, what each block gives
    to the targets of one part, summed, and the state to its parts: all in a
    few rows of arrays. Parts hold whole regions. A row is there once
    something came to it, as in the long form.
    """

    STATE = "_part long, block int, nodes binary, deg binary, there binary, pi binary, r binary"

    def __init__(self, state: DataFrame, adj: Adjacency, near: DataFrame, alpha: float | Column):
        self.spark, self.scratch, self.adj, self.near = state.sparkSession, Scratch(state.sparkSession), adj, near
        wide = _Wide(state, ["pi", "r"], adj)
        self.width, self.kind = wide.width, state.schema["dim"].dataType
        rate = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
        places = sorted(wide.places.select("_k", "dim", rate.cast("double").alias("a")).collect(), key=lambda p: p["_k"])
        self.dims = [p["dim"] for p in places]
        self.alpha = self._by_block([p["a"] for p in places], 0.0)
        self.parts = max(adj.tasks, -(-wide.rows.count() // PART_NODES))
        own = F.pmod(F.expr(f"node div {REGION}"), F.lit(self.parts)).cast("long").alias("_part")
        rows = wide.rows.select(own, "block", "node", "deg", *wide.columns("pi"), *wide.columns("r")).repartition(self.parts, "_part", "block")
        self.state = self.scratch.keep(rows.groupBy("_part", "block").applyInArrow(_pack(self.width), self.STATE), "packed")
        wide.scratch.drop("wide")
        wide.scratch.drop("rows")

    def _by_block(self, values: list[float], rest: float) -> np.ndarray:
        """One value a dimension as rows of ``width``."""
        blocks = max(1, -(-len(values) // self.width))
        return np.array([*values, *[rest] * (blocks * self.width - len(values))]).reshape(blocks, self.width)

    def by_limits(self, limit: DataFrame):
        """Which rows go, above or below the thresholds of their dimension; none where it has no threshold."""
        of = {t["dim"]: t for t in limit.collect() if t["dim"] is not None}  # one row for each dimension
        side = lambda name, none: self._by_block([none if d not in of or of[d][name] is None else of[d][name] for d in self.dims], none)
        hi, lo, above = side("hi", math.nan), side("lo", -math.inf), _tools()[1]
        return lambda r, deg, block: above(r, hi[block][:, None]) | above(lo[block][:, None], r)

    def by_degree(self, scale: float):
        """Which rows go, |(1-alpha) r| >= deg * scale."""
        alpha, above = self.alpha, _tools()[1]
        return lambda r, deg, block: (deg > 0) & ~above(deg * scale, np.abs((1 - alpha[block])[:, None] * r))

    def left(self, rule) -> int:
        width, read = self.width, _tools()[2]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for row in batch.to_pylist():
                    _, deg, there, _, r = read(row, width)
                    yield pa.RecordBatch.from_arrays([pa.array([int((there & rule(r, deg, row["block"])).sum())])], ["left"])

        return self.state.mapInArrow(run, "left long").agg(F.coalesce(F.sum("left"), F.lit(0))).first()[0]

    def push(self, rule) -> tuple[int, int]:
        """One round; how many rows are to go after it, and how many there are."""
        own = self.state.mapInArrow(_given(self.width, rule, self.alpha, self.adj.reverse), "_region long, node long, hub long, block int, nodes binary, m binary, held binary")
        region = F.when(F.col("_region").isNotNull(), F.array("_region")).otherwise(self.adj.regions("node", "hub"))
        dealt = own.select(F.explode(region).alias("_region"), "block", "nodes", "m", "held").repartition(self.adj.tasks, "_region")
        passed = dealt.groupBy("_region").cogroup(self.near.groupBy("_region")).applyInArrow(_passed(self.width, self.parts), "_part long, block int, _region long, nodes binary, m binary, came binary")
        by = ["_part", "block"]
        both = self.state.repartition(self.parts, *by).groupBy(*by).cogroup(passed.repartition(self.parts, *by).groupBy(*by))
        after, seen = both.applyInArrow(_next(self.width, rule, self.alpha, self.adj.reverse), f"{self.STATE}, left long, rows long"), Observation()
        self.state = self.scratch.replace(after.observe(seen, F.sum("left").alias("left"), F.sum("rows").alias("rows")), "packed").drop("left", "rows")
        return seen.get["left"] or 0, seen.get["rows"] or 0

    def long(self) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = StructType([StructField("node", LongType()), StructField("dim", self.kind), StructField("pi", DoubleType()), StructField("r", DoubleType())])
        return self.state.mapInArrow(_unpacked(self.width, self.dims, to_arrow_schema(schema)), schema)


class _Loop:
    """A state pushed round by round, each one job: the rows that are still to go are counted while they are written.

    A state is a base (node, dim, pi, r) and deltas, all written in the shared
    folder, so a lost executor costs its tasks only. While much of the state is
    to go, a round writes a new base. Once the frontier is a small share of it,
    a round writes a delta: the rows that gave or got, with what was added and
    what they hold now. The next frontier is among them. Deltas are folded into
    the base when together they have half as many rows. The base's residuals
    and the links stay partitioned in memory; lost blocks are read again from
    their tables. The driver holds counters. Along blocks a state of over
    ``PACKS`` rows is packed at the first round, and each round writes a base.
    """

    #: Frontiers of up to this share of the state's rows are written as deltas, and deltas are folded above this one.
    SPARSE, FOLD = 0.1, 0.5

    def __init__(self, state: DataFrame, w: DataFrame | Adjacency, side: DataFrame, key: str, alpha: float | Column, most: int):
        self.spark, self.scratch = state.sparkSession, Scratch(state.sparkSession)
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.w, self.near, self.hubs, self.deg = w, None, None, None
        self.side, self.key, self.alpha, self.most = side, key, alpha, most
        self.state, self.rounds = self.scratch.keep(state, "state"), 0
        self.deltas: list[str] = []
        self.delta_rows, self.held = 0, None
        self.packed: _Packed | None = None
        #: What each round wrote: ("base" or "delta", rows to go before it, rows written).
        self.log: list[tuple[str, int, int]] = []

    def _meet(self) -> None:
        """Make what rounds look up, at the first one: a state within its thresholds needs no links."""
        if self.near is not None:
            return
        if isinstance(self.w, Adjacency) and self.w.edges.count() <= FEW:
            self.w = (reverse_weights if self.w.reverse else weights)(self.w.edges)
        if isinstance(self.w, Adjacency):
            self.near = self.w.blocks.repartition(self.w.tasks, "_region").persist()
            if self.state.count() > PACKS:
                self.packed = _Packed(self.state, self.w, self.near, self.alpha)
                return
            self.deg = self.w.degrees.repartition(self.n, "node").persist()
        else:
            near, hubs = links(self.w, self.scratch)
            self.hubs = hubs if hubs.limit(1).count() else None
            self.near = near.repartition(self.n, "src", "chunk").persist()

    def _came(self, front: DataFrame) -> DataFrame:
        """(node, dim, m): what a frontier gives, not summed; along blocks, without the weight of who gets it."""
        if self.deg is None:
            return flow(front, self.near, self.hubs, self.alpha)
        own = front.join(self.deg, "node").select("node", "deg", "dim", self.w.gives((1 - self.alpha) * F.col("r")).alias("m"))
        return self.w.multiplied(own, "dim", ["m"], self.near)

    def _got(self, rows: DataFrame) -> DataFrame:
        """Sums (node, dim, _m, _own, ...) with ``_m`` weighted; a row that is not the state's own and lies at a node without edges is none."""
        if self.deg is None:
            return rows.withColumn("_m", F.coalesce("_m", F.lit(0.0)))
        return rows.join(self.deg, "node", "left").where("_own = 1 or deg is not null").withColumn("_m", F.coalesce(self.w.gets(F.col("_m")), F.lit(0.0))).drop("deg")

    def _forget(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held, self.deltas, self.delta_rows = None, [], 0

    def _changes(self) -> DataFrame:
        return self.spark.read.parquet(*self.deltas)

    def fold(self) -> None:
        """Add the deltas to the base."""
        if self.deltas:
            rows = self.state.unionAll(self._changes().select("node", "dim", F.col("dpi").alias("pi"), F.col("dr").alias("r")))
            self.state = self.scratch.replace(rows.groupBy("node", "dim").agg(F.sum("pi").alias("pi"), F.sum("r").alias("r")), "state")
            self._forget()

    def _front(self, go: Column) -> DataFrame:
        return self.state.join(self.side, self.key).where(go).select("node", "dim", "r")

    def _whole(self, front: DataFrame) -> DataFrame:
        """The next base."""
        gone = front.select("node", "dim", (self.alpha * F.col("r")).alias("pi"), (-F.col("r")).alias("r"), F.lit(None).cast("double").alias("_m"), F.lit(1).alias("_own"))
        came = self._came(front).select("node", "dim", F.lit(0.0).alias("pi"), F.lit(0.0).alias("r"), F.col("m").alias("_m"), F.lit(0).alias("_own"))
        rows = self.state.select("node", "dim", "pi", "r", F.lit(None).cast("double").alias("_m"), F.lit(1).alias("_own")).unionAll(gone).unionAll(came)
        rows = rows if self.deg is None else rows.repartition(self.n, "node")
        summed = rows.groupBy("node", "dim").agg(F.sum("pi").alias("pi"), F.sum("r").alias("r"), F.sum("_m").alias("_m"), F.max("_own").alias("_own"))
        return self._got(summed).select("node", "dim", "pi", (F.col("r") + F.col("_m")).alias("r"))

    def _touched(self, front: DataFrame) -> DataFrame:
        """The next delta: (node, dim, dpi, dr, r) of the rows that give or get."""
        if self.held is None:
            self.held = self.state.select("node", "dim", F.col("r").alias("_r")).repartition(self.n, "node", "dim").persist()
        none = F.lit(None).cast("double").alias("_m")
        new = front.select("node", "dim", (self.alpha * F.col("r")).alias("dpi"), (-F.col("r")).alias("dr"), none, F.lit(1).alias("new"), F.lit(1).alias("_own"))
        rows = new.unionAll(self._came(front).select("node", "dim", F.lit(0.0).alias("dpi"), F.lit(0.0).alias("dr"), F.col("m").alias("_m"), F.lit(1).alias("new"), F.lit(0).alias("_own")))
        if self.deltas:
            rows = rows.unionAll(self._changes().select("node", "dim", F.lit(0.0).alias("dpi"), "dr", none, F.lit(0).alias("new"), F.lit(1).alias("_own")))
        summed = rows.groupBy("node", "dim").agg(F.sum("dpi").alias("dpi"), F.sum(F.col("dr") * F.col("new")).alias("dr"), F.sum("dr").alias("_all"), F.sum("_m").alias("_m"), F.max("new").alias("new"), F.max("_own").alias("_own")).where("new = 1")
        met = self._got(summed).join(self.held, ["node", "dim"], "left")
        return met.select("node", "dim", "dpi", (F.col("dr") + F.col("_m")).alias("dr"), (F.coalesce("_r", F.lit(0.0)) + F.col("_all") + F.col("_m")).alias("r"))

    def _run_packed(self, left: int | None, scale: float | None) -> None:
        """``run``, packed; ``left`` rows are to go, None if it is not known."""
        rule = self.packed.by_limits(self.side) if scale is None else self.packed.by_degree(scale)
        left = self.packed.left(rule) if left is None else left
        while left:
            if self.rounds == self.most:
                raise RuntimeError(f"{left} residuals are still outside the thresholds after {self.most} rounds")
            before, (left, rows) = left, self.packed.push(rule)
            self.log.append(("base", before, rows))
            self.rounds += 1
            if self.rounds % RELEASE == 0:
                self.scratch.release()

    def run(self, go: Column, scale: float | None = None) -> None:
        """Push until no row of the state, joined to its thresholds, is one to ``go``: outside (hi, lo) of its dimension, or, with ``scale``, at ``scale`` times its degree."""
        if self.packed is not None:
            return self._run_packed(None, scale)
        self.fold()
        front, total = self._front(go), self.state.count()
        left = front.count()
        while left:
            if self.rounds == self.most:
                raise RuntimeError(f"{left} residuals are still outside the thresholds after {self.most} rounds")
            self._meet()
            if self.packed is not None:
                return self._run_packed(left, scale)
            seen, small = Observation(), left <= self.SPARSE * total
            if not small and self.deltas:
                self.fold()
                front = self._front(go)
            after = self._touched(front) if small else self._whole(front)
            marked = after.join(self.side, self.key, "left").select(*after.columns, F.coalesce(go, F.lit(False)).alias("go"))
            watched = marked.observe(seen, F.count_if("go").alias("left"), F.count(F.lit(1)).alias("rows"))
            if small:
                at = self.scratch.path("delta")
                watched.write.option("compression", "zstd").parquet(at)
                self.deltas.append(at)
                front = self.spark.read.schema(watched.schema).parquet(at).where("go").select("node", "dim", "r")
            else:
                self._forget()
                kept = self.scratch.replace(watched, "state")
                front, self.state = kept.where("go").select("node", "dim", "r"), kept.select("node", "dim", "pi", "r")
            rows = seen.get["rows"]
            self.log.append(("delta" if small else "base", left, rows))
            left, self.rounds = seen.get["left"], self.rounds + 1
            if small:
                self.delta_rows += rows
            else:
                total = rows
            if self.delta_rows > self.FOLD * total and left:
                front = self.scratch.keep(front, "front")
                self.fold()

    def close(self) -> None:
        """Give the memory back."""
        self._forget()
        for held in (self.near, self.deg):
            if held is not None:
                held.unpersist()

    def done(self) -> DataFrame:
        if self.packed is not None:
            self.state, self.packed = self.scratch.replace(self.packed.long(), "state"), None
        self.fold()
        return self.state


def push(state: DataFrame, edges: DataFrame, limit: DataFrame, params: Params = Params(), w: DataFrame | Adjacency | None = None) -> DataFrame:
    """Push until no residual is outside the thresholds; raises if ``params.max_rounds`` do not suffice."""
    limit = Scratch(state.sparkSession).keep(limit, "limits")
    loop = _Loop(state, adjacency(edges) if w is None else w, limit, "dim", params.alpha, params.max_rounds)
    try:
        loop.run(_outside())
        return loop.done()
    finally:
        loop.close()


def initial_operation(features: DataFrame, edges: DataFrame, params: Params = Params()) -> DataFrame:
    """The state of a new graph: from r = x to the tolerance."""
    return push(initial_state(features), edges, thresholds(features, params.rmax), params)


def sweep(features: DataFrame, edges: DataFrame, runs: list[tuple[float, float]], params: Params = Params()) -> DataFrame:
    """(run, node, dim, pi, r): the states of a new graph for all pairs (alpha, rmax) of ``runs``, by their places in the list.

    The runs are pushed together: a dimension of a run is a dimension of one
    state, with the thresholds and the alpha of its run, so a round is one job
    and the links are made once. A run that has reached its tolerance has no
    rows in the frontier. An empty list gives no rows.
    """
    if any(not 0 < a <= 1 for a, _ in runs):
        raise ValueError("alpha lies above 0 and is at most 1")
    top = features.agg(F.max("dim")).first()[0]
    dims = 1 if top is None else top + 1
    alphas = F.array(*[F.lit(float(a)) for a, _ in runs] or [F.lit(1.0)])
    all_runs = F.array(*[F.lit(k) for k in range(len(runs))]).cast("array<int>")
    state = features.select("node", F.explode(all_runs).alias("run"), "dim", "x").select("node", (F.col("run") * dims + F.col("dim")).cast("int").alias("dim"), F.lit(0.0).alias("pi"), F.col("x").cast("double").alias("r"))
    scratch = Scratch(features.sparkSession)
    per = scratch.keep(thresholds(features, 1.0), "sums").withColumn("run", F.explode(all_runs))
    rmax = F.get(F.array(*[F.lit(float(r)) for _, r in runs] or [F.lit(1.0)]), F.col("run"))
    limit = scratch.keep(per.select((F.col("run") * dims + F.col("dim")).cast("int").alias("dim"), (rmax * F.col("hi")).alias("hi"), (rmax * F.col("lo")).alias("lo")), "limits")
    loop = _Loop(state, adjacency(edges), limit, "dim", F.get(alphas, F.expr(f"cast(dim div {dims} as int)")), params.max_rounds)
    try:
        loop.run(_outside())
        done = loop.done()
    finally:
        loop.close()
    return done.select(F.expr(f"cast(dim div {dims} as int)").alias("run"), "node", F.expr(f"cast(dim % {dims} as int)").alias("dim"), "pi", "r")


def size_estimate(edges: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    """One row: the bytes a dense in-memory engine would hold, ((m + n) 4 + 8 n d), in GB."""
    m, n = edges.agg(F.count(F.lit(1)).alias("m")), nodes.agg(F.count(F.lit(1)).alias("n"))
    return m.crossJoin(n).select((((F.col("m") + F.col("n")) * 4 + F.col("n") * dims * 8) / (1 << 30)).alias("gb"))  # one row each


def reverse_push(edges: DataFrame, seeds: DataFrame, rho: float | DataFrame, alpha: float, rounds: int | None = None, max_rounds: int = 500, near: Adjacency | None = None) -> DataFrame:
    """(node, pi_b, r_b) from residual 1 at every seed, with weights 1/deg_dst, until no residual is over ``rho``.

    With ``rounds`` it is that many rounds that push everything. ``near`` is
    the graph's reverse adjacency, if there is one.
    """
    w = adjacency(edges, reverse=True) if near is None else near
    state = seeds.select("node").distinct().select("node", F.lit(0).alias("dim"), F.lit(0.0).alias("pi"), F.lit(1.0).alias("r"))
    if rounds is not None:
        state = push_all(state, w, alpha, rounds)
    else:
        limit = state.sparkSession.createDataFrame([(0, float(rho), -float("inf"))], "dim int, hi double, lo double")
        state = push(state, edges, limit, Params(alpha=alpha, max_rounds=max_rounds), w)
    return state.select("node", F.col("pi").alias("pi_b"), F.col("r").alias("r_b"))


def rho_of(rbmax: float, n: int) -> float:
    return rbmax / math.log(max(n, 2))


def scale_schedule(n: int, avg_degree: float, epsilon: float, lower: float, gamma: float = 1.0) -> tuple[int, list[float]]:
    """The number of walks a unit of mass stands for, and the falling scales of the push before them."""
    walks = max(1, math.ceil((2 + 2 * epsilon / 3) * math.log(max(n, 2)) / (epsilon * epsilon * lower) / gamma))
    scale = max(walks / max(n, 1), 2.0)
    factor = max(scale ** (1 / 3), 2.0)
    out = []
    while scale > 1:
        out.append(scale)
        scale = float(int(scale / factor))
    return walks, [*out, 1.0]


def push_by_degree(state: DataFrame, edges: DataFrame, walks: int, scales: list[float], params: Params) -> DataFrame:
    """The push that leaves work for walks: in units of walks, rows with |(1-alpha) r| >= deg * scale give way, scale after scale."""
    near = adjacency(edges)
    deg = near.degrees
    scaled = state.select("node", "dim", (F.col("pi") * walks).alias("pi"), (F.col("r") * walks).alias("r"))
    loop = _Loop(scaled, near, deg, "node", params.alpha, params.max_rounds)
    try:
        for scale in scales:
            loop.run(F.abs((1 - params.alpha) * F.col("r")) >= F.col("deg") * scale, scale)
        last = loop.done()
    finally:
        loop.close()
    return last.select("node", "dim", (F.col("pi") / walks).alias("pi"), (F.col("r") / walks).alias("r"))


def invariant_error(state: DataFrame, features: DataFrame, edges: DataFrame, alpha: float) -> DataFrame:
    """One row: the largest |pi + alpha r - alpha x - (1-alpha) P pi|."""
    moved = step(state.select("node", "dim", F.col("pi").alias("p")), weights(edges), "p")
    both = state.join(features, ["node", "dim"], "full").join(moved, ["node", "dim"], "full").fillna(0.0, ["pi", "r", "x", "p"])
    return both.agg(F.max(F.abs(F.col("pi") + alpha * F.col("r") - alpha * F.col("x") - (1 - alpha) * F.col("p"))).alias("error"))
