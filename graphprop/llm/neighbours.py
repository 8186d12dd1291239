"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue.

The trees are fitted on a bounded sample; every distinct vector is then filed
under its leaf in each tree. Of a few random directions a node takes that along
which its points spread most. A query walks all trees through one queue ordered
by the squared distances to the planes it has crossed, until the leaves it has
taken hold the wanted share of the vectors. That share, and the number of trees,
are the least work with which queries of the sample find ``target`` of their
exact neighbours: vectors with structure need few leaves, vectors without any
most of them. Leaf by leaf, queries and vectors meet in one group that keeps
each query's best by the exact inner product; groups are salted where a leaf
outgrows ``group_rows``, and dealt in turns where there are more queries than
``group_queries``. Equal vectors are searched once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphprop.llm.store import Scratch


@dataclass(frozen=True)
class Forest:
    """``target`` is the recall that the search is set for, on ``tried`` queries of the sample."""

    trees: int = 4
    sample_rows: int = 20_000
    leaf_rows: int = 512
    directions: int = 8
    target: float = 0.96
    tried: int = 100
    top: int = 20
    query_every: int = 20
    group_rows: int = 20_000
    group_queries: int = 100_000
    seed: int = 11


@dataclass
class Trees:
    """Planes and children of all trees; a child below 0 is the leaf ``-1 - child``. ``size`` counts sample rows of leaves."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    roots: list[int]
    size: np.ndarray

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each row in one tree."""
        node = np.full(len(x), self.roots[tree])
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            side = (np.einsum("ij,ij->i", x[live], self.normal[at]) > self.offset[at]).astype(int)
            node[live] = self.child[at, side]
            live = live[node[live] >= 0]
        return -1 - node

    def search(self, q: np.ndarray, wanted: float, trees: int | None = None) -> list[int]:
        """Leaves of the first ``trees`` trees in the order of the shared queue, until they hold ``wanted`` sample rows."""
        margin = self.normal @ q - self.offset
        queue = [(0.0, k, root) for k, root in enumerate(self.roots[:trees])]
        heapq.heapify(queue)
        found, held, tie = [], 0.0, len(queue)
        while queue and held < wanted:
            far, _, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                side = int(m > 0)
                tie += 1
                heapq.heappush(queue, (far + m * m, tie, self.child[node, 1 - side]))
                node = self.child[node, side]
            found.append(-1 - node)
            held += self.size[-1 - node]
        return found


def grow(x: np.ndarray, cfg: Forest, n_rows: int) -> Trees:
    """Split the sample at medians of random projections until leaves stand for ``leaf_rows`` of ``n_rows`` rows."""
    rng = np.random.default_rng(cfg.seed)
    least = max(2.0, cfg.leaf_rows * len(x) / max(n_rows, 1))
    normal, offset, child, size, roots = [], [], [], [], []

    def build(at: np.ndarray) -> int:
        if len(at) > least:
            drawn = rng.normal(size=(x.shape[1], cfg.directions))
            drawn /= np.linalg.norm(drawn, axis=0)
            along = x[at] @ drawn
            for j in np.argsort(-along.std(0), kind="stable"):
                w, z = drawn[:, j], along[:, j]
                cut = float(np.median(z))
                right = z > cut
                if 0 < right.sum() < len(at):
                    k = len(normal)
                    normal.append(w)
                    offset.append(cut)
                    child.append([0, 0])
                    child[k] = [build(at[~right]), build(at[right])]
                    return k
        size.append(len(at))
        return -len(size)

    for _ in range(cfg.trees):
        roots.append(build(np.arange(len(x))))
    d = x.shape[1]
    return Trees(np.array(normal).reshape(-1, d), np.array(offset), np.array(child, int).reshape(-1, 2), roots, np.array(size, float))


def tuned(trees: Trees, x: np.ndarray, n_rows: int, cfg: Forest) -> tuple[int, float]:
    """How many trees to search, and the sample rows their leaves must hold, for ``target`` at the least work.

    Where the sample is a part of all rows, its neighbours lie further off than
    a query's own, so that the recall of the search is no smaller. A single
    tree of which all leaves are taken is the exact search.
    """
    n = len(x)
    if n < 2:
        return 1, float(n)
    k = min(n - 1, max(1, -(-cfg.top * n // n_rows)))
    own = np.unique(np.linspace(0, n - 1, min(cfg.tried, n)).astype(int))
    score = x[own] @ x.T
    score[np.arange(len(own)), own] = -np.inf
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    leaf = np.stack([trees.leaves(x, t) for t in range(cfg.trees)])
    best = (1, float(n))
    for used in range(2, cfg.trees + 1):
        found = []
        for q, wanted in zip(own, near, strict=True):
            taken = trees.search(x[q], float(n), used)
            at = np.full(len(trees.size), np.inf)
            at[taken] = np.cumsum(trees.size[taken])
            found.append(at[leaf[:used, wanted]].min(0))
        work = np.sort(np.concatenate(found))[int(np.ceil(cfg.target * len(own) * k)) - 1]
        if work < best[1]:
            best = (used, float(work))
    return best


def _matrix(col: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in col]) if len(col) else np.empty((0, 0))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest scores, and of those equal to the least of them."""
    n, m = score.shape
    if m <= k:
        return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    # of a matrix product the last bits vary, so that what is as good but for them stays in
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero(score >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
    return i, j


def _exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order."""
    return np.add.reduce(a * x, 1)


_FILED = "leaf int, salt int, c long, first long, least double, vec binary"

#: Rows that ``_file`` places and gives to Spark at once: a query takes a good part of all leaves, and its vector goes to each.
SLICE = 16_384


def _slices(x: np.ndarray, ids: np.ndarray, place, size: int = SLICE):
    """(row, leaf, salt, least) of ``place(vector matrix, ids)``, a piece of the matrix after the other and at most ``size`` rows at once.

    A piece has as many vectors as the one before lets expect to fill a slice.
    """
    lo, step = 0, 1
    while lo < len(x):
        row, leaf, salt, least = place(x[lo : lo + step], ids[lo : lo + step])
        for at in range(0, len(row), size):
            own = row[at : at + size]
            yield lo + own, leaf[at : at + size], salt[at : at + size], least[own]
        lo += step
        step = max(1, min(2 * step, size * step // max(len(row), 1)))


def _file(table: DataFrame, place) -> DataFrame:
    """Rows (leaf, salt, c, first, least, vec) for each row, leaf and salt that ``place(vector matrix, ids)`` names."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            vec = pa.array([v.tobytes() for v in x], pa.binary())
            for row, leaf, salt, least in _slices(x, batch.column(0).to_numpy(), place):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(salt, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(least), vec.take(at)], ["leaf", "salt", "c", "first", "least", "vec"])

    return table.select("c", "first", "vec").mapInArrow(run, _FILED)


def _met(queries: DataFrame, filed: DataFrame, k: int) -> DataFrame:
    """Per query and vector met in some leaf, among the query's best ``k`` there and not below its ``least``: (q, c, first, score)."""

    def run(qs: pa.Table, xs: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(qs) and len(xs):
            a, x = (_matrix(t.column("vec").combine_chunks()) for t in (qs, xs))
            q, least, c, first = qs.column("c").to_numpy(), qs.column("least").to_numpy(), xs.column("c").to_numpy(), xs.column("first").to_numpy()
            step = max(1, 4_000_000 // len(x))
            for lo in range(0, len(a), step):
                i, j = _best(a[lo : lo + step] @ x.T, k)
                score = _exact(a[lo + i], x[j])
                # the best of each query by exact score, then by id
                order = np.lexsort((first[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                enough = (rank < k) & (score >= least[lo + i])
                i, j, score = i[enough], j[enough], score[enough]
                for column, values in zip(out, (q[lo + i], c[j], first[j], score), strict=True):
                    column.append(values)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.Table.from_arrays([pa.array(np.concatenate(v) if v else np.empty(0, t)) for v, t in zip(out, kinds, strict=True)], ["q", "c", "first", "score"])

    return queries.groupBy("leaf", "salt").cogroup(filed.groupBy("leaf", "salt")).applyInArrow(run, "q long, c long, first long, score double")


def nearest(embeddings: DataFrame, cfg: Forest = Forest(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query and neighbour: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``query_every``, candidates
    all rows but the query's own; scores are inner products in double precision,
    ties go to the smaller id, and with fewer candidates than ``top`` all are
    returned. Vectors that are null, zero, of another length than most (of
    equally common lengths the longest), or hold nulls or non-finite components
    take no part, nor do rows without an id; rows that repeat an id and vector
    count once. Empty tables give empty results. Other columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    v = F.col("vec")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    common = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size(v) == common["d"]).withColumn("k1", F.xxhash64(v)).withColumn("k2", F.xxhash64(F.lit(17), v))
    own = scratch.keep(rows.select("vec_id", "k1", "k2").distinct(), "ids")
    firsts = own.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.max((F.col("vec_id") % cfg.query_every == 0).cast("int")).alias("asks"))
    distinct = rows.join(firsts, ["k1", "k2"]).where("vec_id = first").dropDuplicates(["k1", "k2"])
    table = scratch.keep(distinct.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "first", "asks", "vec"), "distinct")
    n = table.count()
    sample = table.orderBy("k1", "k2").limit(cfg.sample_rows).select("vec").toArrow()
    points = sample.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)
    trees = grow(points, cfg, n)
    scale = n / len(points)
    salts = np.maximum(1, np.ceil(trees.size * scale / cfg.group_rows)).astype(int)
    n_trees, wanted = tuned(trees, points, n, cfg)
    turns = max(1, -(-table.where("asks = 1").count() // cfg.group_queries))

    k = cfg.top + 1  # a query's own vector may be among them

    def by_tree(x: np.ndarray, ids: np.ndarray):
        leaf = np.concatenate([trees.leaves(x, t) for t in range(n_trees)])
        salt = np.tile(ids, n_trees) % salts[leaf] * turns
        return np.tile(np.arange(len(x)), n_trees * turns), np.tile(leaf, turns), np.concatenate([salt + t for t in range(turns)]), np.zeros(len(x))

    filed_points = np.stack([trees.leaves(points, t) for t in range(n_trees)], 1)

    def by_queue(x: np.ndarray, ids: np.ndarray):
        row, leaf, least = [], [], np.full(len(x), -np.inf)
        for i in range(len(x)):
            taken = np.array(trees.search(x[i], wanted, n_trees))
            row.append(np.full(len(taken), i))
            leaf.append(taken)
            # what is not among the best of the sample's points in these leaves is not among the best of all in them
            visited = np.zeros(len(salts), bool)
            visited[taken] = True
            score = points[visited[filed_points].any(1)] @ x[i]  # a bound, lowered below
            if len(score) >= k:
                kth = np.partition(score, len(score) - k)[len(score) - k]
                least[i] = kth - 1e-9 * max(1.0, abs(kth))
        row, leaf = np.concatenate(row), np.concatenate(leaf)
        times = salts[leaf]
        salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(row, times)
        return row, np.repeat(leaf, times), salt * turns + ids[row] % turns, least

    met = _met(_file(table.where("asks = 1"), by_queue), _file(table, by_tree), k)
    merged = met.groupBy("q", "c", "first").agg(F.max("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "c"))).where(F.col("r") <= k).select("q", "c", "score")
    best = scratch.keep(best, "best")
    # the smallest ids of each distinct vector; no query needs more of one
    in_class = own.join(table.select("c", "k1", "k2"), ["k1", "k2"]).select("c", "vec_id")
    few = in_class.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("vec_id"))).where(F.col("r") <= k).select("c", "vec_id")
    listed = best.join(few, "c").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k).select("q", "vec_id", "score")
    asking = in_class.where(F.col("vec_id") % cfg.query_every == 0).select(F.col("c").alias("q"), F.col("vec_id").alias("query_id"))
    pairs = asking.join(listed, "q").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= cfg.top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
