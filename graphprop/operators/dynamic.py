"""Updates of an evolving graph: toggles, and the repair of (pi, r) they call for.

An update file lists directed pairs; each listing toggles an edge, so of a
pair's listings only the parity counts. Repair touches the affected nodes and
the toggled edges, never the rest of a neighbourhood.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphprop.operators.etl import degree
from graphprop.operators.propagate import over, push, thresholds
from graphprop.session import Params
from graphprop.tables import Scratch, listed


def toggles(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """(src, dst, op): +1 for an insertion, -1 for a deletion, of the pairs listed an odd number of times."""
    odd = updates.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select("src", "dst")
    # written first, so that its size is known and the edges stay where they are if it is small
    odd = Scratch(edges.sparkSession).keep(odd, "odd")
    have = edges.select("src", "dst").join(listed(odd), ["src", "dst"], "left_semi").distinct().withColumn("_e", F.lit(-1))
    return odd.join(have, ["src", "dst"], "left").select("src", "dst", F.coalesce("_e", F.lit(1)).alias("op"))


def affected(updates: DataFrame) -> DataFrame:
    """Every source of the file, also of pairs that cancel."""
    return updates.select(F.col("src").alias("node")).distinct()


def apply(edges: DataFrame, toggle: DataFrame) -> DataFrame:
    """The graph after the toggles."""
    kept = edges.select("src", "dst").distinct().join(listed(toggle.where("op = -1")).select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.union(toggle.where("op = 1").select("src", "dst"))


def degrees(edges: DataFrame, toggle: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, deg, new_deg) of ``nodes``: the change is the sum of the toggles."""
    change = toggle.groupBy(F.col("src").alias("node")).agg(F.sum("op").alias("_c"))
    # counting all edges moves a row for each node, keeping those of many nodes would move the edges
    return nodes.join(degree(edges), "node", "left").join(change, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), (F.coalesce("deg", F.lit(0)) + F.coalesce("_c", F.lit(0))).cast("long").alias("new_deg"))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def rescale(state: DataFrame, deg: DataFrame, alpha: float) -> DataFrame:
    """pi scaled to the new degree, so that neighbours keep their equations, and the first residual correction.

    A node of old degree 0 has no scale to change; one of new degree 0 keeps
    its values.
    """
    s, t = F.sqrt(F.col("deg").cast("double")), F.sqrt(F.col("new_deg").cast("double"))
    joined = state.join(deg, "node", "left")
    live = F.col("deg").isNotNull() & (F.col("deg") > 0) & (F.col("new_deg") > 0)
    pi = F.when(live, F.col("pi") * _ratio(t, s)).otherwise(F.col("pi"))
    r = F.when(live, F.col("r") + pi * _ratio(s - t, alpha * t)).otherwise(F.col("r"))
    return joined.select("node", "dim", pi.alias("pi"), r.alias("r"))


def repair(rescaled: DataFrame, features: DataFrame, deg: DataFrame, toggle: DataFrame, all_deg: DataFrame, alpha: float) -> DataFrame:
    """The second residual correction, from the toggled edges.

    ``all_deg`` (node, deg) are the degrees after the batch; pi is that of all
    nodes after ``rescale``.
    """
    # read twice, and mostly counted from all edges after the batch
    all_deg = Scratch(rescaled.sparkSession).keep(all_deg.select("node", "deg"), "degrees")
    ends = toggle.join(all_deg.select(F.col("node").alias("src"), F.col("deg").cast("double").alias("_s")), "src").join(all_deg.select(F.col("node").alias("dst"), F.col("deg").cast("double").alias("_d")), "dst", "left")
    # a neighbour that a deletion left without edges keeps the degree it was rescaled by
    old = deg.select(F.col("node").alias("dst"), F.col("deg").cast("double").alias("_o"))
    ends = ends.join(old, "dst", "left").withColumn("_d", F.when(F.coalesce(F.col("_d"), F.lit(0.0)) > 0, F.col("_d")).otherwise(F.col("_o")))
    pi = rescaled.select(F.col("node").alias("dst"), "dim", F.col("pi").alias("_p"))
    flow = ends.join(pi, "dst").groupBy(F.col("src").alias("node"), "dim").agg(F.sum(F.col("op") * _ratio(F.col("_p"), F.sqrt(F.col("_s") * F.col("_d")))).alias("_f"))
    s, t = F.sqrt(F.col("deg").cast("double")), F.sqrt(F.col("new_deg").cast("double"))
    # only rows of affected nodes meet features and flows; the others stay where they are
    hit, marked = deg.select("node").distinct(), F.col("new_deg") > 0
    mine = rescaled.join(deg, "node").join(features.join(hit, "node", "left_semi"), ["node", "dim"], "left").join(flow, ["node", "dim"], "left")
    x, f = F.coalesce("x", F.lit(0.0)), F.coalesce("_f", F.lit(0.0))
    change = (F.col("pi") + alpha * F.col("r") - alpha * x) * _ratio(s - t, t) + (1 - alpha) * f
    mended = mine.select("node", "dim", "pi", F.when(marked, F.col("r") + change / alpha).otherwise(F.col("r")).alias("r"))
    return rescaled.join(hit, "node", "left_anti").select("node", "dim", "pi", "r").unionAll(mended)


def candidates(state: DataFrame, nodes: DataFrame, limit: DataFrame) -> DataFrame:
    """Affected rows outside the thresholds; dimensions without one prune themselves."""
    return over(state.join(nodes, "node", "left_semi"), limit)


@dataclass
class Graph:
    """A graph, its features and its state; an update returns the next one."""

    edges: DataFrame
    features: DataFrame
    state: DataFrame

    def repaired(self, updates: DataFrame, params: Params) -> tuple[Graph, DataFrame]:
        """The graph after the batch with the invariant restored, and the affected nodes; nothing is pushed yet."""
        scratch = Scratch(self.edges.sparkSession)
        toggle, nodes = scratch.keep(toggles(self.edges, updates), "toggles"), scratch.keep(affected(updates), "affected")
        after = scratch.keep(apply(self.edges, toggle), "edges")
        deg = scratch.keep(degrees(self.edges, toggle, nodes), "degrees")
        scaled = rescale(self.state, deg, params.alpha)
        return Graph(after, self.features, repair(scaled, self.features, deg, toggle, degree(after), params.alpha)), nodes

    def update(self, updates: DataFrame, params: Params = Params()) -> Graph:
        """The batch update: repair, then push to the tolerance."""
        after, _ = self.repaired(updates, params)
        return Graph(after.edges, self.features, push(after.state, after.edges, thresholds(self.features, params.rmax), params))


def _single_toggles(updates: DataFrame, first: int, last: int):
    """For each line ``first < seq <= last``: seq and the undirected toggle (src, dst); a line that reverses the one before belongs to it.

    The lines are sorted once and fetched partition after partition.
    """
    before = None
    for r in updates.where((F.col("seq") > first) & (F.col("seq") <= last)).select("seq", "src", "dst").orderBy("seq").toLocalIterator():
        if r.src == r.dst:
            raise ValueError("self loops cannot be toggled one at a time")
        if before == (r.dst, r.src):
            before = None
            continue
        before = (r.src, r.dst)
        yield r.seq, updates.sparkSession.createDataFrame([(r.src, r.dst), (r.dst, r.src)], "src long, dst long")


def update_one_by_one(graph: Graph, updates: DataFrame, first: int, last: int, params: Params = Params()) -> Graph:
    """The edges of lines ``first < seq <= last`` one at a time, in their order: a batch each.

    Sequential by nature: for streams of single edges and for tests. Toggles of
    self loops are rejected.
    """
    for _, pair in _single_toggles(updates, first, last):
        graph = graph.update(pair, params)
    return graph


def repush(graph: Graph, params: Params = Params()) -> Graph:
    """Push whatever is over the thresholds anywhere."""
    return Graph(graph.edges, graph.features, push(graph.state, graph.edges, thresholds(graph.features, params.rmax), params))


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the Frobenius distance of two (node, dim, pi) tables."""
    both = a.select("node", "dim", F.col("pi").alias("_a")).join(b.select("node", "dim", F.col("pi").alias("_b")), ["node", "dim"], "full").fillna(0.0, ["_a", "_b"])
    return both.agg(F.sqrt(F.coalesce(F.sum((F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))), F.lit(0.0))).alias("d"))


def drift(versions: DataFrame) -> DataFrame:
    """(t, drift) from (t, node, dim, pi): |Z_t - Z_{t-1}| / |Z_t - Z_0|, null where the latter is 0."""
    own = Window.partitionBy("node", "dim").orderBy("t")
    z = versions.withColumn("_prev", F.lag("pi").over(own)).withColumn("_first", F.first("pi").over(own)).where("_prev is not null")
    sums = z.groupBy("t").agg(F.sqrt(F.sum((F.col("pi") - F.col("_prev")) * (F.col("pi") - F.col("_prev")))).alias("a"), F.sqrt(F.sum((F.col("pi") - F.col("_first")) * (F.col("pi") - F.col("_first")))).alias("b"))
    return sums.select("t", F.expr("try_divide(a, b)").alias("drift"))


def update_until_drift(graph: Graph, updates: DataFrame, first: int, last: int, threshold: float, params: Params = Params()) -> tuple[Graph, int]:
    """Lines one at a time until a step's drift exceeds ``threshold``; the graph and the last line applied."""
    start = graph.state
    begun = False
    for seq, pair in _single_toggles(updates, first, last):
        after = graph.update(pair, params)
        step, whole = distance(after.state, graph.state).first()["d"], distance(after.state, start).first()["d"]
        graph = after
        if begun and whole and step / whole > threshold:
            return graph, seq
        begun = True
    return graph, last
