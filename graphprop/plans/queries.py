"""Queries over the driver's tables, one for each operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprop.functions import fixed
from graphprop.operators import dynamic, etl, features, metrics, monitor, propagate, walks
from graphprop.plans.fixtures import ALPHA, HEAD, Fixture, drawn, push_steps, stopping_walks, threshold_rounds, threshold_steps
from graphprop.plans.fixtures import fixed as fx
from graphprop.session import Params
from graphprop.tables import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RMAX = 1e-3


def query(sql: str | None = None) -> Callable[[Callable[[Fixture], DataFrame]], Query]:
    """Register a query under its function's name; ``sql`` follows the fixture's CTEs."""

    def register(f: Callable[[Fixture], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Fixture(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = HEAD + sql
        return run

    return register


# ---- graph ETL ---------------------------------------------------------------


@query("SELECT src, dst FROM und")
def symmetrize(f: Fixture) -> DataFrame:
    return etl.symmetrize(f.pairs())


@query("SELECT src, dst FROM e WHERE (src + 2 * dst) % 3 = 0")
def edge_mask(f: Fixture) -> DataFrame:
    return etl.mask(f.graph(), (F.col("src") + 2 * F.col("dst")) % 3 == 0)


@query("SELECT src, dst FROM pair")
def upper_triangle(f: Fixture) -> DataFrame:
    return etl.upper_triangle(f.graph())


_HELD = "(src % 7 = 0 OR dst % 7 = 0)"


@query(f"SELECT src, dst FROM und WHERE NOT {_HELD}")
def holdout_kept(f: Fixture) -> DataFrame:
    return etl.hold_out(f.graph(), f.nodes().where("node % 7 = 0"))[0]


@query(f"SELECT src, dst FROM pair WHERE {_HELD}")
def holdout_split(f: Fixture) -> DataFrame:
    return etl.hold_out(f.graph(), f.nodes().where("node % 7 = 0"))[1]


@query("SELECT src, dst FROM e")
def self_loops(f: Fixture) -> DataFrame:
    return etl.add_self_loops(f.graph(loops=False), f.nodes())


@query("SELECT src, dst FROM und")
def drop_self_loops(f: Fixture) -> DataFrame:
    return etl.drop_self_loops(f.graph())


_PERMUTED = "(src * 2654435761 + dst * 40503 + 7) % 1000003"


@query(
    f""", n AS (SELECT src, dst, row_number() OVER (ORDER BY {_PERMUTED}, src, dst) - 1 AS seq, count(*) OVER () // 5 AS size FROM later)
SELECT CAST(seq // size AS INTEGER) AS batch, CAST(seq AS BIGINT) AS seq, src, dst FROM n WHERE seq // size < 5"""
)
def batches_disjoint(f: Fixture) -> DataFrame:
    return etl.batches(f.later(), 5).select("batch", "seq", "src", "dst")


@query("SELECT CAST(t AS INTEGER) AS batch, src, dst FROM later, range(4) r(t) WHERE batch <= t")
def batches_cumulative(f: Fixture) -> DataFrame:
    return etl.cumulative(f.later(), 4)


@query("SELECT batch, src, dst FROM later")
def batches_to_disjoint(f: Fixture) -> DataFrame:
    return etl.to_disjoint(etl.cumulative(f.later(), 4))


@query(f"SELECT src, dst, {_PERMUTED} AS k FROM later")
def permutation_key(f: Fixture) -> DataFrame:
    return f.later().select("src", "dst", etl.hash_order(F.col("src"), F.col("dst"), 7).alias("k"))


@query("SELECT src, dst FROM pair WHERE y < 2000 UNION ALL SELECT dst, src FROM pair WHERE y < 2000")
def snapshot_union(f: Fixture) -> DataFrame:
    p = f.pairs()
    return etl.snapshot(f.initial(p, loops=False), f.later(p), 1)


@query(
    """, ever AS (SELECT 0 AS b, src, dst FROM ip UNION ALL SELECT batch, src, dst FROM later), way AS (SELECT b, src, dst FROM ever UNION ALL SELECT b, dst, src FROM ever)
SELECT CAST(t AS INTEGER) AS t, src AS node, count(*) AS deg FROM way, range(4) r(t) WHERE b <= t GROUP BY t, src"""
)
def snapshot_degrees(f: Fixture) -> DataFrame:
    p = f.pairs()
    return etl.degrees_over_time(etl.intervals(p.where("y < 1999").select("src", "dst"), f.later(p)), 4)


_GONE = "(src * 31 + dst * 17) % 97 = 0"
_TOGGLED = f""", ev AS (SELECT 0 AS t, src, dst FROM ip UNION ALL SELECT batch, src, dst FROM later UNION ALL SELECT 1, src, dst FROM ip WHERE {_GONE} UNION ALL SELECT 3, src, dst FROM ip WHERE {_GONE} AND src % 2 = 0),
iv AS MATERIALIZED (SELECT src, dst, t AS start, lead(t) OVER w AS stop, row_number() OVER w AS k FROM ev WINDOW w AS (PARTITION BY src, dst ORDER BY t))"""


def _toggled(f: Fixture) -> DataFrame:
    """Intervals of a series with insertions, deletions and edges that come back."""
    p = f.kept_pairs()
    come = f.later(p).select(F.col("batch").alias("t"), "src", "dst")
    gone = p.where((F.col("y") < 1999) & ((F.col("src") * 31 + F.col("dst") * 17) % 97 == 0))
    back = gone.where("src % 2 = 0")
    one = come.unionAll(gone.select(F.lit(1), "src", "dst")).unionAll(back.select(F.lit(3), "src", "dst"))
    return etl.toggled_intervals(p.where("y < 1999").select("src", "dst"), one.unionAll(one.select("t", F.col("dst"), F.col("src"))))


@query(_TOGGLED + " SELECT src, dst, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM iv WHERE k % 2 = 1")
def edge_intervals(f: Fixture) -> DataFrame:
    """When each edge of the series is there, each time once."""
    return _toggled(f)


@query(
    _TOGGLED
    + """, wy AS (SELECT src, dst, start, stop FROM iv WHERE k % 2 = 1 UNION ALL SELECT dst, src, start, stop FROM iv WHERE k % 2 = 1)
SELECT CAST(t AS INTEGER) AS t, src AS node, count(*) AS deg FROM wy, range(4) r(t) WHERE start <= t AND (stop IS NULL OR stop > t) GROUP BY t, src"""
)
def toggled_degrees(f: Fixture) -> DataFrame:
    """Degrees over time, deletions included."""
    return etl.degrees_over_time(_toggled(f), 4)


@query(
    """, t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders), n AS (SELECT t, (row_number() OVER (ORDER BY t) - 1) // 30 AS bucket FROM t)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders JOIN n ON n.t = CAST(o_orderdate AS DATE) GROUP BY bucket"""
)
def time_buckets(f: Fixture) -> DataFrame:
    o = f.table("orders").select(F.to_date("o_orderdate").alias("t"), "o_custkey")
    return etl.bucket_times(o, 30).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


@query("SELECT src, dst, 1.0::DOUBLE AS value FROM und")
def adjacency_binary(f: Fixture) -> DataFrame:
    return etl.adjacency(f.pairs())


@query("SELECT p_partkey AS node, CAST(row_number() OVER (ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_partkey) - 1 AS BIGINT) AS new_id FROM part")
def reindex_labelled_first(f: Fixture) -> DataFrame:
    return etl.reindex_labelled_first(f.nodes(), f.table("part").where("p_size > 25").select(F.col("p_partkey").alias("node")))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS t FROM orders")
def year_extract(f: Fixture) -> DataFrame:
    date = F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.dayofmonth("o_orderdate")
    return f.table("orders").select("o_orderkey", etl.year_of(date).alias("t"))


@query("SELECT node, y FROM cls")
def label_encode(f: Fixture) -> DataFrame:
    return f.classes()


@query(
    """, k AS (SELECT node, y, row_number() OVER (PARTITION BY y ORDER BY (node * 2654435761 + 7) % 1000003, node) / CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS s FROM cls)
SELECT node, y, CASE WHEN s <= 0.4 THEN 'train' WHEN s <= 0.4 + 0.2 THEN 'val' ELSE 'test' END AS split FROM k"""
)
def stratified_split(f: Fixture) -> DataFrame:
    return etl.stratified_split(f.classes(), 0.4, 0.2)


@query(
    f""", st AS (SELECT y AS t, row_number() OVER (ORDER BY y) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT y FROM pair)),
j AS (SELECT pair.y AS t, src, dst, k < ceil(n * 0.7) AS train FROM pair JOIN st ON st.t = pair.y),
l AS (SELECT t, src, dst, row_number() OVER (ORDER BY {_PERMUTED}, src, dst, t) - 1 AS r FROM j WHERE NOT train), tot AS (SELECT count(*) AS n FROM pair)
SELECT t, src, dst, 'train' AS split FROM j WHERE train
UNION ALL SELECT t, src, dst, CASE WHEN r < floor(n * 0.1) THEN 'val' ELSE 'test' END FROM l, tot WHERE r < floor(n * 0.1) + floor(n * 0.2)"""
)
def temporal_split(f: Fixture) -> DataFrame:
    return etl.temporal_split(f.kept_pairs().select(F.col("y").alias("t"), "src", "dst"))


@query("SELECT node, deg FROM deg")
def degree(f: Fixture) -> DataFrame:
    return etl.degree(f.graph())


_DIRECTED = ", o AS (SELECT src AS node, count(*) AS n FROM pair GROUP BY src), i AS (SELECT dst AS node, count(*) AS n FROM pair GROUP BY dst)"


@query(
    _DIRECTED
    + """, b AS (SELECT node.node, coalesce(o.n, 0) AS o, coalesce(i.n, 0) AS i FROM node LEFT JOIN o ON o.node = node.node LEFT JOIN i ON i.node = node.node)
SELECT count(*) AS n_nodes, CAST(sum(o) AS BIGINT) AS n_edges, min(node) AS min_id, max(node) AS max_id, max(o) AS max_out, max(i) AS max_in,
  CAST(count(*) FILTER (o = 0) AS BIGINT) AS dead_ends, CAST(count(*) FILTER (o = 0 AND i = 0) AS BIGINT) AS isolated FROM b"""
)
def graph_stats(f: Fixture) -> DataFrame:
    return etl.graph_statistics(f.pairs().select("src", "dst"), f.nodes())


@query("SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT) AS pos, dst FROM e")
def neighbour_positions(f: Fixture) -> DataFrame:
    return etl.positions(f.graph())


@query("SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY deg, dst) - 1 AS BIGINT) AS pos, dst FROM e JOIN deg ON deg.node = e.dst")
def degree_sorted_adj(f: Fixture) -> DataFrame:
    return etl.positions(f.graph(f.kept_pairs()), by_degree=True, symmetric=True)


@query(_DIRECTED + ", b AS (SELECT node.node, coalesce(o.n, 0) AS deg FROM node LEFT JOIN o ON o.node = node.node) SELECT node, CAST(sum(deg) OVER (ORDER BY node) - deg AS BIGINT) AS start, CAST(deg AS BIGINT) AS deg FROM b")
def csr_indptr(f: Fixture) -> DataFrame:
    return etl.csr(f.pairs(), f.nodes())


_DEAD = "NOT EXISTS (SELECT 1 FROM pair WHERE pair.src = node.node)"


@query(f"SELECT node FROM node WHERE {_DEAD}")
def dead_ends(f: Fixture) -> DataFrame:
    return etl.dead_ends(f.pairs(), f.nodes())


@query(f"SELECT src, dst FROM pair UNION ALL SELECT node, -1 FROM node WHERE {_DEAD}")
def fill_dead_ends(f: Fixture) -> DataFrame:
    return etl.fill_dead_ends(f.pairs(), f.nodes(), F.lit(-1))


@query("SELECT src, CASE WHEN dst % 11 = 0 THEN -1 ELSE dst END AS dst, dst AS was FROM e")
def redirect_edges(f: Fixture) -> DataFrame:
    return etl.redirect(f.graph(), f.nodes().where("node % 11 = 0"), F.lit(-1))


@query("SELECT src, dst FROM e")
def restore_edges(f: Fixture) -> DataFrame:
    return etl.restore(etl.redirect(f.graph(), f.nodes().where("node % 11 = 0"), F.lit(-1)))


@query("SELECT p.src, p.dst, CASE WHEN p.y < 1999 THEN -1 ELSE 1 END AS present FROM pair p")
def edge_exists(f: Fixture) -> DataFrame:
    p = f.pairs()
    return etl.edge_exists(p.select("src", "dst"), f.initial(p))


@query("SELECT src, dst FROM ip UNION SELECT src, dst FROM later")
def insert_edges(f: Fixture) -> DataFrame:
    p = f.pairs()
    return etl.insert(p.where("y < 1999"), p)


@query("SELECT src, dst FROM ip")
def delete_edges(f: Fixture) -> DataFrame:
    p = f.pairs()
    return etl.delete(p.select("src", "dst"), f.later(p))


_WALK = f""", fe AS (SELECT src, dst FROM pair UNION ALL SELECT node, -1 FROM node WHERE {_DEAD}), fd AS (SELECT src, count(*) AS deg FROM fe GROUP BY src)
"""


@query(_WALK + "SELECT fe.src, CAST(row_number() OVER (PARTITION BY fe.src ORDER BY dst) - 1 AS BIGINT) AS pos, dst, deg FROM fe JOIN fd ON fd.src = fe.src")
def walk_graph(f: Fixture) -> DataFrame:
    return etl.walk_graph(f.kept_pairs().select("src", "dst"), f.nodes(), -1)


@query(_WALK + "SELECT dst, src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS BIGINT) AS pos FROM fe")
def reverse_index(f: Fixture) -> DataFrame:
    return etl.reverse_index(etl.walk_graph(f.kept_pairs().select("src", "dst"), f.nodes(), -1))


@query(
    """, c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), m AS (SELECT max(user_id) + 1 AS b FROM events)
SELECT user_id AS src, CAST(b + i AS BIGINT) AS dst, count(*) AS n, CAST(sum(CASE WHEN events.event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM events JOIN c ON c.event_type = events.event_type, m GROUP BY 1, 2"""
)
def events_interaction_graph(f: Fixture) -> DataFrame:
    e = f.table("events").select(F.col("user_id").alias("user"), F.col("event_type").alias("item"), F.col("ts").alias("t"), (F.col("event_type") == "error").cast("int").alias("label"))
    return etl.interactions(e).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad"))


# ---- features ----------------------------------------------------------------


@query(f"SELECT node, dim, {fx('x')} AS x FROM feat")
def standardize(f: Fixture) -> DataFrame:
    return f.features().select("node", "dim", fixed(F.col("x")).alias("x"))


@query(
    f""", ev AS (SELECT CAST(ts AS DATE) AS t, event_id AS node, value AS x FROM events), s AS (SELECT t, avg(x) AS m, stddev_pop(x) AS sd FROM ev GROUP BY t)
SELECT node, {fx('(x - m) / coalesce(nullif(sd, 0), 1)', 5)} AS x FROM ev JOIN s ON s.t = ev.t"""
)
def standardize_by_time(f: Fixture) -> DataFrame:
    e = f.table("events").select(F.to_date("ts").alias("t"), F.col("event_id").alias("node"), F.lit(0).alias("dim"), F.col("value").alias("x"))
    return features.standardize(e, ("t",)).select("node", fixed(F.col("x"), 5).alias("x"))


_WIDE = ", em AS (SELECT vec_id AS node, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i))"


@query(_WIDE + f", n AS (SELECT node, sqrt(sum(x * x)) AS n FROM em GROUP BY node) SELECT em.node, dim, {fx('x / coalesce(nullif(n, 0), 1)')} AS x FROM em JOIN n ON n.node = em.node")
def l2_normalize(f: Fixture) -> DataFrame:
    return features.l2_normalize(f.wide()).select("node", "dim", fixed(F.col("x")).alias("x"))


@query(_WIDE + f" SELECT dim, {fx('sum(abs(x))', 4)} AS l1 FROM em GROUP BY dim")
def l1_norm(f: Fixture) -> DataFrame:
    return features.l1_norm(f.wide()).select("dim", fixed(F.col("l1"), 4).alias("l1"))


@query(f"SELECT dim, {fx('sum(CASE WHEN x > 0 THEN x ELSE 0 END)', 4)} AS pos, {fx('sum(CASE WHEN x < 0 THEN x ELSE 0 END)', 4)} AS neg FROM feat GROUP BY dim")
def column_sums_signed(f: Fixture) -> DataFrame:
    return features.column_sums(f.features()).select("dim", fixed(F.col("pos"), 4).alias("pos"), fixed(F.col("neg"), 4).alias("neg"))


@query(
    f""", a AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM node), b AS (SELECT node AS src, row_number() OVER (ORDER BY (node * 2654435761 + 40503 + 7) % 1000003, node) AS k FROM node)
SELECT a.node, dim, {fx('x')} AS x FROM feat JOIN b ON b.src = feat.node JOIN a ON a.k = b.k"""
)
def permute_rows(f: Fixture) -> DataFrame:
    return features.permute_rows(f.features()).select("node", "dim", fixed(F.col("x")).alias("x"))


@query(f", g AS (SELECT d FROM range(4) r(d) ORDER BY (d * 2654435761 + 7) % 1000003, d LIMIT 2) SELECT node, dim, CASE WHEN dim IN (SELECT d FROM g) THEN 0 ELSE {fx('x')} END AS x FROM feat")
def drop_columns(f: Fixture) -> DataFrame:
    return features.drop_columns(f.features(), 4, 0.5).select("node", "dim", fixed(F.col("x")).alias("x"))


@query(f", k AS (SELECT node, row_number() OVER (ORDER BY CASE WHEN node % 3 = 0 THEN 0 ELSE 1 END, node) - 1 AS id FROM node) SELECT CAST(id AS BIGINT) AS node, dim, {fx('x')} AS x FROM feat JOIN k ON k.node = feat.node")
def copy_rows(f: Fixture) -> DataFrame:
    m = etl.reindex_labelled_first(f.nodes(), f.nodes().where("node % 3 = 0"))
    return features.copy_rows(f.features(), m).select("node", "dim", fixed(F.col("x")).alias("x"))


@query(
    f""", kept AS (SELECT * FROM feat WHERE node NOT IN (SELECT node FROM aff)), chg AS (SELECT * FROM feat WHERE node IN (SELECT node FROM aff))
SELECT node, dim, {fx('x')} AS x, 1 AS label FROM feat UNION ALL SELECT node, dim, {fx('x')}, 1 FROM kept UNION ALL SELECT node, dim, {fx('x')}, 0 FROM chg"""
)
def contrastive_set(f: Fixture) -> DataFrame:
    x = f.features()
    kept, changed = monitor.partition(x, dynamic.affected(f.updates()))
    return features.contrastive_set(x, kept, changed).select("node", "dim", fixed(F.col("x")).alias("x"), "label")


@query(_WIDE + f" SELECT node, dim, {fx('x')} AS x FROM em")
def pack_unpack(f: Fixture) -> DataFrame:
    return features.unpacked(features.packed(f.wide())).select("node", "dim", fixed(F.col("x")).alias("x"))


# ---- propagation -------------------------------------------------------------


def _steps(k: int, rest: str, **kw) -> str:
    return ", " + push_steps(k, **kw) + rest


@query(", h0 AS (SELECT node, dim, 0.1 * x AS x FROM feat)" + "".join(f", h{i} AS (SELECT b.node, b.dim, b.x + 0.9 * coalesce(m, 0) AS x FROM h0 b LEFT JOIN (SELECT w.dst AS node, dim, sum(x * w) AS m FROM h{i - 1} h JOIN w ON w.src = h.node GROUP BY w.dst, dim) t ON t.node = b.node AND t.dim = b.dim)" for i in range(1, 5)) + f" SELECT node, dim, {fx('x')} AS x FROM h4")
def propagate_k(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    return propagate.propagate(f.features(), f.graph(p), 4, ALPHA).select("node", "dim", fixed(F.col("x")).alias("x"))


@query(", x0 AS (SELECT node, x FROM feat WHERE dim = 0), h0 AS (SELECT node, 0.1 * x AS x FROM x0)" + "".join(f", h{i} AS (SELECT b.node, b.x + 0.9 * coalesce(m, 0) AS x FROM h0 b LEFT JOIN (SELECT w.dst AS node, sum(x * w) AS m FROM h{i - 1} h JOIN w ON w.src = h.node GROUP BY w.dst) t ON t.node = b.node)" for i in range(1, 5)) + f" SELECT node, {fx('x')} AS x FROM h4 ORDER BY h4.x DESC, node LIMIT 10")
def top_propagated(f: Fixture) -> DataFrame:
    """The ten nodes of largest propagated size: a top-k report."""
    p = f.kept_pairs()
    h = propagate.propagate(f.features().where("dim = 0"), f.graph(p), 4, ALPHA)
    return h.orderBy(F.desc("x"), "node").limit(10).select("node", fixed(F.col("x")).alias("x"))


@query(_steps(3, f" SELECT node, dim, {fx('pi')} AS pi, {fx('r')} AS r FROM s3"))
def push_fixed_k(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    return propagate.push_all(propagate.initial_state(f.features()), propagate.adjacency(f.initial(p)), ALPHA, 3).select("node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


@query(_steps(3, f" SELECT dim, {fx('sum(abs(r))', 3)} AS l1, {fx('max(abs(r))')} AS linf FROM s3 GROUP BY dim"))
def residual_norms(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    s = propagate.push_all(propagate.initial_state(f.features()), propagate.adjacency(f.initial(p)), ALPHA, 3)
    return s.groupBy("dim").agg(fixed(F.sum(F.abs("r")), 3).alias("l1"), fixed(F.max(F.abs("r"))).alias("linf"))


_LIMIT = f", lim AS (SELECT dim, {RMAX} * sum(CASE WHEN x > 0 THEN x ELSE 0 END) AS hi, {RMAX} * sum(CASE WHEN x < 0 THEN x ELSE 0 END) AS lo FROM feat GROUP BY dim)"


@query(f", n AS (SELECT ie.dst AS node, dim, sum(x * w) AS x FROM feat JOIN iw ie ON ie.src = feat.node GROUP BY ie.dst, dim) SELECT node, CAST(j AS INTEGER) AS dim, {fx('sum(x * (1 + (dim + 2 * j) % 3))', 5)} AS x FROM n, range(2) r(j) GROUP BY node, j")
def convolve(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    m = [[float(1 + (i + 2 * j) % 3) for j in range(2)] for i in range(4)]
    return propagate.convolve(f.features(), f.initial(p), m).select("node", "dim", fixed(F.col("x"), 5).alias("x"))


@query(_LIMIT + " SELECT feat.node, feat.dim FROM feat JOIN lim ON lim.dim = feat.dim WHERE x > hi OR x < lo")
def frontier(f: Fixture) -> DataFrame:
    x = f.features()
    return propagate.over(propagate.initial_state(x), propagate.thresholds(x, RMAX)).select("node", "dim")


@query(
    _LIMIT
    + f""", s AS (SELECT feat.node, feat.dim, x, x > hi OR x < lo AS go FROM feat JOIN lim ON lim.dim = feat.dim),
m AS (SELECT iw.dst AS node, dim, sum(0.9 * x * w) AS m FROM s JOIN iw ON iw.src = s.node WHERE go GROUP BY iw.dst, dim)
SELECT s.node, s.dim, {fx('CASE WHEN go THEN 0.1 * x ELSE 0 END')} AS pi, {fx('CASE WHEN go THEN coalesce(m, 0) ELSE x + coalesce(m, 0) END')} AS r FROM s LEFT JOIN m ON m.node = s.node AND m.dim = s.dim"""
)
def push_round(f: Fixture) -> DataFrame:
    p, x = f.kept_pairs(), f.features()
    s = propagate.push_round(propagate.initial_state(x), propagate.kept_weights(f.initial(p)), propagate.thresholds(x, RMAX), ALPHA)
    return s.select("node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


@query(
    ", rw AS (SELECT ie.src, ie.dst, 1.0 / deg AS w FROM ie JOIN ideg ON ideg.node = ie.dst)"
    + _steps(4, f" SELECT node, {fx('pi', 8)} AS pi_b, {fx('r', 8)} AS r_b FROM s4", w="rw", start="SELECT node, 0 AS dim, 0.0::DOUBLE AS pi, 1.0::DOUBLE AS r FROM aff")
)
def reverse_push_k(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    return propagate.reverse_push(f.initial(p), dynamic.affected(f.updates(p)), 0.0, ALPHA, rounds=4).select("node", fixed(F.col("pi_b"), 8).alias("pi_b"), fixed(F.col("r_b"), 8).alias("r_b"))


@query(", m AS (SELECT count(*) AS m FROM ie), n AS (SELECT count(*) AS n FROM node) SELECT " + fx("((m + n) * 4 + n * 4 * 8) / 1073741824.0", 9) + " AS gb FROM m, n")
def size_estimate(f: Fixture) -> DataFrame:
    return propagate.size_estimate(f.initial(), f.nodes(), 4).select(fixed(F.col("gb"), 9).alias("gb"))


_START = "SELECT node, dim, 0.0::DOUBLE AS pi, x AS r FROM feat"


@query(_LIMIT.replace(str(RMAX), "1e-4") + ", " + threshold_steps(120, "t", _START) + f" SELECT node, dim, {fx('pi')} AS pi, {fx('r')} AS r FROM t120")
def push_to_tolerance(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    s = propagate.initial_operation(f.features(), f.initial(p), Params(rmax=1e-4))
    return s.select("node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


_RUNS = [(0.1, 1e-3), (0.1, 1e-4), (0.3, 1e-3), (0.3, 1e-4)]


@query(
    "".join(f", lim{k} AS (SELECT dim, {r} * CASE WHEN p > 0 THEN p ELSE -n END AS hi, {r} * CASE WHEN n < 0 THEN n ELSE -p END AS lo FROM "
            f"(SELECT dim, sum(CASE WHEN x > 0 THEN x ELSE 0 END) AS p, sum(CASE WHEN x < 0 THEN x ELSE 0 END) AS n FROM feat GROUP BY dim)), " + threshold_steps(60, f"v{k}_", _START, limit=f"lim{k}", alpha=a)
            for k, (a, r) in enumerate(_RUNS))
    + " UNION ALL ".join(f" SELECT {k} AS run, node, dim, {fx('pi')} AS pi, {fx('r')} AS r FROM v{k}_60" for k in range(len(_RUNS)))
)
def push_sweep(f: Fixture) -> DataFrame:
    """Four pairs of (alpha, rmax), pushed together: a row per run, node and dimension."""
    s = propagate.sweep(f.features(), f.initial(f.kept_pairs()), _RUNS)
    return s.select("run", "node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


@query()
def push_by_degree(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    e, n = f.initial(p), f.nodes().count()
    n_walks, scales = propagate.scale_schedule(n, 100.0, 0.5, 1e-3)
    return propagate.push_by_degree(propagate.initial_state(f.features()), e, n_walks, scales, Params())


# ---- updates -----------------------------------------------------------------


@query("SELECT src, dst, op FROM tog")
def toggle_parity(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    return dynamic.toggles(f.initial(p), f.updates(p))


@query("SELECT node FROM aff")
def affected_nodes(f: Fixture) -> DataFrame:
    return dynamic.affected(f.updates())


@query("SELECT src, dst FROM ne")
def apply_updates(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    e = f.initial(p)
    return dynamic.apply(e, dynamic.toggles(e, f.updates(p)))


@query("SELECT node, deg, new_deg FROM adeg")
def updated_degrees(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    e, u = f.initial(p), f.updates(p)
    return dynamic.degrees(e, dynamic.toggles(e, u), dynamic.affected(u))


_SCALED = """, sc AS (SELECT s.node, s.dim, pi * coalesce(sqrt(CAST(new_deg AS DOUBLE)) / sqrt(CAST(deg AS DOUBLE)), 1) AS pi, r, deg, new_deg FROM s3 s LEFT JOIN adeg a ON a.node = s.node),
r1 AS (SELECT node, dim, pi, r + coalesce(pi * (sqrt(CAST(deg AS DOUBLE)) - sqrt(CAST(new_deg AS DOUBLE))) / (0.1 * sqrt(CAST(new_deg AS DOUBLE))), 0) AS r, deg, new_deg FROM sc)"""


def _fixture_update(f: Fixture):
    scratch = Scratch(f.spark)
    p = f.kept_pairs()
    e, u = f.initial(p), f.updates(p)
    x = scratch.keep(f.features(), "features")
    toggle, hit = scratch.keep(dynamic.toggles(e, u), "toggles"), dynamic.affected(u)
    deg = scratch.keep(dynamic.degrees(e, toggle, hit), "degrees")
    s = scratch.keep(propagate.push_all(propagate.initial_state(x), propagate.adjacency(e), ALPHA, 3), "state")
    return x, e, toggle, hit, deg, s, dynamic.rescale(s, deg, ALPHA)


@query(_steps(3, _SCALED + f" SELECT node, dim, {fx('pi')} AS pi, {fx('r')} AS r FROM r1"))
def pi_rescale(f: Fixture) -> DataFrame:
    return _fixture_update(f)[-1].select("node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


_REPAIRED = (
    _SCALED
    + """, fl AS (SELECT tog.src AS node, dim, sum(op * pi / sqrt(CAST(a.deg AS DOUBLE) * b.deg)) AS f FROM tog JOIN ndeg a ON a.node = tog.src JOIN ndeg b ON b.node = tog.dst JOIN r1 ON r1.node = tog.dst GROUP BY tog.src, dim),
r2 AS (SELECT r1.node, r1.dim, pi, CASE WHEN r1.deg IS NULL THEN r ELSE r + ((pi + 0.1 * r - 0.1 * x) * (sqrt(CAST(r1.deg AS DOUBLE)) - sqrt(CAST(new_deg AS DOUBLE))) / sqrt(CAST(new_deg AS DOUBLE)) + 0.9 * coalesce(f, 0)) / 0.1 END AS r
FROM r1 JOIN feat ON feat.node = r1.node AND feat.dim = r1.dim LEFT JOIN fl ON fl.node = r1.node AND fl.dim = r1.dim)"""
)


@query(_steps(3, _REPAIRED + f" SELECT node, dim, {fx('pi')} AS pi, {fx('r')} AS r FROM r2"))
def residual_repair(f: Fixture) -> DataFrame:
    x, e, toggle, _, deg, _, scaled = _fixture_update(f)
    fixed_ = dynamic.repair(scaled, x, deg, toggle, etl.degree(dynamic.apply(e, toggle)), ALPHA)
    return fixed_.select("node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


@query(_steps(3, _REPAIRED + _LIMIT + " SELECT r2.node, r2.dim FROM r2 JOIN lim ON lim.dim = r2.dim JOIN aff ON aff.node = r2.node WHERE r > hi OR r < lo"))
def update_candidates(f: Fixture) -> DataFrame:
    x, e, toggle, hit, deg, _, scaled = _fixture_update(f)
    fixed_ = dynamic.repair(scaled, x, deg, toggle, etl.degree(dynamic.apply(e, toggle)), ALPHA)
    return dynamic.candidates(fixed_, hit, propagate.thresholds(x, RMAX)).select("node", "dim")


@query(
    _steps(
        3,
        f""", v AS (SELECT 1 AS t, node, dim, pi FROM s1 UNION ALL SELECT 2, node, dim, pi FROM s2 UNION ALL SELECT 3, node, dim, pi FROM s3),
d AS (SELECT a.t, sqrt(sum((a.pi - b.pi) * (a.pi - b.pi))) AS x, sqrt(sum((a.pi - c.pi) * (a.pi - c.pi))) AS y FROM v a JOIN v b ON b.t = a.t - 1 AND b.node = a.node AND b.dim = a.dim JOIN v c ON c.t = 1 AND c.node = a.node AND c.dim = a.dim GROUP BY a.t)
SELECT t, {fx('x / nullif(y, 0)')} AS drift FROM d""",
    )
)
def drift_rate(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    w, s = propagate.adjacency(f.initial(p)), propagate.initial_state(f.features())
    versions = None
    for t in (1, 2, 3):
        s = Scratch(f.spark).keep(propagate.push_all(s, w, ALPHA, 1), "state")
        v = s.select(F.lit(t).alias("t"), "node", "dim", "pi")
        versions = v if versions is None else versions.unionAll(v)
    return dynamic.drift(versions).select("t", fixed(F.col("drift")).alias("drift"))


_NEW = ", nw AS MATERIALIZED (SELECT ne.src, ne.dst, 1.0 / sqrt(CAST(a.deg AS DOUBLE) * b.deg) AS w FROM ne JOIN ndeg a ON a.node = ne.src JOIN ndeg b ON b.node = ne.dst)"
#: Updates push to the published tolerance, of which no graph here is so large that it leaves nothing to push.
_PUSHED = _LIMIT.replace(str(RMAX), str(Params.rmax)) + ", " + threshold_rounds("t", _START)


@query(_PUSHED + _REPAIRED.replace("s3 s", "t s") + _NEW + ", " + threshold_rounds("v", "SELECT node, dim, pi, r FROM r2", w="nw") + f" SELECT node, dim, {fx('pi')} AS pi, {fx('r')} AS r FROM v")
def batch_update(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    params, x = Params(), Scratch(f.spark).keep(f.features(), "features")
    g = dynamic.Graph(f.initial(p), x, propagate.initial_operation(x, f.initial(p), params))
    return g.update(f.updates(p), params).state.select("node", "dim", fixed(F.col("pi")).alias("pi"), fixed(F.col("r")).alias("r"))


def _chosen(mass: str, delta: float) -> str:
    """CTEs ending in ``ch`` (node): the selection from ``ms`` (node, dim, r, e) by the budget."""
    return (
        mass
        + f""", sg AS (SELECT node, dim, abs(e) AS e, e > 0 AS pos, r FROM ms), tt AS (SELECT dim, e > 0 AS pos, sum(abs(e)) AS total FROM ms GROUP BY dim, e > 0),
sr AS (SELECT dim, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS sp, -sum(CASE WHEN r <= 0 THEN r ELSE 0 END) AS sn, (SELECT count(*) FROM node) AS n FROM ms GROUP BY dim),
rn AS (SELECT sg.node, sg.dim, sg.pos, e, sum(e) OVER (PARTITION BY sg.dim, sg.pos ORDER BY e DESC, sg.node ROWS UNBOUNDED PRECEDING) - e AS prev FROM sg),
ch AS (SELECT DISTINCT rn.node FROM rn JOIN tt ON tt.dim = rn.dim AND tt.pos = rn.pos JOIN sr ON sr.dim = rn.dim WHERE e > 0 AND total - prev > floor(CASE WHEN rn.pos THEN sp ELSE sn END * {delta} / n * 1e12 + 0.5))"""
    )


_RHO_N = "(SELECT 1.0 / ln(count(*)) FROM node)"
_LAZY = (
    _PUSHED
    + _SCALED.replace("s3 s", "t s")
    + ", rl AS (SELECT 0 AS dim, "
    + _RHO_N
    + " AS hi, -1e300 AS lo), rw AS MATERIALIZED (SELECT ne.src, ne.dst, 1.0 / deg AS w FROM ne JOIN ndeg ON ndeg.node = ne.dst), "
    + threshold_steps(40, "u", "SELECT node, 0 AS dim, 0.0::DOUBLE AS pi, 1.0::DOUBLE AS r FROM aff", w="rw", limit="rl")
    + f""", bd AS (SELECT node.node, CASE WHEN coalesce(pi, 0) > 0 THEN least((coalesce(pi, 0) + {_RHO_N}) * 0.9 / 0.1, 1) ELSE greatest((coalesce(pi, 0) - {_RHO_N}) * 0.9 / 0.1, -1) END AS p FROM node LEFT JOIN u40 ON u40.node = node.node),
ms AS MATERIALIZED (SELECT r1.node, r1.dim, r, CAST(floor(r * p / CAST(ndeg.deg AS DOUBLE) * 1e12 + 0.5) AS BIGINT) AS e FROM r1 JOIN bd ON bd.node = r1.node JOIN ndeg ON ndeg.node = r1.node)"""
)


@query(_chosen(_LAZY, 1.0) + " SELECT node FROM ch")
def lazy_update(f: Fixture) -> DataFrame:
    """The nodes that carry the error budget after batch 1."""
    p = f.kept_pairs()
    params, x = Params(delta=1.0), Scratch(f.spark).keep(f.features(), "features")
    g = dynamic.Graph(f.initial(p), x, propagate.initial_operation(x, f.initial(p), params))
    return monitor.lazy_update(g, f.updates(p), f.nodes(), params)[1]


# ---- monitoring --------------------------------------------------------------

_RHO = 0.2
_BACK = ", rw AS (SELECT ie.src, ie.dst, 1.0 / deg AS w FROM ie JOIN ideg ON ideg.node = ie.dst)" + _steps(2, "", w="rw", start="SELECT node, 0 AS dim, 0.0::DOUBLE AS pi, 1.0::DOUBLE AS r FROM aff")
_BOUND = _BACK + f", bd AS (SELECT node.node, CASE WHEN coalesce(pi, 0) > 0 THEN least((coalesce(pi, 0) + {_RHO}) * 0.9 / 0.1, 1) ELSE greatest((coalesce(pi, 0) - {_RHO}) * 0.9 / 0.1, -1) END AS p FROM node LEFT JOIN s2 ON s2.node = node.node)"
_MASS = _BOUND + ", ms AS (SELECT feat.node, feat.dim, x AS r, CAST(floor(x * p / CAST(deg AS DOUBLE) * 1e12 + 0.5) AS BIGINT) AS e FROM feat JOIN bd ON bd.node = feat.node JOIN ideg ON ideg.node = feat.node)"


def _bound(f: Fixture, p: DataFrame) -> DataFrame:
    back = propagate.reverse_push(f.initial(p), dynamic.affected(f.updates(p)), 0.0, ALPHA, rounds=2)
    return monitor.node_bound(back, f.nodes(), _RHO, ALPHA)


def _mass(f: Fixture) -> DataFrame:
    p = f.kept_pairs()
    s = f.features().select("node", "dim", F.lit(0.0).alias("pi"), F.col("x").alias("r"))
    return monitor.error_mass(s, _bound(f, p), etl.degree(f.initial(p)))


@query(_BOUND + f" SELECT node, {fx('p', 8)} AS p FROM bd")
def node_bound(f: Fixture) -> DataFrame:
    return _bound(f, f.kept_pairs()).select("node", fixed(F.col("p"), 8).alias("p"))


@query(_MASS + " SELECT node, dim, CAST(floor(e / 1e4 + 0.5) AS BIGINT) AS e FROM ms")
def error_mass(f: Fixture) -> DataFrame:
    return _mass(f).select("node", "dim", F.floor(F.col("e") / 1e4 + 0.5).cast("long").alias("e"))


@query(_MASS + f" SELECT dim, CAST(floor(sum(CASE WHEN e > 0 THEN e ELSE 0 END) / 1e6 + 0.5) AS BIGINT) AS e_pos, CAST(floor(sum(CASE WHEN e <= 0 THEN e ELSE 0 END) / 1e6 + 0.5) AS BIGINT) AS e_neg, {fx('sum(CASE WHEN r > 0 THEN r ELSE 0 END)', 4)} AS s_pos, {fx('sum(CASE WHEN r <= 0 THEN r ELSE 0 END)', 4)} AS s_neg FROM ms GROUP BY dim")
def signed_totals(f: Fixture) -> DataFrame:
    t = monitor.signed_totals(_mass(f))
    micro = lambda c: F.floor(F.col(c) / 1e6 + 0.5).cast("long").alias(c)
    return t.select("dim", micro("e_pos"), micro("e_neg"), fixed(F.col("s_pos"), 4).alias("s_pos"), fixed(F.col("s_neg"), 4).alias("s_neg"))


_DELTA = 2.0
_CHOSEN = _chosen(_MASS, _DELTA)


@query(_CHOSEN + " SELECT node FROM ch")
def error_budget_select(f: Fixture) -> DataFrame:
    return monitor.select(Scratch(f.spark).keep(_mass(f), "mass"), _DELTA, f.nodes().count())


@query(_CHOSEN + f" SELECT node, dim, {fx('x')} AS x, CAST(CASE WHEN node IN (SELECT node FROM ch) THEN 1 ELSE 0 END AS INTEGER) AS changed FROM feat")
def changed_kept_partition(f: Fixture) -> DataFrame:
    scratch, x = Scratch(f.spark), f.features()
    chosen = scratch.keep(monitor.select(scratch.keep(_mass(f), "mass"), _DELTA, f.nodes().count()), "changed")
    kept, changed = monitor.partition(x, chosen)
    mark = lambda d, v: d.select("node", "dim", fixed(F.col("x")).alias("x"), F.lit(v).alias("changed"))
    return mark(kept, 0).unionAll(mark(changed, 1))


@query(_CHOSEN + ", k AS (SELECT node FROM node WHERE node NOT IN (SELECT node FROM ch)) SELECT node FROM k ORDER BY (node * 2654435761 + 2 * 40503 + 7) % 1000003, node LIMIT (SELECT count(*) FROM ch)")
def memory_sample(f: Fixture) -> DataFrame:
    """As many unchanged nodes as the error budget selects: a sampling operator."""
    from graphprop.operators.learn import memory_sample as sample

    scratch = Scratch(f.spark)
    return sample(f.raw_features(), scratch.keep(monitor.select(scratch.keep(_mass(f), "mass"), _DELTA, f.nodes().count()), "changed"))


# ---- walks -------------------------------------------------------------------

_NEAR = ", nb AS MATERIALIZED (SELECT ie.src, row_number() OVER (PARTITION BY ie.src ORDER BY dst) - 1 AS pos, dst, deg FROM ie JOIN ideg ON ideg.node = ie.src)"


@query(
    _NEAR
    + ", k0 AS MATERIALIZED (SELECT node AS start, CAST(w AS BIGINT) AS walk, node FROM node, range(2) r(w))"
    + "".join(f", k{i + 1} AS MATERIALIZED (SELECT start, walk, dst AS node FROM k{i} JOIN nb ON nb.src = k{i}.node AND nb.pos = {drawn('walk', str(i), 1)} % nb.deg)" for i in range(3))
    + " SELECT start, walk, node FROM k3"
)
def walk_hash_k(f: Fixture) -> DataFrame:
    return walks.fixed_walks(f.nodes(), f.initial(f.kept_pairs()), 2, 3)


@query("SELECT node AS start, CAST(w AS BIGINT) AS walk, node FROM ideg, range(200000) r(w) WHERE w < deg")
def walk_starts(f: Fixture) -> DataFrame:
    e = f.initial(f.kept_pairs())
    return walks.starts(etl.degree(e), F.col("deg"))


@query(", c AS (SELECT node, deg, sum(deg) OVER (ORDER BY node) - deg AS lo, sum(deg) OVER () AS t FROM ideg) SELECT node, CAST(floor((lo + deg) * 5000 / CAST(t AS DOUBLE) + 0.5) - floor(lo * 5000 / CAST(t AS DOUBLE) + 0.5) AS BIGINT) AS times FROM c")
def sample_sources(f: Fixture) -> DataFrame:
    """How often each node is drawn by degree: a sampling operator."""
    return walks.sample_sources(etl.degree(f.initial(f.kept_pairs())), "deg", 5000, ["node"]).select("node", "times")


WALK_ALPHA = 0.5


@query(", " + stopping_walks("SELECT node AS start, CAST(w AS BIGINT) AS walk FROM ideg, range(200000) r(w) WHERE w < deg", WALK_ALPHA, 1, first_hop=True) + " SELECT start AS node, walk, node AS stop FROM wk WHERE done")
def walk_cache(f: Fixture) -> DataFrame:
    e = f.initial(f.kept_pairs())
    return walks.walk_cache(f.nodes(), e, WALK_ALPHA)


_TAIL = (
    ", "
    + push_steps(2, alpha=WALK_ALPHA)
    + """, mass AS MATERIALIZED (SELECT * FROM (SELECT s2.node, dim, sign(r) AS sg, CAST(floor(abs(r) * sqrt(CAST(deg AS DOUBLE)) * 1e9 + 0.5) AS BIGINT) AS m FROM s2 JOIN ideg ON ideg.node = s2.node WHERE r <> 0) WHERE m > 0),
pl AS (SELECT node, dim, sg, m, sum(m) OVER (PARTITION BY dim ORDER BY node) - m AS lo, sum(m) OVER (PARTITION BY dim) AS total FROM mass),
dr AS MATERIALIZED (SELECT node AS start, dim, sg, CAST(total AS DOUBLE) AS total, CAST(floor(CAST((lo + m) * 20000 AS DOUBLE) / CAST(total AS DOUBLE) + 0.5) - floor(CAST(lo * 20000 AS DOUBLE) / CAST(total AS DOUBLE) + 0.5) AS BIGINT) AS times FROM pl), """
    + stopping_walks("SELECT start, CAST(w AS BIGINT) AS walk FROM (SELECT start, max(times) AS most FROM dr GROUP BY start), range(20001) r(w) WHERE w < most", WALK_ALPHA, 1)
    + ", ld AS (SELECT wk.node, dim, sum(sg) AS s, max(total) AS total FROM wk JOIN dr ON dr.start = wk.start AND wk.walk < dr.times WHERE done GROUP BY wk.node, dim)"
)


@query(_TAIL + f" SELECT s2.node, s2.dim, {fx('pi + coalesce(s * (ld.total / (1e9 * 20000)) / sqrt(CAST(deg AS DOUBLE)), 0)')} AS pi FROM s2 LEFT JOIN ld ON ld.node = s2.node AND ld.dim = s2.dim LEFT JOIN ideg ON ideg.node = s2.node")
def push_and_walk(f: Fixture) -> DataFrame:
    p, x = f.kept_pairs(), f.features()
    near = propagate.adjacency(f.initial(p))
    s = propagate.push_all(propagate.initial_state(x), near, WALK_ALPHA, 2)
    return walks.walk_tail(Scratch(f.spark).keep(s, "state"), near.edges, WALK_ALPHA, 20_000, deg=near.degrees).select("node", "dim", fixed(F.col("pi")).alias("pi"))


@query(", aw AS (SELECT src, dst, (src * 7 + dst * 13) % 10 + 0.5 AS w FROM ie)" + f" SELECT src, dst, {fx('w / sum(w) OVER (PARTITION BY src)', 8)} AS share FROM aw")
def alias_shares(f: Fixture) -> DataFrame:
    """With what probability the alias tables of weighted edges choose each neighbour."""
    from graphprop.operators import alias

    w = f.initial(f.kept_pairs()).withColumn("w", (F.col("src") * 7 + F.col("dst") * 13) % 10 + 0.5)
    return alias.shares(alias.alias_tables(w)).select("src", "dst", fixed(F.col("share"), 8).alias("share"))


_AFTER = ", " + stopping_walks("SELECT node AS start, CAST(w AS BIGINT) AS walk FROM ndeg, range(200000) r(w) WHERE w < deg", WALK_ALPHA, 1, first_hop=True).replace("ie.", "ne.").replace("FROM ie", "FROM ne").replace("ideg", "ndeg")


@query(_AFTER + " SELECT start AS node, walk, node AS stop FROM wk WHERE done")
def refreshed_walk_cache(f: Fixture) -> DataFrame:
    """The stored walk cache of the initial graph, refreshed by the first batch: that of the graph after it."""
    from graphprop.operators import walkindex

    p, scratch = f.kept_pairs(), Scratch(f.spark)
    e, u, at = f.initial(p), f.updates(p), scratch.path("index")
    toggle = scratch.keep(dynamic.toggles(e, u), "toggles")
    walkindex.save(f.nodes(), e, WALK_ALPHA, at)
    walkindex.refresh(scratch.keep(dynamic.apply(e, toggle), "edges"), toggle.select(F.col("src").alias("node")), WALK_ALPHA, at)
    return walkindex.load(f.spark, at)


_CACHED = ", " + push_steps(2, alpha=WALK_ALPHA) + ", " + stopping_walks("SELECT node AS start, CAST(w AS BIGINT) AS walk FROM ideg, range(200000) r(w) WHERE w < deg", WALK_ALPHA, 1, first_hop=True)


@query(
    _CACHED
    + f""", mv AS (SELECT wk.node, s2.dim, sum({1 - WALK_ALPHA} * r * sqrt(CAST(deg AS DOUBLE)) / deg) AS m FROM wk JOIN s2 ON s2.node = wk.start JOIN ideg ON ideg.node = wk.start WHERE done GROUP BY wk.node, s2.dim)
SELECT s2.node, s2.dim, {fx(f'pi + {WALK_ALPHA} * r + coalesce(m / sqrt(CAST(deg AS DOUBLE)), 0)')} AS pi FROM s2 JOIN ideg ON ideg.node = s2.node LEFT JOIN mv ON mv.node = s2.node AND mv.dim = s2.dim"""
)
def push_and_cached_walks(f: Fixture) -> DataFrame:
    p, x = f.kept_pairs(), f.features()
    near = propagate.adjacency(f.initial(p))
    s = Scratch(f.spark).keep(propagate.push_all(propagate.initial_state(x), near, WALK_ALPHA, 2), "state")
    cache = walks.walk_cache(f.nodes(), near.edges, WALK_ALPHA, deg=near.degrees)
    return walks.cached_tail(s, near.edges, cache, WALK_ALPHA, near.degrees).select("node", "dim", fixed(F.col("pi")).alias("pi"))


# ---- metrics -----------------------------------------------------------------

_PRED = ", pr AS (SELECT node, y, CAST((node * 7 + y * (node % 3)) % 6 AS INTEGER) AS p FROM cls)"


def _predictions(f: Fixture) -> DataFrame:
    return f.classes().withColumn("predicted", ((F.col("node") * 7 + F.col("y") * (F.col("node") % 3)) % 6).cast("int"))


@query(_PRED + f" SELECT {fx('avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pr")
def accuracy(f: Fixture) -> DataFrame:
    return metrics.accuracy(_predictions(f)).select(fixed(F.col("accuracy")).alias("accuracy"))


@query(_PRED + " SELECT y, p AS predicted, count(*) AS n FROM pr GROUP BY y, p")
def confusion(f: Fixture) -> DataFrame:
    return metrics.confusion(_predictions(f))


_F1 = (
    _PRED
    + """, cl AS (SELECT DISTINCT y AS cls FROM pr UNION SELECT DISTINCT p FROM pr),
cf AS (SELECT cls, count(*) FILTER (y = cls AND p = cls) AS tp, count(*) FILTER (p = cls AND y <> cls) AS fp, count(*) FILTER (y = cls AND p <> cls) AS fn FROM cl, pr GROUP BY cls)"""
)


@query(_F1 + f" SELECT cls, tp, fp, fn, {fx('2.0 * tp / nullif(2.0 * tp + fp + fn, 0)')} AS f1 FROM cf")
def f1_by_class(f: Fixture) -> DataFrame:
    return metrics.f1_by_class(_predictions(f)).withColumn("f1", fixed(F.col("f1")))


@query(_F1 + f" SELECT {fx('avg(2.0 * tp / nullif(2.0 * tp + fp + fn, 0))')} AS macro, {fx('2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn))')} AS micro FROM cf")
def f1_macro_micro(f: Fixture) -> DataFrame:
    return metrics.f1(_predictions(f)).select(fixed(F.col("macro")).alias("macro"), fixed(F.col("micro")).alias("micro"))


@query(
    f""", s AS (SELECT (node * 13) % 101 AS score, CASE WHEN y > 2 THEN 1 ELSE 0 END AS y FROM cls), t AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY score),
u AS (SELECT p, q, sum(q) OVER (ORDER BY score) - q AS b FROM t) SELECT {fx('sum(p * (b + 0.5 * q)) / CAST(sum(p) * sum(q) AS DOUBLE)')} AS auc FROM u"""
)
def roc_auc_rank(f: Fixture) -> DataFrame:
    s = f.classes().select(((F.col("node") * 13) % 101).alias("score"), (F.col("y") > 2).cast("int").alias("y"))
    return metrics.roc_auc(s).select(fixed(F.col("auc")).alias("auc"))


@query(f"SELECT {fx('avg(o_totalprice)', 3)} AS total, {fx('avg(o_custkey)', 3)} AS customer FROM orders")
def metric_means(f: Fixture) -> DataFrame:
    o = f.table("orders").select(F.col("o_totalprice").alias("total"), F.col("o_custkey").alias("customer"))
    return metrics.means(o, ["total", "customer"]).select(fixed(F.col("total"), 3).alias("total"), fixed(F.col("customer"), 3).alias("customer"))


@query(
    """, r AS (SELECT event_id AS seq, event_type AS dataset, CAST(user_id % 2 AS VARCHAR) AS model, user_id AS value FROM events)
SELECT dataset, max_by(value, seq) FILTER (model = '0') AS "m0", max_by(value, seq) FILTER (model = '1') AS "m1" FROM r GROUP BY dataset"""
)
def latest_cells(f: Fixture) -> DataFrame:
    r = f.table("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"), F.col("user_id").alias("value"))
    return metrics.latest_cells(r, ["m0", "m1"])


@query()
def block_model(f: Fixture) -> DataFrame:
    from graphprop.sources.blockmodel import BlockModel, block_edges

    return block_edges(f.spark, BlockModel(nodes=2000))


@query()
def discriminator(f: Fixture) -> DataFrame:
    """Scores of a contrastive discriminator for every part."""
    from graphprop.operators import learn

    x = Scratch(f.spark).keep(f.features(), "features")
    scratch = Scratch(f.spark)
    kept, changed = monitor.partition(x, scratch.keep(monitor.select(scratch.keep(_mass(f), "mass"), _DELTA, f.nodes().count()), "changed"))
    model = learn.discriminator(features.contrastive_set(x, kept, changed))
    return learn.predicted(model, learn.vectors(features.packed(x)).withColumn("y", F.lit(0)))


@query()
def classifier(f: Fixture) -> DataFrame:
    """Predictions of a perceptron for every part's type."""
    from graphprop.operators import learn

    x = learn.vectors(features.packed(f.features())).join(f.classes(), "node")
    x = Scratch(f.spark).keep(x.select("node", "y", "vec"), "rows")
    return learn.predicted(learn.mlp(learn.vectors(x), [4, 16, 8], rounds=20), learn.vectors(x))


_SOFTMAX = """, part_nodes AS (SELECT DISTINCT node FROM feat), xs AS (SELECT node, dim, x FROM feat UNION ALL SELECT node, 4, 1.0 FROM part_nodes),
z AS (SELECT node, CAST(c AS INTEGER) AS c, exp(sum(x * ((dim + 2 * c) % 3) / 4.0)) AS e FROM xs, range(6) r(c) GROUP BY node, c),
pz AS (SELECT z.node, c, e / sum(e) OVER (PARTITION BY z.node) - CASE WHEN y = c THEN 1 ELSE 0 END AS d FROM z JOIN cls ON cls.node = z.node)"""


@query(_SOFTMAX + f" SELECT CAST(dim AS INTEGER) AS dim, c AS class, {fx('sum(x * d) / count(*)')} AS gradient FROM xs JOIN pz ON pz.node = xs.node GROUP BY dim, c")
def class_gradient(f: Fixture) -> DataFrame:
    """The mean gradient of multinomial regression at given weights, intercepts as dimension 4."""
    from graphprop.operators import learn

    w = np.array([[(i + 2 * c) % 3 / 4.0 for c in range(6)] for i in range(5)])
    g, _ = learn.softmax_gradient(features.packed(f.features()).join(f.classes(), "node"), w)
    rows = [(i, c, float(g[i, c])) for i in range(5) for c in range(6)]
    return f.spark.createDataFrame(rows, "dim int, class int, gradient double").withColumn("gradient", fixed(F.col("gradient")))


_NETWORK = f""", nz AS (SELECT node, j, sum(x * ((dim + 2 * j) % 3 - 1) / 2.0) + 0.5 AS z FROM feat, range(2) r(j) GROUP BY node, j),
nm AS (SELECT j, avg(z) AS m, sqrt(var_pop(z) + 1e-5) AS sd, (3 - j) / 2.0 AS sc, count(*) AS n FROM nz GROUP BY j),
na AS MATERIALIZED (SELECT node, nz.j, (z - m) / sd AS u, sd, sc, n, greatest(sc * (z - m) / sd + 0.25, 0) AS a FROM nz JOIN nm ON nm.j = nz.j),
nl AS (SELECT node, c, n, exp(sum(a * ((j + 2 * c) % 5 - 2) / 4.0) + c / 8.0) AS l FROM na, range(6) r(c) GROUP BY node, c, n),
nd AS MATERIALIZED (SELECT nl.node, c, (l / sum(l) OVER (PARTITION BY nl.node) - CASE WHEN y = c THEN 1 ELSE 0 END) / n AS d FROM nl JOIN cls ON cls.node = nl.node),
nu AS MATERIALIZED (SELECT na.node, j, u, sd, sc, CASE WHEN a > 0 THEN sum(d * ((j + 2 * c) % 5 - 2) / 4.0) ELSE 0 END AS up FROM na JOIN nd ON nd.node = na.node GROUP BY na.node, j, u, sd, sc, a),
ns AS (SELECT j, avg(up) AS s, avg(up * u) AS t FROM nu GROUP BY j)
SELECT part, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {fx("g")} AS gradient FROM (
SELECT 'weight0' AS part, dim AS i, nu.j, sum(x * sc / sd * (up - s - u * t)) AS g FROM nu JOIN ns ON ns.j = nu.j JOIN feat ON feat.node = nu.node GROUP BY dim, nu.j
UNION ALL SELECT 'weight1', j, c, sum(a * d) FROM na JOIN nd ON nd.node = na.node GROUP BY j, c UNION ALL SELECT 'bias1', 0, c, sum(d) FROM nd GROUP BY c
UNION ALL SELECT 'scale0', 0, j, sum(up * u) FROM nu GROUP BY j UNION ALL SELECT 'shift0', 0, j, sum(up) FROM nu GROUP BY j)"""


@query(_NETWORK)
def network_gradient(f: Fixture) -> DataFrame:
    """The mean gradient of a perceptron with a normalised hidden layer at given weights, over all parts as one batch."""
    from graphprop.operators import network

    w0 = np.array([[((i + 2 * j) % 3 - 1) / 2.0 for j in range(2)] for i in range(4)])
    w1 = np.array([[((j + 2 * c) % 5 - 2) / 4.0 for c in range(6)] for j in range(2)])
    net = network.Network([w0, w1], [np.full(2, 0.5), np.arange(6) / 8.0], [np.array([1.5, 1.0])], [np.full(2, 0.25)], [np.zeros(2)], [np.ones(2)])
    rows = Scratch(f.spark).keep(features.packed(f.features()).join(f.classes(), "node").select("node", "vec", "y"), "rows")
    at = net.moved(network.gradient(net, rows)[0])
    out = [(name, i, j, float(v)) for name, a in at.arrays().items() if name in ("weight0", "weight1", "bias1", "scale0", "shift0") for (i, j), v in np.ndenumerate(np.atleast_2d(a))]
    return f.spark.createDataFrame(out, "part string, i int, j int, gradient double").withColumn("gradient", fixed(F.col("gradient")))


@query()
def network_classifier(f: Fixture) -> DataFrame:
    """Predictions of that perceptron for every part's type, trained by Adam with dropout on the training part of a stratified split."""
    from graphprop.operators import network

    split = etl.stratified_split(f.classes())
    rows = Scratch(f.spark).keep(features.packed(f.features()).join(split, "node").select("node", "vec", "y", "split"), "rows")
    train, held = rows.where("split = 'train'"), rows.where("split = 'val'")
    got = network.fit(train, held, network.Network.new([4, 16, 6]), network.Training(epochs=3, batches=2, dropout=0.1))
    return network.predicted(got.network, rows)


@query(f""", em AS (SELECT node, CAST(j AS INTEGER) AS k, sum(x * (1 + (dim + 2 * j) % 3)) + 0.5 AS v FROM feat, range(3) r(j) GROUP BY node, j)
SELECT node, k, {fx("v / sqrt(sum(v * v) OVER (PARTITION BY node))", 5)} AS v FROM em""")
def embed_normalized(f: Fixture) -> DataFrame:
    """The linear encoder's rows, brought to length 1."""
    from graphprop.operators import learn

    w = np.array([[float(1 + (i + 2 * j) % 3) for j in range(3)] for i in range(4)])
    unit = learn.normalized(learn.embed(features.packed(f.features()), w, np.full(3, 0.5)))
    return unit.select("node", F.posexplode("vec").alias("k", "v")).withColumn("v", fixed(F.col("v"), 5))


# ---- sources and sinks: what is written is read back -------------------------


def _lines(f: Fixture, line: DataFrame) -> str:
    at = Scratch(f.spark).path("lines")
    line.toDF("value").write.text(at)
    return at


@query("SELECT src, dst FROM und")
def text_edge_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    at = Scratch(f.spark).path("edges")
    files.write_text_edges(f.pairs(), at)
    return files.text_edges(f.spark, at)


@query("SELECT src, dst FROM pair")
def commented_edge_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    head = f.spark.createDataFrame([("# nodes and edges",), ("",), ("x 1",)], "value string")
    return files.commented_edges(f.spark, _lines(f, f.pairs().select(F.concat_ws("\t", "src", "dst")).union(head)))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS lo, count(*) - 1 AS hi, count(*) AS kinds, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM upd")
def update_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    u = files.update_file(f.spark, _lines(f, f.updates().select(F.concat_ws(" ", "src", "dst"))))
    return u.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("kinds"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


@query("SELECT src, dst, CAST(y AS VARCHAR) AS t FROM pair")
def temporal_edge_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    return files.temporal_edges(f.spark, _lines(f, f.pairs().select(F.concat_ws(" ", "src", "dst", "y"))))


@query("SELECT src, dst, CAST(y AS INTEGER) AS t FROM pair UNION ALL SELECT dst, src, CAST(y AS INTEGER) FROM pair")
def dated_edge_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    line = F.format_string("[%d, %d, %d, 'x']", "src", "dst", F.col("y") * 10000 + 101)
    return files.dated_edges(f.spark, _lines(f, f.pairs().select(line)))


@query("SELECT node, y FROM cls")
def dated_label_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    return files.dated_labels(f.spark, _lines(f, f.classes().select(F.format_string("(%d, 'x', 19990101, %d)", "node", F.col("y") + 1))))


@query("SELECT user_id AS src, event_id AS dst, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label FROM events")
def interaction_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    at = Scratch(f.spark).path("csv")
    f.table("events").select(F.col("user_id").alias("u"), F.col("event_id").alias("i"), (F.col("event_type") == "error").cast("int").alias("label")).write.option("header", "true").csv(at)
    return files.interaction_csv(f.spark, at)


@query("SELECT node FROM node")
def query_node_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    return files.query_nodes(f.spark, _lines(f, f.nodes().select(F.col("node").cast("string"))))


@query("SELECT batch, src, dst FROM later UNION ALL SELECT batch, dst, src FROM later")
def update_batch_files(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    at = Scratch(f.spark).path("batches")
    files.write_updates(f.later(), at)
    return f.spark.read.parquet(at).select(F.col("batch").cast("int").alias("batch"), "src", "dst")


@query("SELECT node, deg FROM deg UNION ALL SELECT node, deg FROM deg")
def appended_vectors(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    at = Scratch(f.spark).path("vectors")
    for _ in range(2):
        files.write_vector(etl.degree(f.graph()), at)
    return f.spark.read.schema("node long, deg long").option("sep", "\t").csv(at)


@query("SELECT 'a' AS run, 'rows' AS name, CAST((SELECT count(*) FROM pair) AS DOUBLE) AS value UNION ALL SELECT 'b', 'nodes', CAST((SELECT count(*) FROM node) AS DOUBLE)")
def appended_metrics(f: Fixture) -> DataFrame:
    from graphprop.sources import files

    at = Scratch(f.spark).path("metrics")
    files.append_metrics(f.spark, at, [("a", "rows", float(f.pairs().count()))])
    files.append_metrics(f.spark, at, [("b", "nodes", float(f.nodes().count()))])
    return f.spark.read.parquet(at)


@query("SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY deg, dst) - 1 AS BIGINT) AS pos, dst, CAST(deg2 AS BIGINT) AS deg FROM (SELECT e.src, dst, deg.deg, o.deg AS deg2 FROM e JOIN deg ON deg.node = e.dst JOIN deg o ON o.node = e.src)")
def csr_tables(f: Fixture) -> DataFrame:
    """The written adjacency: neighbours by position, and the degree that the row pointers give."""
    from graphprop.sources import files

    at = Scratch(f.spark).path("csr")
    files.write_csr(f.graph(loops=False), f.nodes(), at, self_loops=True)
    ptr = f.spark.read.parquet(f"{at}/indptr").select(F.col("node").alias("src"), "deg")
    return f.spark.read.parquet(f"{at}/indices").join(ptr, "src").select("src", "pos", "dst", "deg")


@query("SELECT src, dst FROM ip UNION ALL SELECT src, dst FROM later WHERE batch <= 2")
def snapshot_access(f: Fixture) -> DataFrame:
    """One snapshot of the series, each edge once."""
    p = f.pairs()
    return etl.upper_triangle(etl.snapshot_of(etl.intervals(p.where("y < 1999").select("src", "dst"), f.later(p)), 2)).select("src", "dst")


@query("SELECT src, dst FROM e")
def csr_array_files(f: Fixture) -> DataFrame:
    """Edges written as binary indices and pointers, and read back by ranges that cut sources."""
    from graphprop.sources import arrays

    scratch = Scratch(f.spark)
    at, e = scratch.path("csr"), scratch.keep(f.graph(), "edges")
    order = scratch.keep(etl.numbered(e, [F.col("src"), F.col("dst")], "node").select("node", "dst"), "order")
    edges, nodes = order.count(), f.nodes().count()
    arrays.write_rows(order.select("node", F.array(F.col("dst").cast("double")).alias("vec")), f"{at}/indices", "<u4", False, arrays.part_rows(edges, 20_000))
    ptr = scratch.keep(etl.csr(e, f.nodes()), "pointers")
    last = ptr.agg((F.max("node") + 1).alias("node"), F.sum("deg").alias("start"))
    both = ptr.select("node", "start").unionAll(last)
    arrays.write_rows(both.select("node", F.array(F.col("start").cast("double")).alias("vec")), f"{at}/indptr", "<u4", False, arrays.part_rows(nodes, 300))
    return arrays.csr_arrays(f.spark, f"{at}/indices", f"{at}/indptr", step=arrays.part_rows(edges, 40_000))


@query(f"SELECT vec_id AS node, CAST(k - 1 AS INTEGER) AS dim, {fx('CAST(v AS DOUBLE)')} AS x FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)")
def npy_array_files(f: Fixture) -> DataFrame:
    """The feature matrix written as npy parts, and read back by ranges of rows."""
    from graphprop.sources import arrays

    at, rows = Scratch(f.spark).path("npy"), f.table("embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    arrays.write_rows(rows, at, rows_per_part=150)
    return features.unpacked(arrays.npy_rows(f.spark, at, step=64)).select("node", "dim", fixed(F.col("x")).alias("x"))
