"""The evolving graph that the queries run on, from the driver's tables, as DataFrames and as the head of a SQL statement.

Parts are nodes; two parts bought in one order are joined, at the year of their
first common order. The graph before 1999 is the initial one, later years are
update batches. All hashes are plain integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprop.operators import etl, features
from graphprop.tables import Scratch, dealt, tasks

ALPHA = 0.1
FIRST_UPDATE = 1999


class Fixture:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("node"))

    def pairs(self) -> DataFrame:
        """(src, dst, y) with src < dst: pairs of parts and the year of their first common order."""
        line = self.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
        n = tasks(line)
        ol = dealt(line, n, "o").distinct()
        year = dealt(self.table("orders").select(F.col("o_orderkey").alias("o"), F.year("o_orderdate").cast("long").alias("y")), n, "o")
        a, b = ol.select("o", F.col("p").alias("src")), ol.select("o", F.col("p").alias("dst"))
        joined = a.join(b, "o").where("src < dst").join(year if n is None else year.hint("merge"), "o")
        return dealt(joined.select("src", "dst", "y"), n, "src", "dst").groupBy("src", "dst").agg(F.min("y").alias("y"))

    def kept_pairs(self) -> DataFrame:
        """``pairs``, written once: for queries that read them many times."""
        return Scratch(self.spark).keep(self.pairs(), "pairs")

    def graph(self, pairs: DataFrame | None = None, loops: bool = True) -> DataFrame:
        """All years, both directions."""
        p = self.pairs() if pairs is None else pairs
        e = p.select("src", "dst").unionAll(p.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return e.unionAll(self.nodes().select(F.col("node").alias("src"), F.col("node").alias("dst"))) if loops else e

    def initial(self, pairs: DataFrame | None = None, loops: bool = True) -> DataFrame:
        return self.graph((self.pairs() if pairs is None else pairs).where(F.col("y") < FIRST_UPDATE), loops)

    def later(self, pairs: DataFrame | None = None) -> DataFrame:
        """(batch, src, dst): pairs first seen in 1999, 2000, ... as batches 1, 2, ..."""
        p = self.pairs() if pairs is None else pairs
        return p.where(F.col("y") >= FIRST_UPDATE).select((F.col("y") - FIRST_UPDATE + 1).cast("int").alias("batch"), "src", "dst")

    def updates(self, pairs: DataFrame | None = None) -> DataFrame:
        """Toggles of batch 1: insertions of 1999, deletions of a residue class of initial pairs, and pairs listed twice; both directions."""
        p = self.pairs() if pairs is None else pairs
        come = p.where(F.col("y") == FIRST_UPDATE)
        go = p.where((F.col("y") < FIRST_UPDATE) & ((F.col("src") * 31 + F.col("dst") * 17) % 97 == 0))
        twice = p.where((F.col("y") == FIRST_UPDATE + 1) & ((F.col("src") + F.col("dst")) % 5 == 0))
        one = come.unionAll(go).unionAll(twice).unionAll(twice).select("src", "dst")
        return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def raw_features(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
        line = self.table("lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
        a = part.select("node", F.expr("stack(2, 0, s, 1, r) as (dim, x)"))
        return a.unionAll(line.select("node", F.expr("stack(2, 2, q, 3, d) as (dim, x)")))

    def features(self) -> DataFrame:
        return features.standardize(self.raw_features())

    def classes(self) -> DataFrame:
        """(node, y): the part's type, encoded."""
        return etl.label_encode(self.table("part").select(F.col("p_partkey").alias("node"), "p_type"), "p_type").select("node", "y")

    def wide(self) -> DataFrame:
        return features.unpacked(self.table("embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec")))


HEAD = f"""
WITH RECURSIVE ol AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pair AS MATERIALIZED (SELECT a.p AS src, b.p AS dst, CAST(min(year(o_orderdate)) AS BIGINT) AS y FROM ol a JOIN ol b ON a.o = b.o AND a.p < b.p JOIN orders ON o_orderkey = a.o GROUP BY a.p, b.p),
node AS (SELECT p_partkey AS node FROM part),
und AS (SELECT src, dst FROM pair UNION ALL SELECT dst, src FROM pair),
e AS (SELECT src, dst FROM und UNION ALL SELECT node, node FROM node),
ip AS (SELECT src, dst FROM pair WHERE y < {FIRST_UPDATE}),
ie AS MATERIALIZED (SELECT src, dst FROM ip UNION ALL SELECT dst, src FROM ip UNION ALL SELECT node, node FROM node),
later AS (SELECT CAST(y - {FIRST_UPDATE} + 1 AS INTEGER) AS batch, src, dst FROM pair WHERE y >= {FIRST_UPDATE}),
one AS (SELECT src, dst FROM pair WHERE y = {FIRST_UPDATE}
  UNION ALL SELECT src, dst FROM ip WHERE (src * 31 + dst * 17) % 97 = 0
  UNION ALL SELECT src, dst FROM pair, range(2) WHERE y = {FIRST_UPDATE + 1} AND (src + dst) % 5 = 0),
upd AS (SELECT src, dst FROM one UNION ALL SELECT dst, src FROM one),
raw AS (SELECT p_partkey AS node, 0 AS dim, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part
  UNION ALL SELECT l_partkey, 2, avg(l_quantity) FROM lineitem GROUP BY l_partkey UNION ALL SELECT l_partkey, 3, avg(l_discount) FROM lineitem GROUP BY l_partkey),
feat AS MATERIALIZED (SELECT raw.node, raw.dim, (x - m) / coalesce(nullif(s, 0), 1) AS x FROM raw JOIN (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM raw GROUP BY dim) t ON raw.dim = t.dim),
deg AS (SELECT src AS node, count(*) AS deg FROM e GROUP BY src),
ideg AS MATERIALIZED (SELECT src AS node, count(*) AS deg FROM ie GROUP BY src),
w AS (SELECT e.src, e.dst, 1.0 / sqrt(CAST(a.deg AS DOUBLE) * b.deg) AS w FROM e JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.dst),
iw AS MATERIALIZED (SELECT ie.src, ie.dst, 1.0 / sqrt(CAST(a.deg AS DOUBLE) * b.deg) AS w FROM ie JOIN ideg a ON a.node = ie.src JOIN ideg b ON b.node = ie.dst),
cls AS (SELECT p_partkey AS node, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS y FROM part),
tog AS MATERIALIZED (SELECT o.src, o.dst, CASE WHEN x.src IS NULL THEN 1 ELSE -1 END AS op FROM (SELECT src, dst FROM upd GROUP BY src, dst HAVING count(*) % 2 = 1) o LEFT JOIN ie x ON x.src = o.src AND x.dst = o.dst),
aff AS (SELECT DISTINCT src AS node FROM upd),
ne AS MATERIALIZED (SELECT src, dst FROM ie WHERE NOT EXISTS (SELECT 1 FROM tog t WHERE t.op = -1 AND t.src = ie.src AND t.dst = ie.dst) UNION ALL SELECT src, dst FROM tog WHERE op = 1),
ndeg AS MATERIALIZED (SELECT src AS node, count(*) AS deg FROM ne GROUP BY src),
adeg AS (SELECT aff.node, CAST(coalesce(a.deg, 0) AS BIGINT) AS deg, CAST(coalesce(b.deg, 0) AS BIGINT) AS new_deg FROM aff LEFT JOIN ideg a ON a.node = aff.node LEFT JOIN ndeg b ON b.node = aff.node)
"""


def fixed(value: str, digits: int = 6) -> str:
    return f"CAST(floor(({value}) * 1e{digits} + 0.5) AS BIGINT)"


def push_steps(k: int, w: str = "iw", start: str = "SELECT node, dim, 0.0::DOUBLE AS pi, x AS r FROM feat", alpha: float = ALPHA) -> str:
    """CTEs s0 .. sk of the fixed-round push."""
    out = [f"s0 AS ({start})"]
    for i in range(1, k + 1):
        out.append(
            f"m{i} AS (SELECT {w}.dst AS node, dim, sum(r * {w}.w) AS m FROM s{i - 1} s JOIN {w} ON {w}.src = s.node GROUP BY {w}.dst, dim), "
            f"s{i} AS (SELECT coalesce(s.node, m.node) AS node, coalesce(s.dim, m.dim) AS dim, coalesce(s.pi, 0) + {alpha} * coalesce(s.r, 0) AS pi, (1 - {alpha}) * coalesce(m.m, 0) AS r "
            f"FROM s{i - 1} s FULL JOIN m{i} m ON m.node = s.node AND m.dim = s.dim)"
        )
    return ", ".join(out)


def threshold_steps(k: int, name: str, start: str, w: str = "iw", limit: str = "lim", alpha: float = ALPHA) -> str:
    """CTEs name0 .. namek of the push to ``limit`` (dim, hi, lo); rounds after the last one that moves anything change nothing."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for i in range(1, k + 1):
        out.append(
            f"g{name}{i} AS MATERIALIZED (SELECT s.node, s.dim, pi, r, r > hi OR r < lo AS go FROM {name}{i - 1} s JOIN {limit} ON {limit}.dim = s.dim), "
            f"{name}{i} AS MATERIALIZED (SELECT node, dim, sum(pi) AS pi, sum(r) AS r FROM (SELECT node, dim, CASE WHEN go THEN pi + {alpha} * r ELSE pi END AS pi, CASE WHEN go THEN 0 ELSE r END AS r FROM g{name}{i} "
            f"UNION ALL SELECT {w}.dst, dim, 0, (1 - {alpha}) * r * {w}.w FROM g{name}{i} g JOIN {w} ON {w}.src = g.node WHERE go) GROUP BY node, dim)"
        )
    return ", ".join(out)


def threshold_rounds(name: str, start: str, w: str = "iw", limit: str = "lim", alpha: float = ALPHA) -> str:
    """CTEs ending in ``name``: the push to ``limit`` (dim, hi, lo), in as many rounds as it takes."""
    marked = lambda t: f"(SELECT s.k, s.node, s.dim, pi, r, r > hi OR r < lo AS go FROM {t} s JOIN {limit} ON {limit}.dim = s.dim)"
    return f"""{name}_rounds AS (SELECT CAST(0 AS BIGINT) AS k, node, dim, pi, r FROM ({start})
  UNION ALL SELECT k + 1, node, dim, sum(pi), sum(r) FROM (
    SELECT k, node, dim, CASE WHEN go THEN pi + {alpha} * r ELSE pi END AS pi, CASE WHEN go THEN 0 ELSE r END AS r FROM (SELECT *, bool_or(go) OVER () AS more FROM {marked(f"{name}_rounds")}) WHERE more
    UNION ALL SELECT k, {w}.dst, dim, 0, {1 - alpha} * r * {w}.w FROM {marked(f"{name}_rounds")} g JOIN {w} ON {w}.src = g.node WHERE go) GROUP BY k, node, dim),
{name} AS MATERIALIZED (SELECT node, dim, pi, r FROM {name}_rounds WHERE k = (SELECT max(k) FROM {name}_rounds))"""


def drawn(walk: str, step: str, seed: int, purpose: int = 1) -> str:
    """A walk's draw below 2^60 at a step: 15 hexadecimal digits of an MD5 digest."""
    return f"CAST('0x' || substr(md5('{seed}:' || start || ':' || {walk} || ':' || {step}), {1 + 15 * purpose}, 15) AS BIGINT)"


def stopping_walks(start: str, alpha: float, seed: int, first_hop: bool = False) -> str:
    """CTEs ending in ``wk`` (start, walk, node, k, done): the walks of ``start`` (start, walk) until each has stopped, on ``nb`` (src, pos, dst, deg)."""
    go = f"{drawn('walk', 'k', seed, 0)} >= {int(alpha * (1 << 60))}" + (" OR k = 0" if first_hop else "")
    return f"""nb AS MATERIALIZED (SELECT ie.src, row_number() OVER (PARTITION BY ie.src ORDER BY dst) - 1 AS pos, dst, deg FROM ie JOIN ideg ON ideg.node = ie.src),
wk AS (SELECT start, walk, start AS node, CAST(0 AS BIGINT) AS k, false AS done FROM ({start})
  UNION ALL SELECT a.start, a.walk, CASE WHEN a.go THEN coalesce(nb.dst, a.start) ELSE a.node END, a.k + 1, NOT a.go
  FROM (SELECT wk.*, {go} AS go, {drawn('walk', 'k', seed)} AS d, ideg.deg FROM wk LEFT JOIN ideg ON ideg.node = wk.node WHERE NOT done) a LEFT JOIN nb ON nb.src = a.node AND nb.pos = a.d % a.deg)"""
