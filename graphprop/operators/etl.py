"""Graph ETL: edges (src, dst) as DataFrames, never adjacency objects.

Columns are ``src long, dst long``; nodes are ``node long``. Everything here is
a lazy plan of built-in operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphprop.tables import Scratch, dealt, tasks


def _ranged(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` in ranges of ``keys``, written with the number of each range, so that every reader sees the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Scratch(df.sparkSession).keep(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranged")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select("src", "dst").union(reverse(edges)).distinct()


def mask(edges: DataFrame, keep: Column) -> DataFrame:
    return edges.where(keep)


def upper_triangle(edges: DataFrame) -> DataFrame:
    """Edges with src < dst; self loops go."""
    return edges.where("src < dst")


def hold_out(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, held out): an undirected edge is held out if either end is among ``nodes``.

    What is kept is symmetric again; what is held out stays one-directional.
    """
    marked = nodes.select(F.col("node")).distinct().withColumn("_in", F.lit(True))
    pick = lambda side: marked.select(F.col("node").alias(side), F.col("_in").alias(f"_{side}"))
    flagged = upper_triangle(edges).join(pick("src"), "src", "left").join(pick("dst"), "dst", "left")
    out = F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False))
    return symmetrize(flagged.where(~out)), flagged.where(out).select("src", "dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def _numbered(df: DataFrame, keys: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """``numbered``, and the written ranges that it reads."""
    ranged = _ranged(df, keys)
    inside = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each partition
    return inside.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_part", "_rank", "_before"), ranged


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Global 0-based numbers in the order of ``keys``, without one task holding all rows.

    Rows are ranged into partitions, counted, and numbered within; the counts
    of earlier partitions are added.
    """
    return _numbered(df, keys, name)[0]


#: Hash orders are below this prime.
PRIME = 1000003


def hash_order(src: Column, dst: Column, seed: int) -> Column:
    """An arithmetic hash that any SQL engine computes alike: the order of a random permutation. Ids are reduced first, so none is too large."""
    own = lambda c, by: F.pmod(c, F.lit(PRIME)) * by % PRIME
    return ((own(src, 2654435761 % PRIME) + own(dst, 40503) + seed) % PRIME).cast("long")


def batches(edges: DataFrame, n_batches: int, seed: int = 7) -> DataFrame:
    """``edges`` permuted and cut into ``n_batches`` disjoint batches of equal size; the remainder is dropped."""
    keys = [hash_order(F.col("src"), F.col("dst"), seed), F.col("src"), F.col("dst")]
    dealt, ranged = _numbered(edges.select("src", "dst"), keys, "seq")
    size = ranged.count() // n_batches
    return dealt.withColumn("batch", F.floor(F.col("seq") / max(size, 1)).cast("int")).where((F.col("batch") < n_batches) & F.lit(size > 0))


def cumulative(batched: DataFrame, n_batches: int) -> DataFrame:
    """Batch t of the result holds all edges of batches up to t: the copies are the result; ``intervals`` holds each edge once."""
    return batched.where(F.col("batch") < n_batches).select(F.explode(F.sequence(F.col("batch"), F.lit(n_batches - 1))).alias("batch"), "src", "dst")


def to_disjoint(batched: DataFrame) -> DataFrame:
    """Undo ``cumulative``: each edge in the batch where it first appears."""
    return batched.groupBy("src", "dst").agg(F.min("batch").alias("batch")).select("batch", "src", "dst")


def snapshot(init: DataFrame, batched: DataFrame, t: int) -> DataFrame:
    """The graph after batch ``t``: initial edges and all batches up to ``t``, in both directions."""
    return symmetrize(init.select("src", "dst").union(batched.where(F.col("batch") <= t).select("src", "dst")))


def _pair(*more: str | Column) -> list[Column | str]:
    return [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *more]


def intervals(init: DataFrame, batched: DataFrame, first: int = 0) -> DataFrame:
    """(src, dst, start, stop) with src <= dst: each undirected edge once, from the first snapshot that has it; nothing ends.

    Initial edges are there from snapshot ``first``, those of a batch from its number.
    """
    rows = init.select(*_pair(F.lit(first).alias("start"))).unionAll(batched.select(*_pair(F.col("batch").cast("int").alias("start"))))
    return rows.groupBy("src", "dst").agg(F.min("start").alias("start")).withColumn("stop", F.lit(None).cast("int"))


def toggled_intervals(init: DataFrame, toggles: DataFrame, first: int = 0) -> DataFrame:
    """(src, dst, start, stop): when each undirected edge is there, from ``start`` to before ``stop``, null for ever.

    ``toggles`` are (t, src, dst) with t above ``first``. An undirected toggle
    may be listed in both directions; of a direction's listings in one t only
    the parity counts. An edge that goes and comes back has a row for each time.
    """
    rows = toggles.groupBy("t", "src", "dst").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(*_pair(F.col("t").cast("int").alias("t")))
    events = init.select(*_pair(F.lit(first).alias("t"))).distinct().unionAll(rows.distinct())
    # an edge has at most one event in a t
    times = events.groupBy("src", "dst").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    each = times.select("src", "dst", "ts", F.explode(F.sequence(F.lit(0), F.size("ts") - 1, F.lit(2))).alias("k"))
    return each.select("src", "dst", F.get("ts", F.col("k")).alias("start"), F.get("ts", F.col("k") + 1).alias("stop"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs that are there once; self loops once."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    return pairs.select("src", "dst", *rest).unionAll(pairs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def snapshot_of(edges: DataFrame, t: int) -> DataFrame:
    """Snapshot ``t`` of ``intervals``, in both directions: a filter, no sort and no distinct."""
    live = (F.col("start") <= t) & (F.col("stop").isNull() | (F.col("stop") > t))
    return _both_ways(edges.where(live).select("src", "dst"))


def degrees_over_time(edges: DataFrame, n_snapshots: int) -> DataFrame:
    """(t, node, deg) for snapshots 0 to ``n_snapshots - 1``: running sums of what starts and stops, no copies of edges.

    A node's rows in the sum are the snapshots in which its degree changes.
    """
    ends = _both_ways(edges.select("src", "dst", "start", "stop"))
    change = ends.select(F.col("src").alias("node"), F.col("start").alias("t"), F.lit(1).alias("c")).unionAll(ends.where("stop is not null").select("src", "stop", F.lit(-1)))
    summed = change.where(F.col("t") < n_snapshots).groupBy("node", "t").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("node").orderBy("t")
    ran = summed.select("node", "t", F.sum("c").over(order).alias("deg"), F.coalesce(F.lead("t").over(order), F.lit(n_snapshots)).alias("_to"))
    return ran.where("deg > 0").select(F.explode(F.sequence(F.greatest("t", F.lit(0)), F.col("_to") - 1)).alias("t"), "node", F.col("deg").cast("long").alias("deg"))


def snapshots(init: DataFrame, batched: DataFrame, n_batches: int) -> DataFrame:
    """(t, src, dst) for all snapshots: each edge is made one of first, then repeated for the snapshots that have it."""
    own = intervals(init, batched).where(F.col("start") < n_batches)
    return _both_ways(own.select("src", "dst", F.explode(F.sequence(F.col("start"), F.lit(n_batches - 1))).alias("t"))).select("t", "src", "dst")


def bucket_times(edges: DataFrame, step: int, time: str = "t") -> DataFrame:
    """Number the distinct times in order and merge every ``step`` of them."""
    times = edges.select(time).distinct()
    number = numbered(times, [F.col(time)], "_k").select(time, F.floor(F.col("_k") / step).cast("int").alias("bucket"))
    return edges.join(number, time)


def adjacency(edges: DataFrame) -> DataFrame:
    """The binary symmetric matrix as (src, dst, value)."""
    return symmetrize(edges).withColumn("value", F.lit(1.0))


def reindex_labelled_first(nodes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node, new_id): labelled nodes first, then the others, each in the order of ids."""
    flag = labelled.select("node").distinct().withColumn("_y", F.lit(0))
    marked = nodes.select("node").distinct().join(flag, "node", "left").withColumn("_y", F.coalesce("_y", F.lit(1)))
    return numbered(marked, [F.col("_y"), F.col("node")], "new_id").drop("_y")


def year_of(date: Column) -> Column:
    """The year of a date written as the integer yyyymmdd."""
    return F.floor(date / 10000).cast("int")


def label_encode(rows: DataFrame, column: str, name: str = "y") -> DataFrame:
    """Distinct values in order become 0, 1, ...; the codes are joined back."""
    codes = numbered(rows.select(column).distinct(), [F.col(column)], name).withColumn(name, F.col(name).cast("int"))
    return rows.join(codes, column)


def _salted_ranks(rows: DataFrame, group: list[str], key: Column, tie: Column, name: str, salts: int = 64) -> DataFrame:
    """1-based ranks by (key, tie) in each group, from ranges of ``key`` below PRIME, so that no group is one task."""
    salted = rows.withColumn("_salt", F.floor(key * salts / PRIME).cast("int"))
    inside = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(key, tie)))
    sizes = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*group, "_salt", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_salt")) - F.col("_n")).alias("_before"))
    return inside.join(before, [*group, "_salt"]).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_salt", "_rank", "_before")


def stratified_split(labels: DataFrame, train: float = 0.4, val: float = 0.2, seed: int = 7) -> DataFrame:
    """(node, y, split): in each class the first shares by hash are train and val, the rest test."""
    key = hash_order(F.col("node"), F.lit(0).cast("long"), seed)
    sized = labels.join(labels.groupBy("y").agg(F.count(F.lit(1)).alias("_size")), "y")
    ranked = _salted_ranks(sized, ["y"], key, F.col("node"), "_r")
    share = F.col("_r") / F.col("_size")
    return ranked.select("node", "y", F.when(share <= train, "train").when(share <= train + val, "val").otherwise("test").alias("split"))


def temporal_split(edges: DataFrame, train_stamps: float = 0.7, val: float = 0.1, test: float = 0.2, seed: int = 7) -> DataFrame:
    """(t, src, dst, split): the first ``ceil(train_stamps * stamps)`` stamps train; of the later edges, permuted, shares of all edges are val and test."""
    times = numbered(edges.select("t").distinct(), [F.col("t")], "_k")
    n = times.agg(F.count(F.lit(1)).alias("stamps"))
    staged = edges.join(times.crossJoin(F.broadcast(n)), "t").withColumn("_train", F.col("_k") < F.ceil(F.col("stamps") * train_stamps))
    total = edges.count()
    late = numbered(staged.where("not _train").select("t", "src", "dst"), [hash_order(F.col("src"), F.col("dst"), seed), F.col("src"), F.col("dst"), F.col("t")], "_r")
    n_val, n_test = int(total * val), int(total * test)
    split = F.when(F.col("_r") < n_val, "val").when(F.col("_r") < n_val + n_test, "test")
    return staged.where("_train").select("t", "src", "dst", F.lit("train").alias("split")).union(late.select("t", "src", "dst", split.alias("split")).where(F.col("split").isNotNull()))


def degree(edges: DataFrame, by: str = "src") -> DataFrame:
    return edges.groupBy(F.col(by).alias("node")).agg(F.count(F.lit(1)).alias("deg"))


def graph_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, min_id, max_id, max_out, max_in, dead_ends, isolated."""
    out, into = degree(edges).withColumnRenamed("deg", "out"), degree(edges, "dst").withColumnRenamed("deg", "into")
    both = nodes.select("node").join(out, "node", "left").join(into, "node", "left").fillna(0, ["out", "into"])
    return both.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("out"), F.lit(0)).cast("long").alias("n_edges"), F.min("node").alias("min_id"), F.max("node").alias("max_id"),
        F.max("out").alias("max_out"), F.max("into").alias("max_in"), F.sum((F.col("out") == 0).cast("long")).alias("dead_ends"), F.sum(((F.col("out") == 0) & (F.col("into") == 0)).cast("long")).alias("isolated"),
    )


#: A node with more neighbours than this is a hub: its neighbours are numbered in ranges, those of others by a sort within a task.
HUB = 100_000

#: Edges for which a task that sorts them is meant.
SORT_ROWS = 2_000_000


def _hubs(edges: DataFrame, scratch: Scratch, hub: int, written: bool = False, deg: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges written once, as they may be already, their degrees, as they may be too, and the hubs (src); None where there are none."""
    e = edges.select("src", "dst") if written or deg is not None else scratch.keep(edges.select("src", "dst"), "edges")
    deg = scratch.keep(degree(e), "degrees") if deg is None else deg
    found = scratch.keep(deg.where(F.col("deg") > hub).select(F.col("node").alias("src")), "hubs")
    return e, deg, found if found.limit(1).count() else None


def _ranged_positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """(src, pos, dst): edges are numbered as a whole, in ranges that cut a hub's neighbours too, and count from their source's first number."""
    rows = numbered(rows, [F.col("src"), *map(F.col, order)], "_at")
    first = rows.groupBy("src").agg(F.min("_at").alias("_first"))
    return rows.join(first, "src").select("src", (F.col("_at") - F.col("_first")).alias("pos"), "dst")


def _apart(rows: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of other nodes, and rows of hubs; a null source is no hub."""
    return rows.join(F.broadcast(hubs), "src", "left_anti"), rows.join(F.broadcast(hubs), "src", "left_semi")


def _with_degrees(edges: DataFrame, scratch: Scratch, hub: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges (src, dst, deg) of a symmetric graph, and its hubs: as many edges lead to a node as leave it, so those that meet at ``dst`` are counted there."""
    rows = edges.select("src", "dst").where("dst is not null")
    met = dealt(rows, tasks(rows, SORT_ROWS), "dst").withColumn("deg", F.count(F.lit(1)).over(Window.partitionBy("dst")))
    e = scratch.keep(met, "edges")
    found = scratch.keep(e.where(F.col("deg") > hub).select(F.col("dst").alias("src")).distinct(), "hubs")
    return e, found if found.limit(1).count() else None


def positions(edges: DataFrame, by_degree: bool = False, hub: int = HUB, written: bool = False, symmetric: bool = False) -> DataFrame:
    """(src, pos, dst): each node's neighbours numbered from 0 by id, or by degree and id.

    A node's neighbours are sorted in one task, hubs' in ranges. ``written``
    edges are a table, which need not be written again; of ``symmetric`` ones,
    which read written tables too, no degrees are joined. Rows are dealt by
    their number, so that no task sorts more as the graph grows.
    """
    scratch, order = Scratch(edges.sparkSession), ["dst"]
    if by_degree and symmetric:
        (rows, hubs), order = _with_degrees(edges, scratch, hub), ["deg", "dst"]
    else:
        rows, deg, hubs = _hubs(edges, scratch, hub, written)
    n = tasks(rows, SORT_ROWS)
    if by_degree and not symmetric:
        rows, order = dealt(rows, n, "dst").join(deg.select(F.col("node").alias("dst"), "deg").hint("merge"), "dst"), ["deg", "dst"]
    own = Window.partitionBy("src").orderBy(*order)
    sort = lambda few: dealt(few, n, "src").select("src", (F.row_number().over(own) - 1).cast("long").alias("pos"), "dst")
    if hubs is None:
        return sort(rows)
    few, many = _apart(rows, hubs)
    return sort(few).unionAll(_ranged_positions(many, order))


def chunked(edges: DataFrame, size: int = 1024, hub: int = HUB, deg: DataFrame | None = None) -> DataFrame:
    """(src, chunk, first, deg, dsts): each node's neighbours in the order of ``positions``, ``size`` to a row.

    Neighbour ``pos`` is entry ``pos % size`` of chunk ``pos div size``; a hub
    takes as many rows as it needs, and they lie in as many groups. Where the
    written degrees ``deg`` are given, edges read written tables and are not
    written again.
    """
    rows, _, hubs = _hubs(edges, Scratch(edges.sparkSession), hub, deg=deg)
    few, many = (rows, None) if hubs is None else _apart(rows, hubs)
    listed = few.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("all")).withColumn("deg", F.size("all").cast("long"))
    cut = listed.select("src", "deg", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(deg - 1) div {size}"))).alias("chunk"))
    out = cut.select("src", "chunk", (F.col("chunk") * size).alias("first"), "deg", F.slice("all", (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("dsts"))
    if many is None:
        return out
    placed = _ranged_positions(many, ["dst"]).withColumn("chunk", F.expr(f"pos div {size}"))
    rows = placed.groupBy("src", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("dsts"))
    sized = rows.groupBy("src").agg(F.sum(F.size("dsts")).alias("deg"))
    return out.unionByName(rows.join(sized, "src").select("src", "chunk", (F.col("chunk") * size).alias("first"), "deg", "dsts"))


def prefix_sums(df: DataFrame, keys: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before each in the order of ``keys``, range after range."""
    ranged = _ranged(df, keys)
    inside = ranged.withColumn("_own", F.sum(value).over(Window.partitionBy("_part").orderBy(*keys)) - F.col(value))
    sizes = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row for each partition
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def csr(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, start, deg): the row pointers of the compressed adjacency; isolated nodes have degree 0."""
    deg = nodes.select("node").join(degree(edges), "node", "left").fillna(0, ["deg"])
    return prefix_sums(deg, [F.col("node")], "deg", "start").select("node", F.col("start").cast("long"), F.col("deg").cast("long"))


def dead_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without out-edges."""
    return nodes.select("node").join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def fill_dead_ends(edges: DataFrame, nodes: DataFrame, target: Column) -> DataFrame:
    """Give every dead end one edge to ``target`` (a dummy id, a node, or an expression of ``node``)."""
    filled = dead_ends(edges, nodes).select(F.col("node").alias("src"), target.cast("long").alias("dst"))
    return edges.select("src", "dst").union(filled)


def redirect(edges: DataFrame, sources: DataFrame, target: Column) -> DataFrame:
    """Turn the edges into any of ``sources`` (node) towards ``target``; the original is kept in ``was`` to restore."""
    flag = sources.select(F.col("node").alias("_n")).distinct()
    joined = edges.join(flag, edges["dst"] == F.col("_n"), "left")
    return joined.select("src", F.when(F.col("_n").isNotNull(), target.cast("long")).otherwise(F.col("dst")).alias("dst"), F.col("dst").alias("was"))


def restore(redirected: DataFrame) -> DataFrame:
    return redirected.select("src", F.col("was").alias("dst"))


def edge_exists(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, present): -1 for edges that exist (a toggle would delete them), 1 for others."""
    have = edges.select("src", "dst").distinct().withColumn("_e", F.lit(-1))
    return pairs.join(have, ["src", "dst"], "left").select("src", "dst", F.coalesce("_e", F.lit(1)).alias("present"))


def insert(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(more.select("src", "dst")).distinct()


def delete(edges: DataFrame, less: DataFrame) -> DataFrame:
    return edges.join(less.select("src", "dst"), ["src", "dst"], "left_anti")


def walk_graph(edges: DataFrame, nodes: DataFrame, dummy: int) -> DataFrame:
    """Edges for walks: no self loops, dead ends lead to ``dummy``; (src, pos, dst, deg)."""
    scratch = Scratch(edges.sparkSession)
    kept = scratch.keep(drop_self_loops(edges).select("src", "dst"), "edges")
    filled = scratch.keep(fill_dead_ends(kept, nodes, F.lit(dummy)), "filled")
    return positions(filled).join(degree(filled).withColumnRenamed("node", "src"), "src").select("src", "pos", "dst", "deg")


def reverse_index(walk: DataFrame) -> DataFrame:
    """(dst, src, pos): where each node appears as a neighbour."""
    return walk.select("dst", "src", "pos")


def interactions(events: DataFrame) -> DataFrame:
    """Edges user -> item, with time and label, from (user, item, t, label); items are numbered after the users."""
    top = events.agg((F.coalesce(F.max("user"), F.lit(-1)) + 1).alias("_base"))
    return label_encode(events, "item", "_i").crossJoin(F.broadcast(top)).select(F.col("user").alias("src"), (F.col("_base") + F.col("_i")).cast("long").alias("dst"), "t", "label")
