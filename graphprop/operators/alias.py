"""Weighted neighbours by alias tables: one lookup and one draw for a choice, hubs in chunks.

A table of m entries is m columns of equal height, each shared by at most two
entries: a draw takes a column and then one of its two. Columns are as high as
the weights' total and an entry fills m times its weight of them, so that
building only adds and subtracts: the shares of weights that are multiples of
one power of two are those of the weights to the last bit. A node with more than
``SIZE`` neighbours has a table for each chunk of them, and over those a table
whose entries are the chunks with their summed weights, level over level until
one table is left; a choice goes down its node's levels. No task holds more
than one table's entries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprop.operators.walks import COIN, RANGE, WAY, draw
from graphprop.tables import Scratch

#: Entries of one table.
SIZE = 1024


def columns(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of positive weights what each column of height ``weight.sum()`` holds of its own entry, and the entry that has the rest of it."""
    full = weight.sum()
    height = weight * len(weight)
    own, other = np.full(len(weight), full), np.arange(len(weight))
    low, high = list(np.flatnonzero(height < full)[::-1]), list(np.flatnonzero(height >= full)[::-1])
    while low and high:
        a, b = low.pop(), high[-1]
        own[a], other[a] = height[a], b
        height[b] -= full - height[a]
        if height[b] < full:
            low.append(high.pop())
    return own, other


def _built(rows: DataFrame) -> DataFrame:
    """(src, chunk, total, items, own, other) of (src, chunk, entries): one table a row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                items, weights = [], []
                for entries in batch.column(2).to_pylist():
                    items.append([e["item"] for e in entries])
                    weights.append(np.array([e["w"] for e in entries]))
                made = [columns(w) for w in weights]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([float(w.sum()) for w in weights]), pa.array(items, pa.list_(pa.int64())),
                        pa.array([list(o) for o, _ in made], pa.list_(pa.float64())), pa.array([list(o) for _, o in made], pa.list_(pa.int32())),
                    ],
                    ["src", "chunk", "total", "items", "own", "other"],
                )

    return rows.mapInArrow(run, "src long, chunk long, total double, items array<long>, own array<double>, other array<int>")


def alias_tables(weighted: DataFrame, size: int = SIZE) -> list[DataFrame]:
    """A DataFrame for each level, written once: (src, chunk, total, items, own, other), the neighbours' level first.

    ``weighted`` is (src, dst, w); parallel edges add up, and edges whose weight
    is null, not finite or not positive are never chosen. Which chunk a
    neighbour is in is a hash of it, so a chunk has about half of ``size``
    entries; the top level has one table for each node with more than one chunk
    below it.
    """
    if size < 4:
        raise ValueError("a table has room for at least 4 entries")
    scratch = Scratch(weighted.sparkSession)
    w = F.col("w").cast("double")
    good = weighted.where(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")))
    items = scratch.keep(good.groupBy("src", F.col("dst").alias("item")).agg(F.sum(w).alias("w")), "items")
    out: list[DataFrame] = []
    while True:
        many = scratch.keep(items.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).select("src", F.ceil(F.col("n") * 2 / size).alias("chunks")), "many")
        dealt = items.join(many, "src", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("item"), F.col("chunks")), F.lit(0)).cast("long"))
        grouped = dealt.groupBy("src", "chunk").agg(F.array_sort(F.collect_list(F.struct("item", "w"))).alias("entries"))
        out.append(scratch.keep(_built(grouped), "tables"))
        if not many.limit(1).count():
            return out
        items = scratch.keep(out[-1].join(many, "src", "left_semi").select("src", F.col("chunk").alias("item"), F.col("total").alias("w")), "items")


def shares(tables: list[DataFrame]) -> DataFrame:
    """(src, dst, share): with what probability the tables choose each neighbour."""
    below = None
    for table in reversed(tables):
        each = table.select("src", "chunk", (F.size("items") * F.col("total")).alias("area"), "total", "items", F.posexplode(F.arrays_zip("own", "other")).alias("k", "c"))
        own = each.select("src", "chunk", "area", F.get("items", F.col("k")).alias("item"), F.col("c.own").alias("held"))
        rest = each.select("src", "chunk", "area", F.get("items", F.col("c.other")).alias("item"), (F.col("total") - F.col("c.own")).alias("held"))
        here = own.unionAll(rest).groupBy("src", "chunk", "item").agg((F.sum("held") / F.first("area")).alias("share"))
        if below is not None:
            up = below.select("src", F.col("item").alias("chunk"), F.col("share").alias("_up"))
            # a node without a table above has one chunk, which is always taken
            here = here.join(up, ["src", "chunk"], "left").withColumn("share", F.col("share") * F.coalesce("_up", F.lit(1.0))).drop("_up")
        below = here
    return below.select("src", F.col("item").alias("dst"), "share")


def weighted_step(walks: DataFrame, tables: list[DataFrame], k: int, seed: int) -> DataFrame:
    """Move every walk (start, walk, node) to a neighbour by weight; a walk at a node without one starts again at its start."""
    moved = walks.withColumn("_chunk", F.lit(0).cast("long"))
    for level in range(len(tables) - 1, -1, -1):
        at = F.lit(f"{k}/{level}")
        pick = lambda purpose, at=at: draw(F.col("walk"), F.col("start"), at, seed, purpose)
        table = tables[level].select(F.col("src").alias("_src"), F.col("chunk").alias("_of"), "total", "items", "own", "other")
        met = moved.join(table, (F.col("node") == F.col("_src")) & (F.col("_chunk") == F.col("_of")), "left")
        slot = met.withColumn("_k", (pick(WAY) % F.size("items")).cast("int"))
        entry: Column = F.when(pick(COIN) < F.get("own", F.col("_k")) / F.col("total") * float(RANGE), F.col("_k")).otherwise(F.get("other", F.col("_k")))
        chosen = F.get("items", entry)
        if level:
            moved = slot.withColumn("_chunk", F.coalesce(chosen, F.lit(0).cast("long"))).select(*walks.columns, "_chunk")
        else:
            moved = slot.withColumn("node", F.coalesce(chosen, F.col("start"))).select(*walks.columns)
    return moved


def weighted_walks(walks: DataFrame, weighted: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """(start, walk, node): where walks of ``length`` weighted steps end."""
    tables = alias_tables(weighted)
    for k in range(length):
        walks = weighted_step(walks, tables, k, seed)
    return walks
