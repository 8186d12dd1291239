"""Near-duplicate detection: SuperMinHash, banding, exact verification, union-find.

Documents with equal shingle sets form one class, named by its smallest id, so
copies cost one row each and never meet in pairs. Class representatives are
banded; the members of a bucket are compared with its smallest one by a byte of
each signature position, which never rules out a pair that the signatures would
not. Where all agree, that one stands for the bucket; where some do not, all
members of the bucket meet by their bytes. The links that are left give
clusters, which hold every pair that shares a bucket and may be similar enough,
but not what merely shares a bucket with it. A cluster's whole sets are then
compared inside one task, or block against block where it is large: signatures
rule out pairs far below the threshold, a union-find those already connected,
and whole sets decide the rest. Only a spanning forest of links leaves the task.
Hence no bucket is capped, and no bucket emits its pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.store import Scratch

#: Positions of a signature: a prime, so that ``a + b*j`` visits each position once.
SIGNATURE = 127
#: A rank j takes the high bits of a signature value, a uniform draw the low 25.
RANK_BITS = 25


@dataclass(frozen=True)
class NearDedup:
    """``numerator``/``denominator`` is the similarity from which documents are linked.

    With 25 bands of 5 rows a pair of similarity 0.85 shares no bucket once in
    2 million; ``slack`` standard deviations below the threshold the signatures'
    agreement rules a pair out. A cluster is compared in blocks of ``block``
    sets; a mixed bucket of more than ``bucket`` members is a cluster as it is.
    """

    width: int = 5
    numerator: int = 85
    denominator: int = 100
    bands: int = 25
    rows: int = 5
    slack: float = 6.0
    block: int = 1024
    bucket: int = 4096

    @property
    def least_agreement(self) -> int:
        p = self.numerator / self.denominator
        return max(0, int(SIGNATURE * (p - self.slack * (p * (1 - p) / SIGNATURE) ** 0.5)))


def super_minhash(elements: np.ndarray, of: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, one row for each range ``of`` of distinct elements.

    Element x puts ``(j, u_j(x))`` at position ``a(x) + b(x)*j mod 127`` for
    j = 0, 1, ...: each element's ranks are a permutation of the positions. A row
    leaves the loop as soon as no position can still fall, which for a long row
    is after one or two ranks. Rows without elements keep the largest value.
    """
    n = len(of) - 1
    sig = np.full(n * SIGNATURE, np.uint32(0xFFFFFFFF))
    row = np.repeat(np.arange(n), np.diff(of))
    el = elements
    seed = tx.mix(el ^ np.uint64(0xA0761D6478BD642F))
    a = (seed % np.uint64(SIGNATURE)).astype(np.int64)
    b = (1 + (seed >> np.uint64(32)) % np.uint64(SIGNATURE - 1)).astype(np.int64)
    for j in range(SIGNATURE):
        if not len(el):
            break
        draw = (tx.mix(el + np.uint64((j + 1) * 0x8BB84B93962EACC9 & (2**64 - 1))) >> np.uint64(64 - RANK_BITS)).astype(np.uint32)
        np.minimum.at(sig, row * SIGNATURE + (a + b * j) % SIGNATURE, np.uint32(j << RANK_BITS) | draw)
        live = (sig.reshape(n, SIGNATURE).max(1) >= np.uint64((j + 1) << RANK_BITS))[row]
        if not live.all():
            el, row, a, b = el[live], row[live], a[live], b[live]
    return sig.reshape(n, SIGNATURE)


def shingle_sets(col: pa.Array, width: int):
    """For blocks of rows: first row, end row, the distinct shingles of each row (sorted), their ranges."""
    for lo, hi, h, of in tx.word_hashes(col):
        runs, at = tx.shingles(h, of, width)
        sets = [np.unique(runs[at[k] : at[k + 1]]) for k in range(hi - lo)]
        yield lo, hi, sets, np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def _band_keys(sig: np.ndarray, cfg: NearDedup) -> np.ndarray:
    key = np.zeros((len(sig), cfg.bands), np.uint64)
    for k in range(cfg.rows):
        key = tx.mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, k : cfg.bands * cfg.rows : cfg.rows].astype(np.uint64) + np.arange(cfg.bands, dtype=np.uint64))
    return key.view(np.int64)


def signatures(docs: DataFrame, cfg: NearDedup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, set_hash, bands and sketch, a byte of each signature position (all three null for an empty set)."""

    def run(batches):
        for batch in batches:
            ids, ns, fps, keys, sketch = [], [], [], [], []
            for lo, hi, sets, of in shingle_sets(batch.column(1), cfg.width):
                sig = super_minhash(np.concatenate(sets), of)
                key = _band_keys(sig, cfg)
                sketch += [x.tobytes() if len(s) else None for x, s in zip(sig.astype(np.uint8), sets, strict=True)]
                ids.append(batch.column(0).slice(lo, hi - lo))
                ns += [len(s) for s in sets]
                fps += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys += [x if len(s) else None for x, s in zip(key, sets, strict=True)]
            if ids:
                columns = [pa.concat_arrays(ids), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components (node, component): the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours, then
    jumps to that label's own label; rounds grow as the logarithm of a chain.
    """
    both = scratch.keep(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")), "links")
    label = scratch.keep(nodes.select(F.col("node"), F.col("node").alias("component")), "labels")
    while True:
        near = both.join(label, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("component").alias("near"))
        moved = label.join(near, F.col("node") == F.col("dst"), "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("to"))
        moved = scratch.keep(moved, "moved")
        up = moved.select(F.col("node").alias("_n"), F.col("to").alias("_up"))
        jumped = scratch.keep(moved.join(up, F.col("to") == F.col("_n"), "left").select("node", "was", F.least("to", F.coalesce("_up", "to")).alias("component")), "labels")
        changed = jumped.where("component <> was").limit(1).count()
        label = jumped.select("node", "component")
        if not changed:
            return label


def _bytes(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), SIGNATURE)


def _agreeing(pairs: DataFrame, sketches: DataFrame, cfg: NearDedup) -> DataFrame:
    """``pairs`` (a, b) with ``near``: whether their sketches agree often enough for a link."""
    left, right = (sketches.select(F.col("node").alias(k), F.col("sketch").alias(f"_{k}")) for k in ("a", "b"))
    least = cfg.least_agreement

    def run(batches):
        for batch in batches:
            if len(batch):
                near = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long, near boolean")


def forest_of(sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that agree in at least ``least`` places: each row meets those not reached yet."""
    out, rest = [], np.arange(len(sketch))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = (sketch[rest] == sketch[x]).sum(1) >= least
            out += [(int(x), int(y)) for y in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return out


def _bucket_links(members: DataFrame, cfg: NearDedup) -> DataFrame:
    """Links (a, b) of buckets (band, node, sketch) of at most ``cfg.bucket`` members: a spanning forest of each."""
    least = cfg.least_agreement

    def run(batches):
        held: list[pa.RecordBatch] = []

        def links(rows: pa.Table) -> pa.RecordBatch:
            band, node = rows.column("band").to_numpy(), rows.column("node").to_numpy()
            sketch = _bytes(rows.column("sketch").combine_chunks())
            edge = np.concatenate([[0], np.flatnonzero(band[1:] != band[:-1]) + 1, [len(band)]])
            found = [(node[lo + x], node[lo + y]) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if hi - lo > 1 for x, y in forest_of(sketch[lo:hi], least)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            band = batch.column("band").to_numpy()
            cut = int(np.searchsorted(band, band[-1]))  # the last bucket may go on
            if cut or (held and held[-1].column("band")[0].as_py() != band[0]):
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield links(pa.Table.from_batches(held))

    # the smallest node comes first, as in the comparison with it, whose links are then found again and not others
    return members.repartition("band").sortWithinPartitions("band", "node").mapInArrow(run, "a long, b long")


def fewer_links(links: DataFrame) -> DataFrame:
    """Links (a, b) with the components of ``links``: each b keeps its smallest a, and its other a's hang on that one.

    Where many b have the same few a's, as in the buckets of a large group, they
    become one link each and a link for each pair of a's. The a's of one b are
    gathered: at most one a band from a bucket's smallest node and one from its
    spanning forest.
    """
    first = F.element_at("_over", 1)
    over = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("_over"))
    return over.select(first.alias("a"), F.explode(F.concat(F.array("b"), F.slice("_over", 2, F.size("_over")))).alias("b")).distinct()


def _plausible(member: DataFrame, sketches: DataFrame, cfg: NearDedup, scratch: Scratch) -> DataFrame:
    """Links (a, b) whose components hold each pair that shares a bucket and agrees often enough for a link."""
    pivot = scratch.keep(member.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1"), "pivots")
    star = scratch.keep(member.join(pivot, "band").where("node <> pivot").select("band", "m", F.col("pivot").alias("a"), F.col("node").alias("b")), "star")
    tested = scratch.keep(_agreeing(star.select("a", "b").distinct(), sketches, cfg), "tested")
    mixed = scratch.keep(star.join(tested.where("not near"), ["a", "b"]).select("band", "m").distinct(), "mixed")
    near = tested.where("near").select("a", "b")
    # what is too large to meet at once stays one cluster, and meets in blocks
    whole = star.join(mixed.where(F.col("m") > cfg.bucket).select("band"), "band", "left_semi").select("a", "b")
    small = member.join(mixed.where(F.col("m") <= cfg.bucket).select("band"), "band", "left_semi").join(sketches, "node").select("band", "node", "sketch")
    return scratch.keep(fewer_links(near.union(whole).union(_bucket_links(small, cfg))), "plausible")


def _whole_sets(texts: DataFrame, wanted: DataFrame, cfg: NearDedup) -> DataFrame:
    """The whole sets (cluster, node, members) of the classes in ``wanted``; a repeated row gives its set again, which changes no link."""
    some = texts.join(wanted.select("_rep", "_hash", "node", "cluster"), F.col("doc_id") == F.col("_rep"))

    def run(batches):
        for batch in batches:
            for lo, hi, sets, _ in shingle_sets(batch.column(3), cfg.width):
                want = batch.column(2).slice(lo, hi - lo).to_pylist()
                keep = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() == h for x, h in zip(sets, want, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary())], ["cluster", "node", "members"]).filter(keep)

    return some.select("cluster", "node", "_hash", "text").mapInArrow(run, "cluster long, node long, members binary")


def links_between(label: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], cfg: NearDedup) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links between rows of ``left`` and of ``right`` (masks), and the most typical row.

    ``label`` holds the components known so far; only pairs of different ones
    are looked at. Rows are taken in the order of their agreement with the
    majority signature, so that in a group around one text that text comes
    first and joins the others.
    """
    size = np.array([len(s) for s in sets])
    sig = super_minhash(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    ordered = np.sort(sig, axis=0)
    run = np.ones(SIGNATURE, np.int64)
    most, typical_value = run.copy(), ordered[0].copy()
    for k in range(1, len(ordered)):
        run = np.where(ordered[k] == ordered[k - 1], run + 1, 1)
        longer = run > most
        most[longer], typical_value[longer] = run[longer], ordered[k][longer]
    typical = (sig == typical_value).sum(1)
    label = np.unique(label, return_inverse=True)[1]
    own = np.flatnonzero(left)
    out = []
    for x in own[np.argsort(-typical[own], kind="stable")]:
        near = np.flatnonzero(right & (label != label[x]) & (np.minimum(size, size[x]) * cfg.denominator >= np.maximum(size, size[x]) * cfg.numerator))
        if not len(near):
            continue
        near = near[(sig[near] == sig[x]).sum(1) >= cfg.least_agreement]
        if not len(near):
            continue
        flat = np.concatenate([sets[y] for y in near])
        at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
        both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(size[near]) - size[near])
        for y in near[cfg.denominator * both >= cfg.numerator * (size[near] + size[x] - both)]:
            if label[y] != label[x]:
                out.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return out, int(np.argmax(typical))


_FOUND = "a long, b long"


def _linked(rows: DataFrame, cfg: NearDedup, keys: list[str]) -> DataFrame:
    """Links of each group of (node, label, side, members): side 0 meets side 1, side 2 meets all. A row (a, a) names a group's most typical node."""

    def run(t: pa.Table) -> pa.Table:
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("members")]
        found, typical = links_between(t.column("label").to_numpy(), side != 1, side != 0, sets, cfg)
        a, b = [node[x] for x, _ in found] + [node[typical]], [node[y] for _, y in found] + [node[typical]]
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # dealt by all keys: after a join by cluster Spark would leave all blocks of a cluster in one task
    return rows.repartition(*keys).groupBy(*keys).applyInArrow(run, _FOUND)


def _large_clusters(sets: DataFrame, blocks: DataFrame, links: DataFrame, label: DataFrame, cfg: NearDedup, scratch: Scratch) -> DataFrame:
    """All links, after blocks of one cluster met: first each block with the typical nodes of all, then block with block where components remain."""
    placed = sets.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    placed = scratch.keep(placed.join(label.select("node", F.col("component").alias("label")), "node"), "large")
    typical = placed.join(links.where("a = b").select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    spread = typical.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("side", F.lit(0))
    to_typical = _linked(placed.withColumn("side", F.lit(1)).unionByName(spread), cfg, ["cluster", "block"])
    links = scratch.keep(links.union(to_typical).where("a <> b"), "verified")
    nodes = placed.select("node").distinct()
    label = components(nodes, links.join(nodes, F.col("a") == F.col("node"), "left_semi"), scratch)
    again = placed.drop("label").join(label.select("node", F.col("component").alias("label")), "node")
    split = again.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cluster")
    rest = again.join(split, "cluster", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("other <> block")
    pairs = rest.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "label", (F.col("block") > F.col("other")).cast("int").alias("side"), "members")
    return scratch.keep(links.union(_linked(pairs, cfg, ["cluster", "p", "q"]).where("a <> b")), "verified")


def near_duplicates(docs: DataFrame, cfg: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, set_class, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a set holds the
    distinct runs of ``width`` words, or the whole sequence of a shorter text.
    Null and empty texts, and texts of blanks, have empty sets and are linked
    with nothing. A row without an id cannot be named: it is linked with
    nothing, its component is null and it is kept. Rows that repeat an id and
    text get the same component, so all are kept or none; of different texts
    under one id, each is in its own text's component. ``set_class`` is the
    smallest id with the same set. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(signatures(docs, cfg, id_col, text_col), "signatures")
    named = table.where("doc_id is not null and set_hash is not null")
    classes = scratch.keep(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    # a class is named by a number of its own: one id may have stood before several texts
    numbered = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    whole = named.select("doc_id", "set_hash", "bands", "sketch").join(numbered, "set_hash").where("doc_id = rep").dropDuplicates(["node"])
    whole = scratch.keep(whole.select("node", "bands", "sketch"), "bands")
    member = whole.select("node", F.explode("bands").alias("band"))
    star = _plausible(member, whole.select("node", "sketch"), cfg, scratch)
    scratch.drop("bands")
    scratch.release()
    nodes = scratch.keep(star.select(F.col("a").alias("node")).union(star.select("b")).distinct(), "nodes")
    cluster = components(nodes, star, scratch).withColumnRenamed("component", "cluster")
    wanted = numbered.join(cluster, "node").select(F.col("rep").alias("_rep"), F.col("set_hash").alias("_hash"), "node", "cluster")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = scratch.keep(_whole_sets(texts, wanted, cfg), "sets")
    scratch.release()
    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).select("cluster", F.ceil(F.col("m") / cfg.block).cast("int").alias("k"))
    large = scratch.keep(sizes.where("k > 1"), "blocks")
    block = F.pmod(F.xxhash64("node"), F.coalesce("k", F.lit(1))).cast("int")
    first = sets.join(large, "cluster", "left").withColumn("block", block).select("cluster", "block", "node", F.col("node").alias("label"), F.lit(2).alias("side"), "members")
    links = scratch.keep(_linked(first, cfg, ["cluster", "block"]), "verified")
    label = components(nodes, links.where("a <> b"), scratch)
    if large.limit(1).count():
        links = _large_clusters(sets, large, links, label, cfg, scratch)
        label = components(nodes, links, scratch)
    group = numbered.join(label, "node", "left").select("node", "set_hash", "rep", F.coalesce("component", "node").alias("component"))
    smallest = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    named_class = group.join(smallest, "component").select("set_hash", "rep", "component_id")
    return table.join(named_class, "set_hash", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("set_class"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )
