"""Ranked lexical search that scores each class of equal bags once.

A document's score for any item depends on its counts of the items' words and
on its length alone. So documents are restricted to the items' vocabulary while
they are read; those with the same counts and the same length term form a
class, and only classes are scored. Classes are grouped by the counts
themselves, with partial sums before the shuffle, so a third of all documents
in one class is one row of each task. Every task keeps the best classes of each
item that it has seen; the winners' members, by ascending id, make the result.

Items come in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.store import Scratch

#: Delimiters of the words ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``.
SIGNS = np.zeros(256, bool)
SIGNS[:128] = True
SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = False

#: What a null id counts as in the order of ids.
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Ranking:
    """``top`` documents for each item; a block of items holds at most ``block_bytes`` of text and ``block_items`` items, or one item."""

    top: int = 20
    block_bytes: int = 4 << 20
    block_items: int = 4096
    chunk_cells: int = 4 << 20


# ---- words -------------------------------------------------------------------


class Vocabulary:
    """The distinct words of a block of items, sorted by hash; ``find`` compares bytes, so that equal hashes of different words do no harm."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.empty(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if words else ends
        h = tx.hashes(data, starts, ends)
        order = np.argsort(h, kind="stable")
        if len(h) > 1 and (np.diff(h[order]) == 0).any():
            raise ValueError("two words of the items have the same hash")
        self.data, self.hashes = data, h[order]
        self.starts, self.lengths, self.number = starts[order], (ends - starts)[order], order.astype(np.int32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words in ``data`` those of the vocabulary: their places in the list, and their numbers."""
        if not len(self.hashes) or not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        h = tx.hashes(data, starts, ends)
        pos = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[pos] == h) & (self.lengths[pos] == ends - starts))
        pos = pos[hit]
        length = self.lengths[pos]
        same = np.ones(len(hit), bool)
        for lo in range(0, len(hit), 1 << 18):
            n = length[lo : lo + (1 << 18)]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(starts[hit[lo : lo + len(n)]], n) + step] != self.data[np.repeat(self.starts[pos[lo : lo + len(n)]], n) + step]
            same[lo + np.searchsorted(np.cumsum(n), np.flatnonzero(differ), "right")] = False
        return hit[same], self.number[pos[same]]


def words_of(text: str | None) -> list[bytes]:
    """The words of one text in turn."""
    data, offsets = tx.utf8(pa.array([text], pa.string()))
    data = tx.folded(data)
    starts, ends, _ = tx.words(data, offsets, SIGNS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _bags(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For blocks of a string column: the first row, each row's number of words, and its counted words as pairs of 32-bit word number and count."""
    data, offsets = tx.utf8(column)
    for lo, hi in tx.blocks(offsets):
        part = tx.folded(data[offsets[lo] : offsets[hi]])
        starts, ends, of = tx.words(part, offsets[lo : hi + 1] - offsets[lo], SIGNS)
        hit, number = vocabulary.find(part, starts, ends)
        row = np.searchsorted(of, hit, "right") - 1
        key, count = np.unique(row.astype(np.int64) << 32 | number, return_counts=True)
        pairs = np.stack([key & 0xFFFFFFFF, count], 1).astype("<u4")
        at = np.searchsorted(key >> 32, np.arange(hi - lo + 1))
        yield lo, np.diff(of), [pairs[at[k] : at[k + 1]].tobytes() for k in range(hi - lo)]


# ---- items -------------------------------------------------------------------


def item_blocks(items: DataFrame, cfg: Ranking) -> Iterator[list[Row]]:
    """The items (item_id, text) in blocks, fetched partition after partition; ``items`` must be written, so that it is read alike each time."""
    block: list[Row] = []
    size = 0
    for row in items.toLocalIterator():
        own = len((row["text"] or "").encode())
        if block and (len(block) == cfg.block_items or size + own > cfg.block_bytes):
            yield block
            block, size = [], 0
        block.append(row)
        size += own
    if block:
        yield block


class Queries:
    """The items of a block as postings by word number: which items hold it, and how often."""

    def __init__(self, bags: list[Counter], weight: np.ndarray):
        flat = sorted((t, k, n) for k, bag in enumerate(bags) for t, n in bag.items())
        self.item = np.array([k for _, k, _ in flat], np.int64)
        self.weight = np.array([n for _, _, n in flat], np.int64) * weight[np.array([t for t, _, _ in flat], np.int64)] if flat else np.empty(0, np.int64)
        self.first = np.searchsorted(np.array([t for t, _, _ in flat], np.int64), np.arange(len(weight) + 1))
        self.n = len(bags)

    def scores(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, n_rows: int) -> np.ndarray:
        """A matrix of scores, rows by items, from each row's words and what one unit of weight gains there."""
        out = np.zeros(n_rows * self.n, np.int64)
        order = np.argsort(term, kind="stable")
        edges = np.flatnonzero(np.diff(term[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # a word at a time: rows and items that hold it are each distinct
            own, t = order[a:b], int(term[order[a]])
            p = slice(self.first[t], self.first[t + 1])
            at = (row[own, None] * self.n + self.item[None, p]).ravel()
            out[at] += (gain[own, None] * self.weight[None, p]).ravel()
        return out.reshape(n_rows, self.n)


def _best(score: np.ndarray, first: np.ndarray, top: int) -> np.ndarray:
    """The places of the ``top`` highest positive scores, equal ones by ascending ``first``."""
    live = np.flatnonzero(score > 0)
    if len(live) > top:
        cut = np.partition(score[live], len(live) - top)[len(live) - top]
        live = live[score[live] >= cut]
    return live[np.lexsort((first[live], -score[live]))][:top]


def _winners(queries: Queries, top: int, cells: int):
    """A function over batches of (key, first, m, bag): each task's best classes of each item, as (item, key, first, score)."""

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = [(np.empty(0, np.int64), np.empty(0, np.int64), []) for _ in range(queries.n)]
        step = max(1, cells // max(queries.n, 1))
        for batch in batches:
            keys, firsts, ms, bags = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
            for lo in range(0, batch.num_rows, step):
                hi = min(lo + step, batch.num_rows)
                own = [np.frombuffer(b.as_buffer(), "<u4").reshape(-1, 2).astype(np.int64) for b in bags[lo:hi]]
                row = np.repeat(np.arange(hi - lo), [len(b) for b in own])
                flat = np.concatenate(own)
                tf = flat[:, 1]
                score = queries.scores(row, flat[:, 0], (1_000_000_000 * tf) // (1000 * tf + 12 * ms[lo:hi][row]), hi - lo)
                for k in np.flatnonzero((score > 0).any(0)).tolist():
                    s, f, names = kept[k]
                    found = _best(score[:, k], firsts[lo:hi], top)
                    if len(s) == top and len(found) and score[found[0], k] < s[-1]:
                        continue
                    s, f = np.concatenate([s, score[found, k]]), np.concatenate([f, firsts[lo:hi][found]])
                    names = [*names, *(keys[lo + x].as_py() for x in found.tolist())]
                    best = _best(s, f, top)
                    kept[k] = (s[best], f[best], [names[x] for x in best.tolist()])
        for k, (s, f, names) in enumerate(kept):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(names, pa.binary()), pa.array(f), pa.array(s)], ["item", "key", "first", "score"])

    return run


def _search(rows: DataFrame, block: list[Row], cfg: Ranking, scratch: Scratch) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items, numbered from 0."""
    found = [Counter(words_of(r["text"])) for r in block]
    words = sorted(set().union(*found))
    number = {w: k for k, w in enumerate(words)}
    size = len(words)

    def bag(batches):
        vocabulary = Vocabulary(words)
        for batch in batches:
            for lo, n, bags in _bags(batch.column(1), vocabulary):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(bags)), pa.array(n.astype(np.int64)), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    def frequency(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")[::2]
            total += np.bincount(terms, minlength=size)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], ["term", "df"])

    bags = scratch.keep(rows.mapInArrow(bag, "doc_id long, n long, bag binary"), "bags")
    whole = bags.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_words = whole["N"], whole["L"]
    if not size or not n_words:
        return scratch.spark.createDataFrame([], "item int, rank int, doc_id long, score long")
    held = bags.where(F.octet_length("bag") > 0)
    counts = held.select("bag").mapInArrow(frequency, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # one row for each word of the block
    weight = np.zeros(size, np.int64)
    for r in counts:
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    m = F.expr(f"75L + (25L * n * {n_docs}L) div {n_words}L").alias("m")
    own = held.select(F.coalesce("doc_id", F.lit(_LAST)).alias("first"), m, "bag").withColumn("key", F.unhex(F.sha2(F.concat(F.col("m").cast("string").cast("binary"), F.lit(b":"), F.col("bag")), 256)))
    classes = scratch.keep(own.groupBy("key", "m", "bag").agg(F.min("first").alias("first")), "classes")
    queries = Queries([Counter({number[w]: n for w, n in c.items()}) for c in found], weight)
    scored = classes.select("key", "first", "m", "bag").mapInArrow(_winners(queries, cfg.top, cfg.chunk_cells), "item int, key binary, first long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first", "key")
    best = scratch.keep(scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cfg.top).drop("_r"), "winners")
    # at most top keys for each item of the block
    keys = F.broadcast(best.select("key").distinct())
    if classes.join(keys, "key").groupBy("key").count().where("count > 1").limit(1).count():
        raise RuntimeError("two classes have the same digest")
    members = own.select("key", "first").join(keys, "key").withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("first"))).where(F.col("_r") <= cfg.top)
    ranked = best.select("item", "key", "score").join(members.select("key", "first"), "key")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "first"))).where(F.col("rank") <= cfg.top)
    return ranked.select("item", "rank", F.nullif("first", F.lit(_LAST)).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, cfg: Ranking = Ranking(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per item its ``top`` documents of highest score: item_id, rank (from 1), doc_id, score.

    Null texts hold no words; documents without words count nowhere, items
    without words have no rows. Each row of ``items`` is an item of its own,
    and each row of ``docs`` a document: rows that repeat an id are ranked
    singly, a null id comes after all others of its score. Empty tables give no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = scratch.keep(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "items")
    kind = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(asked, cfg):
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(block)], f"item int, item_id {kind}")
        out = out.unionByName(_search(rows, block, cfg, scratch).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # one row an item of the block
    return out


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
), c AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws)) AS l FROM w),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM w) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(c.n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, c GROUP BY t),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * c.n) // c.l AS m FROM w, c),
s AS (SELECT item_id, m.doc_id, m.r, CAST(sum(q.k * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score FROM tf JOIN q ON q.t = tf.t JOIN df ON df.t = tf.t JOIN m ON m.r = tf.r GROUP BY item_id, m.doc_id, m.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
