"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

The corpus becomes chunks: a few million tokens as codes into the chunk's own
sorted vocabulary. All counting is per chunk first, and what is shuffled are
packed blocks of distinct keys, one for each chunk and bucket of a table:

1. words: buckets of words sum the chunks' counts and answer each chunk with
   ids and totals;
2. bigrams: buckets of histories sum the chunks' bigrams, keep the table of
   histories and answer each chunk with the totals of its bigrams;
3. backoff weights: once the global counts of counts give the discounts, each
   bucket answers each chunk with the weights of its histories;
4. scores: each chunk looks up its tokens, recursively: the discounted bigram,
   else the history's weight times the discounted unigram.

A block is bounded by its chunk and a bucket by the number of buckets, which
follows the corpus. Histories too frequent for one bucket are spread over
several by the word that follows; their sums are added up apart.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.store import Scratch

#: Counts up to this are discounted.
LAST_DISCOUNTED = 5

_END = np.uint64(0xE1D0C0DE5EED0001)
_START_ID = np.uint32(0xFFFFFFFF)


@dataclass(frozen=True)
class Katz:
    chunk_tokens: int = 2_000_000
    words_per_bucket: int = 2_000_000
    tokens_per_bucket: int = 3_000_000
    hot_history: int = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, byte plane after byte plane."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    raw = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize)
    return bytes([np.dtype(kind).itemsize]) + raw.T.tobytes()


def unpack(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if len(raw) == 1:
        return np.empty(0, np.int64)
    return np.ascontiguousarray(raw[1:].reshape(raw[0], -1).T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing ratios d[0..LAST_DISCOUNTED], from the numbers ``n[r]`` of keys seen r times.

    Katz's formula, with the largest cut-off for which all ratios lie in (0, 1];
    where the counts of counts allow none, absolute discounting.
    """
    d = np.ones(LAST_DISCOUNTED + 1)
    for k in range(LAST_DISCOUNTED, 0, -1):
        if min(n[1 : k + 2]) <= 0:
            continue
        common = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        ratio = (((r + 1) * np.array(n[2 : k + 2])) / (r * np.array(n[1 : k + 1])) - common) / (1 - common) if common < 1 else np.zeros(k)
        if ((ratio > 0) & (ratio <= 1)).all() and ratio[0] < 1:
            d[1 : k + 1] = ratio
            return d
    r = np.arange(1, LAST_DISCOUNTED + 1)
    less = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d[1:] = (r - min(max(less, 0.1), 0.9)) / r
    return d


@dataclass
class Unigrams:
    """Discounted unigram probabilities; all words never seen share the freed mass as one word."""

    total: int
    distinct: int
    d: np.ndarray
    unseen: float
    scale: float

    @classmethod
    def of(cls, total: int, distinct: int, n: list[int]) -> Unigrams:
        d = discounts(n)
        freed = sum((1 - d[r]) * r * n[r] for r in range(1, LAST_DISCOUNTED + 1))
        if not total:
            return cls(0, 0, d, 1.0, 1.0)
        if freed <= 0:  # nothing to discount: one more occurrence, of an unseen word
            return cls(total, distinct, np.ones_like(d), 1 / (total + 1), 1 / (total + 1))
        return cls(total, distinct, d, freed / total, 1 / total)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.where(c <= LAST_DISCOUNTED, c, 0)] * c * self.scale, self.unseen)


def counts_of_counts(totals: np.ndarray) -> list[int]:
    return [int((totals == r).sum()) for r in range(LAST_DISCOUNTED + 2)]


# ---- chunks ------------------------------------------------------------------


def _chunks(docs: DataFrame, cfg: Katz) -> DataFrame:
    """Rows (chunk, ids, held, lengths, words, counts, codes, n)."""
    limit = cfg.chunk_tokens
    names = ["chunk", "ids", "held", "lengths", "words", "counts", "codes", "n_words", "n_tokens"]

    def emit(number, parts):
        ids, held, n, h = (np.concatenate(x) if k else [v for y in x for v in y] for k, x in enumerate(zip(*parts, strict=True)))
        at = np.cumsum(n) - 1
        tokens = np.empty(int(n.sum()), np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[at] = False
        tokens[inside], tokens[at] = h, _END
        words, codes = np.unique(tokens, return_inverse=True)
        counts = np.bincount(codes[~np.repeat(held, n)], minlength=len(words))
        columns = [[number], [ids], [held.tobytes()], [pack(n)], [words.tobytes()], [pack(counts)], [pack(codes)], [len(words)], [len(tokens)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches):
        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, h, of in tx.word_hashes(batch.column(2)):
                parts.append((batch.column(0).slice(lo, hi - lo).to_pylist(), held[lo:hi], np.diff(of) + 1, h))
                size += len(h) + hi - lo
                if size >= limit:
                    yield emit(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield emit(number, parts)

    return docs.mapInArrow(run, "chunk long, ids array<long>, held binary, lengths binary, words binary, counts binary, codes binary, n_words long, n_tokens long")


def _dealt(bucket: np.ndarray, n: int):
    """For each bucket that has any: its number and the positions in it, in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def _of(words: np.ndarray, n: int) -> np.ndarray:
    return (tx.mix(words) % np.uint64(n)).astype(np.int64)


# ---- words -------------------------------------------------------------------

_WORD_BLOCK = "bucket int, chunk long, words binary, counts binary"
_REPLY = "kind string, bucket int, chunk long, a binary, b binary, n array<long>"
_REPLY_NAMES = ["kind", "bucket", "chunk", "a", "b", "n"]
_REPLY_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _word_totals(chunks: DataFrame, buckets: int) -> DataFrame:
    """Answers for each chunk and bucket, kind w: ids and totals; a row for each bucket, kind n: N, V, counts of counts."""

    def send(batches):
        for batch in batches:
            for chunk, words, counts in zip(*batch.columns, strict=True):
                w, c = np.frombuffer(words.as_buffer(), np.uint64), unpack(counts.as_buffer())
                rows = [(b, chunk.as_py(), w[at].tobytes(), pack(c[at])) for b, at in _dealt(_of(w, buckets), buckets)]
                yield from _table(rows, ["bucket", "chunk", "words", "counts"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]).to_batches()

    def add(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("words")]
        u, at = np.unique(np.concatenate(words), return_inverse=True)
        totals = np.bincount(at, np.concatenate([unpack(x.as_buffer()) for x in t.column("counts")]), len(u)).astype(np.int64)
        ids = np.arange(len(u), dtype=np.int64) * buckets + bucket
        if ids[-1] >= int(_START_ID):
            raise OverflowError("more than 4 billion distinct words")
        rows, lo = [("n", bucket, None, None, None, [int(totals.sum()), int((totals > 0).sum()), *counts_of_counts(totals)])], 0
        for chunk, w in zip(t.column("chunk").to_pylist(), words, strict=True):
            own = at[lo : lo + len(w)]
            rows.append(("w", bucket, chunk, pack(ids[own]), pack(totals[own]), None))
            lo += len(w)
        return _table(rows, _REPLY_NAMES, _REPLY_TYPES)

    return chunks.select("chunk", "words", "counts").mapInArrow(send, _WORD_BLOCK).groupBy("bucket").applyInArrow(add, _REPLY)


# ---- bigrams -----------------------------------------------------------------


class Chunk:
    """A chunk with its words' ids and totals, its distinct bigrams and the buckets they go to."""

    def __init__(self, row: pa.Table, replies: pa.Table, word_buckets: int, buckets: int, hot: int):
        get = lambda name: row.column(name)[0].as_buffer()
        words = np.frombuffer(get("words"), np.uint64)
        self.lengths, self.codes = unpack(get("lengths")), unpack(get("codes"))
        self.held = np.frombuffer(get("held"), bool)
        self.docs = row.column("ids")[0].as_py()
        n = len(words)
        ids, self.totals = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        places = dict(_dealt(_of(words, word_buckets), word_buckets))
        for kind, bucket, a, b in zip(*[replies.column(c) for c in ("kind", "bucket", "a", "b")], strict=True):
            if kind.as_py() == "w":
                at = places[bucket.as_py()]
                ids[at], self.totals[at] = unpack(a.as_buffer()), unpack(b.as_buffer())
        ids[n] = int(_START_ID)
        end = int(np.searchsorted(words, _END))
        self.totals[n] = self.totals[end] if end < n else 0  # as many starts as ends
        history = np.concatenate([[n], self.codes[:-1]])
        history[np.cumsum(self.lengths)[:-1]] = n
        keys, self.back = np.unique(history * np.int64(n + 1) + self.codes, return_inverse=True)
        self.h, self.w = keys // (n + 1), keys % (n + 1)
        self.ids = ids
        spread = np.maximum(1, -(-self.totals[self.h] // hot))
        self.hot = spread > 1
        salt = np.where(self.hot, 1 + ids[self.w] % spread, 0)
        bucket = (tx.mix(ids[self.h].astype(np.uint64) + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        self.places = dict(_dealt(bucket, buckets))

    def runs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The histories of the bigrams at ``at`` as (first positions, run lengths)."""
        h = self.h[at]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return first, np.diff(np.append(first, len(h)))


_PAIR_BLOCK = "bucket int, chunk long, history binary, hot binary, runs binary, word binary, total binary, count binary"
_PAIR_NAMES = [x.split()[0] for x in _PAIR_BLOCK.split(", ")]
_TABLE = "kind string, bucket int, chunk long, counts binary, n array<long>, hot binary, ids binary, c binary, r binary, s binary, chunks array<long>, at array<binary>"
_TABLE_NAMES = [x.split()[0] for x in _TABLE.split(", ")]
_TABLE_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.binary())]


def _bigram_totals(chunks: DataFrame, replies: DataFrame, unigrams: Unigrams, word_buckets: int, buckets: int, hot: int) -> DataFrame:
    """Kind c: for each chunk and bucket the totals of its bigrams. Kind t: for each bucket its histories and who asked for them."""

    def send(row: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(row, answers, word_buckets, buckets, hot)
        learnt = np.bincount(c.back[~np.repeat(c.held, c.lengths)], minlength=len(c.h))
        rows = []
        for b, at in c.places.items():
            first, runs = c.runs(at)
            rows.append((b, row.column("chunk")[0].as_py(), pack(c.ids[c.h[at[first]]]), pack(c.hot[at[first]]), pack(runs), pack(c.ids[c.w[at]]), pack(c.totals[c.w[at]]), pack(learnt[at])))
        return _table(rows, _PAIR_NAMES, [pa.int32(), pa.int64(), *[pa.binary()] * 6])

    def add(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        get = lambda name: [unpack(x.as_buffer()) for x in t.column(name)]
        history, runs, words = get("history"), get("runs"), get("word")
        key = np.concatenate([(np.repeat(h, r).astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64) for h, r, w in zip(history, runs, words, strict=True)])
        u, at = np.unique(key, return_inverse=True)
        del key
        totals = np.bincount(at, np.concatenate(get("count")), len(u)).astype(np.int64)
        own = np.zeros(len(u), np.int64)
        own[at] = np.concatenate(get("total"))
        h, back = np.unique((u >> np.uint64(32)).astype(np.int64), return_inverse=True)
        seen = totals > 0
        c = np.bincount(back, totals, len(h)).astype(np.int64)
        r = np.stack([np.bincount(back, totals == k, len(h)) for k in range(1, LAST_DISCOUNTED + 1)], 1).astype(np.int64)
        s = np.bincount(back, np.where(seen, unigrams(own), 0.0), len(h))
        is_hot = np.zeros(len(h), bool)
        for ids, flags in zip(history, get("hot"), strict=True):
            is_hot[np.searchsorted(h, ids)] |= flags > 0
        rows, lo, asked = [], 0, []
        blank = [None] * 7
        for chunk, ids, w in zip(t.column("chunk").to_pylist(), history, words, strict=True):
            rows.append(("c", bucket, chunk, pack(totals[at[lo : lo + len(w)]]), None, *blank))
            asked.append((chunk, pack(np.searchsorted(h, ids))))
            lo += len(w)
        rows.append(("t", bucket, None, None, counts_of_counts(totals), pack(is_hot), pack(h), pack(c), pack(r.ravel()), s.tobytes(), [x for x, _ in asked], [x for _, x in asked]))
        return _table(rows, _TABLE_NAMES, _TABLE_TYPES)

    sent = chunks.groupBy("chunk").cogroup(replies.where("kind = 'w'").groupBy("chunk")).applyInArrow(send, _PAIR_BLOCK)
    return sent.groupBy("bucket").applyInArrow(add, _TABLE)


def _hot_sums(table: DataFrame) -> dict[int, tuple]:
    """Of the histories that were spread over buckets: (c, counts of counts, seen mass). There are at most as many as buckets."""

    def run(batches):
        for batch in batches:
            for hot, ids, c, r, s in zip(*batch.columns, strict=True):
                at = np.flatnonzero(unpack(hot.as_buffer()))
                r = unpack(r.as_buffer()).reshape(-1, LAST_DISCOUNTED)[at]
                columns = [unpack(ids.as_buffer())[at], unpack(c.as_buffer())[at], *r.T, np.frombuffer(s.as_buffer())[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "c", *(f"r{k}" for k in range(LAST_DISCOUNTED)), "s"])

    rs = [f"r{k}" for k in range(LAST_DISCOUNTED)]
    rows = table.where("kind = 't'").select("hot", "ids", "c", "r", "s").mapInArrow(run, "id long, c long, " + ", ".join(f"{r} long" for r in rs) + ", s double")
    return {x["id"]: (x["c"], [x[r] for r in rs], x["s"]) for x in rows.groupBy("id").agg(*[F.sum(v).alias(v) for v in ("c", *rs, "s")]).collect()}


def backoff(c: np.ndarray, r: np.ndarray, s: np.ndarray, d: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """The weight and the divisor of each history, from its count, its bigrams seen r times and the unigram mass of its seen words.

    Seen words get ``d*count/divisor``; what that leaves is shared by the others
    in proportion to their unigram mass. A history without discounted bigrams
    gets a divisor larger by 1, so that something is left.
    """
    freed = (r * ((1 - d[1:]) * np.arange(1, LAST_DISCOUNTED + 1))).sum(1)
    divisor = np.where(freed > 1e-9, c, c + 1).astype(float)
    left = np.where(freed > 1e-9, freed, 1.0) / np.maximum(divisor, 1)
    return np.where(c > 0, left / np.maximum(1 - s, unigrams.unseen), 1.0), np.maximum(divisor, 1)


def _weights(table: DataFrame, d: np.ndarray, unigrams: Unigrams, hot: dict[int, tuple]) -> DataFrame:
    """Kind a: for each chunk and bucket the backoff weights and divisors of its histories."""

    def run(batches):
        for batch in batches:
            for bucket, flags, ids, c, r, s, chunks, ats in zip(*batch.columns, strict=True):
                flags, ids, c = (unpack(x.as_buffer()) for x in (flags, ids, c))
                r, s = unpack(r.as_buffer()).reshape(-1, LAST_DISCOUNTED).copy(), np.frombuffer(s.as_buffer()).copy()
                for k in np.flatnonzero(flags):
                    c[k], r[k], s[k] = hot[int(ids[k])]
                weight, divisor = backoff(c, r, s, d, unigrams)
                for chunk, at in zip(chunks, ats, strict=True):
                    at = unpack(at.as_buffer())
                    yield from _table([("a", bucket.as_py(), chunk.as_py(), weight[at].tobytes(), pack(divisor[at].astype(np.int64)), None)], _REPLY_NAMES, _REPLY_TYPES).to_batches()

    return table.where("kind = 't'").select("bucket", "hot", "ids", "c", "r", "s", "chunks", "at").mapInArrow(run, _REPLY)


# ---- scores ------------------------------------------------------------------


def _scores(chunks: DataFrame, replies: DataFrame, d: np.ndarray, unigrams: Unigrams, word_buckets: int, buckets: int, hot: int) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(row, answers, word_buckets, buckets, hot)
        seen, weight, divisor = np.zeros(len(c.h), np.int64), np.ones(len(c.h)), np.ones(len(c.h))
        for kind, bucket, a, b in zip(*[answers.column(x) for x in ("kind", "bucket", "a", "b")], strict=True):
            kind = kind.as_py()
            if kind == "w":
                continue
            at = c.places[bucket.as_py()]
            if kind == "c":
                seen[at] = unpack(a.as_buffer())
            else:
                _, runs = c.runs(at)
                weight[at], divisor[at] = np.repeat(np.frombuffer(a.as_buffer()), runs), np.repeat(unpack(b.as_buffer()), runs)
        own = c.totals[c.w]
        p = np.where(seen > 0, d[np.where(seen <= LAST_DISCOUNTED, seen, 0)] * seen / divisor, weight * unigrams(own))
        base = np.log10((own + 0.5) / (unigrams.total + 0.5 * (unigrams.distinct + 1)))
        first = np.cumsum(c.lengths) - c.lengths
        sums = [np.add.reduceat(x[c.back], first) for x in ((own > 0).astype(np.int64), base, np.log10(p))]
        columns = [c.docs, c.held, c.lengths, sums[0], np.full(len(first), unigrams.total), sums[1], sums[2]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def katz_scores(docs: DataFrame, cfg: Katz = Katz(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from rows whose crc32(doc_id) mod 5 is not 1; a null id counts as
    such. Tokens are words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, then
    one end, also of null and empty texts. ``base_score`` is an add-one-half
    unigram model, ``score`` the Katz bigram model, over a closed vocabulary plus
    one word for all unseen ones. Repeated rows are counted and scored each. With
    no training row every probability is 1; an empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    key = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))
    name, n_files = f"graphprop_chunks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bucketed by chunk, so that answers are shuffled to the chunks and chunks stay where they are
    _chunks(docs.select(key.alias("doc_id"), held.alias("held"), F.col(text_col).alias("text")), cfg).write.bucketBy(n_files, "chunk").option("compression", "zstd").option("path", scratch.path("chunks")).saveAsTable(name)
    try:
        chunks = spark.table(name)
        size = chunks.agg(F.sum("n_words").alias("w"), F.sum("n_tokens").alias("t")).first()
        word_buckets = max(1, -(-(size["w"] or 0) // cfg.words_per_bucket))
        buckets = max(1, -(-(size["t"] or 0) // cfg.tokens_per_bucket))
        words = scratch.keep(_word_totals(chunks, word_buckets), "words")
        n = [0] * (LAST_DISCOUNTED + 4)
        for r in words.where("kind = 'n'").select(F.posexplode("n").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
            n[r.k] = r.v
        unigrams = Unigrams.of(n[0], n[1], n[2:])
        hot = max(cfg.hot_history, unigrams.total // buckets)
        table = scratch.keep(_bigram_totals(chunks, words, unigrams, word_buckets, buckets, hot), "bigrams")
        n = [0] * (LAST_DISCOUNTED + 2)
        for r in table.where("kind = 't'").select(F.posexplode("n").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
            n[r.k] = r.v
        d = discounts(n)
        weights = scratch.keep(_weights(table, d, unigrams, _hot_sums(table)), "weights")
        answers = words.where("kind = 'w'").unionByName(weights).unionByName(table.where("kind = 'c'").select("kind", "bucket", "chunk", F.col("counts").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("array<long>").alias("n")))
        return scratch.keep(_scores(chunks, answers.select("kind", "bucket", "chunk", "a", "b"), d, unigrams, word_buckets, buckets, hot), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
