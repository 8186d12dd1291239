"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are words of a fixed lexicon, words and word beginnings that labelled
training rows single out, and patterns. Each voter fires on a document or not. The label model has a
firing rate per voter and class (hence its accuracy), fitted by EM over counts
of vote patterns of all documents; labelled training rows are clamped. Voters
are correlated given the class: each may depend on one other, in the tree of
dependencies with the largest conditional mutual information, and EM fits the
tree's rates, so that a voter that repeats another one adds nothing. A
logistic classifier is trained on the given labels and, where there is none,
the posterior labels of all documents, by Newton steps whose sums are taken
within partitions over the counted patterns, and scores every document.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.store import Scratch

# Insults that vote for the toxic class.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "pathetic", "trash", "worthless", "disgusting", "scum", "clown",
    "dumb", "fool", "imbecile", "jerk", "bastard", "bitch", "whore", "slut", "asshole", "retard",
    "idiota", "estúpido", "imbécil", "basura", "dummkopf", "abschaum", "arschloch", "schwachkopf", "crétin", "connard",
)

PATTERNS = ("two_insults", "three_insults", "dense_insults", "shouted_insult", "shouting")

#: Words are runs of letters: a-z and all bytes beyond ASCII.
_LETTERS = np.ones(256, bool)
_LETTERS[ord("a") : ord("z") + 1] = False
_LETTERS[128:] = False


@dataclass(frozen=True)
class Toxicity:
    """``labelled_rows`` bounds the labelled rows searched for words (the smallest hashes of ids).

    A word or beginning becomes a voter if ``min_precision`` of its documents
    are toxic, and if its log-likelihood ratio is so large that fewer than
    ``chance`` of all words would get there at random, both by documents and by
    different surroundings of the word, for copies of a document are no further
    evidence. Where one is the beginning of another, the one of larger ratio stands for both. The ``alone``
    ones with the largest ratios are a voter each. All others vote too, in
    ``bands`` voters of words of like ratio, so that the model's matrices do not
    grow with the number of words.
    """

    labelled_rows: int = 20_000
    alone: int = 128
    bands: int = 8
    min_precision: float = 0.7
    chance: float = 0.05
    rounds: int = 12
    threshold: float = 0.7


#: Lengths in bytes of the beginnings that may become voters; 0 is the whole word.
_LENGTHS = (0, 3, 4, 5, 6, 7, 8)


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(tx.hashes(tx.folded(data), np.array([0]), np.array([len(data)]))[0])


def _letters(col: pa.Array):
    """For blocks of rows: first, end, bytes, row offsets, word starts, ends, ranges and hashes."""
    data, offsets = tx.utf8(col)
    for lo, hi in tx.blocks(offsets):
        raw = data[offsets[lo] : offsets[hi]]
        low, off = tx.folded(raw), offsets[lo : hi + 1] - offsets[lo]
        starts, ends, of = tx.words(low, off, _LETTERS)
        yield lo, hi, raw, off, starts, ends, of, tx.hashes(low, starts, ends)


def _row_sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[of[1:]] - total[of[:-1]]


def _beginnings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words longer than ``length`` bytes their places and the hashes of their beginnings; of 0 the words themselves."""
    if not length:
        return np.arange(len(starts)), tx.hashes(low, starts, ends)
    at = np.flatnonzero(ends - starts > length)
    return at, tx.hashes(low, starts[at], starts[at] + length)


def _word_support(labelled: DataFrame) -> DataFrame:
    """Documents of each class that hold a word or a word's beginning: (length, word, text, toxic, clean)."""

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, raw, _, starts, ends, of, _ in _letters(batch.column(0)):
                low, row = tx.folded(raw), np.repeat(np.arange(len(of) - 1), np.diff(of))
                for length in _LENGTHS:
                    at, h = _beginnings(low, starts, ends, length)
                    order = np.lexsort((h, row[at]))
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (row[at][order][1:] != row[at][order][:-1])
                    at, h = at[order][new], h[order][new]
                    bad = y[lo + row[at]] == 1
                    u, first, back = np.unique(h, return_index=True, return_inverse=True)
                    text = [low[starts[k] : starts[k] + length if length else ends[k]].tobytes() for k in at[first]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(u), length, np.int32)), pa.array(u.view(np.int64)), pa.array(text, pa.binary()),
                            pa.array(np.bincount(back, bad, len(u)).astype(np.int64)), pa.array(np.bincount(back, ~bad, len(u)).astype(np.int64)),
                        ],
                        ["length", "word", "text", "toxic", "clean"],
                    )

    parts = labelled.select("text", "toxic").mapInArrow(run, "length int, word long, text binary, toxic long, clean long")
    return parts.groupBy("length", "word").agg(F.min("text").alias("text"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class _Nested:
    """Words none of which begins another: says whether a further one is nested with any."""

    def __init__(self, words: list[bytes]):
        self.sorted: list[bytes] = []
        for w in sorted(words, key=len):
            self.add(w)

    def add(self, word: bytes) -> bool:
        """Take ``word`` in unless it begins a known word or a known word begins it."""
        at = bisect.bisect_left(self.sorted, word)
        after, before = self.sorted[at : at + 1], self.sorted[max(at - 1, 0) : at]
        if (after and after[0].startswith(word)) or (before and word.startswith(before[0])):
            return False
        self.sorted.insert(at, word)
        return True


def _contexts(labelled: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """(length, word, toxic, clean) of ``keys``: in how many surroundings the word stands in documents of each class.

    A document's surroundings of a word are the words before and after its first
    place there. Copies of a document have the same ones and count once; near
    copies count once more for each change right beside the word.
    """
    by_length = [(length, np.sort(np.array([h for n, h in keys if n == length], np.uint64))) for length in sorted({n for n, _ in keys})]

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, raw, _, starts, ends, of, whole in _letters(batch.column(0)):
                low, row = tx.folded(raw), np.repeat(np.arange(len(of) - 1), np.diff(of))
                same = row[1:] == row[:-1]
                before, after = np.zeros(len(whole), np.uint64), np.zeros(len(whole), np.uint64)
                before[1:][same], after[:-1][same] = whole[:-1][same], whole[1:][same]
                around = before * np.uint64(0x9E3779B97F4A7C15) + after
                for length, known in by_length:
                    place, h = _beginnings(low, starts, ends, length) if length else (np.arange(len(whole)), whole)
                    found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                    place, h = place[found], h[found]
                    order = np.lexsort((place, h, row[place]))
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (row[place][order][1:] != row[place][order][:-1])
                    place, h = place[order][new], h[order][new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(h), length, np.int32)), pa.array(h.view(np.int64)), pa.array(around[place].view(np.int64)), pa.array(y[lo + row[place]] == 1)],
                        ["length", "word", "around", "bad"],
                    )

    each = labelled.select("text", "toxic").mapInArrow(run, "length int, word long, around long, bad boolean").distinct()
    return each.groupBy("length", "word").agg(F.count_if("bad").alias("toxic"), F.count_if(~F.col("bad")).alias("clean"))


def _mined(labelled: DataFrame, cfg: Toxicity, scratch: Scratch) -> list[tuple[int, int]]:
    """All (length, hash) that training labels single out, the best supported first; of nested beginnings only the best one."""
    support = scratch.keep(_word_support(labelled), "support")
    size = support.agg(F.count(F.lit(1)).alias("keys")).crossJoin(labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))).first()  # one row each
    if not size["bad"] or size["bad"] == size["n"]:
        return []
    least, rate = float(np.log(max(size["keys"], 1) / cfg.chance)), size["bad"] / size["n"]
    t, c = F.col("toxic"), F.col("clean")
    ratio = t * F.log(t / (t + c) / rate) + F.when(c > 0, c * F.log(c / (t + c) / (1 - rate))).otherwise(0.0)

    def singled_out(counts: DataFrame) -> DataFrame:
        return counts.where((t > 0) & (t >= cfg.min_precision * (t + c))).withColumn("ratio", ratio).where(F.col("ratio") >= least)

    # words of at most ``labelled_rows`` rows
    by_rows = {(r["length"], r["word"] & (2**64 - 1)): bytes(r["text"]) for r in singled_out(support).select("length", "word", "text").collect()}
    if not by_rows:
        return []
    best = [((r["length"], r["word"] & (2**64 - 1)), r["ratio"]) for r in singled_out(_contexts(labelled, list(by_rows))).collect()]
    best.sort(key=lambda r: (-r[1], len(by_rows[r[0]]), by_rows[r[0]], r[0][0]))
    nested = _Nested([w.encode() for w in LEXICON])
    return [key for key, _ in best if nested.add(by_rows[key])]


def _voters(mined: int, cfg: Toxicity) -> list[int]:
    """Which voter each mined word is, from 0: its own, or that of its band."""
    alone = min(mined, cfg.alone)
    rest = mined - alone
    bands = min(cfg.bands, rest)
    return list(range(alone)) + [alone + k * bands // rest for k in range(rest)]


def votes(docs: DataFrame, lexicon: list[tuple[int, int]], id_col: str = "doc_id", text_col: str = "text", voters: list[int] | None = None) -> DataFrame:
    """Per row: doc_id, the voters that fire as bits of ``fires``, and further features ``x``.

    ``lexicon`` holds (length, hash) of words (0) and beginnings, ``voters`` the
    voter of each (by default its own). ``x`` holds small whole numbers, so that
    equal patterns can be counted.
    """
    voter_of = np.arange(len(lexicon)) if voters is None else np.array(voters)
    n_lex = int(voter_of.max()) + 1
    by_length = []
    for length in sorted({n for n, _ in lexicon}):
        entry = np.array([k for k, (n, _) in enumerate(lexicon) if n == length])
        key = np.array([lexicon[k][1] for k in entry], np.uint64)
        by_length.append((length, np.sort(key), voter_of[entry[np.argsort(key)]]))

    def run(batches):
        for batch in batches:
            ids, fires, xs = [], [], []
            for lo, hi, raw, off, starts, ends, of, whole in _letters(batch.column(1)):
                n, low = hi - lo, tx.folded(raw)
                hits, voters = [], []
                for length, known, voter in by_length:
                    place, h = _beginnings(low, starts, ends, length) if length else (np.arange(len(whole)), whole)
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    found = np.flatnonzero(known[at] == h)
                    hits.append(place[found])
                    voters.append(voter[at[found]])
                hit = np.concatenate(hits)
                row = np.searchsorted(of, hit, "right") - 1
                counts = np.zeros((n, n_lex))
                np.add.at(counts, (row, np.concatenate(voters)), 1)
                caps = (raw >= 65) & (raw <= 90)
                small = (raw >= 97) & (raw <= 122)
                n_words = np.diff(of)
                n_caps, n_small = _row_sums(caps, off), _row_sums(small, off)
                shout = np.zeros(n)
                np.add.at(shout, row, caps[starts[hit]] & caps[np.minimum(starts[hit] + 1, len(raw) - 1)])
                total, kinds = counts.sum(1), (counts > 0).sum(1)
                dense = total / np.maximum(n_words, 1)
                caps_share = n_caps / np.maximum(n_caps + n_small, 1)
                pattern = np.stack([total >= 2, total >= 3, dense >= 0.01, shout > 0, caps_share > 0.5], 1)
                fired = np.concatenate([counts > 0, pattern], 1)
                fires += [r.tobytes() for r in np.packbits(fired, 1)]
                x = np.stack([np.minimum(total, 100), kinds, np.rint(np.minimum(dense * 100, 10) * 4), np.rint(caps_share * 32)], 1)
                ids.append(batch.column(0).slice(lo, n))
                xs += list(x.astype(np.int16))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(fires, pa.binary()), pa.array(xs, pa.list_(pa.int16()))], ["doc_id", "fires", "x"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fires binary, x array<smallint>")


@dataclass
class LabelModel:
    """Class prior, each voter's firing rate by class, and the voter it depends on (-1: none).

    ``given[v, f, c]`` is the firing rate of voter v in class c where its parent
    fires (f = 1) or not; without a parent both are ``rate[v, c]``.
    """

    prior: float
    rate: np.ndarray
    parent: np.ndarray
    given: np.ndarray | None = None

    def __post_init__(self):
        if self.given is None:
            self.given = np.repeat(self.rate[:, None, :], 2, 1)

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        hit, miss = np.log(self.given[:, :, 1] / self.given[:, :, 0]), np.log((1 - self.given[:, :, 1]) / (1 - self.given[:, :, 0]))
        above = fires[:, self.parent] & (self.parent >= 0)
        odds = np.where(fires, np.where(above, hit[:, 1], hit[:, 0]), np.where(above, miss[:, 1], miss[:, 0]))
        z = np.log(self.prior / (1 - self.prior)) + odds.sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bits(fires: pa.Array, n: int) -> np.ndarray:
    """The first ``n`` voters of each row of packed bits."""
    flat = np.frombuffer(b"".join(fires.to_pylist()), np.uint8).reshape(len(fires), -1)
    return np.unpackbits(flat, axis=1)[:, :n] > 0


def _features(fires: np.ndarray, x: pa.Array) -> np.ndarray:
    """What the classifier sees: a constant, the voters, and the scaled further features."""
    more = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fires), -1)
    return np.concatenate([np.ones((len(fires), 1)), fires, np.log1p(more[:, :2]), more[:, 2:3] / 4, more[:, 3:] / 32], 1)


def _summed(table: DataFrame, run) -> np.ndarray:
    """The sum of the arrays that ``run(batch)`` gives for the batches of ``table``: within partitions first, then entry by entry."""

    def partition(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = run(batch).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

    got = table.mapInArrow(partition, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(got))
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out


def _given(batch: pa.RecordBatch, fires: np.ndarray, model: LabelModel) -> np.ndarray:
    """The label where there is one, else the posterior."""
    given = batch.column("given").to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(given), model.posterior(fires), given)


def _moments(patterns: DataFrame, model: LabelModel) -> np.ndarray:
    """Posterior-weighted sums of ``f f'`` for both classes, over all patterns, with a constant voter in front."""
    n = len(model.parent)

    def run(batch):
        fires = _bits(batch.column("fires"), n)
        p, count = _given(batch, fires, model), batch.column("n").to_numpy().astype(float)
        f = np.concatenate([np.ones((len(fires), 1)), fires], 1)
        return np.stack([f.T @ (f * w[:, None]) for w in ((1 - p) * count, p * count)])

    total = _summed(patterns.select("fires", "given", "n"), run)
    return (total if len(total) else np.zeros(2 * (n + 1) ** 2)).reshape(2, n + 1, n + 1)


def _rates(m: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The model that the moments of both classes give; a parent's cell counts one more row of its voter's own rate."""
    size, fired, v = m[:, 0, 0], m[:, 0, 1:], np.arange(len(parent))
    rate = np.clip(((fired + 0.5) / (size[:, None] + 1)).T, 1e-6, 1 - 1e-6)
    both, above = m[:, 1 + v, 1 + parent], m[:, 0, 1 + parent]
    given = np.stack([(fired - both + rate.T) / (size[:, None] - above + 1), (both + rate.T) / (above + 1)]).transpose(2, 0, 1)
    given = np.where((parent >= 0)[:, None, None], np.clip(given, 1e-6, 1 - 1e-6), rate[:, None, :])
    return LabelModel(float(np.clip((size[1] + 1) / (size.sum() + 2), 1e-4, 0.5)), rate, parent, given)


def information(m: np.ndarray) -> np.ndarray:
    """Rows times the mutual information of each two voters given the class, from the moments of both classes."""
    total = np.zeros((m.shape[1] - 1,) * 2)
    for c in (0, 1):
        n, one = m[c, 0, 0], m[c, 0, 1:]
        if n <= 0:
            continue
        on = m[c, 1:, 1:]
        a, b = one[:, None], one[None]
        for cell, x, y in ((on, a, b), (a - on, a, n - b), (b - on, n - a, b), (n - a - b + on, n - a, n - b)):
            # sums of many parts may leave an empty cell a little off zero
            some = (cell > 1e-9) & (x > 1e-9) & (y > 1e-9)
            total += np.where(some, cell * np.log(np.where(some, cell * n / np.where(some, x * y, 1), 1)), 0)
    np.fill_diagonal(total, 0)
    return total


def dependencies(m: np.ndarray, chance: float) -> np.ndarray:
    """Each voter's parent in the spanning forest of largest information, or -1.

    A link needs so much information that among independent voters one of all
    links would reach it by ``chance``: twice the information has the tail
    exp(-x / 2) there, of two degrees of freedom.
    """
    gain = information(m)
    n = len(gain)
    least = np.log(max(n * (n - 1) / 2, 1) / chance)
    parent, best, reach, left = np.full(n, -1), np.full(n, -1), np.zeros(n), np.ones(n, bool)
    for _ in range(n):
        v = int(np.argmax(np.where(left, reach, -1)))
        left[v] = False
        parent[v] = best[v]
        nearer = left & (gain[v] >= least) & (gain[v] > reach)
        best[nearer], reach[nearer] = v, gain[v][nearer]
    return parent


def fit_label_model(patterns: DataFrame, n_voters: int, cfg: Toxicity) -> LabelModel:
    """EM over (fires, label or null, count) rows with voters that depend on each other.

    The tree of dependencies and the first rates come from the labelled rows, in
    which no posterior has counted a repeated voter twice yet. Without labels of
    both classes EM starts with independent voters that speak for toxicity, and
    the tree comes from its posteriors after half of the rounds.
    """
    model = LabelModel(0.1, np.tile([0.005, 0.3], (n_voters, 1)), np.full(n_voters, -1))
    m = _moments(patterns.where(F.col("given").isNotNull()), model)
    known = bool((m[:, 0, 0] > 0).all())
    if known:
        model = _rates(m, dependencies(m, cfg.chance))
    for k in range(cfg.rounds):
        m = _moments(patterns, model)
        turn = not known and k == cfg.rounds // 2
        new = _rates(m, dependencies(m, cfg.chance) if turn else model.parent)
        moved = np.abs(new.given - model.given).max() + abs(new.prior - model.prior)
        model = new
        if moved < 1e-4 and (known or k >= cfg.rounds // 2):
            break
    return model


def fit_classifier(patterns: DataFrame, model: LabelModel, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression on the labels and posteriors of (fires, x, given, n) rows, by Newton steps."""
    n_voters = len(model.parent)
    d = n_voters + 5
    w = np.zeros(d)
    penalty = np.full(d, ridge)
    penalty[0] = 1e-6
    for _ in range(steps):

        def run(batch, w=w):
            fires = _bits(batch.column("fires"), n_voters)
            y, count = _given(batch, fires, model), batch.column("n").to_numpy().astype(float)
            f = _features(fires, batch.column("x"))
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            return np.concatenate([f.T @ (f * (count * p * (1 - p))[:, None]), (f.T @ (count * (y - p)))[:, None]], 1)

        total = _summed(patterns, run)
        if not len(total):
            break
        total = total.reshape(d, d + 1)
        step = np.linalg.solve(total[:, :d] + np.diag(penalty), total[:, d] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, cfg: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    ``labels`` (doc_id, toxic) is learnt from only where crc32(doc_id) mod 3 is
    not 1; rows with a null id or label teach nothing and of labels that
    disagree on one id the larger counts. Null and empty texts fire no voter and
    get the score of such texts. A null id counts as not held out. Repeated rows
    are scored each, texts of equal features equally. Without labels the lexicon
    alone starts EM; an empty table gives an empty result. Other columns are not
    read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold != 1)
    some = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.labelled_rows))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    mined = _mined(scratch.keep(base.join(some, "doc_id").select("text", "toxic"), "labelled"), cfg, scratch)
    lexicon = [(0, _hash_of(w)) for w in LEXICON] + mined
    voters = list(range(len(LEXICON))) + [len(LEXICON) + k for k in _voters(len(mined), cfg)]
    n_voters = max(voters) + 1 + len(PATTERNS)
    table = scratch.keep(votes(base, lexicon, voters=voters), "votes")
    given = table.join(y, "doc_id", "left").groupBy("fires", "x", F.col("toxic").cast("double").alias("given")).agg(F.count(F.lit(1)).alias("n"))
    seen = scratch.keep(given, "features")
    patterns = scratch.keep(seen.groupBy("fires", "given").agg(F.sum("n").alias("n")), "patterns")
    model = fit_label_model(patterns, n_voters, cfg)
    w = fit_classifier(seen, model)
    threshold = cfg.threshold

    def run(batches):
        for batch in batches:
            f = _features(_bits(batch.column(2), n_voters), batch.column(3)) if len(batch) else np.zeros((0, len(w)))
            z = np.add.reduce(f * w, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "held_out", "score"])

    scored = table.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "fires", "x").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
