from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE_TEXTS, blank_words, documents

from graphprop.llm import katz
from graphprop.llm.katz import Katz, katz_scores


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Brute:
    """The same model over dictionaries."""

    def __init__(self, rows):
        uni, bi = Counter(), Counter()
        for i, t in rows:
            if not held(i):
                w = [*blank_words(t), "</s>"]
                uni.update(w)
                bi.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.uni, self.bi, self.n, self.v = uni, bi, sum(uni.values()), len(uni)
        tally = lambda c: [0, *[sum(x == r for x in c.values()) for r in range(1, 7)]]
        self.u = katz.Unigrams.of(self.n, self.v, tally(uni))
        self.d = katz.discounts(tally(bi))
        self.history = Counter()
        self.next = {}
        for (h, w), c in bi.items():
            self.history[h] += c
            self.next.setdefault(h, {})[w] = c

    def p1(self, w):
        return float(self.u(np.array([self.uni[w]]))[0])

    def p(self, w, h):
        if not self.history[h]:
            return self.p1(w)
        seen = self.next[h]
        freed = sum((1 - self.d[c]) * c for c in seen.values() if c <= 5)
        total = self.history[h] if freed > 1e-9 else self.history[h] + 1
        if w in seen:
            return (self.d[seen[w]] if seen[w] <= 5 else 1) * seen[w] / total
        left = (freed if freed > 1e-9 else 1) / total
        return left / max(1 - sum(self.p1(x) for x in seen), self.u.unseen) * self.p1(w)

    def row(self, i, t):
        w = [*blank_words(t), "</s>"]
        base = sum(math.log10((self.uni[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        own = sum(math.log10(self.p(x, h)) for h, x in zip(["<s>", *w[:-1]], w, strict=True))
        return held(i), len(w), sum(self.uni[x] > 0 for x in w), self.n, base, own


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    return [(100 + k, " ".join(rng.choice("abcdefghij") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 60)))) for k in range(n)] + [(1000, "b a " * 300)]


@pytest.mark.parametrize("cfg", [Katz(), Katz(chunk_tokens=100, words_per_bucket=20, tokens_per_bucket=300, hot_history=40)])
def test_agrees_with_dictionaries(spark, cfg):
    rows = corpus() + EDGE_TEXTS
    brute = Brute(rows)
    out = katz_scores(documents(spark, rows), cfg).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        r, want = by[i], brute.row(i, t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert math.isclose(r.base_score, want[4], rel_tol=1e-9) and math.isclose(r.score, want[5], rel_tol=1e-9)


def test_probabilities_sum_to_one():
    b = Brute(corpus(2))
    words = list(b.uni)
    for h in [*words[:8], "<s>", "never"]:
        assert math.isclose(sum(b.p(w, h) for w in words) + b.p("unseen word", h), 1, rel_tol=1e-9)


def test_only_held_out_rows_and_empty_table(spark):
    i = next(k for k in range(100) if held(k))
    r = katz_scores(documents(spark, [(i, "a b")])).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)
    assert katz_scores(documents(spark, [])).collect() == []


def test_pack_round_trip():
    for a in ([], [0], [255, 256, 1], [2**40, 3], list(range(1000))):
        assert katz.unpack(katz.pack(np.array(a, np.int64))).tolist() == a


def test_discounts():
    d = katz.discounts([0, 1000, 400, 220, 140, 95, 70])
    assert ((d[1:] > 0) & (d[1:] <= 1)).all() and d[1] < d[3]
    assert (katz.discounts([0, 0, 0, 0, 0, 0, 0])[1:] < 1).all()
