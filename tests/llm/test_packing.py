from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from helpers import EDGE_TEXTS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from graphprop.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = [
    *EDGE_TEXTS,
    (20, "It's THE end, isn't it? we've 12345 words..!! <|endoftext|> x<|startoftext|>y"),
    (21, "İstanbul ÇÉÀ ß ﬁ é  wide blank \x0bvt \x1cfs ΣΑΣ"),
    (22, "word " * 5000),
    (23, "tok " * 2047),
    (24, "tok " * 2048),
    (25, "\u0000 nul \u007f del"),
]


def test_ids_and_places(spark):
    out = packing.packed(documents(spark, TEXTS), PATH, with_ids=True).collect()
    want = {}
    for i, t in TEXTS:
        ids = ids_of(t)
        for p, a in enumerate(range(0, len(ids), 2048)):
            want.setdefault((i, p), []).append((a, ids[a : a + 2048]))
    assert len(out) == sum(map(len, want.values()))
    for r in out:
        start, ids = want[r.doc_id, r.piece][0]
        assert (r.start, r.length, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) == -(-total // 2048)


def test_sequences_hold_the_ids(spark):
    p = packing.packed(documents(spark, TEXTS[:6]), PATH, with_ids=True)
    assert sum(len(r.ids) for r in packing.sequences(p).collect()) == sum(len(ids_of(t)) for _, t in TEXTS[:6])


def test_empty_table(spark):
    assert packing.packed(documents(spark, []), PATH).collect() == []


def whole(plan, counts):
    got = np.zeros_like(counts)
    for pattern, times in plan:
        assert times > 0 and sum(a * n for a, n in pattern) <= len(counts) - 1
        for a, n in pattern:
            got[a] += n * times
    return (got == counts).all()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
def test_plans_hold_every_piece(some):
    counts = np.zeros(61, np.int64)
    for k, n in some.items():
        counts[k] = n
    fit, own = packing.best_fit(counts, 60), packing.bin_completion(counts, 60)
    assert whole(fit, counts) and whole(own, counts)
    assert sum(n for _, n in own) <= sum(n for _, n in fit)
    assert sum(n for _, n in own) >= -(-int((counts * np.arange(61)).sum()) // 60)


def test_completion_beats_best_fit():
    counts = np.zeros(101, np.int64)
    for k in (60, 50, 40, 30, 20):  # 60+40, 50+50, 30+30+40, ...
        counts[k] = 7
    counts[35] = 20
    own = sum(n for _, n in packing.bin_completion(counts, 100))
    assert own <= sum(n for _, n in packing.best_fit(counts, 100))


def fewest(counts, capacity):
    """The optimum, by trying every filling of each sequence in turn."""

    @functools.cache
    def best(left):
        top = max((k for k, n in enumerate(left) if n), default=0)
        if not top:
            return 0
        return 1 + min(best(rest) for rest in fillings(left, top, capacity, True))

    def fillings(left, k, room, first=False):
        if not k:
            yield left
            return
        for n in range(int(first), min(left[k], room // k) + 1):
            yield from fillings((*left[:k], left[k] - n, *left[k + 1 :]), k - 1, room - n * k)

    return best(tuple(int(n) for n in counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 4), max_size=4))
def test_the_whole_search_finds_the_optimum(some):
    counts = np.zeros(17, np.int64)
    for k, n in some.items():
        counts[k] = n
    own = packing.bin_completion(counts, 16, nodes=10**6)
    assert whole(own, counts)
    assert sum(n for _, n in own) == fewest(counts, 16)


def test_long_fillings_less_often_than_the_counts_allow():
    counts = np.zeros(2049, np.int64)
    counts[1100], counts[700], counts[316] = 8, 8, 24
    own = packing.bin_completion(counts, 2048)
    assert whole(own, counts)
    assert sum(n for _, n in own) == 11  # 6 of 1100+3*316, 2 of 1100+700, 3 of 2*700+2*316


@pytest.mark.parametrize("seed", [1, 2])
def test_near_the_bound_on_many_pieces(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(rng.lognormal(6, 1, 20000).astype(int) + 1, 2047), minlength=2049)
    own = sum(n for _, n in packing.bin_completion(counts, 2048))
    assert own <= -(-int((counts * np.arange(2049)).sum()) // 2048) * 1.002 + 1
