from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import EDGE_TEXTS, blank_words, documents

from graphprop.llm import near_dedup as nd
from graphprop.llm.near_dedup import NearDedup, near_duplicates


def brute(rows):
    sets = {}
    for i, t in rows:
        w = blank_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = [i for i in sets if sets[i]]
    part = {i: i for i in sets}

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, k = [], 100
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 160))]
        rows.append((k, " ".join(base)))
        k += 1
        for _ in range(rng.randint(0, 9)):
            other = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                other[rng.randrange(len(other))] = word()
            rows.append((k, "  ".join(other).upper()))
            k += 1
    rng.shuffle(rows)
    return rows


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 3])
def test_agrees_with_all_pairs(spark, block):
    rows = corpus()
    assert got(near_duplicates(documents(spark, rows), NearDedup(block=block))) == brute(rows)


def test_hub_of_many_copies_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, "lonely text of five words")]
    for k in range(1, 60):
        other = list(base)
        if k != 37:
            other[rng.randrange(10, 110)] = f"x{k}"
        rows.append((k, " ".join(other)))
    assert got(near_duplicates(documents(spark, rows), NearDedup(block=8))) == brute(rows)


def test_edges(spark):
    out = near_duplicates(documents(spark, EDGE_TEXTS)).collect()
    assert len(out) == len(EDGE_TEXTS)
    by = {r.doc_id: r for r in out}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert all(by[k].kept and by[k].component_id == k for k in (1, 2, 3, 4, 5, 6, 7))
    assert by[None].component_id is None and by[None].kept
    assert by[4].n_shingles == 1 and by[6].n_shingles == 4


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def test_long_and_repeating_text(spark):
    long = "la " * 200_000 + "end of it"
    out = got(near_duplicates(documents(spark, [(1, long), (2, long), (3, "la la la la la")])))
    assert out[2][1] == 1 and not out[2][2] and out[3][1] == 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    sig = nd.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    assert (sig < 0xFFFFFFFF).all()
    few = nd.super_minhash(x[:3], np.array([0, 3]))
    assert (few < 0xFFFFFFFF).all()


def test_buckets_fall_apart_where_members_disagree(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (3, nd.SIGNATURE), dtype=np.uint8)
    rows, kind = [], {}
    for k in range(90):
        own = base[k % 3].copy()
        own[rng.integers(0, nd.SIGNATURE, 10)] ^= 1
        rows.append((k // 45 if k < 80 else 5 + k, k, own.tobytes()))
        kind[k] = k % 3
    table = spark.createDataFrame(rows, "band long, node long, sketch binary").repartition(6)
    label = {k: k for k in kind}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in nd._bucket_links(table, NearDedup()).collect():
        assert kind[r.a] == kind[r.b]
        label[top(r.a)] = top(r.b)
    for lo, hi in ((0, 45), (45, 80)):
        assert all((top(a) == top(b)) == (kind[a] == kind[b]) for a in range(lo, hi) for b in range(lo, hi))
    assert all(top(k) == k for k in range(80, 90))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_mixed_buckets_lose_no_link(spark, bucket):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(30)}" for _ in range(60)]
        for c in range(6):
            other = list(base)
            for _ in range(c):
                other[rng.randrange(60)] = f"x{rng.randrange(9)}"
            rows.append((g * 10 + c, " ".join(other)))
    cfg = NearDedup(bands=60, rows=2, bucket=bucket)
    assert got(near_duplicates(documents(spark, rows), cfg)) == brute(rows)


def test_fewer_links_keep_the_components(spark):
    rng = random.Random(5)
    links = [(0, b) for b in range(5, 60)] + [(rng.randrange(5), b) for b in range(5, 60)] + [(rng.randrange(60, 200), rng.randrange(60, 200)) for _ in range(90)]
    links = [(a, b) for a, b in links if a != b]
    fewer = {tuple(r) for r in nd.fewer_links(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}

    def parts(pairs):
        label = {k: k for k in range(200)}
        for _ in range(200):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts(fewer) == parts(links)
    assert {x for p in fewer for x in p} == {x for p in links for x in p} and len(fewer) <= len(set(links))
    assert nd.fewer_links(spark.createDataFrame([], "a long, b long")).collect() == []
