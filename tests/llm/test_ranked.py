from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from graphprop.llm import ranked
from tests.llm.helpers import EDGE_TEXTS, UPPER, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, top):
    """Every document scored for every item."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, bag), n in zip(bags, sizes, strict=True):
            if n:
                m = 100 - 25 + (25 * n * n_docs) // n_words
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in words(text) if bag[t])
                if score > 0:
                    found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "item_id long, text string, rank int, item string, score int")


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search_is_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [*("w%d" % k for k in range(30)), "Äé", "äé", "漢字", "ABC", "abc", "x1", "the"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(n))
    docs = [*EDGE_TEXTS, *((20 + k, text(rng.randrange(1, 25))) for k in range(150))]
    copies = [text(8) for _ in range(4)]
    docs += [(500 + k, copies[k % 4]) for k in range(200)] + [(900, "the " * 5000), (901, "w1 " * 3)]
    items = [(k, text(rng.randrange(0, 9))) for k in range(25)] + [(99, None), (98, ""), (97, "nothing of it"), (5, "w1 w1 w1"), (None, "w2 same row")]
    want = plain(docs, items, 20)
    df, asked = documents(spark, docs).repartition(7), benchmark(spark, items)
    assert got(ranked.search(df, asked)) == want
    assert got(ranked.search(df, asked, ranked.Ranking(block_bytes=300, chunk_cells=50))) == want
    assert got(ranked.search(df, asked, ranked.Ranking(top=3))) == plain(docs, items, 3)


def test_equal_scores_go_by_id_across_classes(spark):
    docs = [(k, f"w1 other{k % 3}") for k in range(60, 0, -1)] + [(100 + k, "x y z") for k in range(300)]
    items = [(1, "w1"), (2, "other1 w1")]
    rows = ranked.search(documents(spark, docs), benchmark(spark, items))
    assert got(rows) == plain(docs, items, 20)
    assert [r["doc_id"] for r in sorted(rows.where("item_id = 1").collect(), key=lambda r: r["rank"])] == list(range(1, 21))


def test_empty_tables(spark):
    some, asked = documents(spark, [(1, "a b")]), benchmark(spark, [(1, "a")])
    assert got(ranked.search(documents(spark, []), asked)) == []
    assert got(ranked.search(some, benchmark(spark, []))) == []
    assert got(ranked.search(documents(spark, [(1, None), (2, "...")]), asked)) == []
    assert ranked.search(some, asked).schema == ranked.search(documents(spark, []), asked).schema


def test_vocabulary_compares_bytes():
    v = ranked.Vocabulary([b"abc", b"abd", b"xyz"])
    v.hashes[:] = np.sort(v.hashes)
    data = np.frombuffer(b"abc abd abe xyz", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15])
    hit, number = v.find(data, starts, ends)
    assert hit.tolist() == [0, 1, 3] and number.tolist() == [0, 1, 2]
    v.data = np.frombuffer(b"abcabXxyz", np.uint8)  # as if another word had that hash
    assert v.find(data, starts, ends)[0].tolist() == [0, 3]
