from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from graphprop.llm import spelling
from tests.llm.helpers import EDGE_TEXTS, UPPER, documents


def plain_words(docs, cfg):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % cfg.drop_one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= cfg.least_letters and n >= cfg.least_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, cfg):
    """All pairs of words compared."""
    words = plain_words(docs, cfg)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= cfg.share * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def got(df):
    rows = [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(rng, letters, n_words, n_docs):
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(n_words)]
    stems += [s[:k] + rng.choice(letters) + s[k + rng.randrange(2) :] for s in stems for k in [rng.randrange(len(s))]]
    stems += [s + e for s in stems[:20] for e in ("", "a", "aa", "aaa")]
    text = lambda: " ".join(rng.choice(stems) if rng.random() < 0.7 else rng.choice(stems[:5]) for _ in range(rng.randrange(60)))
    return [(k, text()) for k in range(n_docs)]


def test_variants_are_brute_force(spark):
    rng = random.Random(2)
    for letters, cfg in (("ab", spelling.Spelling(least_letters=4, least_count=2, share=2, drop_one_in=7)), ("abcdeàÿ×Z", spelling.Spelling(drop_one_in=19))):
        docs = [*EDGE_TEXTS, *corpus(rng, letters, 60, 120)]
        assert got(spelling.variants(documents(spark, docs).repartition(4), cfg)) == plain(docs, cfg)


def test_forms_lead_to_roots(spark):
    docs = [(1, "colours " * 5 + "colour " * 25 + "colorr " * 125 + "colorx " * 625 + "colory " * 625), (2, "kolours " * 5)]
    cfg = spelling.Spelling(drop_one_in=1 << 40)
    rows = got(spelling.variants(documents(spark, docs), cfg))
    assert rows == plain(docs, cfg)
    assert {r[0]: r[5] for r in rows}["kolours"] == "kolours" and {r[0]: r[5] for r in rows}["colorr"] == "colorx"


def test_long_words_take_few_levels(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    other = long[:1500] + ("x" if long[1500] != "x" else "y") + long[1501:]
    text = f"{long} {other} {long[1:]} {long}q {'z' * 400} {'z' * 401} short words"
    docs = [(k, text) for k in range(5)]
    cfg = spelling.Spelling(drop_one_in=1 << 40, max_rounds=8)
    assert got(spelling.variants(documents(spark, docs), cfg)) == plain(docs, cfg)


def test_deleted_letters_count_from_the_hash(spark):
    docs = [(k, "abcdéfgh Zebras zebras") for k in range(400)]
    cfg = spelling.Spelling(least_count=1)
    assert {(r["word"], r["n"]) for r in spelling.counted_words(documents(spark, docs), cfg).collect()} == set(plain_words(docs, cfg).items())


def test_empty_tables(spark):
    for docs in ([], [(1, None)], [(1, "too few of them")]):
        assert got(spelling.variants(documents(spark, docs))) == set()
    same = [(k, "onlyword") for k in range(5)]
    assert got(spelling.variants(documents(spark, same))) == plain(same, spelling.Spelling())
