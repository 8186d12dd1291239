from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE_TEXTS, UPPER, blank_words, documents

from graphprop.llm import quality as q
from graphprop.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())


@pytest.mark.parametrize(("op", "label", "mod", "least"), [(q.quality, "quality", (5, 0), 0.97), (t.toxicity, "toxic", (3, 1), 0.9)])
def test_held_out_rows(spark, op, label, mod, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = op(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % mod[0] == mod[1])).all()
    both = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert auc(both[label].to_numpy(), both["score"].to_numpy()) > least
    assert ((both["score"] >= (0.3 if label == "quality" else 0.7)).astype(int) == both["predicted"]).all()


@pytest.mark.parametrize("op", [q.quality, t.toxicity])
def test_edges(spark, op):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (5, 1, 1), (6, 0, 1), (6, 1, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = op(documents(spark, EDGE_TEXTS), labels).collect()
    assert len(out) == len(EDGE_TEXTS) and all(0 <= r.score <= 1 for r in out)
    same = [r.score for r in out if r.doc_id == 7]
    assert same[0] == same[1]
    assert op(documents(spark, []), labels).collect() == []
    assert len(op(documents(spark, EDGE_TEXTS), labels.where("false")).collect()) == len(EDGE_TEXTS)


def test_lang_source_and_other_folds_are_not_inputs(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    import pyspark.sql.functions as F

    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in t.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in t.toxicity(docs.withColumn("lang", F.lit("zz")), other).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x = np.sort(rng.normal(size=50))
    y, w = (x > 0) + rng.normal(size=50) * 0.3, rng.integers(1, 5, 50).astype(float)
    xs, ys = q.isotonic(x, y, w)
    assert (np.diff(ys) > 0).all() and (np.diff(xs) > 0).all()
    assert abs(np.average(np.interp(x, xs, ys), weights=w) - np.average(y, weights=w)) < 0.1


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 6))
    cfg = q.Quality(features=20_000, kernel_width=2.0)
    z = q.FourierMap(np.zeros(6), np.ones(6), cfg)(x)[:, 1:]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / 8)).max() < 0.05


def packed_votes(spark, fires, given):
    rows = [(np.packbits(f).tobytes(), g, 1) for f, g in zip(fires, given, strict=True)]
    return spark.createDataFrame(rows, "fires binary, given double, n long").groupBy("fires", "given").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


def test_a_repeated_voter_adds_nothing(spark):
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    fires = np.stack([rng.random(4000) < np.where(y, hit, false) for hit, false in [(0.6, 0.05), (0.6, 0.05), (0.5, 0.1)]], 1)
    given = [float(v) if k % 10 == 0 else None for k, v in enumerate(y)]
    once = t.fit_label_model(packed_votes(spark, fires, given), 3, t.Toxicity())
    twice = np.concatenate([fires, fires[:, 2:], fires[:, 2:]], 1)  # the last voters repeat the third
    model = t.fit_label_model(packed_votes(spark, twice, given), 5, t.Toxicity())
    assert (once.parent == -1).all() and (model.parent[:2] == -1).all() and (model.parent[2:] >= 2).sum() == 2
    p, q = once.posterior(fires), model.posterior(twice)
    assert p[y].mean() > p[~y].mean() + 0.3
    assert np.abs(p - q).max() < 0.05
    alike = t.LabelModel(model.prior, model.rate, np.full(5, -1))
    assert np.abs(p - alike.posterior(twice)).max() > 0.2
    # without labels EM starts from what voters are for
    blind = t.fit_label_model(packed_votes(spark, fires, [None] * 4000), 3, t.Toxicity()).posterior(fires)
    assert blind[y].mean() > blind[~y].mean() + 0.3


def test_posterior_and_rates_equal_enumeration():
    rng = np.random.default_rng(2)
    n, parent = 4, np.array([-1, 0, 1, 0])
    every = (np.arange(2**n)[:, None] >> np.arange(n)) % 2 > 0
    given = rng.uniform(0.05, 0.95, (n, 2, 2))
    given[0, 1] = given[0, 0]
    rate = np.zeros((n, 2))
    model = t.LabelModel(0.3, rate, parent, given)
    joint = np.array([[np.prod([(g if f[v] else 1 - g) for v in range(n) for g in [given[v, int(parent[v] >= 0 and f[parent[v]]), c]]]) for c in (0, 1)] for f in every])
    assert np.allclose(joint.sum(0), 1)
    want = 0.3 * joint[:, 1] / (0.3 * joint[:, 1] + 0.7 * joint[:, 0])
    assert np.allclose(model.posterior(every), want)
    # the moments of many rows of that law give the law and its tree back
    f = np.concatenate([np.ones((2**n, 1)), every], 1)
    m = np.stack([f.T @ (f * (1e7 * p * joint[:, c])[:, None]) for c, p in ((0, 0.7), (1, 0.3))])
    back = t._rates(m, parent)
    assert np.abs(back.given - given).max() < 1e-5 and abs(back.prior - 0.3) < 1e-5
    found = t.dependencies(m, 0.05)
    assert {frozenset((v, p)) for v, p in enumerate(found) if p >= 0} == {frozenset((v, p)) for v, p in enumerate(parent) if p >= 0}
    mutual = sum(
        1e7 * p * sum(q * np.log(q / (a * b)) for x in (0, 1) for y in (0, 1) for q in [joint[(every[:, 1] == x) & (every[:, 3] == y), c].sum()] for a in [joint[every[:, 1] == x, c].sum()] for b in [joint[every[:, 3] == y, c].sum()])
        for c, p in ((0, 0.7), (1, 0.3))
    )
    assert abs(t.information(m)[1, 3] - mutual) < 1e-3


def test_every_word_that_labels_single_out_votes(spark):
    import pyspark.sql.functions as F

    words = ["vb" + "".join(chr(97 + k // 26**j % 26) for j in (2, 1, 0)) + "q" for k in range(40)]
    names = [w[2:5][::-1] + w for w in words]  # no two share a beginning of three letters
    calm = lambda k: "calm" + "".join(chr(97 + k // 26**j % 26) for j in (2, 1, 0))
    texts = [" ".join([calm(k), "talk"] + ([names[k // 2 % 40], calm(k * 3 % 3200)] if k % 2 else [])) for k in range(3200)]
    rows = [(k, text, k % 2) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    cfg = t.Toxicity(alone=5, bands=3)
    mined = t._mined(docs.select("text", "toxic"), cfg, t.Scratch(spark))
    assert len(mined) == 40
    assert t._voters(40, cfg) == [0, 1, 2, 3, 4] + [5] * 12 + [6] * 12 + [7] * 11 and t._voters(3, cfg) == [0, 1, 2] and t._voters(0, cfg) == []
    out = {r.doc_id: r.predicted for r in t.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", F.col("toxic")), cfg).collect()}
    assert out == {k: y for k, _, y in rows}


def test_copies_are_no_further_evidence(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, 7))
    vocabulary = [word() for _ in range(400)]
    plain = lambda n: list(rng.choice(vocabulary, n))
    copied = [word() for _ in range(30)]
    near = [" ".join(w if rng.random() > 0.01 else word() for w in copied) for _ in range(60)]
    toxic = [" ".join([*plain(6), "qqvillain", *plain(6)]) for _ in range(120)]
    rows = [(x, 1) for x in near + toxic] + [(" ".join(plain(14)), 0) for _ in range(900)]
    found = t._mined(spark.createDataFrame(rows, "text string, toxic int"), t.Toxicity(), t.Scratch(spark))
    heads = {(n, t._hash_of("qqvillain"[:n] if n else "qqvillain")) for n in t._LENGTHS}
    assert len(found) == 1 and set(found) <= heads


def test_nested_words_are_found_as_by_comparing_all():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 6))) for _ in range(400)]
    known = [b"abc", b"abcb", b"ccc"]
    nested, plain = t._Nested(known), list(known)
    for w in words:
        fits = not any(w.startswith(x) or x.startswith(w) for x in plain)
        assert nested.add(w) == fits
        plain += [w] * fits


def brute_votes(text, lexicon):
    """The voters by name, and the whole-number features, of one text."""
    low = (text or "").translate(UPPER)
    spans = [m.span() for m in re.finditer(r"[a-z\x80-\U0010FFFF]+", low)]
    words = [low[a:b] for a, b in spans]
    count = {k: 0 for k in lexicon}
    shout = False
    for (a, b), w in zip(spans, words, strict=True):
        for k in lexicon:
            length, stem = k
            if w == stem if not length else len(w.encode()) > length and w.encode()[:length] == stem.encode():
                count[k] += 1
                raw = text[a:b].encode()
                after = text.encode()[len(text[:a].encode()) + 1 :][:1]
                shout |= raw[:1].isupper() and after.isupper()
    total, kinds = sum(count.values()), sum(v > 0 for v in count.values())
    dense = total / max(len(words), 1)
    caps, small = sum("A" <= c <= "Z" for c in text or ""), sum("a" <= c <= "z" for c in text or "")
    share = caps / max(caps + small, 1)
    fired = [v > 0 for v in count.values()] + [total >= 2, total >= 3, dense >= 0.01, shout, share > 0.5]
    return fired, [min(total, 100), kinds, round(min(dense * 100, 10) * 4), round(share * 32)]


def test_votes_equal_a_plain_count(spark):
    lexicon = [(0, w) for w in t.LEXICON] + [(4, "vill"), (5, "scoun"), (3, "é ".strip() + "a")]
    hashed = [(n, t._hash_of(w)) for n, w in lexicon]
    texts = [*EDGE_TEXTS, (10, "You IDIOT, idiot! Idiota villain VILLAINS vill scoundrel éab éa"), (11, "STUPID " * 3 + "x" * 70_000 + " moron"), (12, "a villa,idiot." * 20_000), (13, "CRÉTIN crétin Estúpido")]
    got = t.votes(documents(spark, texts), hashed).toArrow()
    bits = t._bits(got.column("fires").combine_chunks(), len(lexicon) + len(t.PATTERNS))
    for (_, text), fired, x in zip(texts, bits, got.column("x").to_pylist(), strict=True):
        want = brute_votes(text, lexicon)
        assert (fired.tolist(), x) == want, text and text[:60]


def test_classifier_equals_a_local_fit(spark):
    rng = np.random.default_rng(3)
    fires, y = rng.random((600, 3)) < 0.3, rng.random(600)
    x = rng.integers(0, 6, (600, 4))
    rows = [(np.packbits(f).tobytes(), [int(v) for v in a], float(b), 2) for f, a, b in zip(fires, x, y, strict=True)]
    table = spark.createDataFrame(rows, "fires binary, x array<smallint>, given double, n long").repartition(5)
    w = t.fit_classifier(table, t.LabelModel(0.1, np.full((3, 2), 0.5), np.full(3, -1)))
    f = np.concatenate([np.ones((600, 1)), fires, np.log1p(x[:, :2]), x[:, 2:3] / 4, x[:, 3:] / 32], 1)
    p = 1 / (1 + np.exp(-(f @ w)))
    slope = 2 * f.T @ (y - p) - np.r_[1e-6, np.ones(len(w) - 1)] * w
    assert np.abs(slope).max() < 1e-3


def brute_statistics(text):
    data = (text or "").encode()
    words = [w.encode() for w in blank_words(text)]
    raw_words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    n, nw, nl = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda ok: sum(map(ok, data)) / n
    symbol = lambda c: bool(q._SYMBOL[c])
    size = [len(w) for w in words]
    most = max((words.count(w) for w in set(words)), default=0) if len(words) < 5000 else max(Counter(words).values())
    return [
        np.log1p(len(words)), np.log1p(len(data)), min(sum(size) / nw, 40), share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b" \t\n\r\x0b\x0c"),
        share(symbol), share(lambda c: c == 33), share(lambda c: c == 124), share(lambda c: c >= 128), share(lambda c: c in b".?"),
        np.log1p(len(lines)), np.log1p(nw / nl), len(set(words)) / nw, sum(a == b for a, b in zip(words, words[1:])) / nw, sum(a == b for a, b in zip(words, words[2:])) / nw,
        most / nw, 1 - len(set(lines)) / nl, sum(symbol(w[-1]) for w in raw_words) / nw, sum(k <= 2 for k in size) / nw,
    ]


def test_statistics_equal_a_plain_count(spark):
    texts = [*EDGE_TEXTS, (10, "One two two\nTWO. a|b ##\n\nOne two two\n$$ x$ é! ?\t end."), (11, "line\n" * 30_000), (12, "w" * 300_000), (13, "ab ab cd ab " * 9000)]
    got = [r.x for r in q.statistics(documents(spark, texts)).collect()]
    for (_, text), x in zip(texts, got, strict=True):
        want = brute_statistics(text)
        assert len(want) == len(q.STATISTICS) and np.allclose(x, want, rtol=1e-5, atol=1e-6), (text and text[:40], np.round(np.array(x) - want, 4))


@pytest.mark.parametrize("op", [q.quality, t.toxicity])
def test_copies_score_alike_wherever_they_stand(spark, op):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.select("doc_id", "text").union(docs.select(docs.doc_id + 1_000_000, docs.text)).repartition(7)
    found = {r.doc_id: r.score for r in op(twice, labels).collect()}
    assert all(found[i] == found[i + 1_000_000] for i in found if i < 1_000_000)
