from __future__ import annotations

import hashlib
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from helpers import EDGE_TEXTS, documents, plain_words

from graphprop.llm import decontaminate as dc
from graphprop.llm.registry import op5_decontaminate


def brute(rows, items):
    windows = set()
    for item, text in items:
        w = plain_words(text)
        if item is not None and w:
            windows |= {(str(item), tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12))}
    out = []
    for i, text in rows:
        w, hit, names = plain_words(text), set(), set()
        for item, p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(item)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fixture(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["the"] * 30 + ["É", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([3, 12, 13, 14, 40]))) for k in range(12)] + [(12, None), (13, "..."), (14, "one-word"), (15, "the the the the the the the the the the the the the the")]
    rows = list(EDGE_TEXTS) + [(300, "ONE word. one,word"), (301, "the " * 40)]
    for k in range(100, 140):
        t = text(rng.choice([20, 100, 400]))
        if k % 2:
            own = rng.choice(items[:12])[1].split()
            a = rng.randrange(len(own))
            t += ". " + "; ".join(own[a : a + rng.choice([5, 13, 20, 40])]).upper().replace("É", "É") + " " + text(10)
        rows.append((k, t))
    return rows, items


def test_agrees_with_all_windows(spark):
    rows, items = fixture()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items + items[:3]], "item_id long, text string, doc_id int")
    out = dc.digest(dc.decontaminate(documents(spark, rows), bench)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, items)
    assert any(r.contaminated for r in out) and not all(r.contaminated for r in out)


def test_oracle(spark, tmp_path):
    rows, items = fixture(2)
    rows = [r for r in rows if r[0] is not None and r[0] != 7]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [r[0] for r in items], "text": [r[1] for r in items]}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({dc.ORACLE_SQL})").fetchall()
    own = sorted((tuple(r) for r in op5_decontaminate(spark, str(tmp_path)).collect()), key=str)
    assert sorted(want, key=str) == own == brute(rows, items)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.decontaminate(documents(spark, []), bench).collect() == []
    r = dc.digest(dc.decontaminate(documents(spark, [(1, "a b c")]), bench.where("false"))).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (3, 0, False)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "alpha beta gamma delta"), (2, "alpha so beta gamma"), (3, "alpha x x x x x x x beta x x x x x x x x gamma"), (4, "nothing"), (None, "alpha beta gamma delta")]
    out = dc.proximity_matches(documents(spark, rows), bench, slop=2, cfg=dc.Decontamination(rarest=3))
    hits = {r.doc_id for r in out.collect()}
    assert 1 in hits and 3 not in hits and 4 not in hits and None not in hits
