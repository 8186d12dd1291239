from __future__ import annotations

import __spark_entry__
import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(cp.STAGES) - 1:
            assert out.columns == columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= kept
        kept, docs = now, out
    final = {(r.doc_id, r.piece): r for r in cp.run(spark, SF).collect()}
    assert {d for d, _ in final} == kept
    assert {k: r.ids_crc32 for k, r in final.items()} == {(r.doc_id, r.piece): r.ids_crc32 for r in docs.collect()}


def test_each_stage_drops_what_it_should(spark):
    base = " ".join(f"w{k}" for k in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    rows = [(1, base), (2, base + " more"), (3, item.text), (4, "clean text with mail a@b.cc inside it"), (None, base), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(cp.drop_near_duplicates(spark, docs, SF)) == {1, 3, 4, 5, None}
    assert ids(cp.drop_contaminated(spark, docs, SF)) == {1, 2, 4, 5, None}
    red = {r.doc_id: r for r in cp.redact_personal_data(spark, docs, SF).collect()}
    assert red[4].text == "clean text with mail <email> inside it" and red[4].n_chars == len(red[4].text)
    assert red[5].text is None and len(red) == 6
    assert ids(cp.drop_toxic(spark, docs, SF)) == {1, 2, 3, 4, 5, None}


def test_near_duplicates_go_from_four_fifths(spark):
    word = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, word("a", 60)), (2, word("a", 60) + " " + word("x", 12)), (3, word("b", 60)), (4, word("b", 60) + " " + word("y", 14)), (5, word("c", 60)), (6, word("c", 60) + " " + word("z", 15))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # 56 of 68, of 70 and of 71 shingles
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == {1, 3, 5, 6}


def test_registry():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("gone", ["no rows"])
def test_empty_table(spark, gone):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
