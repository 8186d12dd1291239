from __future__ import annotations

import hashlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from graphprop.llm import warc
from graphprop.llm.registry import op9_warc
from graphprop.llm.store import Scratch

SCHEMA = "page_id long, url string, html string, digest string, bytes int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], SCHEMA)


BIG = "é" * 600
ROWS = [(1, "http://a/ b\r\nX: y", "short"), (2, None, "short"), (3, "http://c", BIG), (4, "http://d", BIG), (9, "http://e", BIG), (5, "http://f", None), (6, "http://g", ""), (7, "http://h", "WARC/1.1\r\n\r\n\r\n\r\n" * 90), (8, "http://i", "x" * 300_000), (10, "u", "y" * 999), (11, "u", "y" * 999)]


def test_round_trip(spark):
    out = {r.page_id: r for r in warc.archive(pages(spark, ROWS)).collect()}
    assert len(out) == len(ROWS)
    for i, _, h in ROWS:
        data = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r.refers_to for i, r in out.items() if r.record_type == "revisit"} == {3: 9, 4: 9}


def test_payloads_come_back_whole(spark):
    path = Scratch(spark).path("archives")
    warc.write(warc.resolve(pages(spark, ROWS)), path)
    out = {r.page_id: r.payload for r in warc.read(spark, path, with_payload=True).collect()}
    assert all(bytes(out[i]) == (h or "").encode() for i, _, h in ROWS if i not in (3, 4))
    assert out[3] is None


def test_files_are_bounded_by_bytes(spark):
    path = Scratch(spark).path("archives")
    cfg = warc.Archive(file_bytes=4000, tier_bytes=100)
    warc.write(warc.resolve(pages(spark, ROWS).coalesce(1), cfg), path, cfg)
    sizes = [sum(r.payload_bytes for r in g) for g in by_file(spark, path)]
    assert len(sizes) > 3 and all(n <= 4000 for n in sizes if n not in (300_000,))
    assert warc.read(spark, path).count() == len(ROWS)


def by_file(spark, path):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("path").collect()
    return [warc.read(spark, r.path).where("record_type = 'response'").collect() for r in files]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "u", BIG), (1, "u", BIG), (None, "u", BIG), (None, "u", "small")]
    out = warc.archive(pages(spark, rows)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in out) == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert warc.archive(pages(spark, [])).collect() == []


def test_oracle(spark, tmp_path):
    pq.write_table(pa.table({"page_id": [r[0] for r in ROWS], "url": [r[1] for r in ROWS], "html": [r[2] for r in ROWS]}), tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = sorted(con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in op9_warc(spark, str(tmp_path)).collect()) == want
