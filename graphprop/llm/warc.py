"""WARC archives with revisit records.

Headers (page, payload digest, size) alone are shuffled by digest; a payload of
enough bytes that occurs again is written once, and its other pages become
revisit records that refer to it. The repeated digests are joined back to the
pages, by broadcast where their written size allows, so that payloads move only
where it does not. Archives are written by Spark's own committer: a record ends in CRLF CRLF, so records are lines of a text file with
that separator, compressed by the writer. Reading goes by Content-Length, so a
payload may hold anything.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphprop.llm.store import Scratch

_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class Archive:
    """``least_bytes`` is the size from which payloads are written once; a file holds at most ``file_bytes`` of payload, or one record."""

    least_bytes: int = 1000
    file_bytes: int = 256 << 20
    tier_bytes: int = 64 << 10
    date: str = "2024-01-01T00:00:00Z"


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    return page.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("bytes"))


def headers(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, digest, bytes) of each row, written."""
    return scratch.keep(_pages(pages, id_col, id_col, html_col).select("page_id", "digest", "bytes"), "headers")


def resolve(pages: DataFrame, cfg: Archive = Archive(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html", head: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, html, digest, bytes, refers_to (null for a response)."""
    scratch = Scratch(pages.sparkSession)
    head = headers(pages, scratch, id_col, html_col) if head is None else head
    known = head.where((F.col("bytes") >= cfg.least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("original"))
    again = head.where(F.col("bytes") >= cfg.least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    known = scratch.keep(known.join(again, "digest"), "originals")
    page = _pages(pages, id_col, url_col, html_col)
    return page.join(known, "digest", "left").select("page_id", "url", "html", "digest", "bytes", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("refers_to"))


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write(resolved: DataFrame, path: str, cfg: Archive = Archive(), largest: int | None = None) -> None:
    """Write a record for each row of ``resolve`` to gzip WARC files under ``path``.

    Records go to tiers by size, each 64 times the one before, so that a number
    of records bounds a file's bytes; ``largest`` is the largest payload.
    """
    if largest is None:
        largest = resolved.agg(F.max("bytes").alias("m")).first()["m"] or 0
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    fields = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        ("WARC-Date", F.lit(cfg.date)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"), F.col("digest")))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        ("X-Payload-Length", F.col("bytes").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    header = F.concat_ws(_END, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])
    least, most = -1, cfg.tier_bytes
    while least < largest:
        own = resolved.where((F.col("bytes") > least) & (F.col("bytes") <= most)).withColumn("block", block)
        record = own.select(F.concat(header, F.lit(_END * 2), F.col("block")).alias("value"))
        record.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, cfg.file_bytes // most)).text(f"{path}/to-{most}")
        least, most = most, most * 64


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and blocks of a gzip WARC file, one at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not the start of a record: {line[:80]!r}")
            headers: dict[str, str] = {}
            while line := f.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.lower()] = value.strip()
            size = int(headers["content-length"])
            block = f.read(size)
            if len(block) != size:
                raise ValueError("a record is cut short")
            yield headers, block


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives under ``path``; the digests of responses are computed anew and must agree."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for h, block in records(content.as_py()):
                    said = h["warc-payload-digest"].removeprefix("sha1:")
                    payload, n = None, int(h["x-payload-length"])
                    if h["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if hashlib.sha1(payload).hexdigest() != said or len(payload) != n:
                            raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
                    ids = [int(h[k]) if h.get(k) else None for k in ("x-page-id", "x-refers-to-page-id")]
                    out.append((ids[0], h.get("warc-target-uri"), n, said, h["warc-type"], ids[1], payload if with_payload else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
                names = [*(x.split()[0] for x in RECORDS.split(", ")), "payload"]
                yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    out = files.select("content").mapInArrow(rows, RECORDS + ", payload binary")
    return out if with_payload else out.drop("payload")


def archive(pages: DataFrame, cfg: Archive = Archive(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to WARC archives in the shared folder and read them back.

    Per row: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to. The payload is the html in UTF-8, empty for null. Of equal
    payloads of at least ``least_bytes`` the largest page_id is the response;
    rows that repeat that page_id and payload are responses too. Rows with a
    null page_id revisit a page of the same payload if there is one. Blanks and
    control characters of a url are written as %20, a null url is left out.
    An empty table gives no records. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    path = scratch.path("archives")
    head = headers(pages, scratch, id_col, html_col)
    largest = head.agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("m")).first()["m"]
    write(resolve(pages, cfg, id_col, url_col, html_col, head), path, cfg, largest)
    return read(pages.sparkSession, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS dg FROM p),
m AS (SELECT dg, max(page_id) AS mx FROM d WHERE n >= 1000 GROUP BY dg)
SELECT d.page_id, d.n AS payload_bytes, d.dg AS payload_digest,
  CASE WHEN m.mx IS NOT NULL AND m.mx <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.mx IS NOT NULL AND m.mx <> d.page_id THEN m.mx END AS refers_to
FROM d LEFT JOIN m ON d.dg = m.dg AND d.n >= 1000
"""
