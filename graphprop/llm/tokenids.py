"""Token ids in binary archives: one zstandard frame a document, a dictionary shared by all of them.

Documents are ranged by id, encoded and compressed where they then lie, and
written by Spark's own committer, so a lost executor costs its tasks only. A
shard is a file of its own:

    header   magic (8), SHA-256 of the dictionary (32), shard number u32, bytes an id u8
    frame    the ids of one document, little-endian, as one zstandard frame; one after the other
    index    a zstandard frame of five arrays: doc_id i64, has an id u8, offset u64, length u64, n_tokens u64
    tail     rows of the index u64, length of the index u64, magic (8)

Header, every frame and index with tail end in one line feed, which belongs to
the format and to no length. The dictionary lies beside the shards. A document
is read by its offset alone, without the frames before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.packing import WordCache
from graphprop.llm.store import Scratch

MAGIC = b"ZIDSHRD1"
_HEAD, _TAIL = "<8s32sIB", "<QQ8s"
_HEAD_BYTES, _TAIL_BYTES = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
_KINDS = (("doc_id", "<i8"), ("named", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8"))


@dataclass(frozen=True)
class TokenArchive:
    """The dictionary is trained on the ids of at most ``sample_docs`` documents, drawn by hash, of each the first ``sample_ids``; a shard holds about ``shard_bytes`` of text."""

    end_id: int = 0
    level: int = 3
    dictionary_bytes: int = 64 << 10
    sample_docs: int = 2000
    sample_ids: int = 8192
    shard_bytes: int = 128 << 20
    cached_words: int = 1_000_000


# ---- ids ---------------------------------------------------------------------

_BLANK, _LETTER, _DIGIT, _SYMBOL, _MIXED = range(5)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[128:192] = _LETTER  # continues what its leading byte says
_CLASS[0xC3:0xC6] = _LETTER  # U+00C0 to U+017F
_CLASS[39] = _MIXED  # apostrophes: contractions count
_CLASS[0xC0:0xC3] = _MIXED
_CLASS[0xC6:] = _MIXED


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows to encode whole: those with controls, blanks outside ASCII, or the start of a special token."""
    odd = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return odd
    control = (data < 32) & (_CLASS[data] != _BLANK) | (data == 127)
    a, b, c = data, np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
    special = (a == 60) & (b == 124)
    blank = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    blank |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    odd[np.searchsorted(offsets, np.flatnonzero(control | special | blank), "right") - 1] = True
    return odd


def _pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the runs a byte-level tokenizer merges within, and each row's range of them.

    Runs of letters, of digits and of signs, each with the space before it;
    other blanks run on their own, and the last one before a run that takes no
    part in it stands alone. A word with an apostrophe or other scripts is one
    run of kind ``_MIXED``, of which the tokenizer sees the same pieces as in
    the text.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    mixed = kind == _MIXED
    mixed[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    if mixed.any():
        ws, we, _ = tx.words(data, offsets, _CLASS == _BLANK)
        hit = np.unique(np.searchsorted(ws, np.flatnonzero(mixed), "right") - 1)
        cover = np.zeros(n + 1, np.int8)
        cover[ws[hit]] += 1
        np.subtract.at(cover, we[hit], 1)
        kind[np.cumsum(cover[:-1], dtype=np.int8) > 0] = _MIXED
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n, bool)
    first[offsets[offsets < n]] = True
    after = np.flatnonzero((kind[1:] != _BLANK) & (kind[:-1] == _BLANK) & ~first[1:]) + 1
    start[after - 1] = True
    start[after] = data[after - 1] != 32
    start |= first
    at = np.flatnonzero(start)
    end = np.append(at[1:], n)
    return at, end, kind[end - 1], np.searchsorted(at, offsets)


class ByteCache(WordCache):
    """Token ids of the runs of a byte-level tokenizer, kept by hash; runs seen first are encoded by the library, joined by line feeds, whose id tells them apart."""

    def __init__(self, tokenizer_path: str, most: int):
        super().__init__(tokenizer_path, most)
        found = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(found) != 1:
            raise ValueError("a byte-level tokenizer has one id for a line feed")
        self.feed = found[0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = ["\n".join([*words[lo : lo + 1000], ""]) for lo in range(0, len(words), 1000)]
        flat = np.concatenate([np.array(x, np.uint32) for x in self.encode(joined)] or [np.empty(0, np.uint32)])
        feeds = flat == self.feed
        if feeds.sum() == len(words):
            return flat[~feeds], np.diff(np.flatnonzero(feeds), prepend=-1) - 1
        ids = self.encode(words)
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, odd = len(offsets) - 1, _odd_rows(raw, offsets)
        starts, ends, kinds, of = _pretokens(raw, offsets)
        row = np.repeat(np.arange(n), np.diff(of))
        if odd.any():
            plain = ~odd[row]
            starts, ends, kinds, row = starts[plain], ends[plain], kinds[plain], row[plain]
        u, at, back = np.unique(tx.hashes(raw, starts, ends), return_index=True, return_inverse=True)
        for _ in range(2):  # anew if the cache was emptied for this block
            pos = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
            new = self.known[pos] != u if len(self.known) else np.ones(len(u), bool)
            if not new.any():
                break
            text = raw.tobytes()
            self.learn(u[new], [text[starts[k] : ends[k]].decode("utf-8", "replace") for k in at[new]], kinds[at[new]] == _BLANK)
        pos = np.searchsorted(self.known, u)[back]
        count = self.length[pos].astype(np.int64)
        out = self.ids[np.repeat(self.first[pos] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ranges = np.concatenate([[0], np.cumsum(np.bincount(row, count, n).astype(np.int64))])
        if not odd.any():
            return out, ranges
        rows = np.flatnonzero(odd)
        whole = dict(zip(rows, self.encode([raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in rows]), strict=True))
        parts = [np.array(whole[k], np.uint32) if k in whole else out[ranges[k] : ranges[k + 1]] for k in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_caches: dict[tuple[str, int], ByteCache] = {}


def _cache(tokenizer_path: str, most: int) -> ByteCache:
    key = (tokenizer_path, most)
    return _caches.get(key) or _caches.setdefault(key, ByteCache(tokenizer_path, most))


def _encoded(column: pa.Array, cache: ByteCache, end_id: int, kind: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For blocks of a string column: the first row, and each row's ids with the end id, of the type that files hold."""
    data, offsets = tx.utf8(column)
    for lo, hi in tx.blocks(offsets):
        ids, of = cache.block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, [np.append(ids[of[k] : of[k + 1]], end_id).astype(kind) for k in range(hi - lo)]


# ---- writing -----------------------------------------------------------------


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; where there is too little to train one, the samples' own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary(docs: DataFrame, tokenizer_path: str, kind: str, cfg: TokenArchive) -> bytes:
    """The dictionary for ``docs`` (doc_id, text): the sample is the documents whose ids hash lowest."""
    order = F.xxhash64(F.lit("dictionary"), "doc_id")
    few = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(cfg.sample_docs).select(F.col("doc_id").alias("_id"))
    end, most, ids = cfg.end_id, cfg.cached_words, cfg.sample_ids

    def run(batches):
        for batch in batches:
            for _, rows in _encoded(batch.column(0), _cache(tokenizer_path, most), end, kind):
                yield pa.RecordBatch.from_arrays([pa.array([r[:ids].tobytes() for r in rows], pa.binary())], ["ids"])

    texts = docs.join(F.broadcast(few), F.col("doc_id") == F.col("_id"), "left_semi").select("text")  # at most sample_docs ids
    found = texts.mapInArrow(run, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(cfg.sample_docs).collect()
    return trained([bytes(r["ids"]) for r in found], cfg.dictionary_bytes)


def _index_bytes(rows: list[tuple]) -> bytes:
    columns = list(zip(*rows, strict=True))
    return zstandard.ZstdCompressor().compress(b"".join(np.array(c, kind).tobytes() for c, (_, kind) in zip(columns, _KINDS, strict=True)))


def id_kind(tokenizer_path: str, end_id: int) -> str:
    """How files hold ids: in two bytes where the vocabulary fits, else in four."""
    import tokenizers

    top = max([end_id, *tokenizers.Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()])
    return "<u2" if top < 1 << 16 else "<u4"


def write(docs: DataFrame, tokenizer_path: str, path: str, cfg: TokenArchive = TokenArchive(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` in ascending id to shards under ``path/shards`` and the dictionary to ``path/dictionary``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = id_kind(tokenizer_path, cfg.end_id)
    words = dictionary(rows, tokenizer_path, kind, cfg)
    spark.createDataFrame([(bytearray(words),)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.option("lineSep", "\n").text(f"{path}/dictionary")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // cfg.shard_bytes))
    end, most, level = cfg.end_id, cfg.cached_words, cfg.level

    def run(batches):
        own = zstandard.ZstdCompressionDict(words) if words else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=True)
        index: list[tuple] = []
        at = _HEAD_BYTES + 1
        for batch in batches:
            for lo, arrays in _encoded(batch.column(1), _cache(tokenizer_path, most), end, kind):
                frames = [] if index else [struct.pack(_HEAD, MAGIC, hashlib.sha256(words).digest(), TaskContext.get().partitionId(), np.dtype(kind).itemsize)]
                for k, ids in enumerate(arrays):
                    frame, doc = packer.compress(ids.tobytes()), batch.column(0)[lo + k].as_py()
                    index.append((doc or 0, doc is not None, at, len(frame), len(ids)))
                    at += len(frame) + 1
                    frames.append(frame)
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])
        if index:
            packed = _index_bytes(index)
            yield pa.RecordBatch.from_arrays([pa.array([packed + struct.pack(_TAIL, len(index), len(packed), MAGIC)], pa.binary())], ["value"])

    # rows that repeat an id keep the order they are read in, and so go to several shards where they are many
    order = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    lines = placed.select("doc_id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\n").text(f"{path}/shards")


# ---- reading -----------------------------------------------------------------


def header_of(content: memoryview | bytes, words: bytes) -> tuple[int, str]:
    """The number of a shard and the type of its ids; raises where it is no shard or needs another dictionary."""
    magic, digest, shard, width = struct.unpack(_HEAD, content[: _HEAD_BYTES])
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    if digest != hashlib.sha256(words).digest():
        raise ValueError("the shard was written with another dictionary")
    return shard, f"<u{width}"


def index_of(content: memoryview | bytes) -> dict[str, np.ndarray]:
    """The index of a shard."""
    n, length, magic = struct.unpack(_TAIL, content[-_TAIL_BYTES - 1 : -1])
    if magic != MAGIC:
        raise ValueError("the shard is cut short")
    end = len(content) - _TAIL_BYTES - 1
    raw = zstandard.ZstdDecompressor().decompress(bytes(content[end - length : end]))
    out, at = {}, 0
    for name, kind in _KINDS:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(f"{path}/dictionary/part-*").where("length > 0").select("content").first()
    return bytes(found["content"])[:-1] if found else b""


def frame_ids(frame: bytes, words: bytes, kind: str) -> np.ndarray:
    """The ids of one document from its frame."""
    own = zstandard.ZstdCompressionDict(words) if words else None
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=own).decompress(frame), kind)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards/part-*").where("length > 0").select("path", "content")


INDEX = "path string, shard long, place long, doc_id long, offset long, length long, n_tokens long, before long"


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the archive: path, shard, place, doc_id, offset, length, n_tokens, start, ids_crc32, and with ``with_ids`` the ids.

    ``place`` counts the documents of a shard, ``start`` the ids of all
    documents before. Every frame is decompressed and must hold as many ids as
    the index says.
    """
    words = dictionary_of(spark, path)

    def run(batches):
        own = zstandard.ZstdCompressionDict(words) if words else None
        unpacker = zstandard.ZstdDecompressor(dict_data=own)
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                content = memoryview(value.as_buffer())
                shard, kind = header_of(content, words)
                index = index_of(content)
                before = np.cumsum(index["n_tokens"]).astype(np.int64) - index["n_tokens"].astype(np.int64)
                for lo in range(0, len(before), 4096):
                    part = {k: v[lo : lo + 4096] for k, v in index.items()}
                    crc, own_ids = [], []
                    for at, size, n in zip(part["offset"].tolist(), part["length"].tolist(), part["n_tokens"].tolist(), strict=True):
                        ids = np.frombuffer(unpacker.decompress(content[at : at + size]), kind)
                        if len(ids) != n:
                            raise ValueError("a document has another number of ids than the index says")
                        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        if with_ids:
                            own_ids.append(ids.astype(np.int32))
                    n = len(crc)
                    columns = [
                        pa.array([name.as_py()] * n, pa.string()), pa.array(np.full(n, shard, np.int64)), pa.array(np.arange(lo, lo + n)), pa.array(part["doc_id"], pa.int64(), mask=part["named"] == 0),
                        *(pa.array(part[k].astype(np.int64)) for k in ("offset", "length", "n_tokens")), pa.array(before[lo : lo + n]), pa.array(crc, pa.int64()),
                    ]
                    names = [*(x.split()[0] for x in INDEX.split(", ")), "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own_ids, pa.list_(pa.int32()))] if with_ids else [])], [*names, *["ids"] * with_ids])

    scratch = Scratch(spark)
    found = _shards(spark, path).mapInArrow(run, INDEX + ", ids_crc32 long" + ", ids array<int>" * with_ids)
    found = scratch.keep(found, "documents")
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    sums = sizes.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))  # one row a shard
    placed = found.join(F.broadcast(sums), "shard").withColumn("start", F.col("_base") + F.col("before"))
    return placed.select("path", "shard", "place", "doc_id", "offset", "length", "n_tokens", "start", "ids_crc32", *["ids"] * with_ids)


def fetch(spark: SparkSession, path: str, doc: dict) -> np.ndarray:
    """The ids of one document by its row of the index (path, offset, length), by reading these bytes alone."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(doc["path"])
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        words = dictionary_of(spark, path)
        _, kind = header_of(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, _HEAD_BYTES)), words)
        stream.seek(doc["offset"])
        return frame_ids(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, doc["length"])), words, kind)
    finally:
        stream.close()


def archive(docs: DataFrame, tokenizer_path: str, cfg: TokenArchive = TokenArchive(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to an archive in the shared folder and read it back: the columns of ``read``.

    Texts are encoded whole; null is empty and has the end id alone. Rows with
    a null id come last, rows that repeat an id follow each other. An empty
    table gives no shards and no rows. Other columns are not read.
    """
    path = Scratch(docs.sparkSession).path("token-ids")
    write(docs, tokenizer_path, path, cfg, id_col, text_col)
    return read(docs.sparkSession, path)
