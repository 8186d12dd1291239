from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from graphprop.llm import tokenids
from tests.llm.helpers import EDGE_TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = tokenizers.Tokenizer.from_file(PATH)
PARTS = [
    "word", "Word", "don't", "'s", "it's", "'still", "\"'ve", "I'LL", "12", "3.14", "...", "--", "?!", "é", "Ærø", "ſt", "×", "÷", "漢字", "🙂", "“quoted”", "naïve", "a_b", "http://x.y/z?q=1&r=2",
    " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", " ", " ", "　", "\x0b", "\x1c", "\x00", "<|endoftext|>", "<|", "|>", "²", "½", "²3",
]


def plain(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_ids_are_those_of_the_library():
    rng = random.Random(5)
    cache = tokenids.ByteCache(PATH, 5000)
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(0, 40))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        ids, of = cache.block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        for k, text in enumerate(texts):
            assert ids[of[k] : of[k + 1]].tolist() == PLAIN.encode(text, add_special_tokens=False).ids, repr(text)


def test_archive_round_trip(spark):
    rng = random.Random(7)
    rows = [*EDGE_TEXTS, *((100 + i, " ".join(rng.choice(PARTS) for _ in range(rng.randrange(200)))) for i in range(120)), (50, "long " * 60_000), (-3, "negative id")]
    df = documents(spark, rows).repartition(5)
    path = tokenids.Scratch(spark).path("own")
    tokenids.write(df, PATH, path)
    got = tokenids.read(spark, path, with_ids=True).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[-1] is None and ids[:-1] == sorted(i for i, _ in rows if i is not None)
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(plain(t))
    for r in got:
        want = texts[r["doc_id"]].pop()
        assert r["start"] == at and r["n_tokens"] == len(want) and r["ids"] == want.tolist() and r["ids_crc32"] == zlib.crc32(want.tobytes())
        at += len(want)
    one = next(r for r in got if r["doc_id"] == 50)
    assert tokenids.fetch(spark, path, one.asDict()).tolist() == one["ids"]
    assert len({r["path"] for r in got}) > 1


def test_shards_name_their_dictionary_and_cut_ones_raise(spark):
    df = documents(spark, [(i, f"text number {i} of some") for i in range(300)]).coalesce(1)
    path = tokenids.Scratch(spark).path("own")
    tokenids.write(df, PATH, path)
    words = tokenids.dictionary_of(spark, path)
    content = bytes(tokenids._shards(spark, path).first()["content"])
    assert words and tokenids.header_of(content, words)[1] == "<u2"
    with pytest.raises(ValueError, match="another dictionary"):
        tokenids.header_of(content, words + b"x")
    with pytest.raises(ValueError, match="cut short"):
        tokenids.index_of(content[:-9])
    with pytest.raises(ValueError, match="not a shard"):
        tokenids.header_of(b"x" + content, words)


def test_empty_table_and_short_ones(spark):
    assert tokenids.archive(documents(spark, []), PATH).count() == 0
    for rows in ([(1, None)], [(2, ""), (2, "")], [(None, "x")]):
        got = tokenids.archive(documents(spark, rows), PATH).collect()
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i or 0, len(plain(t))) for i, t in rows)


def test_the_dictionary_helps_short_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the same", "few phrases", "come again", "and again", "in every", "short text"]) for _ in range(12))) for i in range(400)]
    with_it = tokenids.archive(documents(spark, rows), PATH).agg({"length": "sum"}).first()[0]
    without = sum(len(tokenids.zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain(t).astype("<u2").tobytes())) for _, t in rows)
    assert with_it < 0.8 * without
