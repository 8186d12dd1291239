"""Small tables and plain-Python versions of what the operators compute."""

from __future__ import annotations

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, extra=True):
    """Rows of (doc_id, text) with columns whose names clash with those used inside."""
    if not extra:
        return spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(i, t, "en", 7, "x", 1.5, 3) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, band string, score double, words int")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


EDGE_TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "éè   ñ 漢字 🙂 end"), (6, "a b c d e f g h"), (None, "no id here at all, none"), (7, "same row twice"), (7, "same row twice")]
