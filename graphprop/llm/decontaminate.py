"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Each benchmark window is looked up by its rarest words. The index stores the
postings (term, doc, position) of just those words in the training texts.
Postings less the word's offset in the window are candidate starts; a start
that all of a window's rarest words agree on is compared with the whole text,
so results are exact whatever words were chosen. Postings of frequent words are
salted. Texts are read where they lie: only those with candidates are kept for
the comparison, of the others no more than the number of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprop.llm.store import Scratch

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_RAW_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Decontamination:
    """A text is contaminated when at least 1 in ``share`` of its words lie in occurrences of windows.

    Postings of a word go to one group for each ``salt_rows`` of them.
    """

    width: int = 13
    rarest: int = 3
    share: int = 20
    salt_rows: int = 20_000


def words_of(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _BETWEEN_WORDS, -1), "")


def windows_of(benchmark: DataFrame, cfg: Decontamination, scratch: Scratch) -> DataFrame:
    """Distinct (window, item_id, phrase): the runs of ``width`` words of each item, or a shorter item whole."""
    w = F.col("words")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where((F.size("words") > 0) & F.col("item_id").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - cfg.width + 1, F.lit(1)))
    phrases = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i, cfg.width))).alias("phrase")).distinct()
    return scratch.keep(phrases.select(F.monotonically_increasing_id().alias("window"), "item_id", "phrase"), "windows")


def _n_words(text: Column) -> Column:
    """How many words a text has; no lower case is needed to count them."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN_RAW_WORDS, -1), "")).cast("long")


def rarest_terms(texts: DataFrame, windows: DataFrame, cfg: Decontamination, scratch: Scratch) -> DataFrame:
    """The ``rarest`` rarest words of each window over all texts: (window, term, offset, salts, rank, needed)."""
    terms = windows.select("window", F.posexplode("phrase").alias("offset", "term")).groupBy("window", "term").agg(F.min("offset").alias("offset"))
    # written first, so that the planner knows its size and moves no words where it is small
    vocabulary = scratch.keep(terms.select("term").distinct(), "vocabulary")
    counted = texts.select(F.explode(words_of(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = scratch.keep(counted, "counts")
    rated = terms.join(counted, "term", "left").select("window", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset").alias("t"))
    chosen = rated.groupBy("window").agg(F.slice(F.array_sort(F.collect_list("t")), 1, cfg.rarest).alias("ts"))
    # a word that no text holds rules its window out
    live = chosen.where(F.element_at("ts", 1)["n"] > 0)
    flat = live.select("window", F.size("ts").alias("needed"), F.posexplode("ts").alias("rank", "t"))
    salts = F.ceil(F.col("t.n") / cfg.salt_rows).cast("int").alias("salts")
    return scratch.keep(flat.select("window", F.col("t.term").alias("term"), F.col("t.offset").alias("offset"), salts, "rank", "needed"), "terms")


def postings_of(texts: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """The index: (term, salt, doc_id, pos) for every occurrence of the chosen terms."""
    tokens = texts.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    wanted = scratch.keep(terms.select("term", "salts").distinct(), "wanted")
    salt = F.pmod(F.xxhash64("doc_id", "pos"), F.col("salts")).cast("int").alias("salt")
    return scratch.keep(tokens.join(wanted, "term").select("term", salt, "doc_id", "pos"), "postings")


def placed_of(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Where windows would start by each posting: (window, doc_id, start, rank, needed)."""
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return postings.join(salted, ["term", "salt"]).select("window", "doc_id", (F.col("pos") - F.col("offset")).alias("start"), "rank", "needed")


def candidates_of(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Starts on which all chosen terms of a window agree: (window, doc_id, start)."""
    placed = placed_of(postings, terms).where("start >= 0")
    agreed = placed.groupBy("window", "doc_id", "start").agg(F.max("needed").alias("needed"), F.expr("bit_or(shiftleft(1, rank))").alias("ranks"))
    return agreed.where(F.bit_count("ranks") == F.col("needed")).select("window", "doc_id", "start")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The exact occurrences of benchmark windows: (doc_id, text_hash, start, item_id, phrase), each once for each text.

    ``start`` is a word position. Null and empty texts hold no words; benchmark
    rows without an id or words are left out. Rows that repeat an id and text
    are one text here; ``text_hash`` tells different texts of one id apart.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    windows = windows_of(benchmark, cfg, scratch)
    terms = rarest_terms(texts, windows, cfg, scratch)
    found = candidates_of(postings_of(texts, terms, scratch), terms).join(windows, "window").select("doc_id", "start", "item_id", "phrase")
    found = scratch.keep(found, "candidates")
    # a text's starts are at most its own words
    starts = scratch.keep(found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct("start", F.size("phrase").alias("k"))).alias("starts")), "starts")
    few = texts.join(starts.select("_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    few = scratch.keep(few, "few").dropDuplicates(["doc_id", "text_hash"])
    w = F.col("words")
    run = lambda s: F.struct(s["start"].alias("start"), F.slice(w, s["start"] + 1, s["k"]).alias("phrase"))
    held = few.join(starts, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "text_hash", F.explode(F.transform("starts", run)).alias("s"))
    held = held.select("doc_id", "text_hash", "s.start", "s.phrase").alias("h")
    same = F.col("h.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h.start") == F.col("f.start")) & (F.col("h.phrase") == F.col("f.phrase"))
    return held.join(found.alias("f"), same).select("h.doc_id", "h.text_hash", "h.start", "f.item_id", "h.phrase")


def decontaminate(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, hits, items, n_hit, contaminated.

    ``hits`` are the exact occurrences of benchmark windows (start, k) by word
    position, k words long; ``items`` the sorted item ids. Null and empty
    texts have no words and are not contaminated. Benchmark rows without an id
    or words are left out; repeated ones count once. Repeated rows and rows with
    a null id are each judged on their own text. Empty tables are fine on either
    side. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    match = phrase_matches(docs, benchmark, cfg, id_col, text_col)
    by_text = match.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set(F.struct("start", F.size("phrase").alias("k"))).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    by_text = scratch.keep(by_text, "hits")
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), _n_words(text).alias("n_words"))
    joined = counted.join(by_text, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    hit = joined.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<struct<start:int,k:int>>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["k"] - 1))))
    return hit.withColumn("n_hit", F.size(covered).cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * cfg.share >= F.col("n_words")))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, cfg: Decontamination = Decontamination(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Loose matches: (doc_id, item_id, window, start), where a window's rarest words all stand within ``slop`` words of where the phrase would have them.

    Starts are those of the rarest word. Null ids match nothing; null and empty
    texts hold no words.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    windows = windows_of(benchmark, cfg, scratch)
    terms = rarest_terms(texts, windows, cfg, scratch)
    placed = placed_of(postings_of(texts, terms, scratch), terms)
    cell = F.floor(F.col("start") / (slop + 1))
    first = placed.where("rank = 0").select("window", "doc_id", "start", "needed", cell.alias("cell"))
    other = placed.where("rank > 0").select("window", "doc_id", F.col("start").alias("near"), "rank", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    met = first.join(other, ["window", "doc_id", "cell"], "left").where(F.col("near").isNull() | (F.abs(F.col("near") - F.col("start")) <= slop))
    ranks = met.groupBy("window", "doc_id", "start").agg(F.max("needed").alias("needed"), F.expr("bit_or(shiftleft(1, coalesce(rank, 0)))").alias("ranks"))
    whole = ranks.where(F.bit_count(F.col("ranks").bitwiseOR(F.lit(1))) == F.col("needed"))
    return whole.join(windows, "window").select("doc_id", "item_id", "window", "start")


def digest(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return matches.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS i FROM w, sizes)
), hit AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""
