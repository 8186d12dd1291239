"""Spelling variants: words at one edit from each other, found by a frontier of states over a relational trie.

The trie is an edge table. A state (word, position, node) has read ``position``
letters of the word, with one edit, and stands at a node. States are made at
every position from a word's own path: a letter left out stays at the node, a
letter replaced goes to a sibling. Then all states are joined with the edges
level by level; one that has read its word at a node where another word ends is
a neighbour. A word with a letter more finds the one with a letter less, and of
two letters in one place the smaller finds the greater, so inserted letters
need no states.

Levels are those of the compressed trie: an edge leads to the next node that
branches or ends a word, and carries the length and a hash of its letters. So
long words without company take few rounds. Nodes are hashes of prefixes; what
is found is compared letter by letter, so equal hashes add nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphprop.llm.store import Scratch

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = "[^A-Za-z\\u00C0-\\u00FF]+"


@dataclass(frozen=True)
class Spelling:
    """Words have at least ``least_letters`` letters and ``least_count`` occurrences; a form has ``share`` times the word's. One run in ``drop_one_in``, by hash, loses a letter."""

    least_letters: int = 6
    least_count: int = 5
    share: int = 5
    drop_one_in: int = 199
    max_rounds: int = 100_000


def counted_words(docs: DataFrame, cfg: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, that are long and frequent enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    runs = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("_id"), F.explode(F.split(low, _BETWEEN, -1)).alias("run"))
    # deleting a letter makes no run longer
    long = runs.where(F.length("run") >= cfg.least_letters).withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("_h"), F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("_h") % cfg.drop_one_in == 0, short).otherwise(F.col("run"))
    words = long.select(word.alias("word")).where(F.length("word") >= cfg.least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.least_count)


def _node(word: Column, k: Column | int) -> Column:
    """The node that the first ``k`` letters lead to."""
    return F.xxhash64(F.substr(word, F.lit(1), F.lit(k) if isinstance(k, int) else k))


def _letters(words: DataFrame) -> DataFrame:
    """Each word's own path: (word, n, k, node, ch, child), the edge of its letter k from 0."""
    w, k = F.col("word"), F.col("k")
    each = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("k"))
    return each.select("word", "n", "k", _node(w, k).alias("node"), F.substr(w, k + 1, F.lit(1)).alias("ch"), _node(w, k + 1).alias("child"))


def trie(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges (node, ch, child, k) letter by letter, and those of the compressed trie: (node, ch, size, label, child) from every node to the next stop."""
    path = _letters(words)
    edges = scratch.keep(path.groupBy("node", "ch", "child").agg(F.min("k").alias("k")), "edges")
    branching = edges.groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("k").alias("_k")).where("_n > 1").select("node", "_k")
    ends = words.select(F.xxhash64("word").alias("node"), F.length("word").alias("_k"))
    stops = branching.union(ends).groupBy(F.col("node").alias("child")).agg(F.min("_k").alias("_k"))
    plain = path.select("word", "k", "node", "ch", "child")
    # as below, the first levels have few nodes and all words: of the nodes at the first two, at most 8,190 are stops
    near = plain.where("k < 2").join(F.broadcast(stops.where("_k <= 2")), "child", "left")
    far = plain.where("k >= 2").join(stops.where("_k > 2"), "child", "left")
    marked = near.unionByName(far).select("word", "k", "node", "ch", F.when(F.col("_k").isNotNull(), F.col("k") + 1).alias("_at"))
    ahead = Window.partitionBy("word").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = marked.withColumn("_to", F.min("_at").over(ahead))
    size = F.col("_to") - F.col("k")
    label = F.xxhash64(F.substr("word", F.col("k") + 1, size))
    jumps = reach.select("node", "ch", F.struct(size.alias("size"), label.alias("label"), _node(F.col("word"), F.col("_to")).alias("child")).alias("e"))
    jumps = jumps.groupBy("node", "ch").agg(F.first("e.size").alias("size"), F.first("e.label").alias("label"), F.first("e.child").alias("child"))  # words that share the edge share what follows
    return edges, scratch.keep(jumps, "jumps")


def _edited(words: DataFrame, edges: DataFrame, cfg: Spelling) -> DataFrame:
    """The states after one edit: (word, n, pos, node)."""
    path, w, k = _letters(words), F.col("word"), F.col("k")
    again = F.substr(w, k + 2, F.lit(1)) == F.col("ch")  # of equal letters in a row only the last is left out
    without = path.where((F.length("word") > cfg.least_letters) & ~again).select("word", "n", (k + 1).alias("pos"), "node")
    other = edges.select("node", F.col("ch").alias("_ch"), F.col("child").alias("_child"), F.col("k").alias("_k"))
    # the first two levels hold all words but, with 90 letters, at most 8,190 edges; the others are joined by their nodes
    shallow = path.where("k < 2").join(F.broadcast(other.where("_k < 2")), "node")
    deep = path.where("k >= 2").join(other.where("_k >= 2"), "node")
    swap = lambda d: d.where("_ch > ch").select("word", "n", (k + 1).alias("pos"), F.col("_child").alias("node"))
    return without.unionByName(swap(shallow)).unionByName(swap(deep))


def _moved(states: DataFrame, jumps: DataFrame) -> DataFrame:
    """States one level on: those whose next letters are their edge's, and, marked as done, those at the end of their words."""
    w, pos = F.col("word"), F.col("pos")
    left = states.withColumn("done", pos == F.length("word")).withColumn("ch", F.when(~F.col("done"), F.substr(w, pos + 1, F.lit(1))))
    met = left.join(jumps.select(F.col("node").alias("_node"), F.col("ch").alias("_ch"), "size", "label", "child"), (F.col("node") == F.col("_node")) & (F.col("ch") == F.col("_ch")), "left")
    on = (pos + F.col("size") <= F.length("word")) & (F.xxhash64(F.substr(w, pos + 1, F.col("size"))) == F.col("label"))
    return met.where(F.col("done") | on).select("word", "n", F.when(F.col("done"), pos).otherwise(pos + F.col("size")).alias("pos"), F.when(F.col("done"), F.col("node")).otherwise(F.col("child")).alias("node"), "done")


def neighbours(words: DataFrame, cfg: Spelling = Spelling()) -> DataFrame:
    """(word, n, near, near_n), both ways: the pairs of ``words`` (word, n) at one edit, each once."""
    scratch = Scratch(words.sparkSession)
    edges, jumps = trie(words, scratch)
    states, rounds, paths = _edited(words, edges, cfg), 0, []
    while rounds < cfg.max_rounds:
        seen, at = Observation(), scratch.path("states")
        _moved(states, jumps).observe(seen, F.count_if(~F.col("done")).alias("left")).write.option("compression", "zstd").parquet(at)
        paths.append(at)
        rounds += 1
        if not seen.get["left"]:
            break
        states = words.sparkSession.read.parquet(at).where("not done").drop("done")
    else:
        raise RuntimeError(f"states are left after {rounds} levels")
    ended = words.sparkSession.read.parquet(*paths).where("done").select("word", "n", "node")
    found = ended.join(words.select(F.xxhash64("word").alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n")), "node").where(F.levenshtein("word", "near", 1) == 1)
    found = scratch.keep(found.select("word", "n", "near", "near_n").distinct(), "pairs")
    return found.union(found.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for the words of (word, form): forms followed to the last, twice as far each round."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation()
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more"))
        now = scratch.keep(after.observe(seen, F.count_if("_more").alias("n")).drop("_more"), "roots")
        if not seen.get["n"]:
            return now


def variants(docs: DataFrame, cfg: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n, of equal ones the first in
    code-point order, if that n is at least ``share`` times the word's; ``root``
    follows forms to the last and is the word itself where there is none. Null
    texts hold no words; a null id counts as an empty one in the hash that picks
    a letter. Rows that repeat are counted each. An empty table gives no words.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(counted_words(docs, cfg, id_col, text_col), "words")
    near = neighbours(words, cfg)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("_n"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    good = -F.col("b.m") >= cfg.share * F.col("_n")
    judged = scratch.keep(best.select("word", "n_near", F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.m")).alias("form_n")), "judged")
    root = roots(judged.where("form is not null").select("word", "form"), scratch)
    out = words.join(judged, "word", "left").join(root, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
