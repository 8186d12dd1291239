"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

The base patterns find seed entities. The words around them are lexical
patterns: the word before, the word after, and both. Other tokens that look
like identifiers are candidates. A graph of patterns and instances is scored in
rounds: a pattern is as sure as the share of its instances that are (believed
to be) of one kind, an instance as sure as its patterns together make it.
Candidates that end above the threshold become spans of that kind, and count as
seeds of further patterns, until no more are found.

One pass over the texts keeps spans, candidates and their contexts; all later
steps work on that small table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphprop.llm.store import Scratch

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, with possessive repeats and a start only where a run of
#: the first class starts (or the last match ended): the same matches, in linear
#: time and constant stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Tokens that look like identifiers: runs of digit groups, or anything with a digit or an at sign, also as [at].
CANDIDATE = r"(?<!\S)(?:\(?[0-9](?:[().\x20-]{0,3}[0-9])*+(?![^\s,;:!?.])|\S*(?:[0-9@]|\[at\])\S*)"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: What a candidate must look like to be taken for a kind.
SHAPES = {
    "email": r"^[^\s@]+(?:@|\[at\])[^\s@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$",
    "card": r"^(?:[0-9][./_\x20-]?){11,18}[0-9]$",
    "phone": r"^\(?[0-9](?:[().\x20/-]{0,2}[0-9]){6,14}$",
}


@dataclass(frozen=True)
class Bootstrap:
    """``min_support`` distinct seeds, base or accepted, make a context a pattern of a kind; below ``min_pattern`` it proposes nothing. ``rounds`` score each set of patterns."""

    rounds: int = 3
    min_support: int = 3
    min_pattern: float = 0.6
    min_instance: float = 0.9
    context_chars: int = 48


def _running(values: Column, join) -> Column:
    """0 and then ``join`` over all elements up to each of an array of longs, in blocks so that no long array is copied per element."""
    size = 128
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))
    add = lambda acc, v: F.concat(acc, F.array(join(F.element_at(acc, -1), v)))
    before = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), join)), F.array(F.lit(0).cast("long")), add)
    inside = F.transform(blocks, lambda x, b: F.slice(F.aggregate(x, F.array(F.get(before, b)), add), 1, F.size(x)))
    return F.flatten(inside)


def _prefix_sums(values: Column) -> Column:
    """The sums before each element."""
    return _running(values, lambda s, v: s + v)


def _starts(pieces: Column, matches: Column) -> Column:
    """Where each match starts, from ``split`` and ``regexp_extract_all``."""
    before = F.slice(pieces, 1, F.size(matches))
    widths = F.zip_with(before, matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    return F.zip_with(_prefix_sums(widths), before, lambda a, p: a + F.length(p))


def _spans(pieces: Column, matches: Column, context: int) -> Column:
    """Structs (s, e, m, l, r): start, end, match, word before and word after, from ``split`` and ``regexp_extract_all``."""
    last = lambda p: F.lower(F.regexp_extract(F.substring(p, -context, context), r"(\S+)\s*$", 1))
    first = lambda p: F.lower(F.regexp_extract(F.substring(p, 1, context), r"^\s*(\S+)", 1))
    widths = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    at = _prefix_sums(widths)
    rows = F.zip_with(
        F.zip_with(matches, at, lambda m, a: F.struct(m.alias("m"), a.alias("a"))),
        F.zip_with(F.slice(pieces, 1, F.size(matches)), F.slice(pieces, 2, F.size(matches)), lambda p, q: F.struct(p.alias("p"), q.alias("q"))),
        lambda x, c: F.struct((x["a"] + F.length(c["p"])).alias("s"), (x["a"] + F.length(c["p"]) + F.length(x["m"])).alias("e"), x["m"].alias("m"), last(c["p"]).alias("l"), first(c["q"]).alias("r")),
    )
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>")
    return F.when(F.size(matches) > 0, rows).otherwise(empty)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, k: acc + F.when((n - k) % 2 == 0, F.substring(digits, k, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, k, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _passes(kind: str):
    return lambda x: _valid(kind, x["m"])


def _masked(kind: str):
    return lambda m: F.when(_valid(kind, m), F.lit(f"<{kind}>")).otherwise(m)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def find(docs: DataFrame, cfg: Bootstrap, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the valid base spans of each kind, the candidate tokens; each with its context."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    patterns = {**BASE, "candidate": CANDIDATE}
    matched = text.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()])
    split = matched.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"p_{k}") for k, p in patterns.items()])
    placed = split.select("doc_id", F.xxhash64("text").alias("text_hash"), *[_spans(F.col(f"p_{k}"), F.col(f"m_{k}"), cfg.context_chars).alias(k) for k in patterns])
    return placed.select("doc_id", "text_hash", *[F.filter(k, _passes(k)).alias(k) for k in KINDS], "candidate")


def _loose(found: DataFrame) -> DataFrame:
    """Candidates that touch no base span: (row, s, e, m, l, r); surrounding punctuation is stripped."""
    fields = lambda x: [x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["l"].alias("l"), x["r"].alias("r")]
    base = found.where(F.size("candidate") > 0).select("row", F.explode(F.concat(*KINDS)).alias("x")).select("row", *fields(F.col("x")), F.lit(True).alias("base"))
    lead, core = r"^[\"'(\[<{]*", r"^[\"'(\[<{]*(.*?)[\"')\]>},;:.!?\s]*$"
    token = found.select("row", F.explode("candidate").alias("x")).select("row", *fields(F.col("x")))
    bare = F.when(F.regexp_count("m", F.lit(r"\(")) == F.regexp_count("m", F.lit(r"\)")), F.regexp_replace("m", r"[\"',;:.!?\s]+$", "")).otherwise(F.regexp_extract("m", core, 1))
    shift = F.when(F.regexp_count("m", F.lit(r"\(")) == F.regexp_count("m", F.lit(r"\)")), F.lit(0)).otherwise(F.length(F.regexp_extract("m", lead, 0)))
    token = token.select("row", (F.col("s") + shift).alias("s"), F.col("l"), F.col("r"), bare.alias("m")).withColumn("e", F.col("s") + F.length("m")).where("e > s")
    both = base.unionByName(token.withColumn("base", F.lit(False)))
    order = Window.partitionBy("row").orderBy("s", F.desc("base"), "e")
    before = F.max(F.when(F.col("base"), F.col("e"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("s"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.select("*", before.alias("before"), after.alias("after")).where(~F.col("base") & F.coalesce(F.col("before") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("e"), F.lit(True))).drop("base", "before", "after")


def _contexts(rows: DataFrame) -> DataFrame:
    """A row for each pattern an occurrence matches: the word before, the word after, both."""
    return rows.withColumn("pattern", F.explode(F.array(F.concat(F.lit("L "), F.col("l")), F.concat(F.lit("R "), F.col("r")), F.concat(F.lit("B "), F.col("l"), F.lit(" "), F.col("r")))))


def discover(found: DataFrame, cfg: Bootstrap, scratch: Scratch) -> DataFrame:
    """The spans that patterns add: (row, kind, s, e, confidence)."""
    loose = scratch.keep(
        _loose(found).select("row", "s", "e", F.lower("m").alias("instance"), "l", "r", F.array_compact(F.array(*[F.when(F.col("m").rlike(SHAPES[k]), F.lit(k)) for k in KINDS])).alias("kinds")), "loose"
    )
    seeds = reduce(DataFrame.unionByName, [found.select(F.explode(k).alias("x")).select(F.lit(k).alias("kind"), F.lower("x.m").alias("instance"), F.col("x.l").alias("l"), F.col("x.r").alias("r")) for k in KINDS])
    seed_edge = _contexts(seeds).groupBy("pattern", "kind", "instance").agg(F.lit(1.0).alias("score"))
    all_edge = scratch.keep(_contexts(loose).groupBy("pattern", "instance").agg(F.first("kinds").alias("kinds")), "edges")
    accepted = None
    while True:
        edge, rest = seed_edge.select("pattern", "kind", "instance"), all_edge
        if accepted is not None:
            edge = edge.unionByName(all_edge.join(accepted, "instance").select("pattern", "kind", "instance")).distinct()
            rest = all_edge.join(accepted, "instance", "left_anti")
        seen = edge.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
        other = rest.groupBy("pattern").agg(F.count(F.lit(1)).alias("loose"))
        total = seen.groupBy("pattern").agg(F.sum("seeds").alias("seed_total")).join(other, "pattern", "left")
        pattern = scratch.keep(
            seen.where(F.col("seeds") >= cfg.min_support).join(total, "pattern").select("pattern", "kind", "seeds", (F.col("seed_total") + F.coalesce("loose", F.lit(0)) + 1).alias("size")), "patterns"
        )
        offered = scratch.keep(rest.select("pattern", "instance", F.explode("kinds").alias("kind")).join(pattern.select("pattern", "kind"), ["pattern", "kind"], "left_semi"), "offered")
        score = offered.select("kind", "instance").distinct().withColumn("score", F.lit(0.0))
        for _ in range(cfg.rounds):
            believed = offered.join(score, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            sure = pattern.join(believed, ["pattern", "kind"], "left").select("pattern", "kind", ((F.col("seeds") + F.coalesce("more", F.lit(0.0))) / F.col("size")).alias("sure")).where(F.col("sure") >= cfg.min_pattern)
            score = offered.join(sure, ["pattern", "kind"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("sure", F.lit(0.999)))))).alias("score"))
            score = scratch.keep(score, "scores")
        best = score.where(F.col("score") >= cfg.min_instance).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("confidence"))
        new = scratch.keep(best, "accepted")
        if not new.limit(1).count():
            break
        accepted = new if accepted is None else scratch.keep(accepted.unionByName(new), "accepted")
    best = new if accepted is None else accepted
    return loose.join(best, "instance").where(F.array_contains("kinds", F.col("kind"))).select("row", "kind", "s", "e", "confidence")


def personal_data(docs: DataFrame, cfg: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, ``base`` and ``added`` spans as arrays of (s, o, kind, e).

    Offsets are code points, ends exclusive; both arrays are sorted by start,
    then kind as listed in KINDS (``o``). Base spans are the leftmost
    non-overlapping matches of each kind that pass its test. Null and empty
    texts have none. Repeated rows and rows with a null id are searched each.
    An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(find(docs, cfg, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "found")
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = discover(found, cfg, scratch).groupBy("row").agg(F.collect_list(F.struct("s", place[F.col("kind")].alias("o"), "kind", "e")).alias("added"))
    typed = lambda k, i: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("o"), F.lit(k).alias("kind"), x["e"].alias("e")))
    base = F.array_sort(F.concat(*[typed(k, i) for i, k in enumerate(KINDS)]))
    out = found.select("row", "doc_id", "text_hash", base.alias("base")).join(added, "row", "left")
    kind = "array<struct<s:bigint,o:int,kind:string,e:bigint>>"
    return out.select("doc_id", "text_hash", F.col("base").cast(kind).alias("base"), F.array_sort(F.coalesce(F.col("added").cast(kind), F.array().cast(kind))).alias("added"))


#: Code points of a block that texts are cut into, so that a piece is found without counting from the start.
BLOCK = 1024


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The code points from ``a`` to before ``b`` of a text cut into blocks."""
    first = F.floor(a / BLOCK).cast("int")
    own = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(b > a, F.substring(own, (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")


def redact(docs: DataFrame, cfg: Bootstrap = Bootstrap(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``personal_data`` in the text replaced by their kinds in angle brackets.

    All spans are those of the text as it came: base spans are found again by
    the same patterns and tests, added spans, which are few, are joined to their
    rows. No code point of any span stays; spans that overlap leave their kinds
    one after the other, by start. What is left is then searched again, kind
    after kind, for what a failed match had covered; a match that fails its test
    stays. Rows, other columns and null texts stay as they are.
    """
    columns = docs.columns
    added = personal_data(docs, cfg, id_col, text_col).where(F.size("added") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("added").alias("_added")).dropDuplicates(["_doc", "_hash"])
    # written first, so that the planner knows their size and shuffles the texts only if they are many
    added = Scratch(docs.sparkSession).keep(added, "added")
    t = F.coalesce(F.col(text_col), F.lit(""))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(t) == F.col("_hash"))
    kind, none = "array<struct<s:bigint,o:int,kind:string,e:bigint>>", F.array().cast("array<string>")
    out = docs.join(added, same, "left").select(*[F.col(c) for c in columns], F.coalesce(F.col("_added").cast(kind), F.array().cast(kind)).alias("_added"))
    out = out.select("*", *[F.regexp_extract_all(t, F.lit(BASE[k]), F.lit(0)).alias(f"_m_{k}") for k in KINDS])
    out = out.select("*", *[F.when(F.size(f"_m_{k}") > 0, F.split(t, BASE[k], -1)).otherwise(none).alias(f"_p_{k}") for k in KINDS])

    def base(k: str, o: int) -> Column:
        span = lambda m, s: F.struct(s.alias("s"), F.lit(o).alias("o"), F.lit(k).alias("kind"), (s + F.length(m)).alias("e"), m.alias("m"))
        found = F.filter(F.zip_with(f"_m_{k}", _starts(F.col(f"_p_{k}"), F.col(f"_m_{k}")), span), _passes(k))
        return F.when(F.size(f"_m_{k}") > 0, F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["kind"].alias("kind"), x["e"].alias("e"))).cast(kind)).otherwise(F.array().cast(kind))

    out = out.select(*columns, F.array_sort(F.concat("_added", *[base(k, o) for o, k in enumerate(KINDS)])).alias("_spans"))
    reach = _running(F.transform("_spans", lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    some = F.size("_spans") > 0
    out = out.select("*", F.when(some, reach).alias("_reach"), F.when(some, F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("_blocks"))
    pieces = F.zip_with("_spans", "_reach", lambda x, r: F.concat(_between(F.col("_blocks"), r, x["s"]), F.lit("<"), x["kind"], F.lit(">")))
    last = F.array_max(F.transform("_spans", lambda x: x["e"]))
    cut = F.concat(F.array_join(pieces, ""), _between(F.col("_blocks"), last, F.length(t).cast("long")))
    out = out.withColumn(text_col, F.when(some, cut).otherwise(F.col(text_col))).select(*columns)
    text = F.col(text_col)
    for k in ("email", "phone", "ip", "card"):
        matches, parts = F.regexp_extract_all(text, F.lit(BASE[k]), F.lit(0)), F.split(text, BASE[k], -1)
        tail = F.concat(F.transform(matches, _masked(k)), F.array(F.lit("")))
        rebuilt = F.array_join(F.zip_with(parts, tail, lambda p, m: F.concat(p, m)), "")
        out = out.withColumn(text_col, F.when(F.regexp_like(text, F.lit(BASE[k])), rebuilt).otherwise(text))
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, joined as kind:start:end), n_added."""
    return spans.select(
        "doc_id",
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
