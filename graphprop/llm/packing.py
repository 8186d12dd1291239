"""Packing token sequences by bin completion, a branch-and-bound over the lengths' histogram.

Executors tokenise whole texts and cut only what is longer than a sequence. The
driver gets one count for each length (at most ``capacity`` of them) and plans
sequences as patterns of lengths with a multiplicity; executors then place each
piece by its rank among the pieces of its length. Ranks come from salted
buckets of a length, so no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.store import Scratch


@dataclass(frozen=True)
class Packing:
    """``nodes`` bounds each of the two searches, not the rows: where both end early the best plan so far is used."""

    capacity: int = 2048
    end_id: int = 0
    nodes: int = 6000
    branches: int = 4
    bucket_rows: int = 50_000
    cached_words: int = 1_000_000


# ---- tokens ------------------------------------------------------------------

# classes of bytes
_BLANK, _LETTER, _DIGIT, _SYMBOL, _MIXED = range(5)

_PLAIN = np.zeros(256, bool)
_PLAIN[32:127] = True
_PLAIN[[9, 10, 13]] = True
_PLAIN[128:192] = True  # continuation bytes; what they continue is judged by the leading byte
_PLAIN[0xC3:0xC6] = True  # Latin letters up to U+017F

_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 13, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[65:91] = _LETTER
_CLASS[128:] = _LETTER


def _odd_bytes(data: np.ndarray) -> np.ndarray:
    """Marks of what makes a row one to encode whole: other scripts and controls, signs among the Latin letters, the dotted capital I, and the start of a special token."""
    odd = ~_PLAIN[data]
    if len(data) > 1:
        first, second = data[:-1], data[1:]
        odd[:-1] |= (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0) | (first == 60) & (second == 124)
    return odd


def _pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of runs of letters, single digits and runs of signs, and each row's range.

    A blank-separated word with an apostrophe, in which contractions count, is
    one run of class ``_MIXED``.
    """
    kind = _CLASS[data]
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        ws, we, _ = tx.words(data, offsets, _CLASS == _BLANK)
        hit = np.unique(np.searchsorted(ws, quotes, "right") - 1)
        cover = np.zeros(len(data) + 1, np.int8)
        cover[ws[hit]] += 1
        np.subtract.at(cover, we[hit], 1)
        kind[np.cumsum(cover[:-1], dtype=np.int8) > 0] = _MIXED
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), kind, np.zeros(len(offsets), np.int64)
    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start[offsets[(offsets > 0) & (offsets < len(data))]] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(data))
    full = kind[at] != _BLANK
    at, end = at[full], end[full]
    return at, end, kind[at], np.searchsorted(at, offsets)


class WordCache:
    """Token ids of words, kept by hash; encodes the words of a block that are new.

    The tokenizer drops blanks and splits the rest into runs of letters, single
    digits and runs of signs before it merges, so a text's ids are those of its
    runs in turn. That is relied on for texts of ASCII and Latin letters;
    others are encoded whole. The last id of a run ends in the vocabulary's
    end-of-word mark, which tells the ids of joined words apart.
    """

    def __init__(self, tokenizer_path: str, most: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known, self.first, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint16 if len(self.last) <= 1 << 16 else np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, a few texts at a time."""
        return [e.ids for lo in range(0, len(texts), 256) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 256], add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words that are one run each, and how many each has."""
        joined = [" ".join(words[lo : lo + 1000]) for lo in range(0, len(words), 1000)]
        flat = np.concatenate([np.array(x, np.uint32) for x in self.encode(joined)] or [np.empty(0, np.uint32)])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) == len(words) and (not len(ends) or ends[-1] == len(flat)):
            return flat, np.diff(ends, prepend=0)
        ids = self.encode(words)
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def learn(self, h: np.ndarray, words: list[str], mixed: np.ndarray) -> None:
        if len(self.known) + len(h) > self.most:
            self._clear()
        plain, alone = np.flatnonzero(~mixed), np.flatnonzero(mixed)
        flat, length = self.encode_words([words[k] for k in plain])
        own = self.encode([words[k] for k in alone])
        flat = np.concatenate([flat, np.array([i for x in own for i in x], np.uint32)])
        length = np.concatenate([length, np.array([len(x) for x in own], np.int64)])
        known = np.concatenate([self.known, h[plain], h[alone]])
        order = np.argsort(known, kind="stable")
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length) - length])[order]
        self.known, self.length = known[order], np.concatenate([self.length, length.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, flat.astype(self.ids.dtype)])

    def block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and each row's range."""
        n = len(offsets) - 1
        odd = np.zeros(n, bool)
        marks = np.flatnonzero(_odd_bytes(raw))
        odd[np.searchsorted(offsets, marks, "right") - 1] = True
        data = tx.folded(raw)
        starts, ends, kinds, of = _pretokens(data, offsets)
        row = np.repeat(np.arange(n), np.diff(of))
        if odd.any():
            plain = ~odd[row]
            starts, ends, kinds, row = starts[plain], ends[plain], kinds[plain], row[plain]
        u, at, back = np.unique(tx.hashes(data, starts, ends), return_index=True, return_inverse=True)
        for _ in range(2):  # anew if the cache was emptied for this block
            pos = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
            new = self.known[pos] != u if len(self.known) else np.ones(len(u), bool)
            if not new.any():
                break
            text = data.tobytes()
            self.learn(u[new], [text[starts[k] : ends[k]].decode("utf-8", "replace") for k in at[new]], kinds[at[new]] == _MIXED)
        pos = np.searchsorted(self.known, u)[back]
        count = self.length[pos].astype(np.int64)
        out = self.ids[np.repeat(self.first[pos] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        ranges = np.concatenate([[0], np.cumsum(np.bincount(row, count, n).astype(np.int64))])
        if not odd.any():
            return out, ranges
        whole = dict(zip(np.flatnonzero(odd), self.encode([raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in np.flatnonzero(odd)]), strict=True))
        parts = [np.array(whole[k], np.uint32) if k in whole else out[ranges[k] : ranges[k + 1]] for k in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_caches: dict[tuple[str, int], WordCache] = {}


def pieces(docs: DataFrame, tokenizer_path: str, cfg: Packing = Packing(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of each row: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids themselves."""
    capacity, end, most = cfg.capacity, cfg.end_id, cfg.cached_words

    def run(batches):
        cache = _caches.get((tokenizer_path, most)) or _caches.setdefault((tokenizer_path, most), WordCache(tokenizer_path, most))
        for batch in batches:
            data, offsets = tx.utf8(batch.column(1))
            for lo, hi in tx.blocks(offsets):
                ids, of = cache.block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for k in range(hi - lo):
                    doc = np.append(ids[of[k] : of[k + 1]].astype("<u4"), np.array([end], "<u4"))
                    for p, a in enumerate(range(0, len(doc), capacity)):
                        part = doc[a : a + capacity]
                        row.append(lo + k)
                        piece.append(p)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# ---- the plan ----------------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts by length: patterns and how many sequences have each."""
    bins: list[tuple[int, int, Pattern]] = []  # room, how many, contents
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        if not left:
            continue
        out = []
        for room, many, held in sorted(bins):
            k = room // length
            if not left or not k:
                out.append((room, many, held))
                continue
            full = min(many, left // k)
            left -= full * k
            if full:
                out.append((room - k * length, full, (*held, (length, k))))
            if full < many:
                rest = min(left, k)
                left -= rest
                if rest:
                    out.append((room - rest * length, 1, (*held, (length, rest))))
                if many - full - (rest > 0):
                    out.append((room, many - full - (rest > 0), held))
        if left:
            k = capacity // length
            if left // k:
                out.append((capacity - k * length, left // k, ((length, k),)))
            if left % k:
                out.append((capacity - left % k * length, 1, ((length, left % k),)))
        bins = out
    return [(held, many) for _, many, held in bins]


def _likely(counts: np.ndarray, room: int, most: int) -> list[Pattern]:
    """A few fillings of ``room`` to try first, the least waste first, of equal waste the fewest pieces.

    A piece that fills the room alone dominates every other filling. Otherwise
    a greedy start of the longest pieces is completed by one piece or by the
    best pair. ``_undominated`` has the others.
    """
    if counts[room] > 0:
        return [((room, 1),)]
    found: dict[Pattern, int] = {}
    have = np.flatnonzero(counts[: room + 1] > 0)
    if not len(have):
        return [()]

    def add(parts: list[int]) -> None:
        u, n = np.unique(parts, return_counts=True)
        if (counts[u] >= n).all():
            found[tuple((int(a), int(b)) for a, b in zip(u[::-1], n[::-1], strict=True))] = room - sum(parts)

    taken: list[int] = []
    rest = counts[: room + 1].copy()
    left = room
    for _ in range(64):
        have = np.flatnonzero(rest[: left + 1] > 0)
        if not len(have):
            break
        add([*taken, int(have[-1])])
        partner = left - have
        low = np.searchsorted(have, partner, "right") - 1
        ok = low >= 0
        a, b = have[ok], have[low[ok]]
        two = (a != b) | (rest[a] > 1)
        a, b = a[two], b[two]
        if len(a):
            for k in np.lexsort((-np.maximum(a, b), left - a - b))[:2]:
                add([*taken, int(a[k]), int(b[k])])
                if a[k] + b[k] == left and len(found) >= most:
                    break
        if found and min(found.values()) == 0 and len(found) >= most:
            break
        x = int(have[-1])
        taken.append(x)
        rest[x] -= 1
        left -= x
    return sorted(found, key=lambda p: (found[p], sum(n for _, n in p)))[:most]


def _dominated(filling: Pattern, waste: int, others: int) -> bool:
    """Whether a piece of ``others`` (a bit for each length) may take the place of some of the filling's, which then fit where that piece was."""
    one, more = 0, 0  # sums of one piece, of two or more
    for length, n in filling:
        for _ in range(n):
            more |= (one | more) << length
            one |= 1 << length
    near, width = one | more | 1, 1  # a sum and up to width - 1 beyond it
    while width < waste:
        step = min(width, waste - width)
        near |= near << step
        width += step
    return bool(more & others or waste and near << 1 & others)


def _undominated(counts: np.ndarray, room: int, spare: int) -> Iterator[Pattern | None]:
    """All fillings of ``room`` that waste at most ``spare`` and that no other dominates, depth first; None for each that does not count, so that the caller may stop."""
    have = np.flatnonzero(counts[: room + 1] > 0)
    reach = np.cumsum(have * counts[have]).tolist()
    sizes, stock = have.tolist(), counts[have].tolist()
    held = int.from_bytes(np.packbits(counts[: room + 1] > 0, bitorder="little").tobytes(), "little")

    def deeper(k: int, left: int, taken: Pattern, others: int) -> Iterator[Pattern | None]:
        for i in range(min(k, bisect.bisect_right(sizes, left)) - 1, -1, -1):
            if left - reach[i] > spare:
                break
            for n in range(min(stock[i], left // sizes[i]), 0, -1):
                yield from deeper(i, left - n * sizes[i], (*taken, (sizes[i], n)), others ^ (1 << sizes[i]) if n == stock[i] else others)
        yield None if left > spare or _dominated(taken, left, others) else taken

    yield from deeper(len(sizes), room, (), held)


def _steps(left: np.ndarray, capacity: int, spare: int, branches: int, every: bool) -> Iterator[tuple[Pattern, int] | None]:
    """What may be done about the longest piece: likely patterns as often as the counts allow; with ``every`` also all others, and each less often, by halves down to once."""
    x = int(np.flatnonzero(left)[-1])
    rest = left.copy()
    rest[x] -= 1

    def often(filling: Pattern) -> tuple[Pattern, int]:
        parts = dict(filling)
        parts[x] = parts.get(x, 0) + 1
        pattern = tuple(sorted(parts.items(), reverse=True))
        return pattern, min(int(left[k]) // n for k, n in pattern)

    likely = [often(f) for f in _likely(rest, capacity - x, branches)]
    yield from likely
    if not every:
        return
    for pattern, times in likely:
        while times := times // 2:
            yield pattern, times
    tried = {pattern for pattern, _ in likely}
    for filling in _undominated(rest, capacity - x, spare):
        pattern, times = often(filling) if filling is not None else ((), 0)
        if not times:
            yield None
        elif pattern not in tried:
            while times:
                yield pattern, times
                times //= 2


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = 6000, branches: int = 4) -> list[tuple[Pattern, int]]:
    """As few sequences as the search finds for ``counts[length]`` pieces of each length; the fewest, if ``nodes`` suffice.

    Depth first: complete the longest piece left. The incumbent is best-fit
    decreasing; a branch whose waste already excludes fewer sequences is cut,
    as is a rest that was met with no more sequences before, and reaching the
    lower bound ends the search. A first search takes likely fillings only, a
    second one every filling that no other dominates. ``nodes`` bounds each;
    steps and fillings that are tried in vain count.
    """
    best = best_fit(counts, capacity)
    most = sum(n for _, n in best)
    size = np.arange(len(counts))
    total = int((counts * size).sum())
    long = slice(capacity // 2 + 1, None)
    least = max(-(-total // capacity), int(counts[long].sum()))
    if most <= least:
        return best
    for every in (False, True):
        met: dict[bytes, int] = {}
        path: list[tuple[Pattern, int]] = []
        stack = [(counts, total, 0, _steps(counts, capacity, (most - 1) * capacity - total, branches, every))]
        tries = nodes
        while stack and most > least and tries:
            left, sum_left, used, steps = stack[-1]
            step = next(steps, ())
            if step == ():
                stack.pop()
                del path[-1:]
                continue
            tries -= 1
            if step is None:
                continue
            pattern, times = step
            after = left.copy()
            for k, n in pattern:
                after[k] -= n * times
            rest, now = sum_left - times * sum(k * n for k, n in pattern), used + times
            if not rest:
                if now < most:
                    most, best = now, [*path, step]
                continue
            if now + max(-(-rest // capacity), int(after[long].sum())) >= most:
                continue
            key = hashlib.blake2b(after.tobytes(), digest_size=16).digest()
            if met.get(key, most) <= now:
                continue
            met[key] = now
            path.append(step)
            stack.append((after, rest, now, _steps(after, capacity, (most - 1 - now) * capacity - rest, branches, every)))
    return best


# ---- placing -----------------------------------------------------------------


def pack(piece: DataFrame, cfg: Packing = Packing()) -> DataFrame:
    """``piece`` (a kept table with a unique ``row``) with sequence_id and offset added."""
    capacity = cfg.capacity
    tally = piece.groupBy("length").count().collect()  # at most one row for each length up to the capacity
    counts = np.zeros(capacity + 1, np.int64)
    for r in tally:
        counts[r["length"]] = r["count"]
    starts, first, per, offset, base = [], [], [], [], 0
    placed = np.zeros(capacity + 1, np.int64)
    for pattern, times in bin_completion(counts, capacity, cfg.nodes, cfg.branches):
        at = 0
        for length, n in pattern:
            starts.append((length << 44) + int(placed[length]))
            first.append(base)
            per.append(n)
            offset.append(at)
            placed[length] += n * times
            at += n * length
        base += times
    order = np.argsort(np.array(starts, np.int64))
    starts, first, per, offset = (np.array(x, np.int64)[order] for x in (starts, first, per, offset))
    salt = max(1, -(-int(counts.max()) // cfg.bucket_rows))
    dealt = piece.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(salt)).cast("int"))
    size = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = size.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1).join(before, ["length", "bucket"])
    names = [c for c in piece.columns if c != "row"]
    kinds = dict(piece.dtypes)

    def place(batches):
        for batch in batches:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            k = np.searchsorted(starts, (length << 44) + rank, "right") - 1
            within = rank - (starts[k] - (length << 44))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(first[k] + within // per[k]), pa.array(offset[k] + within % per[k] * length)], [*names, "sequence_id", "offset"])

    keyed = ranked.select(F.col("length").alias("_length"), (F.col("before") + F.col("rank")).cast("long").alias("_rank"), *names)
    return keyed.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, cfg: Packing = Packing(), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, on request).

    A row's ids are the tokens of its text and then ``end_id``; a null or empty
    text has ``end_id`` alone. Only rows of more than ``capacity`` ids are cut.
    Repeated rows and rows with a null id are packed each. An empty table gives
    an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep(pieces(docs, tokenizer_path, cfg, with_ids, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(own, cfg)


def sequences(packed_ids: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids; from ``packed`` with ids. A group holds at most a sequence's ids."""
    return packed_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
