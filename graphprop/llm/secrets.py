"""Secret scans: base patterns, and a linear-chain conditional random field that adds what they miss.

Base matches label the tokens of a bounded sample of documents as begin, inside
or outside of a secret. The field sees each token's shape and, of tokens that
are no plain words, the prefix, the neighbouring words, the characters around
and features of the file. Each
window is learnt from twice: as it stands, and with words, prefix, characters
around and file hidden, so that shape alone must tell secrets from what else the
same files hold. The field is fitted by gradient ascent on the conditional
likelihood and decoded by Viterbi over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphprop.llm import text as tx
from graphprop.llm.pii import _is, _joined, _spans
from graphprop.llm.store import Scratch

KINDS = ("assign", "access", "hex")

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Runs too short for their kind's test are left out of the patterns where that leaves the matches the same.
BASE = {"assign": _ASSIGN + r"[A-Za-z0-9+/_.=-]++", "access": r"AKIA[A-Z0-9]{12,}+", "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+"}

O, B, I = 0, 1, 2  # noqa: E741
STATES = 3
WINDOW = 16

_TOKEN = np.ones(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _TOKEN[_lo : _hi + 1] = False
_TOKEN[[ord(c) for c in "+/_-"]] = False


def _lut(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_DIGIT, _LOWER, _UPPER, _HEX, _HIGH = _lut((48, 57)), _lut((97, 122)), _lut((65, 90)), _lut((48, 57), (97, 102)), _lut((128, 255))
_CLASS = np.zeros(256, np.uint8)
for _k, _table in enumerate((_DIGIT, _LOWER, _UPPER, _HIGH), 1):
    _CLASS[_table] = _k
_AROUND = np.zeros(256, np.int64)
for _k, _c in enumerate(' \n"\'=:.,@<>()[]{}', 1):
    _AROUND[ord(_c)] = _k

#: Signs before a token that make it more than a plain word.
_AFTER = np.zeros(256, bool)
_AFTER[[ord(c) for c in "=:@'\""]] = True

_WORDS, _PREFIXES = 4096, 1024
_SIZES = (10, 32, 8, 6, 6, _WORDS, _WORDS, _WORDS, _PREFIXES, 20, 20, 8, 8, 2)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_WEIGHTS = int(sum(_SIZES))
#: Groups that a token's own shape decides, and those that are hidden in the second copy of a window; its weights are all zero.
_SHAPE, _CUES, HIDDEN = 5, slice(5, 13), N_WEIGHTS


@dataclass(frozen=True)
class SecretScan:
    """The field is fitted on windows of about ``sample_docs`` documents: at most ``secret_windows`` around base matches and ``other_windows`` elsewhere."""

    sample_docs: int = 20_000
    secret_windows: int = 800
    other_windows: int = 1_200
    steps: int = 60
    rate: float = 0.25
    ridge: float = 5e-4


@dataclass
class Tokens:
    """The tokens of a block of rows: starts, ends, each row's range, the weight each uses in each group of shape, and marks of those that are no plain words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    shape: np.ndarray
    odd: np.ndarray

    def features(self, at: np.ndarray) -> np.ndarray:
        """The weights that the tokens ``at`` (sorted) use in each group."""
        data, offsets, starts, ends, of, n = self.data, self.offsets, self.starts, self.ends, self.of, len(self.starts)
        if not len(at):
            return np.zeros((0, len(_SIZES)), np.int64)
        near = np.unique(np.clip(np.concatenate([at - 1, at, at + 1]), 0, n - 1))
        own = tx.hashes(tx.folded(data), starts[near], ends[near])
        plain = (self.shape[near, 2] == _FIRST[2]) & (ends[near] - starts[near] <= 20)
        named = np.where(plain, 1 + own % np.uint64(_WORDS - 1), np.uint64(0)).astype(np.int64)
        word = lambda k: named[np.searchsorted(near, np.clip(k, 0, n - 1))]
        row = np.searchsorted(of, at, "right") - 1
        first, last = at == of[row], at + 1 == of[row + 1]
        s, e = starts[at], ends[at]
        prefix = tx.hashes(data, s, np.minimum(s + 4, e))
        left = np.where(s > offsets[row], _AROUND[data[np.maximum(s - 1, 0)]], 19)
        right = np.where(e < offsets[row + 1], _AROUND[data[np.minimum(e, len(data) - 1)]], 19)
        n_bytes = np.maximum(np.diff(offsets), 1)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
        digit_share = (digits[offsets[1:]] - digits[offsets[:-1]]) / n_bytes
        rest = np.stack(
            [
                word(at),
                np.where(first, _WORDS - 1, word(at - 1)),
                np.where(last, _WORDS - 1, word(at + 1)),
                np.where(e - s >= 8, prefix % np.uint64(_PREFIXES), np.uint64(0)).astype(np.int64),
                left,
                right,
                np.minimum(7, np.log2(n_bytes).astype(np.int64) // 4)[row],
                np.minimum(7, (digit_share * 100).astype(np.int64))[row],
                np.zeros(len(at), np.int64),
            ],
            1,
        )
        rest += _FIRST[_SHAPE:]
        rest[~self.odd[at], :-1] = HIDDEN
        return np.concatenate([self.shape[at], rest], 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, of = tx.words(data, offsets, _TOKEN)
    if not len(starts):
        return Tokens(data, offsets, starts, ends, of, np.zeros((0, _SHAPE), np.int64), np.zeros(0, bool))

    def within(lut: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(lut[data], dtype=np.int32)])
        return c[ends] - c[starts]

    d, low, up, hexes, high = within(_DIGIT), within(_LOWER), within(_UPPER), within(_HEX), within(_HIGH)
    kind = _CLASS[data]
    change = np.concatenate([[0, 0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
    turns = change[ends] - change[starts + 1]
    size = ends - starts
    shape = np.stack(
        [
            np.searchsorted([3, 7, 11, 15, 19, 24, 31, 39, 63], size),
            (d > 0) + 2 * (low > 0) + 4 * (up > 0) + 8 * (high > 0) + 16 * (hexes == size),
            np.where(d > 0, 1 + np.minimum(6, 7 * d // size), 0),
            np.minimum(5, turns // 2),
            np.minimum(5, 12 * turns // size),
        ],
        1,
    )
    assigned = _AFTER[data[np.maximum(starts - 1, 0)]] & (starts > 0)
    return Tokens(data, offsets, starts, ends, of, shape + _FIRST[:_SHAPE], (d > 0) | (size > 20) | assigned)


# ---- the field ---------------------------------------------------------------


@dataclass
class Field:
    """Weights (feature, state), those of hidden features last, transitions (from, to), start scores."""

    w: np.ndarray
    t: np.ndarray
    s: np.ndarray

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        out = np.zeros((len(feats), STATES), np.float32)
        for k in range(feats.shape[1]):
            out += self.w[feats[:, k]]
        return out

    def margins(self) -> tuple[float, float]:
        """How far transitions can make up for a token's lead of outside: whatever follows it, and with the next token turned from inside into begin."""
        into = np.vstack([self.t, self.s])  # from any state, or from the start
        out = np.hstack([self.t, np.zeros((STATES, 1))])  # to any state, or to the end
        ways = [(p, x) for p in range(STATES + 1) for x in (B, I) if into[p, x] > -1e3]
        plain = max((into[p, x] - into[p, O]) + (out[x, y] - out[O, y]) for p, x in ways for y in (O, B, 3))
        turned = max((into[p, x] - into[p, O]) + (self.t[x, I] - self.t[O, B]) + (out[I, y] - out[B, y]) for p, x in ways for y in (*range(STATES), 3))
        return plain, turned

    def all_emissions(self, tok: Tokens) -> np.ndarray:
        """Emissions of all tokens; plain words have no features but their shape."""
        e = self.emissions(tok.shape) + self.w[_FIRST[-1]]
        odd = np.flatnonzero(tok.odd)
        e[odd] = self.emissions(tok.features(odd))
        return e


_ALLOWED = np.array([[0, 0, -1e4], [0, 0, 0], [0, 0, 0]], float)
_START_ALLOWED = np.array([0, 0, -1e4], float)


def fit(feats: np.ndarray, tags: np.ndarray, length: np.ndarray, cfg: SecretScan) -> Field:
    """Maximise the conditional log-likelihood of ``tags`` (windows, WINDOW) with Adam; windows are padded at the end."""
    n, wide, groups = feats.shape
    used, flat = np.unique(feats.reshape(-1, groups), return_inverse=True)
    flat = flat.reshape(-1, groups)
    learnt = (used < N_WEIGHTS)[:, None]
    size = len(used) * STATES
    live = (np.arange(wide) < length[:, None])[:, :, None]
    gold = np.eye(STATES)[np.where(live[:, :, 0], tags, 0)] * live
    theta = np.zeros(size + STATES * STATES + STATES)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold_t = np.einsum("nia,nib->ab", gold[:, :-1], gold[:, 1:])
    gold_s = gold[:, 0].sum(0)
    for step in range(1, cfg.steps + 1):
        w, t, s = np.split(theta, [size, size + STATES * STATES])
        w, t, s = w.reshape(-1, STATES), np.exp(t.reshape(STATES, STATES) + _ALLOWED), np.exp(s + _START_ALLOWED)
        e = w[flat].sum(1).reshape(n, wide, STATES)
        e = np.exp(e - e.max(2, keepdims=True))
        # forward and backward, scaled so that each place sums to one
        alpha, beta, scale = np.zeros((wide, n, STATES)), np.ones((wide, n, STATES)), np.ones((wide, n, 1))
        for i in range(wide):
            now = (s if i == 0 else alpha[i - 1] @ t) * e[:, i]
            scale[i] = np.where(live[:, i], now.sum(1, keepdims=True), 1)
            alpha[i] = np.where(live[:, i], now / scale[i], alpha[i - 1])
        pair = np.zeros((STATES, STATES))
        for i in range(wide - 2, -1, -1):
            ahead = e[:, i + 1] * beta[i + 1] / scale[i + 1]
            beta[i] = np.where(live[:, i + 1], ahead @ t.T, beta[i + 1])
            pair += alpha[i].T @ (ahead * live[:, i + 1]) * t
        p = (alpha * beta).transpose(1, 0, 2) * live
        diff = (gold - p).reshape(-1, STATES)
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(diff[:, c], groups), len(used)) for c in range(STATES)], 1)
        g = np.concatenate([(gw * learnt).ravel(), (gold_t - pair).ravel(), gold_s - p[:, 0].sum(0)]) / n - cfg.ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / (1 + step / 40)
    own, t, s = np.split(theta, [size, size + STATES * STATES])
    w = np.zeros((N_WEIGHTS + 1, STATES), np.float32)
    w[used] = own.reshape(-1, STATES) * learnt
    return Field(w, t.reshape(STATES, STATES) + _ALLOWED, s + _START_ALLOWED)


def fit_unlabelled(feats: np.ndarray, tags: np.ndarray, length: np.ndarray, cfg: SecretScan) -> Field:
    """Fit windows and their copies with cues hidden; then anew without the windows where shape alone sees a secret that no base match marks.

    Such windows are no examples of what is outside: base matches are known
    secrets, what is left is merely unlabelled.
    """
    hidden = feats.copy()
    hidden[:, :, _CUES] = HIDDEN
    twice = lambda x, keep: np.concatenate([x[keep], x[keep]])
    keep = np.ones(len(tags), bool)
    for last in (False, True):
        field = fit(np.concatenate([feats[keep], hidden[keep]]), twice(tags, keep), twice(length, keep), cfg)
        if last:
            break
        e = field.emissions(hidden.reshape(-1, hidden.shape[2])).reshape(*tags.shape, STATES).astype(float)
        live = np.arange(tags.shape[1]) < length[:, None]
        e[~live] = (1e6, 0, 0)
        seen = viterbi(e, field.t, np.tile(field.s, (len(e), 1)), np.zeros((len(e), STATES)))
        keep = ~((seen != O) & (tags == O) & live).any(1) | (tags == B).any(1)
    return field


def viterbi(e: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best states of sequences of one length (sequences, tokens, states), with their start and end scores."""
    n, length, _ = e.shape
    score, back = start + e[:, 0], np.zeros((length, n, STATES), np.int8)
    for i in range(1, length):
        ways = score[:, :, None] + t
        back[i] = ways.argmax(1)
        score = ways.max(1) + e[:, i]
    out = np.zeros((n, length), np.int8)
    out[:, -1] = (score + end).argmax(1)
    for i in range(length - 1, 0, -1):
        out[:, i - 1] = back[i, np.arange(n), out[:, i]]
    return out


def decode(field: Field, e: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Viterbi states of all rows.

    A token whose outside score leads by more than any transitions could make
    up is outside on the best path whatever surrounds it: turning it outside
    (and an inside token after it into a begin) never lowers a path's score. So
    the rows fall apart at such tokens, and only the runs between them are
    searched, all of one length together.
    """
    n = len(e)
    states = np.zeros(n, np.int8)
    if not n:
        return states
    t, s = field.t, field.s
    plain, turned = field.margins()
    lead = e[:, O] - np.maximum(e[:, B], e[:, I])
    after = np.append(e[1:, I] - e[1:, B], -np.inf)
    open_ = np.flatnonzero(lead <= np.maximum(plain, turned + after) + 1e-3)
    if not len(open_):
        return states
    cut = np.flatnonzero((np.diff(open_) > 1) | np.isin(open_[1:], of))
    firsts, lasts = open_[np.concatenate([[0], cut + 1])], open_[np.concatenate([cut, [len(open_) - 1]])] + 1
    start = np.where(np.isin(firsts, of)[:, None], s, t[O])
    end = np.where(np.isin(lasts, of)[:, None], np.zeros(STATES), t[:, O])
    for length in np.unique(lasts - firsts):
        own = np.flatnonzero(lasts - firsts == length)
        at = firsts[own, None] + np.arange(length)
        states[at] = viterbi(e[at].astype(float), t, start[own], end[own])
    return states


# ---- Spark -------------------------------------------------------------------


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text, the base spans of each kind (s, e, m, l, r)."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    matched = text.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in BASE.items()])
    split = matched.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"p_{k}") for k, p in BASE.items()])
    placed = split.select("doc_id", "text", *[_spans(F.col(f"p_{k}"), F.col(f"m_{k}"), 8).alias(k) for k in KINDS])
    return placed.withColumn("assign", F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], f"^{_ASSIGN}(.*)$", 1)) >= 8))


def _secret_values(spans: DataFrame) -> Column:
    """Starts and ends of the secrets themselves: of assignments the value."""
    value = lambda x: F.struct((x["e"] - F.length(F.regexp_extract(x["m"], f"^{_ASSIGN}(.*)$", 1))).alias("s"), x["e"].alias("e"))
    own = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    return F.concat(F.transform("assign", value), F.transform("access", own), F.transform("hex", own))


def _inside(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, spans: list) -> np.ndarray:
    """Tags of the tokens by code-point spans of each row."""
    tags = np.zeros(len(starts), np.int8)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for k, own in enumerate(spans):
        if own:
            at = lead[starts[of[k] : of[k + 1]]] - lead[offsets[k]]
            for s, e in sorted(own):
                hit = of[k] + np.flatnonzero((at >= s) & (at < e))
                tags[hit] = I
                tags[hit[:1]] = B
    return tags


def _training_windows(spans: DataFrame) -> DataFrame:
    """(h, secret, feats, tags): windows around base matches, around one token with digits that is none, and at a third of each text."""

    def run(batches):
        for batch in batches:
            data, offsets = tx.utf8(batch.column(0))
            values = batch.column(1).to_pylist()
            for lo, hi in tx.blocks(offsets):
                raw, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                tok = tokens(raw, off)
                tags = _inside(raw, off, tok.starts, tok.ends, tok.of, [[(x["s"], x["e"]) for x in v] for v in values[lo:hi]])
                other = (tags == O) & (tok.shape[:, 2] > _FIRST[2]) & (tok.ends - tok.starts >= 4)
                found = []
                for k in range(hi - lo):
                    a, b = int(tok.of[k]), int(tok.of[k + 1])
                    centres = [*((c, True) for c in np.flatnonzero(tags[a:b] == B)), *((c, False) for c in np.flatnonzero(other[a:b])[:1]), *([((b - a) // 3, False)] if b > a else [])]
                    for c, secret in centres:
                        x = max(a, a + int(c) - WINDOW // 2)
                        y = min(x + WINDOW, b)
                        found.append((x, y, secret))
                at = np.unique(np.concatenate([np.arange(x, y) for x, y, _ in found] or [np.empty(0, np.int64)]))
                feats, out = tok.features(at).astype(np.int32), []
                for x, y, secret in found:
                    h = int(tx.mix(np.uint64([x * 31 + y + len(raw)]))[0] >> np.uint64(1))
                    first = int(np.searchsorted(at, x))
                    out.append((h, secret, feats[first : first + y - x].tobytes(), tags[x:y].tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["h", "secret", "feats", "tags"])

    return spans.select("text", _secret_values(spans).alias("v")).mapInArrow(run, "h long, secret boolean, feats binary, tags binary")


def train(docs: DataFrame, cfg: SecretScan, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field fitted on a sample of ``docs``; none where the sample holds no secret."""
    share = min(1.0, cfg.sample_docs / max(docs.count(), 1))
    last = min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))
    some = Scratch(docs.sparkSession).keep(_training_windows(base_spans(docs.where(F.xxhash64(F.col(id_col)) <= F.lit(last)), id_col, text_col)), "windows")
    parts = [some.where(own).orderBy("h", "feats").limit(most).select("feats", "tags").toArrow() for own, most in (("secret", cfg.secret_windows), ("not secret", cfg.other_windows))]
    if not len(parts[0]):
        return None
    rows = pa.concat_tables(parts)
    tags = [np.frombuffer(x.as_py(), np.int8) for x in rows.column("tags")]
    length = np.array([len(x) for x in tags])
    feats, gold = np.full((len(tags), WINDOW, len(_SIZES)), HIDDEN), np.zeros((len(tags), WINDOW), np.int64)
    for k, (f, x) in enumerate(zip(rows.column("feats"), tags, strict=True)):
        feats[k, : len(x)] = np.frombuffer(f.as_py(), np.int32).reshape(-1, len(_SIZES))
        gold[k, : len(x)] = x
    return fit_unlabelled(feats, gold, length, cfg)


def secrets(docs: DataFrame, cfg: SecretScan = SecretScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ``base`` and ``added`` spans as arrays of (s, o, kind, e), sorted.

    Offsets are code points, ends exclusive; ``o`` is the kind's place, added
    spans are of kind ``crf`` and touch no base span. Null and empty texts have
    none. Repeated rows and rows with a null id are searched each. Where the
    sample holds no secret nothing is added. An empty table gives an empty
    result. Other columns are not read.
    """
    field = train(docs, cfg, id_col, text_col)
    spans = base_spans(docs, id_col, text_col)
    typed = lambda k, i: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("o"), F.lit(k).alias("kind"), x["e"].alias("e")))
    base = F.array_sort(F.concat(*[typed(k, i) for i, k in enumerate(KINDS)]))
    kind = "array<struct<s:bigint,o:int,kind:string,e:bigint>>"
    both = spans.select("doc_id", "text", base.cast(kind).alias("base"))
    if field is None:
        return both.select("doc_id", "base", F.array().cast(kind).alias("added"))

    def run(batches):
        for batch in batches:
            data, offsets = tx.utf8(batch.column(1))
            known = batch.column(2)
            at = known.offsets.to_numpy() - known.offsets[0].as_py()
            flat = known.flatten()
            ks, ke = (flat.field(f).to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, np.int64) for f in ("s", "e"))
            added = []
            for lo, hi in tx.blocks(offsets):
                raw, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                tok = tokens(raw, off)
                starts, ends, of = tok.starts, tok.ends, tok.of
                states = decode(field, field.all_emissions(tok), of)
                hit = np.flatnonzero(states == B)
                rows: list[list] = [[] for _ in range(hi - lo)]
                if len(hit):
                    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    stops = np.append(np.flatnonzero(states != I), len(states))
                    edge = of[np.searchsorted(of, hit, "right")]
                    last = np.minimum(stops[np.searchsorted(stops, hit, "right")], edge) - 1
                    row = np.searchsorted(of, hit, "right") - 1
                    for k, s, e in zip(row, lead[starts[hit]] - lead[off[row]], lead[ends[last]] - lead[off[row]], strict=True):
                        a, b = at[lo + k], at[lo + k + 1]
                        if not ((ks[a:b] < e) & (ke[a:b] > s)).any():
                            rows[k].append({"s": int(s), "o": len(KINDS), "kind": "crf", "e": int(e)})
                added += rows
            kinds = pa.list_(pa.struct([("s", pa.int64()), ("o", pa.int32()), ("kind", pa.string()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), known, pa.array(added, kinds)], ["doc_id", "base", "added"])

    return both.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, joined as kind:start:end), n_added."""
    return spans.select(
        "doc_id",
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
