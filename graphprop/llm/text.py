"""Vectorised word splitting and hashing over Arrow string columns.

All functions work on the UTF-8 bytes of a whole batch, so no Python string is
made. Blocks of documents and segments of words bound the working memory; a
single text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; one longer text makes a block of its own.
BLOCK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Delimiters of the words ``[^\x20\x09-\x0D]+``.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        for k, base in enumerate((_B, _B_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, delimiters: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and each row's range of words (one offset more than rows)."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~delimiters[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, scrambled with its length."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK_BYTES, "right")))
        first, last = int(starts[lo]), int(ends[hi - 1])
        power, inverse = _power_tables(last - first)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * power[: last - first], out=total[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def folded(data: np.ndarray) -> np.ndarray:
    """``data`` with A-Z in lower case."""
    return _LOWER[data]


def word_hashes(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For blocks of rows of a string column: first row, end row, word hashes, each row's range of words.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.
    """
    data, offsets = utf8(col)
    for lo, hi in blocks(offsets):
        part = folded(data[offsets[lo] : offsets[hi]])
        starts, ends, of = words(part, offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, hashes(part, starts, ends), of


def shingles(h: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each row, and each row's range of them.

    A row of fewer words, but not none, has its whole sequence as its only run.
    """
    n = np.diff(of)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_of = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = of[:-1][row] + np.arange(out_of[-1]) - out_of[:-1][row]
    length = np.minimum(n[row], width)
    acc = length.astype(np.uint64)
    for k in range(width):
        live = k < length
        word = h[np.where(live, first + k, first)] if len(first) else h[:0]
        acc = np.where(live, mix(acc * np.uint64(0x9FB21C651E98DF25) + word), acc)
    return acc, out_of
