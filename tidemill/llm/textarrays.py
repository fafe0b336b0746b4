"""Word boundaries and word hashes of a whole column of texts at once, in numpy.

A column of texts is one byte buffer with offsets (the Arrow layout), so words of all
rows are found and hashed with a few vector passes and no loop over rows or words.
A word is a run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes worked on at once: bounds the vectors' memory whatever the batch holds.
BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK + 1)
_DOWN = _powers(_BASE_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one more entry than rows)."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[raw], out=inside[:n])
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1] if n else inside[:0]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last = inside[:n] & ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words: random byte values times powers of an odd base, by prefix sums."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    if len(raw) <= BLOCK:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * _UP[: len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * _DOWN[starts])
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        k = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part = raw[base : int(ends[k - 1])]
        if len(part) > BLOCK:  # one word longer than a block
            up = _powers(_BASE, len(part))
            with np.errstate(over="ignore"):
                out[i] = mix(np.array([np.sum(table[part] * up, dtype=np.uint64)]))[0]
            k = i + 1
        else:
            out[i:k] = word_hashes(part, starts[i:k] - base, ends[i:k] - base, lower)
        i = k
    return out


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's width-word windows and each window's row; a shorter row with words has one."""
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    size = np.minimum(counts, width)[row]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    for k in range(width):
        out = out * np.uint64(_BASE) + np.where(size > k, padded[at + k], np.uint64(0))
    return mix(out + size.astype(np.uint64)), row
