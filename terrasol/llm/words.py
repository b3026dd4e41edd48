"""Vectorised word splitting and hashing of Arrow text batches (numpy, used inside tasks).

Texts are handled as UTF-8 bytes: lowering A-Z and both word classes used by the
operators are byte-wise, because every byte of a non-ASCII character is >= 0x80.
A word or shingle is named by a 64-bit hash (random byte table, odd-multiplier
polynomial, finaliser), which is the same in every task and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words are runs of bytes that are not space or \x09-\x0D
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: words are runs of digits, letters and non-ASCII bytes (text is lower-cased before)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: bytes of text handled by one numpy pass; a single longer text still goes in one pass
SLICE_BYTES = 2 << 20

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, step: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a text column; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [i, j) of texts holding about `limit` bytes together, at least one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and count per text of the words of lowered bytes."""
    n = len(low)
    word = kind[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's edge always parts words
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    n = len(low)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[low] * _power("up", STEP, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", STEP_INVERSE, n + 1)[starts])


def code_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of stretches of code points."""
    n = len(points)
    codes = (points.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes ^ (codes >> np.uint64(32))) * _power("up", STEP, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", STEP_INVERSE, n + 1)[starts])


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words and their number per text; a text with
    fewer words, but not none, has its whole sequence as the one shingle."""
    n = len(words)
    first = np.concatenate([[0], np.cumsum(counts)])
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if n == 0:
        return np.empty(0, np.uint64), out_counts
    powers = _power("up", STEP, width + 1)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += padded[k : k + n] * powers[k + 1]
    take = np.zeros(n, bool)
    lengths = np.maximum(counts - width + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths) + np.arange(lengths.sum())
    take[at] = True
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        i, c = first[d], counts[d]
        rolled[i] = (words[i : i + c] * powers[1 : c + 1]).sum(dtype=np.uint64) + np.uint64(int(c))
        take[i] = True
    return mix(rolled[take]), out_counts
