"""Vectorised views of many texts at once: word spans, word hashes, shingle hashes, per-row sums."""

from __future__ import annotations

import numpy as np

from .common import mix64

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Word separators: the space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


_tables: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """Powers of _P and of its inverse, at least `size` of each; one pair is kept and grows as needed."""
    if not _tables or len(_tables[0]) < size:
        n = 1 << max(16, (size - 1).bit_length())
        p, q = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
        p[0] = q[0] = 1
        _tables[:] = [np.cumprod(p), np.cumprod(q)]
    return _tables


def row_sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of mask over each row's bytes (or words); empty rows give 0."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and word offsets by row. A row's end always ends a word."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    solid = ~SPACE[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = solid
    start = solid & (~before[:-1] | edge[:-1])
    after = np.zeros(len(buf), bool)
    after[:-1] = solid[1:]
    end = solid & (~after | edge[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a position-free polynomial of its bytes, mixed with its length."""
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(word_hash: np.ndarray, woff: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size`-word shingles of each row, and shingle offsets. A row of fewer words has one: all its words."""
    count = np.diff(woff)
    number = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    soff = np.zeros(len(woff), np.int64)
    np.cumsum(number, out=soff[1:])
    row = np.repeat(np.arange(len(number)), number)
    first = woff[:-1][row] + (np.arange(soff[-1]) - soff[:-1][row])
    length = np.minimum(count, size)[row]
    out = length.astype(np.uint64)
    for j in range(size):
        here = j < length
        w = np.where(here, word_hash[np.minimum(first + j, max(len(word_hash) - 1, 0))], np.uint64(0)) if len(word_hash) else np.zeros(0, np.uint64)
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + w)
    return out, soff
