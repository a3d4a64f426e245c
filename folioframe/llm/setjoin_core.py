"""Signatures of the universe-partition set join: bands of sizes, segments of hashed tokens, and pigeonhole bounds.

Sets of sizes a and b with Jaccard similarity of at least 3/4 differ in at most (a + b) / 7 elements. In a band of
sizes every token of the universe belongs to one of m segments, by its hash. k differing elements touch at most k
segments, so a set with c non-empty segments shares at least c - k of them, whole, with any set it is linked to.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Bands are [edge, next edge): edges grow by 16/9, the square of 4/3, so that a set meets its own band and one below.
_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, -(-_EDGES[-1] * 16 // 9)))
EDGES = np.array(_EDGES, np.int64)
#: Segments a band has beyond the fewest that the bound needs, as a share.
SLACK = 0.35
#: Sets of up to this size have each element as a segment of its own; of up to DELETION_MAX, whose segments cost few
#: rows, also index every segment without one of its elements. Above, whole segments alone cost least.
ELEMENT_MAX, DELETION_MAX = 15, 90


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= 75 * (a + b - inter)


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, n, "right") - 1


def segments(j: np.ndarray) -> np.ndarray:
    """Segments of band j: more than the most differences between one of its sets and any linked to it."""
    top = EDGES[j + 1] - 1
    most = (top + np.minimum(top * 4 // 3, np.iinfo(np.int64).max)) // 7
    return (np.ceil((most + 1) * (1 + SLACK))).astype(np.int64)


def most_differences(n: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The most elements in which a set of size n differs from any set that it meets in band j and is linked to."""
    top = np.where(band(n) == j, n * 4 // 3, EDGES[j + 1] - 1)
    return (n + top) // 7


def signatures(h: np.ndarray, off: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of each set (distinct hashes h[off[r]:off[r+1]]) in band j[r]: of every non-empty segment, and in
    small bands of every segment of two or more without each of its elements.

    Returns signature, set number, whether an element is left out, and per set its allocation: the units that its
    segments give (two where deletions are indexed, else one) less the differences that any linked set may have.
    A set with a positive allocation shares at least so many units with each linked set.
    """
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    small = EDGES[j + 1] - 1 <= ELEMENT_MAX
    width = np.where(small, n, segments(j))
    base = np.concatenate([[0], np.cumsum(width)])
    seg = (mix64(h ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(24)) % width[row].astype(np.uint64)
    at = base[row] + np.where(small[row], np.arange(len(h)) - off[:-1][row], seg.astype(np.int64))
    value = mix64(h * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1))
    count = np.bincount(at, minlength=base[-1])
    # sums modulo 2^64, from exact sums of the halves
    low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), minlength=base[-1]).astype(np.uint64)
    high = np.bincount(at, (value >> np.uint64(32)).astype(float), minlength=base[-1]).astype(np.uint64)
    body = low + (high << np.uint64(32))
    full = np.flatnonzero(count)
    owner = np.repeat(np.arange(len(n)), width)
    who, size = owner[full], count[full]
    place = np.where(small[who], 0, full - base[:-1][who]).astype(np.uint64)
    salt = np.zeros(len(count), np.uint64)
    salt[full] = mix64(place * np.uint64(0x8EBC6AF09C88C6E3) + j[who].astype(np.uint64))
    deletes = (EDGES[j + 1] - 1 <= DELETION_MAX) & ~small
    cut = np.flatnonzero(deletes[row] & (count[at] > 1))
    whole = mix64(body[full] + salt[full])
    less = mix64(body[at[cut]] - value[cut] + salt[at[cut]])
    units = np.bincount(who, 1.0 + (deletes[who] & (size > 1)), minlength=len(n)).astype(np.int64)
    return np.concatenate([whole, less]), np.concatenate([who, row[cut]]), np.concatenate([np.zeros(len(whole), bool), np.ones(len(less), bool)]), units - most_differences(n, j)
