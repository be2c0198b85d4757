"""Anchors of windows: which places of a sequence must be compared with other sequences.

Of all k-grams inside a window of `length` symbols the one with the smallest hash is the window's
anchor. Equal windows have anchors with equal hashes, so two sequences can only share a window
if they share the hash of its anchor.
"""

from __future__ import annotations

import numpy as np

#: Low bits of a hash that give way to its place; more than a window is long by far.
_PLACE = 24
_LOW = np.uint64((1 << _PLACE) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for each i, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors(hashes: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of several sequences laid end to end: place, first and last window start.

    hashes: of the k-gram that starts at each place (any value where it would cross the end of a
    sequence); sizes: symbols of each sequence.
    """
    none = np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total < length:
        return none, none, none
    place = np.arange(total - k + 1, dtype=np.uint64)
    lowest = sliding_min((hashes[:len(place)] & ~_LOW) | (place & _LOW), length - k + 1)
    start = np.arange(len(lowest), dtype=np.int64)
    # the low bits are the place modulo 2 ** _PLACE, at most a window away
    best = start + ((lowest.astype(np.int64) - start) & np.int64(_LOW))
    inside = start + length <= np.repeat(ends, sizes)[:len(start)]
    best, start = best[inside], start[inside]
    if not len(best):
        return none, none, none
    turn = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)]))
    return best[turn], start[turn], start[np.append(turn[1:], len(start)) - 1]


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of data[i:i + k] for each i; k is a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    have, odd = 1, 0x9E3779B97F4A7C15
    while have < k and len(h) > have:
        h = h[:-have] * np.uint64(odd) + (h[have:] ^ (h[have:] >> np.uint64(32)))
        odd = (odd * 0xC2B2AE3D27D4EB4F | 1) % 2**64
        have *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end, split at single spaces: start, end and hash of each, words per text."""
    word = data != 32
    edge = np.zeros(len(data) + 1, bool)  # where a text begins
    edge[np.cumsum(sizes)] = edge[0] = True
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    count = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), count
    length = ends - starts
    powers = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
    owner = np.repeat(np.arange(len(starts)), length)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    h = np.add.reduceat((data[starts[owner] + at].astype(np.uint64) + np.uint64(7)) * powers[at], np.cumsum(length) - length)
    h ^= h >> np.uint64(31)
    return starts, ends, h * np.uint64(0xC2B2AE3D27D4EB4F), count


def slices(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[first:last] of each pair, end to end, and the offsets of each."""
    size = last - first
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])], offsets
