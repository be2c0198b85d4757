"""Substring dedup on bytes with suffix arrays.

Shards of contexts (see `repeats`) are cut into blocks. Each block gets a suffix array by
Larsson and Sadakane's refinement (only groups that are not yet sorted are sorted again, by
the rank of what follows them), which ends at the depth of a window: suffixes that share a rank then
share a window, and no longer prefix matters. Windows that are equal lie together and take the
smallest id; blocks are merged by binary search of the windows of one among the sorted windows of the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table
from packetloom.llm.repeats import LENGTH, NEVER, Unit, repeats

#: Symbols of a block.
BLOCK = 500_000
#: Bytes in an anchor.
ANCHOR = 16
#: Symbols in one packed number, and bits of each.
PACKED, BITS = 7, 9


def refined(text: np.ndarray, key: np.ndarray | None = None, have: int = 1, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes, sorted by their first `depth` symbols, and the rank of each suffix, equal for those
    that share as many; all of a suffix counts without a depth.

    key: something that sorts the suffixes by their first `have` symbols, no more than depth; the text itself if
    there is none.
    """
    n = len(text)
    key = text if key is None else key
    # the order within a group is settled by what follows, so no sort needs to be stable
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.zeros(n + 1, np.int64)  # 0 beyond the end
    slots = np.arange(n)
    while True:
        begin = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[order[slots]] = begin + 1
        alone = new & np.append(new[1:], True)
        slots, begin = slots[~alone], begin[~alone]
        if not len(slots) or have == depth:
            return order, rank[:n]
        step = have if depth is None else min(have, depth - have)
        where = order[slots]
        both = begin * (n + 1) + rank[np.minimum(where + step, n)]
        turn = np.argsort(both)
        order[slots] = where[turn]
        both = both[turn]
        new = np.ones(len(slots), bool)
        new[1:] = both[1:] != both[:-1]
        have += step


def suffix_array(text: np.ndarray, key: np.ndarray | None = None, have: int = 1) -> np.ndarray:
    """Starts of the sorted suffixes; key and have as in `refined`."""
    return refined(text, key, have)[0]


def packed(text: np.ndarray) -> np.ndarray:
    """The PACKED symbols from each place on as one number; text is below 2 ** BITS."""
    padded = np.concatenate([text, np.zeros(PACKED + 1, np.int64)])
    out = np.zeros(len(text), np.int64)
    for j in range(PACKED):
        out = (out << BITS) | padded[j:j + len(text)]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int,
                    keys: np.ndarray | None = None) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order, at most `most`.

    By Kasai's rule a suffix shares at least one less than the suffix one symbol to its left.
    The rule is followed in all contexts (starts, sizes) at once. keys are the packed symbols, so
    that PACKED of them are compared at a time.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    step, values = (1, text) if keys is None else (PACKED, keys)
    padded = np.concatenate([values, np.zeros(most + 1, np.int64)])
    # a difference below each of these leaves one leading symbol more
    below = np.array([1]) if keys is None else 1 << BITS * np.arange(PACKED, dtype=np.int64)
    found = np.zeros(n, np.int64)
    turn = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[turn], sizes[turn]
    shared = np.zeros(len(starts), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -t, "left"))
        at = starts[:k] + t
        other = before[at]
        now = np.where(other < 0, 0, np.maximum(shared[:k] - 1, 0))
        going = np.flatnonzero((other >= 0) & (now < most))
        while len(going):
            p, q, m = at[going], other[going], now[going]
            same = step - np.searchsorted(below, padded[p + m] ^ padded[q + m], "right")
            m += np.minimum(same, np.minimum(n - np.maximum(p, q) - m, most - m))
            now[going] = m
            going = going[(same == step) & (m < most) & (np.maximum(p, q) + m < n)]
        shared[:k] = now
        found[at] = now
    out = found[order]
    out[:1] = 0
    return out


def spread(flat: np.ndarray, lengths: np.ndarray, windows: np.ndarray):
    """Contexts of such lengths, end to end, with a 0 behind each: text, starts, sizes with the 0, place of each window, context of each."""
    sizes = lengths + 1
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    text[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))] = flat
    owner = np.repeat(np.arange(len(windows)), windows)
    place = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    return text, starts, sizes, place, owner


def laid_out(bodies: list[np.ndarray], windows: np.ndarray):
    """`spread` of contexts that are arrays of their own."""
    return spread(np.concatenate(bodies), np.array([len(b) for b in bodies]), windows)


def smallest(order: np.ndarray, prefixes: np.ndarray, place: np.ndarray, source: np.ndarray, length: int):
    """Group of each suffix (those that share `length` symbols) in order, and the smallest source of each group."""
    source_at = np.full(len(order), NEVER)
    source_at[place] = source
    head = prefixes < length
    head[:1] = True
    return np.cumsum(head) - 1, np.minimum.reduceat(source_at[order], np.flatnonzero(head))


def _block(bodies: list[bytes], windows: np.ndarray, first: np.ndarray, length: int):
    """Sorted different windows of a block, the smallest source of each, and which one each window is."""
    flat = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 1
    text, _, _, place, owner = spread(flat, np.array([len(b) for b in bodies]), windows)
    _, rank = refined(text, packed(text), PACKED, length) if length > PACKED else refined(text, depth=length)
    mine = rank[place]
    real = np.zeros(len(text) + 1, bool)
    real[mine] = True
    which = (np.cumsum(real) - 1)[mine]
    least = np.full(int(real.sum()), NEVER)
    np.minimum.at(least, which, first[owner])
    one = np.zeros(len(least), np.int64)
    one[which] = place
    found = np.lib.stride_tricks.sliding_window_view((text - 1).astype(np.uint8), length)[one]
    return np.ascontiguousarray(found).view(f"S{length}").ravel(), least, which


def solve(bodies: list[bytes], windows: np.ndarray, first: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> np.ndarray:
    """The smallest source of each window of each context."""
    size = np.cumsum([len(b) for b in bodies])
    part = size // block
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(bodies)]
    done = [_block(bodies[a:b], windows[a:b], first[a:b], length) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    for i, (keys, least, _) in enumerate(done):
        for other, least_other, _ in done[i + 1:]:
            at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            same = keys[at] == other
            both = np.minimum(least[at[same]], least_other[same])
            least[at[same]] = both
            least_other[same] = both
    return np.concatenate([least[which] for _, least, which in done])


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Bytes of documents (doc_id, text) covered by a string of `length` bytes that also starts in a
    document with a smaller doc_id.

    One row per row of docs: doc_id, n (bytes in UTF-8), n_removed, n_spans, kept_sha256 (of the
    bytes that stay, end to end), spans (removed runs). Strings are judged on the input. A null text
    is empty. A null doc_id is smaller than no other and greater than all; rows that repeat a
    doc_id are no repeats of each other. An empty table gives no rows; other columns are not
    looked at.
    """
    return repeats(docs, F.coalesce("text", F.lit("")), Unit(False, ANCHOR), solve, length)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_bytes").drop("spans")
