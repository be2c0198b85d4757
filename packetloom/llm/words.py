"""Words of whole texts as numbers, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once in a task.
CHUNK = 4_000_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word ids of all texts, the different words, and how many words each text has.

    Words are runs of anything but space and \\x09 to \\x0D; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    if "" in words:
        kept = ids != words.index("")
        ids, owner = ids[kept], owner[kept]
    return ids, words, np.bincount(owner, minlength=len(texts))


def word_hashes(words: list[str]) -> np.ndarray:
    """64 bits of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, object), categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i + k] for each i, order-sensitive."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ mix(h[j:j + n])) * _ODD[2]
        out ^= out >> np.uint64(30)
    return mix(out)
