"""Substring dedup on words with a compressed FM-index.

A shard of contexts (see `repeats`) becomes a Burrows-Wheeler transform over word numbers in
a wavelet matrix of packed bits. Contexts are streamed against the index from right to left, all
side by side: each step is one backward search, and a match that has reached the
window's length gives the interval of suffixes that start with this window and is then
shortened at its right end. The smallest id in the interval is the window's source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import table
from packetloom.llm.repeats import LENGTH, Unit, repeats
from packetloom.llm.suffix_arrays import common_prefixes, laid_out, smallest, suffix_array

#: Words in an anchor.
ANCHOR = 8


class Bits:
    """A packed row of bits that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.word = packed.view(np.uint64)
        ones = np.bitwise_count(self.word)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.uint32)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.word[block] & mask)


class WaveletMatrix:
    """Counts any symbol before any place of a sequence, in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for b in range(max(top.bit_length(), 1) - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append((b, Bits(bit.astype(bool))))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(top + 1)
        self.start = self._down(every, np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, bits in self.levels:
            one = bits.ones(at)
            at = np.where((symbol >> b) & 1, bits.zeros + one, at - one)
        return at

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search with matching statistics over texts laid end to end, to a depth of `length`."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
        self.n, self.length, self.top = len(text), length, int(text.max(initial=0))
        self.order = suffix_array(text)
        self.prefixes = common_prefixes(text, self.order, starts, sizes, length)
        self.bwt = WaveletMatrix(text[self.order - 1], self.top)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each place the interval of suffixes that share its first `depth` symbols."""
        if depth not in self._blocks:
            head = self.prefixes < depth
            head[:1] = True
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, self.n))
            self._blocks[depth] = np.repeat(at, size), np.repeat(at + size, size)
        return self._blocks[depth]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.bwt.count(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.below[symbol]
        return base + both[:len(symbol)], base + both[len(symbol):]

    def shorten(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        """Widens each interval to the next one with more suffixes or, at depth 0, to all; in place."""
        edge = np.append(self.prefixes, 0)
        new = np.minimum(np.maximum(np.where(low > 0, edge[low], 0), np.where(high < self.n, edge[high], 0)), depth - 1)
        new = np.maximum(new, 0)
        for d in np.unique(new).tolist():
            these = new == d
            begin, end = self.block(d)
            low[these], high[these] = (begin[low[these]], end[low[these]]) if d else (0, self.n)
        depth[:] = new

    def match(self, patterns: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Yields (place, low, high) of all places of the patterns at which a match of `length` begins.

        Symbols above those of the index match nothing. Patterns are read from their ends.
        """
        turn = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[turn], sizes[turn]
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        depth = np.zeros(len(starts), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -t, "left"))
            place = starts[:k] + sizes[:k] - 1 - t
            symbol = patterns[place]
            todo = np.arange(k)
            unknown = symbol > self.top
            low[:k][unknown], high[:k][unknown], depth[:k][unknown] = 0, self.n, 0
            todo = todo[~unknown]
            while len(todo):
                a, b = self.extend(symbol[todo], low[todo], high[todo])
                good = a < b
                done = todo[good]
                low[done], high[done] = a[good], b[good]
                depth[done] += 1
                todo = todo[~good]
                todo = todo[depth[todo] > 0]  # a symbol that does not occur at all ends the match
                if len(todo):
                    x, y, d = low[todo], high[todo], depth[todo]
                    self.shorten(x, y, d)
                    low[todo], high[todo], depth[todo] = x, y, d
            full = np.flatnonzero(depth[:k] == self.length)
            if len(full):
                yield place[full], low[full], high[full]
                begin, end = self.block(self.length - 1)
                low[full], high[full] = begin[low[full]], end[low[full]]
                depth[full] = self.length - 1


def solve(bodies: list[bytes], windows: np.ndarray, first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The smallest source of each window of each context, words with one space between them."""
    words = [b.split(b" ") for b in bodies]
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    cuts = np.cumsum([len(w) for w in words])[:-1]
    text, starts, sizes, place, owner = laid_out(np.split(coded, cuts), windows)
    index = FMIndex(text, starts, sizes, length)
    group, least = smallest(index.order, index.prefixes, place, first[owner], length)
    found = np.full(len(text), -1)
    for at, low, _ in index.match(text, starts, sizes - 1):
        found[at] = least[group[low]]
    return found[place]


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Words of documents (doc_id, text) covered by a window of `length` words that also starts in a
    document with a smaller doc_id.

    One row per row of docs: doc_id, n (words), n_removed, n_spans, kept_sha256 (of the words that
    stay, with one space between them), spans (removed runs of words). Windows are judged on the
    input. A null or blank text has no words. A null doc_id is smaller than no other and greater
    than all; rows that repeat a doc_id are no repeats of each other. An empty table gives no rows;
    other columns are not looked at.
    """
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return repeats(docs, plain, Unit(True, ANCHOR), solve, length)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_words").drop("spans", "n_spans")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
