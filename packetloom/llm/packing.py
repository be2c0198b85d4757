"""Packing documents into sequences by cutting stock with column generation.

Documents are tokenised once; whole sequences are cut off long ones, and what remains of each
has a length below the sequence length. The histogram of these lengths over all documents, in
classes of WIDTH tokens, gives a linear program over patterns (classes that fit one sequence);
columns are priced by dynamic programming over an unbounded knapsack until no pattern improves
or the bound of Farley proves the rest small. Every split of the token table then rounds the
patterns to its share and gives their places to its documents, ranked by id within a length.
A sequence is used if it is well filled by the tokens themselves; documents that none of these took are laid
end to end and cut where a sequence is full.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import stored, table

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
#: Ends each document.
END = 0
#: Lengths are rounded up to a multiple of this; it divides the capacity.
WIDTH = 8
#: Sequences of a pattern that leave more than this share of their tokens empty are not used.
SLACK = 0.02
#: Column generation ends when the plan is proved to be within this share of the optimum.
GAP = 0.002
#: ... or after so many columns; the plan is valid after each.
COLUMNS = 4000


@lru_cache(maxsize=4)
def _encoder(name: str):
    """text -> ids, as the tokenizers file gives them; ranks of the same vocabulary are faster."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        try:
            return fast.encode_ordinary(text)
        except BaseException as panic:  # its pattern engine gives up on very long runs of white space
            if type(panic).__name__ != "PanicException":
                raise
            return whole.encode(text, add_special_tokens=False).ids

    return encode


def tokenised(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n (tokens with the end) and ids (16 bits each, with the end) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            ids, n = [], []
            for text in batch.column("text"):
                found = encode(text.as_py() or "")
                found.append(END)
                n.append(len(found))
                ids.append(np.array(found, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tokens, f"doc_id {kind}, n long, ids binary")


def best_pattern(value: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of weights within the capacity: (value, count of each)."""
    most = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = np.searchsorted(weights, c, "right")
        most[c] = most[c - 1]
        if k:
            each = most[c - weights[:k]] + value[:k]
            i = int(each.argmax())
            if each[i] > most[c] + 1e-12:
                most[c], take[c] = each[i], i
    counts, c = np.zeros(len(weights)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= weights[take[c]]
    return float(most[capacity]), counts


def plan_patterns(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[float, dict[int, int]]]:
    """Fractional uses of patterns {length: count} that cover the demand with few sequences."""
    weights = np.array(sorted(demand), int)
    if not len(weights):
        return []
    need = np.array([demand[w] for w in weights], float)
    # one pattern of each length alone, as often as it fits
    columns = [np.where(np.arange(len(weights)) == i, capacity // w, 0.0) for i, w in enumerate(weights)]
    inverse = np.diag(1.0 / (capacity // weights))
    uses = inverse @ need
    for _ in range(COLUMNS):
        prices = inverse.sum(0)
        value, column = best_pattern(np.maximum(prices, 0), weights, capacity)
        if value <= 1 + 1e-9 or uses.sum() <= (1 + GAP) * (prices @ need) / value:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = int(np.where(step > 1e-9, uses / step, np.inf).argmin())
        if step[leave] <= 1e-9:
            break
        far = uses[leave] / step[leave]
        uses = np.maximum(uses - far * step, 0)
        uses[leave] = far
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        columns[leave] = column
    return [(float(x), {int(weights[i]): int(p[i]) for i in np.flatnonzero(p)})
            for x, p in zip(uses, columns, strict=True) if x > 1e-9]


def place(n: np.ndarray, order: np.ndarray, plan: list, total: int, capacity: int = CAPACITY):
    """Pieces of the documents of one split: arrays doc, start, length, sequence, offset.

    n: tokens of each document; order: ranks them; plan: patterns of classes; total: the number
    of remainders in all splits.
    """
    whole, rest = n // capacity, n % capacity
    doc = np.repeat(np.arange(len(n)), whole)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    parts = [(doc, start, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), int))]
    at = len(doc)
    kind = -(-rest // WIDTH)
    ranked = order[rest[order] > 0]
    ranked = ranked[np.argsort(kind[ranked], kind="stable")]
    classes, first, count = np.unique(kind[ranked], return_index=True, return_counts=True)
    queue = {int(w): [int(a), int(a + c)] for w, a, c in zip(classes, first, count, strict=True)}
    share = len(ranked) / max(total, 1)
    good = sorted(((x, p) for x, p in plan if sum(w * k for w, k in p.items()) * WIDTH >= (1 - SLACK) * capacity),
                  key=lambda xp: -xp[0])
    line = []  # documents that no well-filled sequence holds
    for again in (False, True):  # each pattern to its share, then while its classes are there
        for x, pattern in good:
            times = min((queue[w][1] - queue[w][0]) // k if w in queue else 0 for w, k in pattern.items())
            times = times if again else min(times, int(np.ceil(x * share)))
            if times <= 0:
                continue
            slots = []
            for w, k in pattern.items():
                a = queue[w][0]
                queue[w][0] += times * k
                slots.append(ranked[a:a + times * k].reshape(times, k))
            who = np.concatenate(slots, 1)
            full = rest[who].sum(1) >= (1 - SLACK) * capacity  # in tokens, as classes are rounded up
            line.append(who[~full].ravel())
            who = who[full]
            times = len(who)
            ends = np.cumsum(rest[who], 1)
            parts.append((who.ravel(), (whole[who] * capacity).ravel(), rest[who].ravel(),
                          np.repeat(at + np.arange(times), who.shape[1]), (ends - rest[who]).ravel()))
            at += times
    line += [ranked[a:b] for a, b in queue.values() if b > a]
    who = np.concatenate(line) if line else ranked
    if len(who):
        ends = np.cumsum(rest[who])
        begins = ends - rest[who]
        # the line of what is left is cut at each document's end and at each full sequence
        cuts = np.unique(np.concatenate([begins, np.arange(0, ends[-1], capacity), ends[-1:]]))
        a, b = cuts[:-1], cuts[1:]
        i = np.searchsorted(begins, a, "right") - 1
        parts.append((who[i], whole[who[i]] * capacity + a - begins[i], b - a, at + a // capacity, a % capacity))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Sequences of at most `capacity` tokens that hold every token of docs (doc_id, text) once.

    One row per piece of a document: doc_id, start, length, ids_crc32 (of the ids as unsigned 32
    bits, little-endian), doc_tokens, sequence_id, offset, ids (of the piece, 16 bits each).

    A null or empty text is the end token alone. Rows that repeat a doc_id, or have none, are
    documents of their own. An empty table gives no rows; other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(tokenised(docs, tokenizer), "tokens")
    kind = F.ceil(F.col("n") % capacity / WIDTH).cast("int")
    demand = {r.kind: r["count"] for r in tokens.groupBy(kind.alias("kind")).count().collect() if r.kind}
    plan, total = plan_patterns(demand, capacity // WIDTH), sum(demand.values())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]  # one split of the token table, of bounded size
        if not read:
            return
        rows = pa.Table.from_batches(read)
        n, names = rows.column("n").to_numpy(), pa.concat_arrays(rows.column("doc_id").chunks)
        order = pa.compute.sort_indices(names).to_numpy().astype(int)
        doc, start, length, sequence, offset = place(n, order, plan, total, capacity)
        turn = np.lexsort((offset, sequence))
        doc, start, length, sequence, offset = (x[turn] for x in (doc, start, length, sequence, offset))
        sequence = sequence + (TaskContext.get().partitionId() << 32)
        blobs = rows.column("ids")
        for k in range(0, len(doc), 4096):
            some = slice(k, k + 4096)
            ids = [blobs[d].as_buffer()[2 * s:2 * (s + m)] for d, s, m in zip(
                doc[some].tolist(), start[some].tolist(), length[some].tolist(), strict=True)]
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(doc[some])),
                *(pa.array(x[some], pa.int64()) for x in (start, length)), pa.array(crc, pa.int64()),
                pa.array(n[doc[some]], pa.int64()), *(pa.array(x[some], pa.int64()) for x in (sequence, offset)),
                pa.array([x.to_pybytes() for x in ids], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return tokens.mapInArrow(pieces, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
                                     "sequence_id long, offset long, ids binary")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents."""
    return pack(docs)
