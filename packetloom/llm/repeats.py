"""Windows of documents that also start in a document with a smaller id.

1. Equal texts are one class, known by its smallest id; what any other of its documents holds
   is repeated as a whole. Texts of classes are written once, bucketed by class, and are not
   shuffled again.
2. Windows are looked for where their anchors are shared with another class (`winnow`).
3. Around each shared anchor the windows that it stands for are cut out as one context. Equal
   contexts of an anchor that stands at very many places are counted once before they move.
4. Contexts are grouped into shards by anchor, and an index over a shard (`Solver`) tells for each
   window the smallest id of a document that has it. Anchors with very many different contexts
   go window by window through an aggregation instead.
5. Contexts are joined back to the places where they stand, and what is covered by repeated
   windows is removed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import cleaned_up, lookup, partitions, small, stored
from packetloom.llm.winnow import anchors, byte_grams, runs, slices
from packetloom.llm.words import chunks, gram_hashes
from packetloom.session import scratch_path

LENGTH = 50
#: Bytes of text whose anchors are looked for at once; some hundred bytes of numbers stand for each.
SLICE = 500_000
#: Stands for a null id, which is smaller than no other.
NEVER = 2**63 - 1
#: Symbols in a shard, about.
SHARD = 1_000_000
#: An anchor with more contexts than this is resolved window by window.
HOT = 20_000


@dataclass(frozen=True)
class Unit:
    """What a window is made of: bytes, or words of a text with single spaces."""
    words: bool
    k: int

    def symbols(self, data: np.ndarray, sizes: np.ndarray):
        """Start and end of each symbol in data, hash of the k-gram at each, symbols per text."""
        if self.words:
            starts, ends, h, count = runs(data, sizes)
            return starts, ends, gram_hashes(h, self.k), count
        places = np.arange(len(data))
        return places, places + 1, byte_grams(data, self.k), sizes


def _anchored(part: pa.RecordBatch, unit: Unit, length: int):
    """Data, symbol starts and ends, and of each anchor: text, symbols before its text, hash, first, last."""
    text = part.column("text")
    raw = text.cast(pa.binary())
    sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]) if len(raw) else np.zeros(0, int)
    at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset] if len(raw) else 0
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at:at + sizes.sum()]
    starts, ends, grams, count = unit.symbols(data, sizes.astype(np.int64))
    place, first, last = anchors(grams, count, length, unit.k)
    before = np.cumsum(count) - count
    owner = np.searchsorted(np.cumsum(count), place, "right")
    return data, starts, ends, owner, before, grams[place].astype(np.int64), first, last


def _sliced(batch: pa.RecordBatch, unit: Unit, length: int):
    """Slices of a batch, each with what `_anchored` finds in it."""
    for part in chunks(batch, most=SLICE):
        yield part, *_anchored(part, unit, length)


#: solve(contexts, windows, first): the smallest id of each window of each context, end to end.
Solver = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def classes(docs: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, class) of every row, and the bucketed table (class, first, size, text)."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER)).alias("id"), text.alias("text"))
    rows = rows.withColumn("class", F.xxhash64("text"))
    name, spark = f"classes_{uuid.uuid4().hex}", docs.sparkSession
    one = rows.groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("size"), F.first("text").alias("text"))
    with cleaned_up(spark):
        one.write.bucketBy(partitions(spark), "class").sortBy("class").option("compression", "zstd").option(
            "path", scratch_path(spark, "classes")).saveAsTable(name)
    return rows.select("doc_id", "id", "class"), spark.table(name)


def shared_anchors(texts: DataFrame, unit: Unit, length: int) -> DataFrame:
    """class, hashes: anchors of the class that another class has too."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, _, owner, _, h, _, _ in _sliced(batch, unit, length):
                turn = np.lexsort((h, owner))
                h, owner = h[turn], owner[turn]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("class").take(pa.array(owner[new])), pa.array(h[new], pa.int64())], ["class", "h"])

    # both uses read one exchange: a row for each anchor and class crosses once
    found = texts.select("class", "text").mapInArrow(find, "class long, h long").repartition(
        partitions(texts.sparkSession), "h")
    twice = found.groupBy("h").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a != b").select("h")
    return stored(found.join(twice.hint("merge"), "h").groupBy("class").agg(F.collect_list("h").alias("hashes")), "shared")


def contexts(texts: DataFrame, shared: DataFrame, unit: Unit, length: int) -> DataFrame:
    """class, first, h, place (symbol where the first window starts), windows, context."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts, ends, owner, before, h, first, last in _sliced(batch, unit, length):
                lists = part.column("hashes")
                known = lists.flatten().to_numpy().astype(np.int64)
                theirs = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                salt = np.int64(-7046029254386353131)
                hit = np.isin(h ^ (owner * salt), known ^ (theirs * salt))
                h, owner, first, last = h[hit], owner[hit], first[hit], last[hit]
                body, offsets = slices(data, starts[first], ends[last + length - 1])
                cuts = pa.Array.from_buffers(pa.binary(), len(h), [
                    None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays([
                    part.column("class").take(who), part.column("first").take(who), pa.array(h, pa.int64()),
                    pa.array(first - before[owner], pa.int64()), pa.array(last - first + 1, pa.int32()), cuts],
                    ["class", "first", "h", "place", "windows", "context"])

    rows = texts.join(shared, "class").select("class", "first", "text", "hashes")
    return stored(rows.mapInArrow(
        cut, "class long, first long, h long, place long, windows int, context binary"
    ).withColumns({"code": F.xxhash64("h", "context"), "code2": F.xxhash64(F.lit(2), "context", "h")}), "contexts")


def solved(places: DataFrame, unit: Unit, length: int, solve: Solver, hot: int) -> DataFrame:
    """code, code2, skip, count, source: `count` windows of a context from `skip` on start first in document source."""
    size = places.agg(F.sum(F.length("context")), F.count("*")).first()
    columns = ["h", "code", "code2", "windows", "context", "source", "latest"]
    if not size[1]:
        return places.select("code", "code2", F.lit(0).alias("skip"), F.lit(0).alias("count"), F.col("first").alias("source"))
    shards = max(1, -(-size[0] // (SHARD * (6 if unit.words else 1))))
    # what stands at very many places is counted once before it moves; of the rest a shard holds all places
    busy = stored(places.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h"), "busy")
    plain = places.join(small(busy), "h", "left_anti").select(
        "h", "code", "code2", "windows", "context", F.col("first").alias("source"), F.col("first").alias("latest"))
    once = stored(places.join(small(busy), "h").groupBy("h", "code", "code2", "windows", "context").agg(
        F.min("first").alias("source"), F.max("first").alias("latest")).select(*columns), "distinct")
    many = stored(once.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("h"), "many")

    def shard(group: pa.Table) -> pa.Table:
        coded = group.column("context").combine_chunks().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        turn = np.argsort(which, kind="stable")
        begin = np.flatnonzero(np.diff(which[turn], prepend=-1))
        column = lambda name: group.column(name).to_numpy()[turn]
        windows = column("windows").astype(np.int64)[begin]
        codes = [column(c)[begin] for c in ("code", "code2")]
        source, latest = np.minimum.reduceat(column("source"), begin), np.maximum.reduceat(column("latest"), begin)
        best = solve(coded.dictionary.to_pylist(), windows, source)
        owner = np.repeat(np.arange(len(windows)), windows)
        skip = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        turn = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])]))
        count = np.diff(np.append(turn, len(owner)))
        used = best[turn] < latest[owner[turn]]
        turn, count = turn[used], count[used]
        return pa.table([*(pa.array(c[owner[turn]], pa.int64()) for c in codes), pa.array(skip[turn], pa.int32()),
                         pa.array(count, pa.int32()), pa.array(best[turn], pa.int64())],
                        ["code", "code2", "skip", "count", "source"])

    cold = plain.unionByName(once.join(small(many), "h", "left_anti").select(*columns)).withColumn(
        "shard", F.pmod("h", F.lit(shards)))
    out = cold.select("shard", *columns[1:]).groupBy("shard").applyInArrow(
        shard, "code long, code2 long, skip int, count int, source long")
    # an anchor with very many contexts: its windows, one by one, to the smallest source
    if unit.words:
        symbols = F.split(F.col("context").cast("string"), " ")
        window = F.transform(F.sequence(F.lit(1), F.col("windows")), lambda i: F.unhex(F.md5(F.concat_ws(" ", F.slice("symbols", i, length)))))
    else:
        symbols = F.col("context")
        window = F.transform(F.sequence(F.lit(1), F.col("windows")), lambda i: F.unhex(F.md5(F.substring("symbols", i, F.lit(length)))))
    each = once.join(small(many), "h").withColumn("symbols", symbols).select(
        "code", "code2", "source", "latest", F.posexplode(window).alias("skip", "window"))
    least = each.groupBy("window").agg(F.min("source").alias("least"))
    single = each.join(least, "window").filter("least < latest").select(
        "code", "code2", F.col("skip").cast("int").alias("skip"), F.lit(1).alias("count"), F.col("least").alias("source"))
    return stored(out.unionByName(single), "solved")


def repeats(docs: DataFrame, text: Column, unit: Unit, solve: Solver, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n, n_removed, n_spans, kept_sha256, spans (start and end in symbols)."""
    rows, texts = classes(docs, text)
    shared = shared_anchors(texts, unit, length)
    places = contexts(texts, shared, unit, length)
    found = places.select("class", "first", "place", "code", "code2").join(
        solved(places, unit, length, solve, hot), ["code", "code2"]).filter("source < first")
    begin = F.col("place") + F.col("skip")
    spans = found.groupBy("class").agg(F.collect_list(F.struct(
        begin.alias("start"), (begin + F.col("count") - 1 + length).alias("end"))).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "n_removed", "n_spans", "kept_sha256", "spans")}
            for body, own in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = body.as_py().encode()
                symbols = (raw.split(b" ") if raw else []) if unit.words else raw
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in own or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(symbols[at:a])
                    at = b
                kept.append(symbols[at:])
                left = b" ".join(w for k in kept for w in k) if unit.words else b"".join(kept)
                out["n"].append(len(symbols))
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([
                batch.column("class"), batch.column("first"), batch.column("size"),
                *(pa.array(out[c], pa.int64()) for c in ("n", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()),
                pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["class", "first", "size", "n", "n_removed", "n_spans", "kept_sha256", "spans"])

    span = "array<struct<start:bigint,end:bigint>>"
    facts = stored(texts.join(spans, "class", "left").select("class", "first", "size", "text", "spans").mapInArrow(
        remove, f"class long, first long, size long, n long, n_removed long, n_spans long, kept_sha256 string, spans {span}"), "facts")
    total = facts.agg(F.sum("size")).first()[0] or 0
    out = lookup(rows, facts, "class", F.col("size"), total)
    copy = (F.col("id") > F.col("first")) & (F.col("n") >= length)
    full = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    return out.select(
        "doc_id", "n", F.when(copy, F.col("n")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, full).otherwise(F.col("spans")).alias("spans"))
