"""How filters overlap: sorted posting lists of failing ids per part, merged by galloping.

Each part of the corpus (a source) keeps, per range of ids, one sorted list for every filter of the
ids that fail it, and one for every label. A merge walks all lists of a range at once: it takes the
smallest head, and where only one list holds it, gallops to the next head of the others, so that a
run that no other list touches is counted in one step. What the lists share and what only some hold
is known then by size, and sizes add up over the ranges. Sizes of all unions of filters give every
order in which they may be applied.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import lookup, partitions, stored, table

FILTERS, LABELS = "ABCDE", ("good", "toxic")
WORDS_LEAST, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5


def text_conditions(text: Column) -> tuple[Callable[[DataFrame], DataFrame], dict[str, Column]]:
    """A step that adds the words of text, and the failure conditions A to D on it."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    return lambda df: df.withColumn("_words", words), {
        "A": n < WORDS_LEAST, "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, id, mask, n): documents by the filters they fail and the labels they have.

    Bit k of mask is filter k of FILTERS, the bits above are LABELS. Documents that fail nothing have
    a null id and are one row per part. n counts documents, since rows may repeat an id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    prepare, found = text_conditions(F.col("_text"))
    bits = sum((F.when(found[f], F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate("ABCD")), F.lit(0))
    scanned = prepare(docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("id"), text.alias("_text")))
    facts = stored(scanned.select("part", "id", bits.alias("bits"), F.sha2("_text", 256).alias("digest")), "facts")
    firsts = stored(facts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "firsts")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    mask = F.col("bits") + F.when(again, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    failing = lookup(facts, firsts, "digest", F.col("copies"), facts.count()).select("part", "id", mask.alias("mask"))
    entries = failing.groupBy("part", F.when(F.col("mask") > 0, F.col("id")).alias("id"), "mask").agg(F.count("*").alias("n"))
    named = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    width = len(FILTERS)
    marks = sum((F.shiftleft(F.coalesce(F.col(x), F.lit(0)), width + k) for k, x in enumerate(LABELS)), F.lit(0))
    return entries.join(named, "id", "left").select("part", "id", (F.col("mask") + marks).alias("mask"), "n")


POSTINGS = ("part string, first_id long, last_id long, ids array<long>, copies array<long>, "
            "lists array<array<int>>, documents long")


def posting_lists(failing: DataFrame, lists: int) -> DataFrame:
    """The lists of each part and range of ids: places in ids, ascending, one list for each bit.

    A range is at most one Arrow batch of rows in order of part and id, so ranges are even whatever
    the ids are, and a part with most of the documents has as many more of them.
    """
    spark = failing.sparkSession
    keys = ["part", "id", "mask"]
    ordered = failing.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("part").to_pylist()
            mask = b.column("mask").to_numpy(zero_copy_only=False)
            edges = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)]
            rows = []
            for lo, hi in zip(edges, edges[1:]):
                fails, ids = mask[lo:hi], b.column("id")[lo:hi].to_pylist()
                known = [i for i in ids if i is not None]
                rows.append({
                    "part": parts[lo], "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
                    "ids": ids, "copies": (n := b.column("n")[lo:hi].to_pylist()), "documents": sum(n),
                    "lists": [np.flatnonzero(fails >> k & 1).astype(np.int32) for k in range(lists)]})
            if len(parts):
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow())
    return ordered.mapInArrow(cut, POSTINGS)


def _arrow() -> pa.Schema:
    return pa.schema([("part", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("ids", pa.list_(pa.int64())),
                      ("copies", pa.list_(pa.int64())), ("lists", pa.list_(pa.list_(pa.int32()))), ("documents", pa.int64())])


def gallop(values: Sequence[int], start: int, bound: int) -> int:
    """First place from start on whose value is not below bound: doubling steps, then halving."""
    step, low = 1, start
    while low + step < len(values) and values[low + step] < bound:
        low, step = low + step, step * 2
    return bisect_left(values, bound, low, min(low + step, len(values)))


def merge(lists: Sequence[Sequence[int]], weights: Sequence[int]) -> dict[int, int]:
    """Weight of the places that exactly the lists of a set hold, by that set as bits."""
    cells: dict[int, int] = {}
    running = [np.concatenate([[0], np.cumsum(np.asarray(weights)[np.asarray(x, dtype=np.int64)])]).tolist() if len(x) else [0]
               for x in lists]
    at = [0] * len(lists)
    live = [k for k, x in enumerate(lists) if len(x)]
    while live:
        low = min(lists[k][at[k]] for k in live)
        on = [k for k in live if lists[k][at[k]] == low]
        if len(on) == 1:
            k = on[0]
            others = [lists[j][at[j]] for j in live if j != k]
            end = gallop(lists[k], at[k], min(others)) if others else len(lists[k])
            cells[1 << k] = cells.get(1 << k, 0) + running[k][end] - running[k][at[k]]
            at[k] = end
        else:
            held = sum(1 << k for k in on)
            cells[held] = cells.get(held, 0) + weights[low]
            for k in on:
                at[k] += 1
        live = [k for k in live if at[k] < len(lists[k])]
    return cells


def unions(cells: dict[int, int], filters: int, labels: int) -> list[list[int]]:
    """Per set of filters, as bits: the size of its union, then that of its part with each label."""
    out = [[0] * (1 << filters) for _ in range(labels + 1)]
    for held, n in cells.items():
        for s in range(1, 1 << filters):
            if held & s:
                out[0][s] += n
                for k in range(labels):
                    if held >> filters + k & 1:
                        out[k + 1][s] += n
    return out


def union_sizes(postings: DataFrame, filters: int, labels: int) -> DataFrame:
    """(part, documents, u0, u1, ...): sizes of all unions of filters, without and with each label."""
    names = [f"u{k}" for k in range(labels + 1)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for part, copies, lists, n in zip(*(b.column(c).to_pylist() for c in ("part", "copies", "lists", "documents"))):
                sizes = unions(merge(lists, copies), filters, labels)
                rows.append({"part": part, "documents": n, **dict(zip(names, sizes))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("part", pa.string()), ("documents", pa.int64()), *((u, pa.list_(pa.int64())) for u in names)]))

    each = postings.mapInArrow(solve, "part string, documents long, " + ", ".join(f"{u} array<long>" for u in names))
    add = lambda u: F.array(*[F.sum(F.col(u)[s]) for s in range(1 << filters)]).alias(u)
    return each.groupBy("part").agg(F.sum("documents").alias("documents"), *[add(u) for u in names])


def report(sizes: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step in it, from the sizes of all unions."""
    k, everything = len(filters), (1 << len(filters)) - 1
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = sizes.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bits = F.array(*[F.lit(1 << f) for f in range(k)])
    bit = lambda at: F.get(bits, F.instr(F.lit(filters), F.substring(F.col("filter_order"), at, F.lit(1))) - 1)
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0),
                         lambda s, i: s.bitwiseOR(F.when(i > 0, bit(i)).otherwise(F.lit(0))))
    rows = rows.withColumns({"_own": bit(F.col("step")), "_before": before})
    size = lambda u, s: F.get(F.col(u), s)
    own, earlier = F.col("_own"), F.col("_before")
    after = earlier.bitwiseOR(own)
    gained = lambda u: size(u, after) - size(u, earlier)
    share = [sum((F.lit(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) * (size("u0", F.lit(s | 1 << f)) - size("u0", F.lit(s)))
                  for s in range(1 << k) if not s >> f & 1), F.lit(0)) for f in range(k)]
    shapley = F.coalesce(*[F.when(own == 1 << f, share[f]) for f in range(k)])
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        long(F.col("documents") - size("u0", after), "kept"), long(gained("u0"), "removed"),
        long(size("u0", own) - gained("u0"), "redundant"),
        long(size("u0", F.lit(everything)) - size("u0", F.lit(everything).bitwiseXOR(own)), "unique_fails"),
        long(gained("u1"), "good_lost"), long(gained("u2"), "toxic_lost"), long(shapley, "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The posting lists of documents (doc_id, text, source), a stored table, and the report on them.

    A null text is empty, a null source the part ''. Each row is a document, also if it repeats another
    or its id. A null doc_id is smaller than none and has none smaller, and no label. A label
    counts if any row of the id has it. Empty documents give no rows. Other columns are not looked at.
    """
    failing = stored(failures(docs, labels), "failing")
    lists = stored(posting_lists(failing, len(FILTERS) + len(LABELS)), "postings")
    return lists, report(union_sizes(lists, len(FILTERS), len(LABELS)))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[1]


SQL = r"""
WITH RECURSIVE w AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
facts AS (
  SELECT part, doc_id, (len(words) < 50)::INT AS a, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce((doc_id > min(doc_id) OVER (PARTITION BY t))::INT, 0) AS e FROM w),
named AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
         count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM facts LEFT JOIN named USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (
  SELECT o AS filter_order, step::INT AS step, substr(o, step, 1) AS f, (1 << (instr('ABCDE', substr(o, step, 1)) - 1))::BIGINT AS own,
         list_sum(list_transform(range(1, step), lambda i: (1 << (instr('ABCDE', substr(o, i, 1)) - 1))::BIGINT)) AS earlier
  FROM orders, range(1, 6) AS s(step) WHERE length(o) = 5),
counted AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER ((mask & (own | coalesce(earlier, 0)::BIGINT)) = 0) AS kept,
         sum(n) FILTER ((mask & own) > 0 AND (mask & coalesce(earlier, 0)::BIGINT) = 0) AS removed,
         sum(n) FILTER ((mask & own) > 0 AND (mask & coalesce(earlier, 0)::BIGINT) > 0) AS redundant,
         sum(n) FILTER (mask = own) AS unique_fails,
         sum(good) FILTER ((mask & own) > 0 AND (mask & coalesce(earlier, 0)::BIGINT) = 0) AS good_lost,
         sum(toxic) FILTER ((mask & own) > 0 AND (mask & coalesce(earlier, 0)::BIGINT) = 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counted
"""
