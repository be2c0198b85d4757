"""Running values over all rows in an order, or over segments of any length.

Rows are cut into even ranges of the order, whatever the distribution of the keys is. Each range
is scanned by itself; what the ranges before it add is one small row per range, folded on the
driver (as many rows as there are shuffle partitions) and added to the rows that need it. So
neither one segment with most of the rows nor one order over everything becomes one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from packetloom.session import materialise


@dataclass(frozen=True)
class Sum:
    """Sum of whole numbers up to and including this row; NULL counts as 0."""
    value: Column


@dataclass(frozen=True)
class Xor:
    """Exclusive or of whole numbers up to and including this row; NULL counts as 0."""
    value: Column


@dataclass(frozen=True)
class Before:
    """Whole number on the row before in the segment, NULL on its first row."""
    value: Column


Wanted = Sum | Xor | Before
PART, PLACE, HEAD = "_scan_part", "_scan_place", "_scan_head"


def _changes(columns: list[pa.Array], last: list[pa.Scalar] | None, n: int) -> np.ndarray:
    """Rows that begin a segment; last holds the keys of the row before the batch."""
    new = np.zeros(n, dtype=bool)
    new[0] = last is None or any(c[0].as_py() != k.as_py() for c, k in zip(columns, last))
    for c in columns:
        a, b = c[1:], c[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return new


def _accumulate(kind: type, values: np.ndarray, starts: np.ndarray, carry: int) -> np.ndarray:
    """Inclusive sums or exclusive ors, from 0 at each start and from carry before the first."""
    fold = np.add if kind is Sum else np.bitwise_xor
    total = fold.accumulate(values)
    undo = np.subtract if kind is Sum else np.bitwise_xor
    where = np.flatnonzero(starts)
    segment = np.cumsum(starts)  # 0 for rows that go on with the segment of the batch before
    base = np.concatenate([np.array([carry], dtype=np.int64),
                           undo(total[where], values[where])])
    if kind is Sum:
        base[1:] = -base[1:]
    return fold(total, base[segment])


def prefix_scan(df: DataFrame, order: Sequence[Column | str], segment: Sequence[str] = (),
                **wanted: Wanted) -> DataFrame:
    """Add running columns in ``order``, which starts again at each value of ``segment``.

    Rows that are equal in segment and order stand in no defined order and lie in one task, so
    aggregate them beforehand where there may be many. Sums are 64-bit and wrap around.
    """
    spark, kinds = df.sparkSession, {k: type(w) for k, w in wanted.items()}
    values = {f"_scan_v_{k}": w.value.cast("long") for k, w in wanted.items()}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [*(F.col(s) for s in segment), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns(values).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    added = ", ".join(f"{k} bigint" for k in wanted)
    schema = f"{PART} int, {PLACE} bigint, {HEAD} boolean, {added}"
    given = ranged.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, head, last = TaskContext.get().partitionId(), 0, True, None
        carry: dict[str, int | None] = {k: None if w is Before else 0 for k, w in kinds.items()}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            columns = [b.column(s) for s in segment]
            starts = _changes(columns, last if place else None, n)
            found = {}
            for k, kind in kinds.items():
                v = b.column(f"_scan_v_{k}")
                if kind is Before:
                    shifted = pa.concat_arrays([pa.array([carry[k]], pa.int64()), v[:-1].cast(pa.int64())])
                    found[k] = pc.if_else(pa.array(starts), pa.scalar(None, pa.int64()), shifted)
                    carry[k] = v[n - 1].as_py()
                else:
                    whole = pc.fill_null(v, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    run = _accumulate(kind, whole, starts, carry[k])
                    found[k], carry[k] = pa.array(run), int(run[-1])
            later = starts.copy()
            later[0] &= place > 0
            first = np.cumsum(later) == 0 if head else np.zeros(n, dtype=bool)
            head = bool(first[-1])
            last = [c[n - 1] for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, dtype=np.int32)),
                 pa.array(np.arange(place, place + n)), pa.array(first), *found.values()],
                names=[*b.schema.names, PART, PLACE, HEAD, *found])
            place += n

    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.fields)
    local = materialise(ranged.mapInArrow(scan, f"{listed}, {schema}"), "scan")
    ends = local.groupBy(PART).agg(
        F.min_by(F.struct(F.lit(0), *segment), PLACE).alias("first"),
        F.max_by(F.struct(F.lit(0), *segment), PLACE).alias("last"),
        *[F.max_by(f"_scan_v_{k}" if w is Before else k, PLACE).alias(f"t_{k}") for k, w in kinds.items()])
    carried, before, running = [], None, {}
    for r in sorted(ends.collect(), key=lambda r: r[PART]):
        going_on = before is not None and before == r["first"]
        if going_on:
            carried.append((r[PART], *(running[k] for k in kinds)))
        whole = going_on and r["first"] == r["last"]
        for k, kind in kinds.items():
            total = r[f"t_{k}"]
            if whole and kind is Sum:
                total += running[k]
            elif whole and kind is Xor:
                total ^= running[k]
            running[k] = total
        before = r["last"]
    past = spark.createDataFrame(carried, f"_scan_p int, " + ", ".join(f"_scan_c_{k} bigint" for k in kinds))
    joined = local.join(F.broadcast(past), F.col(PART) == F.col("_scan_p"), "left")
    final = {}
    for k, kind in kinds.items():
        mine, c = F.col(k), F.col(f"_scan_c_{k}")
        if kind is Before:
            final[k] = F.when(F.col(PLACE) == 0, c).otherwise(mine)
        else:
            add = mine + F.coalesce(c, F.lit(0)) if kind is Sum else mine.bitwiseXOR(F.coalesce(c, F.lit(0)))
            final[k] = F.when(F.col(HEAD), add).otherwise(mine)
    return joined.withColumns(final).drop(
        PART, PLACE, HEAD, "_scan_p", *values, *[f"_scan_c_{k}" for k in kinds])
