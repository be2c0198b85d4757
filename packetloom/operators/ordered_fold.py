"""Sequential folds per key that survive a key of any size.

``fold(state, rows)`` consumes rows of one key in order and returns output rows and the
new state. Rows stream through a task in batches, so only states are held. Keys of ordinary
size stay whole. If some key is larger than the limit, rows are range-partitioned by
(key, order), so a busy key is cut into many consecutive pieces that are folded at the
same time from guessed start states. A piece is folded again only if the state its
predecessor really ended in differs from the guess; when no piece differs, the result
equals the sequential fold.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from packetloom.operators.slices import has_group_over
from packetloom.session import materialise

Fold = Callable[[object, pd.DataFrame], tuple[pd.DataFrame, object]]
# (previous start, previous end, start just chosen for the previous piece) -> next start
Propagate = Callable[[object, object, object], object]


def _runs(pdf: pd.DataFrame, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal values in the columns."""
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for c in columns:
        v = pdf[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    edges = [*np.flatnonzero(change), len(pdf)]
    for a, b in zip(edges, edges[1:]):
        yield pdf.iloc[a:b]


def _pieces(batches: Iterator[pd.DataFrame], keys: list[str]
            ) -> Iterator[tuple[int, tuple, bool, pd.DataFrame]]:
    """Split sorted batches into runs of one (piece, key); flag the first run of a piece."""
    seen = None
    for pdf in batches:
        if pdf.empty:
            continue
        for run in _runs(pdf, ["_part", *keys]):
            part = int(run["_part"].iloc[0])
            yield part, tuple(run[k].iloc[0] for k in keys), part != seen, run
            seen = part


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold,
                schema: T.StructType) -> DataFrame:
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            outs = []
            for rows in _runs(pdf, keys):
                here = tuple(rows[k].iloc[0] for k in keys)
                out, state = fold(state if here == key else None, rows)
                key = here
                outs.append(out)
            yield pd.concat(outs, ignore_index=True)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)


def fold_sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold,
                schema: T.StructType, pieces: int, propagate: Propagate | None = None
                ) -> DataFrame:
    keys, order = list(keys), list(order)
    # Written out, because piece numbers must not change when a task is run again.
    stored = materialise(
        df.repartitionByRange(pieces, *keys, *order)
        .withColumn("_part", F.spark_partition_id()), "fold")

    def over(parts: list[int] | None) -> DataFrame:
        part = stored if parts is None else stored.where(F.col("_part").isin(parts))
        return part.repartition(pieces, "_part").sortWithinPartitions("_part", *keys, *order)

    def run_states(starts: dict) -> Callable:
        def run(batches):
            part, key, state, first_key = None, None, None, None
            for p, k, new_part, rows in _pieces(batches, keys):
                if new_part:
                    if part is not None:
                        yield _end_row(part, first_key, key, state)
                    first_key, key = k, None
                if k != key:
                    start = starts.get(p)
                    state = start[1] if new_part and start and start[0] == k else None
                part, key = p, k
                _, state = fold(state, rows)
            if part is not None:
                yield _end_row(part, first_key, key, state)
        return run

    def _end_row(part, first_key, key, state):
        return pd.DataFrame({"part": [part], "blob": [pickle.dumps((first_key, key, state))]})

    # One small state per piece reaches the driver; pieces, not rows, bound its size.
    starts: dict[int, tuple] = {}
    ends: dict[int, tuple] = {}
    todo: list[int] | None = None
    while True:
        for row in over(todo).mapInPandas(run_states(starts), "part int, blob binary").collect():
            ends[row.part] = pickle.loads(row.blob)
        chosen: dict[int, tuple] = {}
        numbers = sorted(ends)
        for prev, nxt in zip(numbers, numbers[1:]):
            _, last_key, end = ends[prev]
            if ends[nxt][0] != last_key:
                continue
            # the carried key must span the whole previous piece for its start to matter
            whole = ends[prev][0] == last_key
            used = starts[prev][1] if whole and prev in starts else None
            now = chosen[prev][1] if whole and prev in chosen else None
            value = propagate(used, end, now) if propagate else end
            chosen[nxt] = (last_key, value)
        todo = [p for p in numbers if pickle.dumps(chosen.get(p)) != pickle.dumps(starts.get(p))]
        starts = chosen
        if not todo:
            break

    final = dict(starts)

    def emit(batches):
        key, state = None, None
        for p, k, new_part, rows in _pieces(batches, keys):
            if new_part or k != key:
                start = final.get(p)
                state = start[1] if new_part and start and start[0] == k else None
            key = k
            out, state = fold(state, rows)
            yield out

    return over(None).mapInPandas(emit, schema)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold,
                 schema: T.StructType, limit: int, pieces: int | None = None,
                 propagate: Propagate | None = None) -> DataFrame:
    if not has_group_over(df, keys, limit):
        return fold_groups(df, keys, order, fold, schema)
    if pieces is None:
        pieces = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fold_sliced(df, keys, order, fold, schema, pieces, propagate)
