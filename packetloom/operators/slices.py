"""Ordered operations on keys of any size.

A window over a whole key puts that key in one task. Where a key may be too large for
that (``has_group_over`` tells), its timeline is cut into slices; the window runs inside
a slice, and what earlier slices contribute is carried in from a summary of one row per
slice. The summary is map-side combined, so a key that holds a third of the data costs as
many tasks as it has slices. Keys known to be small take one plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom.session import materialise


@dataclass(frozen=True)
class Prev:
    """Value on the row just before, in order."""
    value: Column


@dataclass(frozen=True)
class Last:
    """Latest non-null value up to and including this row."""
    value: Column


@dataclass(frozen=True)
class PrevLast:
    """Latest non-null value on the rows strictly before this one."""
    value: Column


@dataclass(frozen=True)
class RunSum:
    """Sum up to and including this row."""
    value: Column


@dataclass(frozen=True)
class PrevMax:
    """Maximum over all rows strictly before this one."""
    value: Column


@dataclass(frozen=True)
class RunMax:
    """Maximum up to and including this row."""
    value: Column


def time_slice(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us))


Wanted = Prev | Last | PrevLast | RunSum | PrevMax | RunMax


def has_group_over(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Is any group larger than the limit? One map-side combined count."""
    return not df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty()


def _within(w: Wanted, v: Column, inside: W) -> Column:
    """The wanted value over one ordered window."""
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    prior = inside.rowsBetween(W.unboundedPreceding, -1)
    match w:
        case Prev():
            # struct-wrapped, so that a NULL in the previous row stays distinguishable
            return F.lag(F.struct(v.alias("x"))).over(inside)
        case Last():
            return F.last(v, ignorenulls=True).over(upto)
        case PrevLast():
            return F.last(v, ignorenulls=True).over(prior)
        case RunSum():
            return F.sum(v).over(upto)
        case PrevMax():
            return F.max(v).over(prior)
        case _:
            return F.max(v).over(upto)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            slice_by: Column | None, **wanted: Wanted) -> DataFrame:
    """Add ordered columns per key.

    ``slice_by`` must be monotone in ``order``; None promises that every key is small.
    """
    keys, order = list(keys), list(order)
    if slice_by is None:
        inside = W.partitionBy(*keys).orderBy(*order)
        found = {n: _within(w, w.value, inside) for n, w in wanted.items()}
        return df.withColumns(
            {n: c["x"] if isinstance(wanted[n], Prev) else c for n, c in found.items()})
    # read twice below (rows and summary): stored, so that what lies upstream runs once
    df = materialise(df, "slices")
    values = {f"_v_{n}": w.value for n, w in wanted.items()}
    # _pos also orders rows inside the per-slice aggregates
    df = df.withColumns({"_slice": slice_by, "_pos": F.struct(*order), **values})

    carried = {}
    for name, w in wanted.items():
        v = F.col(f"_v_{name}")
        if isinstance(w, Prev):
            carried[name] = F.max_by(F.struct(v.alias("x")), F.col("_pos"))
        elif isinstance(w, Last | PrevLast):
            carried[name] = F.max_by(v, F.when(v.isNotNull(), F.col("_pos")))
        elif isinstance(w, RunSum):
            carried[name] = F.sum(v)
        else:
            carried[name] = F.max(v)
    summary = df.groupBy(*keys, "_slice").agg(
        *[c.alias(f"_s_{n}") for n, c in carried.items()])

    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    fold = {}
    for name, w in wanted.items():
        s = F.col(f"_s_{name}")
        if isinstance(w, Prev | Last | PrevLast):
            fold[f"_c_{name}"] = F.last(s, ignorenulls=True).over(before)
        elif isinstance(w, RunSum):
            fold[f"_c_{name}"] = F.sum(s).over(before)
        else:
            fold[f"_c_{name}"] = F.max(s).over(before)
    # unchecked size: no hint, the optimizer sees both sides' statistics
    carry = summary.withColumns(fold).select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_k_slice"), *fold)
    match = F.col("_slice") == F.col("_k_slice")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{i}"))

    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    local = {f"_l_{n}": _within(w, F.col(f"_v_{n}"), inside) for n, w in wanted.items()}
    joined = df.withColumns(local).join(carry, match, "left")

    final = {}
    for name, w in wanted.items():
        mine, past = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if isinstance(w, Prev):
            final[name] = F.coalesce(mine, past)["x"]
        elif isinstance(w, Last | PrevLast):
            final[name] = F.coalesce(mine, past)
        elif isinstance(w, RunSum):
            final[name] = F.when(
                mine.isNull() & past.isNull(), None
            ).otherwise(F.coalesce(mine, F.lit(0)) + F.coalesce(past, F.lit(0)))
        else:
            final[name] = F.greatest(mine, past)
    helpers = ["_slice", "_pos", "_k_slice", *values, *local, *fold,
               *[f"_k_{i}" for i in range(len(keys))]]
    return joined.withColumns(final).drop(*helpers)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                spread_on: Sequence[str], salts: int | None = None, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``, which must be total.

    Ranked inside salted sub-groups first (salt from the ``spread_on`` columns), so at
    most n rows per salt of a busy key meet in the final ranking. By default there are as many
    salts as shuffle partitions, which follow the size of the data.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    first = salted.withColumn("_rn", place(*keys, "_salt")).where(F.col("_rn") <= n)
    kept = first.withColumn("_rn", place(*keys)).where(F.col("_rn") <= n).drop("_salt")
    return kept.withColumnRenamed("_rn", rank) if rank else kept.drop("_rn")


def flag_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """True on each key's first row in ``order``, by aggregate and join, not by window."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return (df.join(firsts, list(keys))
            .withColumn(name, F.struct(*order) == F.col("_first")).drop("_first"))
