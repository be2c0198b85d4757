"""Sliding aggregates over [t - span, t] for keys of any size.

Every row becomes an arrival and a departure, these are combined per key and moment, and a
running sum over them gives the value at each moment: linear work, where a RANGE frame would be
rows times window. The running sums are prefix scans over ranges of equally many events, so a key
with most of the rows has as many tasks as its rows need, however they lie in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom.operators.prefix import Before, Sum, prefix_scan

HOME = "_home"


def _asked(changes: DataFrame, keys: list[str], at: str, names: Sequence[str]) -> DataFrame:
    """Running sums of changes (keys, _at, _ask, names) at the moments that are asked for."""
    per = changes.groupBy(*keys, "_at").agg(F.max("_ask").alias("_ask"), *[F.sum(n).alias(n) for n in names])
    moved = per.withColumnsRenamed({n: f"_d_{n}" for n in names})
    run = prefix_scan(moved, ["_at"], keys, **{n: Sum(F.col(f"_d_{n}")) for n in names})
    return run.where("_ask").select(*keys, F.col("_at").alias(at), *names)


def sliding_sums(df: DataFrame, keys: Sequence[str], at: str,
                 sums: dict[str, tuple[int, Column]]) -> DataFrame:
    """One row per key and time with each sum over its own span. Values must be integers."""
    keys = list(keys)
    zero = F.lit(0).cast("long")
    arrive = F.struct(F.col(at).alias("_at"), F.lit(True).alias("_ask"),
                      *[c.cast("long").alias(n) for n, (_, c) in sums.items()])
    leave = [
        F.struct((F.col(at) + span + 1).alias("_at"), F.lit(False).alias("_ask"),
                 *[(-c.cast("long") if s == span else zero).alias(n) for n, (s, c) in sums.items()])
        for span in sorted({span for span, _ in sums.values()})]
    events = df.select(*keys, F.explode(F.array(arrive, *leave)).alias("e")).select(*keys, "e.*")
    return _asked(events, keys, at, list(sums))


def sliding_distinct(df: DataFrame, keys: Sequence[str], at: str,
                     counts: dict[str, tuple[int, Column]]) -> DataFrame:
    """One row per key and time with exact distinct counts, each over its own span.

    A value is present on [t, min(next t, t + span + 1)). Columns that are counted over several
    spans look for the next time once.
    """
    keys = list(keys)
    values = {str(c): c for _, c in counts.values()}
    tags = {name: i for i, name in enumerate(values)}
    tagged = F.array(*[F.struct(F.lit(tags[v]).alias("_tag"), c.cast("string").alias("_value"))
                       for v, c in values.items()])
    rows = df.select(*keys, at, F.explode(tagged).alias("e")).select(*keys, at, "e.*").distinct()
    seen = prefix_scan(rows, [F.col(at).desc()], [*keys, "_tag", "_value"], _next=Before(F.col(at)))
    change = lambda when, ask, sign, own: F.struct(
        when.alias("_at"), F.lit(ask).alias("_ask"),
        *[F.when((F.col("_tag") == tags[str(c)]) & own(span), sign).otherwise(0).cast("long").alias(n)
          for n, (span, c) in counts.items()])
    spans = sorted({span for span, _ in counts.values()})
    gone = [change(F.least(F.col("_next"), F.col(at) + span + 1), False, -1, lambda s, span=span: F.lit(s == span))
            for span in spans]
    come = change(F.col(at), True, 1, lambda s: F.lit(True))
    events = seen.select(*keys, F.explode(F.array(come, *gone)).alias("e")).select(*keys, "e.*")
    return _asked(events, keys, at, list(counts))


def sliding_max_count(df: DataFrame, keys: Sequence[str], item: Sequence[str], at: str,
                      span: int, name: str) -> DataFrame:
    """Per key and time: the largest number of rows any single item has in the window.

    A maximum cannot be un-added, but "how many items have at least k rows" can. Those
    sets are nested, so the maximum equals the number of levels k that are occupied.
    """
    keys, item = list(keys), list(item)
    one = F.lit(1).cast("long")
    steps = (
        df.select(*keys, *item, F.explode(F.array(
            F.struct(F.col(at).alias("_at"), one.alias("d")),
            F.struct((F.col(at) + span + 1).alias("_at"), (-one).alias("d")))).alias("e"))
        .select(*keys, *item, "e.*").groupBy(*keys, *item, "_at").agg(F.sum("d").alias("d")).where("d != 0"))
    moved = prefix_scan(steps, ["_at"], [*keys, *item], hi=Sum(F.col("d"))).withColumn("lo", F.col("hi") - F.col("d"))
    levels = moved.select(
        *keys, "_at", F.signum("d").cast("long").alias("d"),
        F.explode(F.sequence(F.least("lo", "hi") + 1, F.greatest("lo", "hi"))).alias("_level"))
    per_level = levels.groupBy(*keys, "_level", "_at").agg(F.sum("d").alias("d")).where("d != 0")
    filled = prefix_scan(per_level, ["_at"], [*keys, "_level"], now=Sum(F.col("d"))).withColumn(
        "was", F.col("now") - F.col("d"))
    held = lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    turns = filled.select(
        *keys, "_at", F.lit(False).alias("_ask"), (held("now") - held("was")).cast("long").alias(name)).where(F.col(name) != 0)
    asks = df.select(*keys, F.col(at).alias("_at"), F.lit(True).alias("_ask"), F.lit(0).cast("long").alias(name))
    return _asked(turns.unionByName(asks), keys, at, [name])


def sliding_max(df: DataFrame, keys: Sequence[str], at: str, span: int, value: Column,
                name: str) -> DataFrame:
    """Per key and time: the maximum over the window, in linear time.

    With blocks as wide as the window, [t - span, t] is a prefix of t's block and a suffix
    of the block before; both are running maxima.
    """
    keys, block = list(keys), span + 1
    per = df.groupBy(*keys, at).agg(F.max(value).alias("_v"))
    mine = F.floor(F.col(at) / F.lit(block))
    copies = F.array(
        F.struct(mine.alias("_block"), F.col(at).alias("_at"), F.lit(True).alias(HOME)),
        F.struct((mine + 1).alias("_block"), (F.col(at) + span).alias("_at"),
                 F.lit(False).alias(HOME)))
    rows = per.select(*keys, "_v", F.explode(copies).alias("e")).select(*keys, "_v", "e.*")
    w = W.partitionBy(*keys, "_block")
    prefix = F.max(F.when(F.col(HOME), F.col("_v"))).over(w.orderBy("_at"))
    suffix = F.max(F.when(~F.col(HOME), F.col("_v"))).over(w.orderBy(F.col("_at").desc()))
    return (rows.withColumn("_pre", prefix).withColumn("_suf", suffix).where(HOME)
            .select(*keys, F.col("_at").alias(at), F.greatest("_pre", "_suf").alias(name)))
