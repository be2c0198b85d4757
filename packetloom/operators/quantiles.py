"""Exact linear-interpolation quantiles of columns of any length.

The built-in ``percentile`` keeps all distinct values of a group in one place. Here values are
counted, a prefix scan over even ranges tells which ranks each one covers, and only the rows
that hold a wanted rank remain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.operators.prefix import Sum, prefix_scan


def _ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, lo, hi, total): zero-based ranks each distinct value covers."""
    named = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])
    values = (df.select(F.explode(named).alias("e")).select("e.*")
              .where(F.col("value").isNotNull()).groupBy("column", "value").count())
    upto = prefix_scan(values, ["value"], ["column"], hi=Sum(F.col("count")))
    totals = upto.groupBy("column").agg(F.max("hi").alias("total"))  # one row per column
    return upto.join(F.broadcast(totals), "column").select(
        "column", "value", (F.col("hi") - F.col("count")).alias("lo"),
        (F.col("hi") - 1).alias("hi"), "total")


def _between(lower: Column, upper: Column, fraction: Column) -> Column:
    return lower + (upper - lower) * fraction


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, q0, q1, ...) with one row per column; NULL quantiles where no value is known."""
    ranked = _ranked(df, columns)
    picks = {}
    for i, x in enumerate(probs):
        h = F.lit(float(x)) * (F.col("total") - 1)
        holds = lambda r: F.col("value").isNotNull() & (F.col("lo") <= r) & (r <= F.col("hi"))
        picks[f"_a{i}"] = F.max(F.when(holds(F.floor(h)), F.col("value")))
        picks[f"_b{i}"] = F.max(F.when(holds(F.ceil(h)), F.col("value")))
        picks[f"_f{i}"] = F.max(h - F.floor(h))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    rows = every.join(ranked.groupBy("column").agg(*[c.alias(n) for n, c in picks.items()]), "column", "left")
    return rows.select("column", *[
        _between(F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_f{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def grid_quantiles(df: DataFrame, column: str, points: int, top: float) -> DataFrame:
    """(i, prob, value): ``points`` evenly spaced quantiles on 0..top."""
    step = top / (points - 1)
    ranked = _ranked(df.select(F.col(column).alias("v")), ["v"])
    # grid positions whose lower or upper rank may fall on this value, with one to spare
    unit = F.lit(step) * F.greatest(F.col("total") - 1, F.lit(1))
    first = F.greatest(F.floor((F.col("lo") - 1) / unit) - 1, F.lit(0))
    last = F.least(F.ceil((F.col("hi") + 1) / unit) + 1, F.lit(points - 1))
    rows = ranked.where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    h = F.col("i") * F.lit(step) * (F.col("total") - 1)
    holds = lambda r: (F.col("lo") <= r) & (r <= F.col("hi"))
    met = rows.groupBy("i").agg(
        F.max(F.when(holds(F.floor(h)), F.col("value"))).alias("a"),
        F.max(F.when(holds(F.ceil(h)), F.col("value"))).alias("b"),
        F.max(h - F.floor(h)).alias("f"))
    return met.select(F.col("i").cast("int").alias("i"), (F.col("i") * step).alias("prob"),
                      _between(F.col("a"), F.col("b"), F.col("f")).alias("value"))
