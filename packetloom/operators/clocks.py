"""The capture-wide packet clock: what had been seen anywhere before a moment.

Both look-ups run on the distinct packet times of a capture (map-side combined), cut
into one-second slices, so neither the capture nor a burst second meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom.operators.slices import time_slice
from packetloom.params import SECOND


def global_prev_ts(packets: DataFrame) -> DataFrame:
    """Add ``g_us``: time of the packet just before this one in (ts, seq), on any key."""
    second = time_slice(F.col("ts_us"), SECOND)
    ticks = packets.groupBy("capture_id", "ts_us").agg(
        F.min("seq").alias("first_seq")).withColumn("_slice", second)
    # one row per second; the last packet time of the second before it that has any
    seconds = packets.groupBy("capture_id", second.alias("_slice")).agg(
        F.max("ts_us").alias("_last"))
    before = W.partitionBy("capture_id").orderBy("_slice")
    seconds = seconds.withColumn("_carry", F.lag("_last").over(before)).drop("_last")
    inside = W.partitionBy("capture_id", "_slice").orderBy("ts_us")
    earlier = (ticks.withColumn("_lag", F.lag("ts_us").over(inside))
               .join(seconds, ["capture_id", "_slice"])
               .select("capture_id", "ts_us", "first_seq",
                       F.coalesce("_lag", "_carry").alias("earlier_us")))
    joined = packets.join(earlier, ["capture_id", "ts_us"])
    g = F.when(F.col("seq") > F.col("first_seq"), F.col("ts_us")).otherwise(F.col("earlier_us"))
    return joined.withColumn("g_us", g).drop("first_seq", "earlier_us")


def export_clock(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """Add ``clock_us``: first packet time anywhere at or after ``deadline_us``.

    A forward as-of on (capture, second): a deadline looks in its own second first and
    falls through to the first packet of the next non-empty second. NULL past the end.
    """
    ticks = packets.select("capture_id", F.col("ts_us").alias("at")).distinct()
    wants = flows.select("capture_id", F.col("deadline_us").alias("at")).distinct()
    both = ticks.withColumn("tick", F.col("at")).unionByName(
        wants.withColumn("tick", F.lit(None).cast("long")))
    both = both.withColumn("_slice", time_slice(F.col("at"), SECOND))

    # descending, so that the frame is an unbounded prefix and stays linear
    later = W.partitionBy("capture_id", "_slice").orderBy(
        F.col("at").desc(), F.col("tick").desc_nulls_last()
    ).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("capture_id").orderBy(F.col("_slice").desc()).rowsBetween(
        W.unboundedPreceding, -1)
    summary = both.groupBy("capture_id", "_slice").agg(F.min("tick").alias("_first")).withColumn(
        "_next", F.last("_first", ignorenulls=True).over(after)).drop("_first")
    found = (
        both.withColumn("_here", F.last("tick", ignorenulls=True).over(later))
        .where(F.col("tick").isNull())
        .join(summary, ["capture_id", "_slice"])
        .select("capture_id", F.col("at").alias("deadline_us"),
                F.coalesce("_here", "_next").alias("clock_us"))
    )
    return flows.join(found, ["capture_id", "deadline_us"], "left")
