"""Rollups of verdicts: per second, per host, per run.

Verdicts carry: at_us, src, dst, fwd_bytes, bwd_bytes, packets, bytes, score, threshold,
is_alert, suppressed, family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom import fixed_values as V
from packetloom.functions import scalars as S
from packetloom.operators.dims import asset_lookup
from packetloom.params import SECOND, Params


def bucket_rollup(verdicts: DataFrame) -> DataFrame:
    second = (F.floor(F.col("at_us") / F.lit(SECOND)) * SECOND).cast("long")
    return verdicts.groupBy(F.timestamp_micros(second).alias("ts")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"), S.count_if(F.col("is_alert")).alias("alerts"),
        F.avg("score").alias("score_mean"), F.max("score").alias("score_max"),
        F.avg("threshold").alias("threshold_mean"))


def host_rollup(verdicts: DataFrame, calibrated: bool = False) -> DataFrame:
    """Deltas per host: what it sent as a source, what it received as a destination."""
    none = lambda t: F.lit(None).cast(t)
    zero = F.lit(0).cast("long")
    at = F.struct("at_us", "seq")
    flag = F.col("calibrated") if calibrated else F.lit(None).cast("boolean")
    out = verdicts.select(
        F.col("src").alias("ip"), F.lit(1).cast("long").alias("o"), zero.alias("i"),
        F.col("fwd_bytes").cast("long").alias("bo"), zero.alias("bi"),
        F.col("is_alert").cast("long").alias("a"), "score", "threshold", flag.alias("cal"),
        at.alias("ord"), "at_us")
    inn = verdicts.select(
        F.col("dst").alias("ip"), zero.alias("o"), F.lit(1).cast("long").alias("i"),
        zero.alias("bo"), F.col("bwd_bytes").cast("long").alias("bi"), zero.alias("a"),
        none("double").alias("score"), none("double").alias("threshold"),
        none("boolean").alias("cal"), none(at_type(verdicts)).alias("ord"), "at_us")
    return out.unionByName(inn).groupBy("ip").agg(
        F.sum("o").alias("flows_out"), F.sum("i").alias("flows_in"),
        F.sum("bo").alias("bytes_out"), F.sum("bi").alias("bytes_in"),
        F.sum("a").alias("alerts"), F.sum("score").alias("score_sum"),
        F.count("score").alias("score_n"), F.max_by("threshold", "ord").alias("threshold"),
        F.max_by("cal", "ord").alias("calibrated"),
        F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))


def at_type(verdicts: DataFrame) -> str:
    kinds = dict(verdicts.dtypes)
    return f"struct<at_us:{kinds['at_us']},seq:{kinds['seq']}>"


def host_score_mean(total: Column, n: Column, mean: Column, score_sum: Column) -> Column:
    """Lifetime mean; inbound flows count in the denominator."""
    older = F.greatest(total - n, F.lit(0))
    fresh = (mean * older + score_sum) / F.greatest(total, F.lit(1))
    return F.when(n > 0, fresh).otherwise(mean)


def hosts_upsert(current: DataFrame, deltas: DataFrame, assets: DataFrame,
                 p: Params = Params()) -> DataFrame:
    """Add one flush of deltas to the host table."""
    old = current.select(*[F.col(c).alias(f"_{c}") if c != "ip" else F.col(c)
                           for c in current.columns])
    both = old.join(deltas, "ip", "full_outer")
    prior = lambda c, v: F.coalesce(F.col(f"_{c}"), F.lit(v))
    add = lambda c: (prior(c, 0) + F.coalesce(F.col(c), F.lit(0))).alias(c)
    total = (prior("flows_out", 0) + prior("flows_in", 0)
             + F.coalesce("flows_out", F.lit(0)) + F.coalesce("flows_in", F.lit(0)))
    merged = both.select(
        "ip", F.coalesce("_first_us", "last_us").alias("first_us"),
        F.coalesce("last_us", "_last_us").alias("last_us"),
        *[add(c) for c in ("flows_out", "flows_in", "bytes_out", "bytes_in", "alerts")],
        host_score_mean(total, F.coalesce("score_n", F.lit(0)), prior("score_mean", 0.0),
                        F.coalesce("score_sum", F.lit(0.0))).alias("score_mean"),
        F.when(F.col("threshold") != 0, F.col("threshold"))
        .otherwise(prior("threshold", 0.0)).alias("threshold"),
        F.when(F.col("threshold") != 0, F.coalesce("calibrated", F.lit(False)))
        .otherwise(prior("calibrated", False)).alias("calibrated"))
    return asset_lookup(merged, "ip", assets, p).withColumnRenamed(
        "asset_criticality", "criticality")


def empty_hosts(deltas: DataFrame) -> DataFrame:
    return deltas.limit(0).select(
        "ip", "first_us", "last_us", "flows_out", "flows_in", "bytes_out", "bytes_in", "alerts",
        F.lit(0.0).alias("score_mean"), F.lit(0.0).alias("threshold"),
        F.lit(False).alias("calibrated"))


def host_table(verdicts: DataFrame, assets: DataFrame, p: Params = Params(),
               calibrated: bool = False) -> DataFrame:
    """All hosts of a batch, as one flush into an empty table."""
    deltas = host_rollup(verdicts, calibrated)
    return hosts_upsert(empty_hosts(deltas), deltas, assets, p)


def engine_stats(verdicts: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """One row for a run: totals, score range, alert rate and alerts by family."""
    alerts = lambda family: S.count_if(F.col("is_alert") & (F.col("family") == family))
    families = F.create_map(*[x for f, *_ in V.FAMILIES for x in (F.lit(f), alerts(f))])
    base = verdicts.agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"), S.count_if(F.col("is_alert")).alias("alerts"),
        S.count_if(F.col("suppressed")).alias("suppressed"),
        F.min("start_us").alias("_first"), F.max("end_us").alias("_last"),
        F.avg("score").alias("_mean"), F.max("score").alias("_max"), families.alias("_families"))
    if packets is not None:  # the packet clock and the packet counters
        seen = packets.agg(
            F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"),
            F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"))
        both = base.drop("packets", "bytes", "_first", "_last").unionByName(
            seen, allowMissingColumns=True)
        base = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    span = S.seconds(F.greatest(F.col("_last") - F.col("_first"), F.lit(0)))
    rate = F.when(span > 0, F.col("alerts") / (span / 3600.0)).otherwise(0.0)
    return base.select(
        "packets", "flows", "alerts", "bytes", F.round(span, 2).alias("span"),
        F.round("_mean", 4).alias("score_mean"), F.round("_max", 4).alias("score_max"),
        F.round(rate, 2).alias("alerts_per_hour"), "suppressed",
        F.map_filter("_families", lambda k, n: n > 0).alias("by_family"))
