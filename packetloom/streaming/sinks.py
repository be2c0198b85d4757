"""Stream sinks: rollups per tick, host and incident tables kept by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.functions import scalars as S
from packetloom.operators import incidents as I, rollups as RU
from packetloom.params import SECOND, Params
from packetloom.session import scratch_path
from packetloom.sources.tables import Batches
from packetloom.streaming.flow_stream import flow_stream


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def late_rows(progress: list) -> int:
    """Rows that came after the watermark had passed them and were dropped."""
    return sum(state.numRowsDroppedByWatermark for p in progress for state in p.stateOperators)


def run_to_end(df: DataFrame, name: str, sink: Callable | None = None,
               mode: str = "append", counts: dict[str, int] | None = None) -> str:
    """Drain what has landed and stop; returns the output path. ``counts`` gets the late rows."""
    # keyed state with timers needs this store; the session default does not offer them
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = scratch_path(df.sparkSession, name)
    writer = df.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if sink is None:
        writer = writer.format("parquet").option("path", out).outputMode(mode)
    else:
        writer = writer.foreachBatch(sink).outputMode("append")
    query = writer.start()
    query.awaitTermination()
    if counts is not None:
        counts["late"] = late_rows(query.recentProgress)
    return out


def buckets_stream(verdicts: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Per-second rollup on event time; a second is emitted once the watermark passes it."""
    second = F.window("ts", "1 second")
    return verdicts.withWatermark("ts", lateness).groupBy(second).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"), S.count_if(F.col("is_alert")).alias("alerts"),
        F.avg("score").alias("score_mean"), F.max("score").alias("score_max"),
        F.avg("threshold").alias("threshold_mean"),
    ).select(F.col("window.start").alias("ts"), "flows", "packets", "bytes", "alerts",
             "score_mean", "score_max", "threshold_mean")


def incident_session_stream(alerts: DataFrame, p: Params = Params(),
                            lateness: str | None = "10 seconds", at: str | None = None) -> DataFrame:
    """Incidents as session windows per dedup key; a gap of exactly the limit still merges.

    ``lateness`` None: ``ts`` has the watermark of the operator before. ``at`` is a column of
    microseconds that incidents take their times from instead of ``ts``.
    """
    keyed = alerts.withColumn("dedup_key", S.dedup_key())
    keyed = keyed.withWatermark("ts", lateness) if lateness else keyed
    seen = F.timestamp_micros(at) if at else F.col("ts")
    session = F.session_window("ts", f"{p.dedup_s} seconds")
    keys = [*I.capture_keys(alerts), "dedup_key"]
    first = F.min(F.struct(F.unix_micros(seen).alias("at"), "seq"))
    return keyed.groupBy(*keys, session).agg(
        F.count(F.lit(1)).alias("occurrences"), first.alias("head"),
        F.max("score").alias("score_max"), F.sum("bytes").alias("total_bytes"),
        F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
    ).withColumn("incident_id", S.incident_id(
        *[F.col(c) for c in keys], F.col("head.at"), F.col("head.seq")),
    ).select("incident_id", *keys, "occurrences", "score_max", "total_bytes",
             "first_seen", "last_seen")


def packets_to_incidents_stream(packets: DataFrame, alerts_of: Callable[[DataFrame], DataFrame],
                                p: Params = Params(), lateness: str = "10 seconds") -> DataFrame:
    """Packets to incidents in one query: flows by keyed state, alerts, incidents by session windows.

    Flows hand their event time and watermark on, so an incident is final once no packet can bring a
    flow into it any more. ``alerts_of`` picks and scores alerts from flows row by row and keeps ``ts``.
    """
    alerts = alerts_of(flow_stream(packets, p, lateness))
    return incident_session_stream(alerts, p, lateness=None, at="at_us")


class HostSink:
    """Sum-merges each micro-batch into the host table; each batch writes the table after it."""

    def __init__(self, spark: SparkSession, assets: DataFrame, p: Params = Params()):
        self.assets, self.p = assets, p
        self.table = Batches.scratch(spark, "hosts")

    def __call__(self, batch: DataFrame, number: int) -> None:
        deltas = RU.host_rollup(batch)
        current = self.table.last(before=number)
        current = RU.empty_hosts(deltas) if current is None else current.drop("asset_name", "criticality")
        self.table.write(RU.hosts_upsert(current, deltas, self.assets, self.p), number)


class TickSink:
    """One summary row per micro-batch: what came in, running totals and open incidents."""

    def __init__(self, spark: SparkSession, p: Params = Params()):
        self.p = p
        self.ticks = Batches.scratch(spark, "ticks")
        self.open = Batches.scratch(spark, "open")

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("at_us")).first()[0]
        if now is None:
            return
        keys = [*I.capture_keys(batch), "dedup_key"]
        keyed = batch.where("is_alert").withColumn("dedup_key", S.dedup_key())
        heads = keyed.groupBy(*keys).agg(F.max("at_us").alias("last_us"))
        before = self.open.last(before=number)
        if before is not None:
            heads = heads.unionByName(before).groupBy(*keys).agg(F.max("last_us").alias("last_us"))
        # incidents whose gap has passed leave the open set
        self.open.write(heads.where(F.col("last_us") >= now - self.p.dedup_s * SECOND), number)
        opened = self.open.last().count()
        row = batch.agg(
            F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"),
            F.sum("bytes").alias("bytes"), S.count_if(F.col("is_alert")).alias("alerts"),
            F.avg("score").alias("score_mean"), F.max("score").alias("score_max"),
            F.avg("threshold").alias("threshold_mean"))
        prior = self.ticks.read(before=number)
        past = prior.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in
                           ("flows", "alerts")]).first() if prior is not None else (0, 0)
        self.ticks.write(row.withColumns({
            "at_us": F.lit(now), "touched": F.lit(keyed.select(*keys).distinct().count()),
            "open_incidents": F.lit(opened).cast("long"),
            "flows_total": F.col("flows") + F.lit(past[0]),
            "alerts_total": F.col("alerts") + F.lit(past[1])}), number)


class IncidentSink:
    """Appends each batch's alerts and recomputes the incidents of the keys that it touched."""

    def __init__(self, spark: SparkSession, assets: DataFrame, p: Params = Params()):
        self.assets, self.p = assets, p
        self.alerts = Batches.scratch(spark, "alerts")
        self.incidents = Batches.scratch(spark, "incidents")

    def __call__(self, batch: DataFrame, number: int) -> None:
        keys = [*I.capture_keys(batch), "dedup_key"]
        self.alerts.write(batch.where("is_alert").withColumn("dedup_key", S.dedup_key()), number)
        stored = self.alerts.read(before=number + 1)
        touched = stored.where(F.col("batch") == number).select(*keys).distinct()
        fresh = I.build_incidents(
            stored.join(touched, keys, "left_semi").drop("dedup_key", "batch"), self.assets, self.p)
        current = self.incidents.last(before=number)
        self.incidents.write(
            fresh if current is None else I.incidents_upsert(current, fresh, touched), number)
