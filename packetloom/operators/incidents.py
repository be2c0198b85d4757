"""Alerts to incidents: sessions per dedup key, then one aggregate per session.

Alerts carry: seq, at_us (the incident clock), src, dst, sport, dport, proto, family,
score, threshold, confidence, label, packets, bytes, and optionally contributions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom import fixed_values as V
from packetloom import schemas
from packetloom.functions import scalars as S
from packetloom.operators.dims import asset_lookup, family_info
from packetloom.operators.slices import (
    PrevMax, has_group_over, running, time_slice, top_per_key,
)
from packetloom.params import SECOND, Params

AT = ["at_us", "seq"]


def capture_keys(alerts: DataFrame) -> tuple[str, ...]:
    return ("capture_id",) if "capture_id" in alerts.columns else ()


def incident_sessions(alerts: DataFrame, p: Params = Params(), keys: tuple[str, ...] = (),
                      at: str = "at_us") -> DataFrame:
    """Add ``dedup_key`` and ``incident_id`` (a hash of capture, key and first alert).

    Alerts of different captures never meet in a session.

    A slice no wider than the gap cannot contain a break, so sessions are found on one
    summary row per key and slice; no key is ever walked alert by alert.
    """
    keys = keys or capture_keys(alerts)
    gap = p.dedup_s * SECOND
    keyed = alerts.withColumn("dedup_key", S.dedup_key()).withColumn(
        "_slice", time_slice(F.col(at), gap))
    group = [*keys, "dedup_key"]
    slices = keyed.groupBy(*group, "_slice").agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"),
        F.min(F.struct(F.col(at).alias("at"), "seq")).alias("head"))
    w = W.partitionBy(*group).orderBy("_slice")
    opens = F.lag("hi").over(w).isNull() | (F.col("lo") - F.lag("hi").over(w) > gap)
    named = slices.withColumn("_opens", opens).withColumn(
        "incident_id", F.last(F.when(F.col("_opens"), F.col("head")), ignorenulls=True).over(w)
    ).select(*group, "_slice", S.incident_id(
        *[F.col(c) for c in group], F.col("incident_id.at"), F.col("incident_id.seq")).alias("incident_id"))
    return keyed.join(named, [*group, "_slice"]).drop("_slice")


def incident_aggregate(sessions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    first = F.struct(*AT)
    opening = lambda c: F.min_by(c, first).alias(c)
    return sessions.groupBy(*keys, "incident_id").agg(
        F.first("dedup_key").alias("dedup_key"), F.first("family").alias("family"),
        *[F.first(c).alias(c) for c in capture_keys(sessions) if c not in keys],
        *[opening(c) for c in ("src", "dst", "dport", "proto")], F.min_by("seq", first).alias("first_seq"),
        F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"),
        F.count(F.lit(1)).alias("occurrences"),
        F.max("score").alias("score_max"), F.avg("score").alias("score_mean"),
        F.sum("bytes").alias("total_bytes"), F.sum("packets").alias("total_packets"),
        F.countDistinct("dport").alias("distinct_dports"),
        F.countDistinct(S.incident_peer()).alias("distinct_peers"),
    )


def _peak() -> Column:
    # highest score, the earliest of equals
    return F.struct("score", (-F.col("at_us")).alias("a"), (-F.col("seq")).alias("b"))


def incident_records(sessions: DataFrame, p: Params = Params(),
                     keys: tuple[str, ...] = ()) -> DataFrame:
    """The opening alert of each incident and those that raised its maximum score."""
    by = [*keys, "incident_id"]
    busy = has_group_over(sessions, by, p.group_rows)
    part = time_slice(F.col("at_us"), p.dedup_s * SECOND) if busy else None
    ranked = running(sessions, by, AT, part, _best=PrevMax(F.col("score")))
    return ranked.where(F.col("_best").isNull() | (F.col("score") > F.col("_best"))).drop("_best")


def incident_peak(sessions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Threshold of the strictly highest alert."""
    return sessions.groupBy(*keys, "incident_id").agg(
        F.max_by("threshold", _peak()).alias("threshold"))


def incident_confidence(sessions: DataFrame, p: Params = Params(),
                        keys: tuple[str, ...] = ()) -> DataFrame:
    """Largest confidence among record alerts, and the contributions of the last explained one."""
    records = incident_records(sessions, p, keys)
    aggs = [F.max("confidence").alias("confidence")]
    if "contributions" in sessions.columns:
        aggs.append(F.max_by(
            "contributions", F.when(F.size("contributions") > 0, _peak())).alias("contributions"))
    return records.groupBy(*keys, "incident_id").agg(*aggs)


def incident_criticality(incidents: DataFrame, assets: DataFrame,
                         p: Params = Params()) -> DataFrame:
    """Asset of the first alert's destination; criticality never below the family's."""
    looked = family_info(asset_lookup(incidents, "dst", assets, p))
    return looked.withColumn(
        "criticality", F.greatest("asset_criticality", "default_criticality")
    ).drop("asset_criticality", "default_criticality")


def incident_truth(sessions: DataFrame, key: str = "incident_id") -> DataFrame:
    return (sessions.where(F.col("label").isNotNull() & (F.col("label") != ""))
            .groupBy(key, F.col("label").alias("truth")).agg(F.count(F.lit(1)).alias("n")))


def graded(incidents: DataFrame) -> DataFrame:
    """Add priority and severity."""
    margin = S.incident_margin(F.col("score_max"), F.col("threshold"))
    return incidents.withColumn("priority", S.incident_priority(
        margin, F.col("criticality"), F.col("confidence"), F.col("occurrences"),
    )).withColumn("severity", S.incident_severity(F.col("priority")))


def build_incidents(alerts: DataFrame, assets: DataFrame, p: Params = Params(),
                    with_truth: bool = False, at: str = "at_us") -> DataFrame:
    """Alerts to complete incident rows. ``at`` is the clock of the session gap."""
    sessions = incident_sessions(alerts, p, at=at)
    base = (incident_aggregate(sessions)
            .join(incident_peak(sessions), "incident_id")
            .join(incident_confidence(sessions, p), "incident_id"))
    if with_truth:
        tally = incident_truth(sessions).groupBy("incident_id").agg(  # one entry per family
            F.map_from_entries(F.collect_list(F.struct("truth", "n"))).alias("truth"))
        base = base.join(tally, "incident_id", "left")
    rows = graded(incident_criticality(base, assets, p))
    return rows.withColumnRenamed("incident_id", "id").withColumns({
        "first_seen": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us"),
        "status": F.lit("NEW"), "assignee": F.lit(None).cast("string"),
        "verdict": F.lit(None).cast("string"), "note": F.lit(None).cast("string"),
        "closed_at": F.lit(None).cast("timestamp"),
    }).drop("first_us", "last_us")


def incident_payload(incidents: DataFrame) -> DataFrame:
    """Display projection: four digits, family title."""
    r4 = lambda c: F.round(c, 4).alias(c)
    titled = incidents if "family_title" in incidents.columns else family_info(incidents)
    return titled.select(
        "id", "family", "family_title", "src", "dst", "dport", "proto", "first_seen", "last_seen",
        "occurrences", r4("score_max"), r4("score_mean"), r4("threshold"), r4("confidence"),
        "severity", "priority", "criticality", "asset_name", "status", "assignee", "verdict",
        "note", "mitre_technique", "mitre_tactic", "total_bytes", "total_packets",
        "distinct_dports", "distinct_peers")


def alert_rows(sessions: DataFrame) -> DataFrame:
    """Alerts as they are stored, one row per alert with its incident."""
    score, thr = F.col("score"), F.col("threshold")
    truth = F.when(F.col("label") != "", F.col("label"))
    contributions = (F.col("contributions") if "contributions" in sessions.columns
                     else F.array().cast(schemas.CONTRIBUTIONS))
    return sessions.select(
        "incident_id", "seq", F.timestamp_micros("at_us").alias("ts"),
        S.seconds(F.col("start_us")).alias("flow_start"),
        S.seconds(F.col("end_us")).alias("flow_end"),
        "src", "sport", "dst", "dport", "proto", "score", "threshold", "family", "confidence",
        S.verdict_severity(score, thr, F.lit(True)).alias("severity"),
        "packets", "bytes",
        S.seconds(F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))).alias("duration"),
        truth.alias("truth"), contributions.alias("contributions"))


def alerts_append_capped(sessions: DataFrame, p: Params = Params(),
                         at: str = "at_us") -> DataFrame:
    """The first alerts of each incident, up to the storage cap, if there is one."""
    if p.alerts_per_incident is None:
        return sessions
    return top_per_key(sessions, ["incident_id"], [F.col(at), F.col("seq")],
                       p.alerts_per_incident, ["seq"])


def alerts_dropped(sessions: DataFrame, p: Params = Params()) -> DataFrame:
    over = F.count(F.lit(1)) - p.alerts_per_incident if p.alerts_per_incident is not None else F.lit(0)
    return sessions.groupBy("incident_id").agg(
        F.greatest(over, F.lit(0)).cast("long").alias("dropped"))


def count_incidents(verdicts: DataFrame, keys: tuple[str, ...] = (), p: Params = Params(),
                    at: str = "end_us") -> DataFrame:
    """Incidents opened by the alerts of a verdict list."""
    sessions = incident_sessions(verdicts.where("is_alert"), p, keys, at)
    distinct = sessions.select(*keys, "incident_id").distinct()
    return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("incidents"))


# stored state

def incidents_upsert(current: DataFrame, touched: DataFrame,
                     whole: DataFrame | None = None) -> DataFrame:
    """Latest state per incident; analyst columns survive the update.

    ``whole`` names dedup keys (and captures) all of whose incidents are in ``touched``: what
    ``current`` has of them besides was absorbed by another incident and goes.
    """
    kept = current.select("id", *[F.col(c).alias(f"_{c}") for c in
                                  ("status", "assignee", "verdict", "note", "closed_at")])
    updated = touched.join(kept, "id", "left").withColumns({
        c: F.coalesce(f"_{c}", c) for c in ("status", "assignee", "verdict", "note", "closed_at")
    }).select(*current.columns)
    left = current.join(touched.select("id"), "id", "left_anti")
    if whole is not None:
        left = left.join(whole, whole.columns, "left_anti")
    return left.select(*current.columns).unionByName(updated)
