"""The smallest complete run: packets to flows to alerts to prioritised incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom import fixed_values as V
from packetloom.operators import classify as C, detect as D
from packetloom.operators.assembly import assemble_flows
from packetloom.operators.datasets import flow_dataset
from packetloom.operators.dims import default_assets
from packetloom.operators.incidents import build_incidents
from packetloom.functions import scalars as S
from packetloom.params import Params
from packetloom.plans.views import packet_view
from packetloom.session import materialise


def rule_alerts(flows: DataFrame, p: Params = Params()) -> DataFrame:
    """A fixed rule on volume in place of the trained detector."""
    total = F.col("total_bytes")
    return flows.select(
        "capture_id", F.col("flow_id").alias("seq"), "src", "dst", "sport", "dport", "proto", "start_us",
        "end_us", F.col("export_us").alias("at_us"), "label",
        F.when(F.col("label") == V.BENIGN, V.UNKNOWN).otherwise(F.col("label")).alias("family"),
        (total / (total + 20.0)).alias("score"), F.lit(p.base_threshold).alias("threshold"),
        F.lit(0.5).alias("confidence"), F.col("total_packets").cast("long").alias("packets"),
        total.cast("long").alias("bytes"), *[c for c in ("ts",) if c in flows.columns],
    ).where(F.col("score") >= F.col("threshold"))


def packets_to_incidents(spark: SparkSession, sf_dir: str, p: Params = Params()) -> DataFrame:
    flows = assemble_flows(packet_view(spark, sf_dir), p)
    alerts = materialise(rule_alerts(flows, p), "alerts")
    incidents = build_incidents(alerts, default_assets(spark), p)
    return incidents.select(
        "id", "dedup_key", "family", "occurrences", "priority", "severity",
        F.unix_micros("first_seen").alias("first_seen"),
        F.unix_micros("last_seen").alias("last_seen"), "total_bytes", "distinct_dports",
        F.round("score_max", 6).alias("score_max")).orderBy(F.desc("priority"), "id")


ORDER = ["export_us", "end_us", "seq"]


def detector_input(flows: DataFrame) -> DataFrame:
    """Flows of ``flow_dataset`` in the columns that fitting, scoring and correlation want."""
    return flows.withColumns({
        "id": F.col("flow_id"), "seq": F.col("flow_id"), "at_us": F.col("export_us"),
        "packets": F.col("total_packets").cast("long"), "bytes": F.col("total_bytes").cast("long")})


def fit_detector(flows: DataFrame, p: Params = Params(), trees: int = 220, sample: int = 4096) -> D.Detector:
    """Forest on benign flows and family classifier on capped labelled ones, all features."""
    model = D.fit_anomaly(flows.where(F.col("label") == V.BENIGN), V.FEATURES, trees, sample)
    capped = C.class_cap(flows, p.class_cap)
    model.classifier = C.classifier_fit(capped.withColumn("vec", S.vectorize(V.FEATURES)))
    return model


def packets_to_verdicts(packets: DataFrame, p: Params = Params(), trees: int = 220,
                        sample: int = 4096) -> DataFrame:
    """Packets to flows with 52 features, scores, families and judgements by each host's threshold."""
    flows = materialise(detector_input(flow_dataset(packets, p)), "flows")
    return D.score_flows(flows, fit_detector(flows, p, trees, sample), ORDER, p)


def verdict_incidents(verdicts: DataFrame, p: Params = Params()) -> DataFrame:
    alerts = materialise(verdicts.where("is_alert"), "alerts")
    return build_incidents(alerts, default_assets(verdicts.sparkSession), p)
