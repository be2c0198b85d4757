"""Detection quality: confusion counts, curves, latencies, class tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from packetloom import fixed_values as V
from packetloom.functions import scalars as S
from packetloom.operators.dims import family_info
from packetloom.operators.incidents import count_incidents
from packetloom.operators.prefix import Sum, prefix_scan
from packetloom.params import Params

LATENCY_SLOT_US = 60_000_000


def truth_join(flows: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdicts with the ground truth of their flows."""
    return verdicts.join(flows.select(*keys, F.col("label").alias("truth")), list(keys))


def _steps(df: DataFrame) -> DataFrame:
    """Distinct scores from high to low, with running positives and rows."""
    per = df.groupBy("score").agg(
        S.count_if(F.col("truth")).alias("pos"), F.count(F.lit(1)).alias("n"))
    # ranges of equally many scores, wherever on the axis they lie
    return prefix_scan(per, [F.col("score").desc()], tp=Sum(F.col("pos")), seen=Sum(F.col("n")))


def pr_curve(df: DataFrame) -> DataFrame:
    """(score, tp, seen, precision, recall) per distinct score. ``truth`` is boolean."""
    positives = df.agg(S.count_if(F.col("truth")).alias("positives")).first()["positives"]
    return _steps(df).select(
        "score", "tp", "seen", "pos", (F.col("tp") / F.col("seen")).alias("precision"),
        S.safe_div(F.col("tp"), F.lit(positives)).alias("recall"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of recall steps times precision; tied scores form one step."""
    steps = _steps(df)
    area = F.sum(F.col("pos") * F.col("tp") / F.col("seen"))
    return steps.agg(S.safe_div(area, F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Mann-Whitney form: ties count half. NULL when one class is missing."""
    neg = F.col("n") - F.col("pos")
    above = F.col("tp") - F.col("pos")  # positives scored strictly higher
    wins = F.sum(neg.cast("double") * (above + F.col("pos") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum(neg)
    return _steps(df).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def evaluate(verdicts: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1. Needs label and is_alert."""
    attack, alert = F.col("label") != V.BENIGN, F.col("is_alert")
    counts = verdicts.agg(
        S.count_if(alert & attack).alias("tp"), S.count_if(alert & ~attack).alias("fp"),
        S.count_if(~alert & attack).alias("fn"), S.count_if(~alert & ~attack).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = S.safe_div(tp, tp + fp), S.safe_div(tp, tp + fn)
    return counts.withColumns({
        "precision": precision, "recall": recall,
        "f1": S.safe_div(2.0 * tp, 2 * tp + fp + fn)})


def benign_rates(verdicts: DataFrame, p: Params = Params()) -> DataFrame:
    """Means over benign captures: alerts and incidents per hour, alert share, flow count."""
    # the clock starts with the flow exported first
    opened_us = F.min_by("start_us", F.struct("export_us", "end_us", "seq"))
    span = S.seconds(F.greatest(F.max("end_us") - opened_us, F.lit(0)))
    per = verdicts.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("flows"), S.count_if(F.col("is_alert")).alias("alerts"),
        span.alias("span"))
    opened = count_incidents(verdicts, ("capture_id",), p)
    joined = per.join(opened, "capture_id", "left")
    hourly = lambda c: F.when(F.col("span") > 0, c / (F.col("span") / 3600.0)).otherwise(0.0)
    return joined.agg(
        F.sum("flows").alias("benign_flows"),
        F.avg(hourly(F.col("alerts"))).alias("alerts_per_hour"),
        F.avg(hourly(F.coalesce("incidents", F.lit(0)))).alias("incidents_per_hour"),
        F.avg(F.col("alerts") / F.col("flows")).alias("fp_rate"))


def hosts_raised(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(
        S.count_if(F.col("calibrated") & F.col("raised")).alias("hosts_raised"))


def attack_window_latency(verdicts: DataFrame, windows: DataFrame) -> DataFrame:
    """Seconds from each attack's start to its family's first alert in that capture."""
    firsts = (verdicts.where(F.col("is_alert") & (F.col("label") != V.BENIGN))
              .groupBy("capture_id", F.col("label").alias("family"))
              .agg(F.min("export_us").alias("first_us")))
    return (windows.join(firsts, ["capture_id", "family"])
            .where(F.col("first_us") >= F.col("start_us"))
            .select("capture_id", "family", "start_us",
                    S.seconds(F.col("first_us") - F.col("start_us")).alias("latency_s")))


def attack_window_latency_each(verdicts: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: its own first alert between start and end.

    Alerts and windows meet in slots of time, so that an alert only sees the windows around it.
    """
    slot = lambda c: F.floor(F.col(c) / F.lit(LATENCY_SLOT_US))
    alerts = verdicts.where(F.col("is_alert") & (F.col("label") != V.BENIGN)).select(
        "capture_id", F.col("label").alias("family"), "export_us", slot("export_us").alias("_slot"))
    spread = windows.withColumn("_slot", F.explode(F.sequence(slot("start_us"), slot("end_us"))))
    inside = F.col("export_us").between(F.col("start_us"), F.col("end_us"))
    return (spread.join(alerts, ["capture_id", "family", "_slot"]).where(inside)
            .groupBy("capture_id", "family", "start_us")
            .agg((S.seconds(F.min("export_us") - F.first("start_us"))).alias("latency_s")))


def latency_summary(latencies: DataFrame) -> DataFrame:
    """p50 and p95 over attack windows (there are few: one row per window)."""
    at = F.percentile("latency_s", F.array(F.lit(0.5), F.lit(0.95)))
    return latencies.agg(at.alias("q"), F.count(F.lit(1)).alias("n")).select(
        "n", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def family_latency(latencies: DataFrame) -> DataFrame:
    return latencies.groupBy("family").agg(
        F.round(F.percentile("latency_s", F.lit(0.5)), 2).alias("median_s"),
        F.count(F.lit(1)).alias("n"))


def family_recall(verdicts: DataFrame) -> DataFrame:
    attack = verdicts.where(F.col("label") != V.BENIGN)
    return attack.groupBy(F.col("label").alias("family")).agg(
        S.count_if(F.col("is_alert")).alias("hits"), F.count(F.lit(1)).alias("support"),
    ).withColumn("recall", F.round(F.col("hits") / F.col("support"), 4))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every family seen as truth or prediction of attacks."""
    predictions = predictions.where(F.col("truth") != V.BENIGN)
    listed = F.col("label").isin(*V.ATTACK_FAMILIES)
    hit = (F.col("truth") == F.col("predicted")).cast("long")
    pairs = predictions.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("named"), (F.col("n") * hit).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("named"), F.lit(0).cast("long").alias("hits")))).alias("e")
    ).select("e.*")
    per = sides.where(listed).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "named", "hits")])
    precision = S.safe_div(F.col("hits"), F.col("named"))
    recall = S.safe_div(F.col("hits"), F.col("support"))
    f1 = S.safe_div(2.0 * F.col("hits"), F.col("support") + F.col("named"))
    return per.select("label", precision.alias("precision"), recall.alias("recall"),
                      f1.alias("f1"), "support")


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Attacks by predicted over the fixed label list, absent rows included as zeros."""
    predictions = predictions.where(F.col("truth") != V.BENIGN)
    labels = [*V.ATTACK_FAMILIES, V.UNKNOWN, V.BENIGN]
    spark = predictions.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], "truth string")  # fixed list
    counted = predictions.groupBy("truth").pivot("predicted", labels).agg(F.count(F.lit(1)))
    return F.broadcast(every).join(counted, "truth", "left").na.fill(0)


def confusion_shares(matrix: DataFrame) -> DataFrame:
    labels = [c for c in matrix.columns if c != "truth"]
    total = sum((F.col(c) for c in labels), F.lit(0))
    return matrix.select("truth", *[S.safe_div(F.col(c), total).alias(c) for c in labels])


def benchmark_table(loud: DataFrame, stealth: DataFrame) -> DataFrame:
    """Family by recall, loud and stealth, with technique and support."""
    other = stealth.select("family", F.col("recall").alias("recall_stealth"))
    joined = family_info(loud).join(other, "family", "left")
    return joined.select(
        "family", F.col("mitre_technique").alias("technique"),
        F.col("recall").alias("recall_loud"),
        F.coalesce("recall_stealth", F.lit(0.0)).alias("recall_stealth"), "support")


def replay_phases(benign: DataFrame, mixed: DataFrame) -> DataFrame:
    """Warm-up rows before the mixed capture, so that both share one host state."""
    return benign.withColumn("phase", F.lit(0)).unionByName(mixed.withColumn("phase", F.lit(1)))
