"""The detector: fitted parts in one object, flows to verdicts, save and load."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom import fixed_values as V
from packetloom.functions import scalars as S
from packetloom.operators import anomaly as A
from packetloom.operators.classify import classifier_fit, classify
from packetloom.operators.threshold import adaptive_threshold, with_veto
from packetloom.params import Params
from packetloom.session import materialise


@dataclass
class Detector:
    features: tuple[str, ...]
    trees: DataFrame
    grid: DataFrame
    scaling: DataFrame          # feature, median, scale
    classifier: PipelineModel | None = None

    def parts(self) -> tuple[A.Forest, list[float], list[float]]:
        return (A.load_forest(self.trees),
                A.in_order(self.scaling, self.features, "median"),
                A.in_order(self.scaling, self.features, "scale"))


def fit_anomaly(benign: DataFrame, names: tuple[str, ...] = V.FEATURES, trees: int = 220,
                sample: int = 4096, seed: int = 0) -> Detector:
    """Scale, forest and calibration from benign flows (columns: id and the features)."""
    scaling = materialise(A.robust_fit(benign, names), "scaling")
    medians = A.in_order(scaling, names, "median")
    scales = A.in_order(scaling, names, "scale")
    vectors = materialise(benign.select(
        "id", A.robust_scale(S.vectorize(names), medians, scales).alias("vec")), "vectors")
    trees_table = materialise(A.iforest_fit(vectors, trees, sample, seed), "trees")
    forest = A.load_forest(trees_table)
    raw = materialise(
        vectors.select(A.iforest_score(forest, vectors)("vec").alias("raw")), "raw")
    grid = materialise(A.ecdf_fit(raw, "raw"), "grid")
    return Detector(names, trees_table, grid, scaling)


def anomaly_scores(flows: DataFrame, model: Detector) -> DataFrame:
    """Add ``vec`` (unscaled), ``scaled``, ``raw`` and calibrated ``score``."""
    forest, medians, scales = model.parts()
    with_vec = flows.withColumn("vec", S.vectorize(model.features))
    scaled = with_vec.withColumn("scaled", A.robust_scale(F.col("vec"), medians, scales))
    raw = scaled.withColumn("raw", A.iforest_score(forest, flows)("scaled"))
    return raw.withColumn("score", A.calibrate_score(model.grid)("raw"))


def score_flows(flows: DataFrame, model: Detector, order: list[str], p: Params = Params(),
                keys: tuple[str, ...] = ("capture_id", "src")) -> DataFrame:
    """Flows to verdicts: score, family, per-host threshold with the veto inside the fold."""
    scored = anomaly_scores(flows, model)
    if model.classifier is not None:
        scored = classify(scored, model.classifier, "vec", p)
    else:
        scored = scored.withColumns({
            "raw_family": F.lit(V.UNKNOWN), "confidence": F.lit(0.0)})
    # scored once, then read by both the fold and the join back
    kept = materialise(scored.drop("scaled"), "scored")
    identity = list(dict.fromkeys([*keys, "capture_id", *order, "score"]))
    slim = with_veto(kept.withColumnRenamed("raw_family", "family"), p).select(*identity, "veto")
    judged = adaptive_threshold(slim, order, p, keys).select(
        "capture_id", *[c for c in order if c != "capture_id"],
        "threshold", "is_alert", "suppressed")
    on = ["capture_id", *[c for c in order if c != "capture_id"]]
    return kept.join(judged, on).withColumn(
        "family", F.when(F.col("is_alert"), F.col("raw_family")).otherwise(V.BENIGN))


def explained(alerts: DataFrame, model: Detector, p: Params = Params()) -> DataFrame:
    """Contributions for the given alerts (choose them with ``explain_budget`` first)."""
    forest, medians, scales = model.parts()
    scaled = A.robust_scale(F.col("vec"), medians, scales)
    prepared = alerts.withColumn("_scaled", scaled)
    zeros = [0.0] * len(medians)  # the median of a centred feature
    return A.explain(
        prepared, A.occluded_scores(forest, zeros, alerts)("_scaled"), F.col("raw"),
        F.col("vec"), medians, model.features, p.explain_top).drop("_scaled")


def model_save(model: Detector, path: str) -> None:
    spark = model.trees.sparkSession
    meta = {"format": V.MODEL_FORMAT, "features": list(model.features),
            "classifier": model.classifier is not None}
    model.trees.write.mode("overwrite").parquet(f"{path}/trees")
    model.grid.write.mode("overwrite").parquet(f"{path}/grid")
    model.scaling.write.mode("overwrite").parquet(f"{path}/scaling")
    if model.classifier is not None:
        model.classifier.write().overwrite().save(f"{path}/classifier")
    # written last: a half-written model has no metadata and does not load
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/meta")


def model_load(spark: SparkSession, path: str,
               features: tuple[str, ...] = V.FEATURES) -> Detector:
    meta = json.loads(spark.read.schema("meta string").parquet(f"{path}/meta").first()["meta"])
    if meta["format"] != V.MODEL_FORMAT:
        raise ValueError(f"model format {meta['format']}, expected {V.MODEL_FORMAT}")
    if tuple(meta["features"]) != tuple(features):
        raise ValueError("model was fitted on a different feature list")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Detector(tuple(features), read("trees"), read("grid"), read("scaling"),
                    PipelineModel.load(f"{path}/classifier") if meta["classifier"] else None)


def train(benign: DataFrame, labelled: DataFrame, p: Params = Params(), trees: int = 220,
          names: tuple[str, ...] = V.FEATURES, seed: int = 0) -> Detector:
    """Anomaly stage on benign flows, classifier on capped labelled flows."""
    from packetloom.operators.classify import class_cap

    model = fit_anomaly(benign, names, trees, seed=seed)
    capped = class_cap(labelled, p.class_cap, seed)
    model.classifier = classifier_fit(
        capped.withColumn("vec", S.vectorize(names)), seed=seed)
    return model
