"""Family classifier on labelled flows. MLlib's forest stands in for boosted trees."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom.functions import scalars as S
from packetloom.params import Params


def class_counts(flows: DataFrame, label: str = "label") -> DataFrame:
    return flows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_cap(flows: DataFrame, cap: int, seed: int = 0, label: str = "label",
              key: tuple[str, ...] = ("capture_id", "seq")) -> DataFrame:
    """At most ``cap`` rows per class, drawn by md5 of key and seed: the same rows on any cluster.

    Counts tell below which hash a class has its cap with room to spare. Only rows below it
    are ranked, so a class of any size costs a scan and no sort.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    drawn = flows.withColumn("_draw", F.md5(text))
    sizes = {r["label"]: r["n"] for r in class_counts(flows, label).collect()}  # one row per family
    room = {c: cap * (1 + 6 / math.sqrt(cap)) / n for c, n in sizes.items()}
    while True:
        below = F.lit(False)
        for c, share in room.items():
            edge = F.lit(f"{min(int(share * 16 ** 8), 16 ** 8 - 1):08x}")
            below = below | (F.col(label).eqNullSafe(F.lit(c)) & ((F.substring("_draw", 1, 8) <= edge) | F.lit(share >= 1)))
        few = drawn.where(below)
        found = {r["label"]: r["n"] for r in class_counts(few, label).collect()}
        short = [c for c, n in sizes.items() if found.get(c, 0) < min(cap, n)]
        if not short:
            break
        room |= {c: 2 * room[c] for c in short}  # an unlucky draw
    place = F.row_number().over(W.partitionBy(label).orderBy("_draw", *key))
    return few.withColumn("_place", place).where(F.col("_place") <= cap).drop("_place", "_draw")


def balanced_weights(flows: DataFrame, label: str = "label") -> DataFrame:
    """Row weight n / (classes * class size)."""
    counts = class_counts(flows, label)
    rows = {r["label"]: r["n"] for r in counts.collect()}  # one row per family
    total, k = sum(rows.values()), len(rows)
    table = F.create_map(*[F.lit(x) for c, n in rows.items() for x in (c, total / (k * n))])
    return flows.withColumn("weight", F.element_at(table, F.col(label)))


def classifier_fit(flows: DataFrame, vec: str = "vec", label: str = "label", trees: int = 40,
                   depth: int = 10, seed: int = 0) -> PipelineModel:
    ready = balanced_weights(flows, label).select(
        F.col(label).alias("label"), "weight",
        array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc"),
        RandomForestClassifier(
            labelCol="class", featuresCol="features", weightCol="weight", numTrees=trees,
            maxDepth=depth, seed=seed, probabilityCol="proba", predictionCol="best"),
    ]).fit(ready)


def classify(flows: DataFrame, model: PipelineModel, vec: str = "vec",
             p: Params = Params()) -> DataFrame:
    """Add ``raw_family`` and ``confidence``; families below the floor are UNKNOWN."""
    labels = model.stages[0].labels
    forest = model.stages[1]
    scored = forest.transform(
        flows.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))))
    proba = vector_to_array("proba")
    named = F.get(F.array(*[F.lit(x) for x in labels]), F.col("best").cast("int"))
    out = scored.withColumns({"confidence": F.array_max(proba), "_named": named})
    return out.withColumn(
        "raw_family", S.unknown_floor(F.col("_named"), F.col("confidence"), p)
    ).drop("features", "rawPrediction", "proba", "best", "_named")
