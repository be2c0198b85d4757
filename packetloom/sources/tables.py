"""Tables at rest: append, replace, and labelled datasets that know their features."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.session import scratch_path


@dataclass
class Batches:
    """A folder for each micro-batch. A batch that runs again overwrites its own folder.

    What a batch reads was written by the batches before it, so nothing half-written is seen.
    """

    spark: SparkSession
    path: str

    @classmethod
    def scratch(cls, spark: SparkSession, name: str) -> Batches:
        return cls(spark, scratch_path(spark, name))

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, before: int | None = None) -> DataFrame | None:
        """All batches, or those before one; None if there are none."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return None
        found = found.withColumn("batch", F.col("batch").cast("long"))
        return found if before is None else found.where(F.col("batch") < before)

    def last(self, before: int | None = None) -> DataFrame | None:
        """The newest batch: the state of a table that every batch writes whole."""
        found = self.read(before)
        newest = found.agg(F.max("batch")).first()[0] if found is not None else None
        return None if newest is None else found.where(F.col("batch") == newest).drop("batch")


_NOTE = "features"


def dataset_write(flows: DataFrame, path: str, features: tuple[str, ...]) -> None:
    """The feature list travels as column metadata inside the Parquet schema."""
    noted = F.col("label").alias("label", metadata={_NOTE: json.dumps(list(features))})
    others = [c for c in flows.columns if c != "label"]
    flows.select(noted, *others).write.parquet(path)


def dataset_read(spark: SparkSession, path: str, features: tuple[str, ...]) -> DataFrame:
    data = spark.read.parquet(path)
    stored = json.loads(data.schema["label"].metadata.get(_NOTE, "[]"))
    if tuple(stored) != tuple(features):
        raise ValueError(
            f"dataset has {len(stored)} features that differ from the {len(features)} expected")
    return data
