"""Typed scans of normalised packets, at rest and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom import schemas
from packetloom.session import scratch_path


def packets_scan(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Declared schema; filters and columns reach the files."""
    return spark.read.schema(schemas.PACKETS).format(kind).load(path)


def packets_stream(spark: SparkSession, path: str, kind: str = "parquet",
                   files_per_trigger: int = 64) -> DataFrame:
    """Packets landing as files. A message bus gives the same schema and plan."""
    return (spark.readStream.schema(schemas.PACKETS).format(kind)
            .option("maxFilesPerTrigger", files_per_trigger).load(path)
            .withColumn("ts", F.timestamp_micros("ts_us")))


def write_packets(packets: DataFrame, path: str | None = None) -> str:
    path = path or scratch_path(packets.sparkSession, "packets")
    packets.select(*schemas.PACKETS.names).write.parquet(path)
    return path
