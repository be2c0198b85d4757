"""Session settings and durable scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("packetloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # keep all cores busy on small local inputs
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder the cluster names; a local one only if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="packetloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="packetloom-")) / "packetloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in root.rglob("*.py"):
            z.write(f, f"packetloom/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    # the driver's own streaming worker does not look at shipped files, only at this path
    path = spark.sparkContext.environment.get("PYTHONPATH")
    spark.sparkContext.environment["PYTHONPATH"] = (
        f"{root.parent}{os.pathsep}{path}" if path else str(root.parent))
    _SHIPPED.add(app)
