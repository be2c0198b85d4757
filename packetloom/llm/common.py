"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import scratch_path

#: A key with at least one in HEAVY of all rows is joined by broadcast: there are at most HEAVY such keys.
HEAVY = 1000
#: Rows of a few numbers each that may be broadcast; about 2 MB.
BROADCAST_ROWS = 50_000
#: Rows of a few numbers each in a file of a stored table, at least, if each core has one to write.
FILE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a query as soon as it has ended; they are not needed once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cleaned_up(spark: SparkSession):
    return setting(spark, CLEANUP, "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    with cleaned_up(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows, in no more partitions than are worth a file each, before it is stored.

    Shuffles follow the size of the input, and where their result is small a file for each of their partitions takes
    longer than the rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def lookup(rows: DataFrame, facts: DataFrame, key: str, size: Column, total: int) -> DataFrame:
    """Inner join of rows to facts, which has one row per key; size(facts) counts the rows of a key.

    Keys with a large share of all rows are few, so their facts are broadcast; what is left
    holds no hot key and is joined by shuffle.
    """
    hot = size * HEAVY >= F.lit(total)
    few = F.broadcast(facts.filter(hot))
    rest = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(
        rest.join(facts.filter(~hot).hint("merge"), key))


def small(rows: DataFrame) -> DataFrame:
    """Rows of a stored table, for a broadcast if they are few and for a shuffle join if not."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def nested(docs: DataFrame) -> DataFrame:
    """All columns as one, row, so that names of ours meet none of theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for those of gone (id, hash of the text), a stored table."""
    return nested(docs).join(small(gone), _same(), "left_anti").select("row.*")


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return nested(docs).join(small(kept), _same(), "left_semi").select("row.*")


def _same() -> Column:
    return F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
