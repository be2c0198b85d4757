"""Exact dedup against a persistent digest index.

The index is a table of one row per normalised text, bucketed and sorted by the digest. A
batch of documents is reduced to one row per digest, the digests that the index has are
taken off by a sort-merge anti-join on the buckets, and the rest is appended as a partition
of its own. A batch that is run again replaces its own partition, so a failed run is repeated
as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import lookup, nested, partitions, stored, table
from packetloom.session import scratch_path

WHITE = r"[\x20\x09-\x0D]+"


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, ""), 256)


class DigestIndex:
    """Digests of all texts seen so far, with the document that stays for each.

    `path` is where it lies, `exists` whether an earlier session made it; the bucket count is
    fixed when it is made and should follow the size it is meant to grow to.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint",
                 exists: bool = False):
        self.spark, self.name = spark, f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id {id_type}, keep_chars INT, "
            f"batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (text_sha256) "
            f"SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'")
        if exists:
            spark.catalog.recoverPartitions(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, winners: DataFrame, batch: str) -> None:
        """Append the digests of winners (text_sha256, keep_id, keep_chars) that are new.

        The batch is one partition, so that running it again replaces what a failed run left.
        """
        known = self.rows().filter(F.col("batch") != batch).hint("merge")
        fresh = stored(winners.join(known, "text_sha256", "left_anti").select(
            "text_sha256", "keep_id", "keep_chars"), "fresh")
        fresh.createOrReplaceTempView(view := f"fresh_{uuid.uuid4().hex}")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch='{batch}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Deduplicate a batch of documents (doc_id, text) and add it to the index.

    One row per document: doc_id, keep_id (the document that stays for its text, of an earlier
    batch if the index had the text), group_size (documents of this batch with that text), kept,
    text_sha256, n_rows (rows this document had).

    Texts are equal when they are after all white space is deleted. Within a batch the longest
    original text stays, then the smallest doc_id. A null text counts as empty. Rows that repeat
    doc_id and text are one document, and one of doc_id with two texts is two. A null doc_id is
    an id of its own that comes after all others. An empty table gives no rows; other columns
    are not looked at.
    """
    digests = stored(docs.select(
        "doc_id", digest(F.col("text")).alias("text_sha256"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.max("chars").alias("chars"), F.count("*").alias("n_rows")), "digests")
    winners = digests.groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("chars")).alias("neg"), F.col("doc_id").isNull().alias("last"), "doc_id"))
        .alias("best"), F.count("*").alias("group_size"))
    winners = stored(winners.select(
        "text_sha256", F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.neg")).cast("int").alias("keep_chars"), "group_size"), "winners")
    index.add(winners, batch)
    facts = index.rows().select("text_sha256", "keep_id", "batch").join(
        winners.select("text_sha256", "group_size"), "text_sha256")
    out = lookup(digests, facts, "text_sha256", F.col("group_size"), digests.count())
    return out.select(
        "doc_id", "keep_id", F.col("group_size").cast("long"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"),
        "text_sha256", "n_rows")


def fresh_index(spark: SparkSession, docs: DataFrame) -> DigestIndex:
    return DigestIndex(spark, scratch_path(spark, "digest-index"), partitions(spark),
                       docs.schema["doc_id"].dataType.simpleString())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = exact_dedup(docs, fresh_index(spark, docs), "all")
    return out.drop("n_rows")


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that stay, in the columns they came with."""
    decided = exact_dedup(docs, fresh_index(spark, docs), "all").filter("kept").select(
        F.col("doc_id").alias("id"), "text_sha256", "n_rows")
    mine = nested(docs).withColumn("digest", digest(F.col("row.text"))).join(
        decided, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text_sha256")))
    once = mine.filter("n_rows = 1").select("row.*")
    again = mine.filter("n_rows > 1").withColumn("doc", F.col("row.doc_id")).dropDuplicates(["doc", "digest"])
    return once.unionByName(again.select("row.*"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
