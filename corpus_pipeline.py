"""Documents to packed sequences, in stages that each call one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.common import scratch_path, table
from packetloom.llm.decontaminate import drop_contaminated
from packetloom.llm.exact_dedup import keep_unique
from packetloom.llm.jaccard_join import keep_representatives
from packetloom.llm.language_crf import keep_languages
from packetloom.llm.packing import pack_documents

STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", keep_unique),
    ("n-gram Jaccard join", keep_representatives),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Language, MinHash order and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
