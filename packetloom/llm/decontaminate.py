"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size. Within a partition an item is known by its MinHash sketch, the
k smallest of its shingle hashes. A document that holds a share of at least `threshold` of an
item's n shingles lacks at most n - ceil(threshold * n) of them, so with k one above that
at least one hash of the sketch is in the document: no item that passes can be missed, however
long the document is. Documents too small for a partition skip it. What the sketches let through
is verified by the exact share of the item's shingles, compared as text.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import stored, table, without

SHINGLE = 5
THRESHOLD = 0.8
#: With more sketch hashes than this, documents meet the sketches in a shuffle join instead.
SKETCH_LITERALS = 50_000

BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, " ")
    return F.split(F.trim(plain), " ")


def _windows(items: Column, each) -> Column:
    """each(start) for every start of SHINGLE consecutive items."""
    last = F.size(items) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), each))


def _texts(found: DataFrame) -> DataFrame:
    return found.withColumn("shingles", F.array_distinct(_windows(
        F.col("words"), lambda i: F.concat_ws(" ", F.slice("words", i + 1, SHINGLE)))))


def hashed(text: DataFrame) -> DataFrame:
    """Adds words and the hash of each shingle; a row id keeps filters from repeating the work."""
    out = text.withColumn("words", words(F.col("text"))).withColumn(
        "of_words", F.transform("words", lambda w: F.xxhash64(w)))
    return out.select("*", F.monotonically_increasing_id().alias("row"), _windows(
        F.col("of_words"), lambda i: F.xxhash64(*(F.get("of_words", i + j) for j in range(SHINGLE))))
        .alias("hashes")).drop("of_words")


def _among(hashes: list[int]):
    return lambda h: h.isin(hashes)


def sketches(benchmark: DataFrame, threshold: float) -> DataFrame:
    """One row per item and text: item_id, item_key, words, n, need, part, sketch."""
    items = hashed(benchmark.select("item_id", "text")).withColumn(
        "hashes", F.array_distinct("hashes")).filter("hashes IS NOT NULL")
    items = items.withColumn("n", F.size("hashes")).withColumn(
        "need", F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int"))
    return items.select(
        "item_id", F.xxhash64("words").alias("item_key"), "words", "n", "need",
        F.floor(F.log2("n")).cast("int").alias("part"),
        F.slice(F.array_sort("hashes"), F.lit(1), F.col("n") - F.col("need") + 1).alias("sketch"),
    ).dropDuplicates(["item_id", "item_key"])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 literals: int = SKETCH_LITERALS) -> DataFrame:
    """Documents (doc_id, text) that hold items (item_id, text): one row per document and item.

    doc_id, item_id, text_hash (of the whole text), n_item and n_shared (distinct shingles of
    the item, and those of them in the document), containment.

    Words are runs of letters, marks and digits in lower case, shingles five of them. Documents
    and items of fewer words, empty and null ones match nothing. Rows that repeat a document or
    an item count once; an id with several texts is judged by each. Null ids are kept. Empty
    tables give no rows; other columns are not looked at.
    """
    items = stored(sketches(benchmark, threshold), "items")
    parts = items.groupBy("part").agg(F.min("need").alias("need"), F.sum(F.size("sketch")).alias("k"))
    sizes = parts.collect()  # one row per power of two
    rows = hashed(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))).filter(
        "hashes IS NOT NULL")
    if sum(p.k for p in sizes) <= literals:
        known = items.select("part", F.explode("sketch").alias("h")).distinct().collect()
        hit = F.lit(False)
        for p in sizes:
            own = [r.h for r in known if r.part == p.part]
            hit |= (F.size("hashes") >= p.need) & F.exists("hashes", _among(own))
        likely = rows.filter(hit)
    else:
        keys = rows.select("doc_id", "text_hash", F.explode("hashes").alias("h")).join(
            items.select(F.explode("sketch").alias("h")).distinct(), "h").select(
            F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
        likely = rows.join(
            keys, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t")),
            "left_semi")
    wanted = _texts(items).select(
        "item_id", "item_key", "n", "need", F.explode("shingles").alias("shingle"))
    shared = _texts(likely).select(
        "row", "doc_id", "text_hash", F.explode("shingles").alias("shingle")).join(wanted, "shingle")
    found = shared.groupBy("row", "doc_id", "text_hash", "item_id", "item_key", "n", "need").agg(
        F.count("*").alias("n_shared")).filter("n_shared >= need")
    return found.groupBy("doc_id", "item_id", "text_hash", "item_key").agg(
        F.max("n").cast("long").alias("n_item"), F.max("n_shared").alias("n_shared")).withColumn(
        "containment", F.col("n_shared") / F.col("n_item")).drop("item_key")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("containment", "n_item", "n_shared")).alias("best")).select(
        "doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item."""
    found = stored(contaminated(docs, table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct(), "contaminated")
    return without(docs, found)


SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM documents),
b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared,
       count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)
"""
