"""Exact search for the largest inner products by elimination over a pivot table.

Distances from every vector to a few pivots are computed once and stored. With them |d(q, p) - d(x, p)|
bounds the distance of q and x from below for each pivot p, and the largest of these bounds the inner
product from above, as 2 qx = |q|^2 + |x|^2 - d(q, x)^2. A query evaluates candidates in the order of
that bound and stops where the bound falls under the worst of its best so far: no later one can enter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.llm.common import stored, table
from packetloom.operators.prefix import Sum, prefix_scan
from packetloom.session import scratch_path

PIVOTS = 24
#: Pivots are chosen from at most so many vectors; these also give each query its first bar.
SAMPLE, SAMPLE_VALUES = 2048, 1 << 20
#: Queries are searched in blocks of at most so many vectors and values, each over all candidates.
BLOCK, BLOCK_VALUES = 2048, 1 << 20
SCALE, STEP, EVERY = 1024, 256, 100
EXACT = 1 << 53


def quantised(vector: Column) -> Column:
    """Whole numbers floor(SCALE * x) of a vector, null where it or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact; beyond 64 bits the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0 ** 62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: the vector furthest from all taken so far, again and again, after the origin."""
    points = sample.astype(np.float64)
    taken = [np.zeros(points.shape[1])]
    near = np.sqrt((points ** 2).sum(axis=1))
    while len(taken) < count and len(points) and near.max() > 0:
        taken.append(points[int(near.argmax())])
        near = np.minimum(near, np.sqrt(((points - taken[-1]) ** 2).sum(axis=1)))
    return np.array(taken)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivots by vectors; squares are summed directly, so that equal vectors are at 0."""
    points = vectors.astype(np.float64)
    return np.array([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots])


class PivotTable:
    """Vectors with their distances to pivots, stored; `rows` has (vec_id, v, length, d)."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS):
        """vectors has vec_id and v, whole numbers. Vectors of other lengths have pivots of their own."""
        rows = vectors.filter(F.col("v").isNotNull()).select("vec_id", "v", F.size("v").alias("length"))
        order = [F.xxhash64("vec_id", "v"), F.col("vec_id")]
        few = rows.filter(F.col("length") <= SAMPLE_VALUES).orderBy(*order).limit(SAMPLE)
        held = F.sum("length").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        self.sample: dict[int, tuple[list[int | None], np.ndarray]] = {}
        drawn = defaultdict(list)
        for r in few.withColumn("held", held).filter(F.col("held") <= SAMPLE_VALUES).collect():
            drawn[r["length"]].append((r["vec_id"], r["v"]))
        for n, found in drawn.items():
            self.sample[n] = [i for i, _ in found], np.array([v for _, v in found], dtype=np.int64).reshape(len(found), n)
        self.pivots = {n: _far_apart(v, pivots) for n, (_, v) in self.sample.items()}
        chosen = self.pivots

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n in set(b.column("length").to_pylist()):
                    part = b.filter(pa.compute.equal(b.column("length"), n))
                    d = _distances(_matrix(part.column("v"), n), chosen.get(n, np.zeros((1, n))))
                    d = pa.FixedSizeListArray.from_arrays(pa.array(d.T.ravel()), len(d)).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, d], names=["vec_id", "v", "length", "d"])
        kind = vectors.schema["vec_id"].dataType.simpleString()
        self.rows = stored(rows.mapInArrow(measure, f"vec_id {kind}, v array<long>, length int, d array<double>"), "pivots")


def _eliminate(q: np.ndarray, qd: np.ndarray, own: int | None, bar: int | None, ids: np.ndarray, x: np.ndarray,
               xd: np.ndarray, norms: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, row) of candidates that may be among the k best; bar is a score that k others are known to reach."""
    lower = np.abs(xd[0] - qd[0])
    for row, d in zip(xd[1:], qd[1:]):
        np.maximum(lower, np.abs(row - d), out=lower)
    whole = norms + qd[0] ** 2  # the first pivot is the origin
    upper = (whole - lower ** 2) / 2 + whole * 1e-9 + 1  # never under the product, whatever was rounded
    open_ = ids != own if own is not None else np.ones(len(ids), dtype=bool)
    if bar is not None:
        open_ &= upper >= bar
    left = np.flatnonzero(open_)
    left = left[np.argsort(-upper[left], kind="stable")]
    best: list[tuple[int, int]] = []
    for at in range(0, len(left), STEP):
        some = left[at:at + STEP]
        if bar is not None and upper[some[0]] < bar:
            break
        scores = _products(q[None, :], x[some])[0]
        if bar is not None:
            some, scores = some[scores >= bar], scores[scores >= bar]
        best += zip(scores.tolist(), some.tolist())
        if len(best) >= k:
            best.sort(key=lambda s: -s[0])
            bar = best[k - 1][0] if bar is None else max(bar, best[k - 1][0])
            best = [s for s in best if s[0] >= bar]
    return best


class _Block:
    """Queries of one length, with their distances and the scores that the sample already gives them."""

    def __init__(self, rows: Sequence, length: int, tab: PivotTable, k: int):
        self.number = [r["number"] for r in rows]
        self.ids = [r["vec_id"] for r in rows]
        self.v = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), length)
        self.d = _distances(self.v, tab.pivots.get(length, np.zeros((1, length)))).T
        ids, sample = tab.sample.get(length, ([], np.zeros((0, length), dtype=np.int64)))
        self.bars: list[int | None] = []
        for own, scores in zip(self.ids, _products(self.v, sample)):
            others = np.sort([s for s, i in zip(scores, ids) if i != own])
            self.bars.append(int(others[-k]) if len(others) >= k else None)


def top_products(tab: PivotTable, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of the table for each query (vec_id, v): query_id, rank from 1, vec_id, score.

    Rows with the id of the query are its own and left out. Queries that repeat id and vector are one;
    candidates that repeat count each. Ties go to the smaller id, null last. Only vectors of the
    same length have a score, so a query may have fewer than k rows, or none.
    """
    spark, path = queries.sparkSession, scratch_path(queries.sparkSession, "found")
    asked = queries.filter(F.col("v").isNotNull()).select("vec_id", "v", F.size("v").alias("length")).distinct()
    cost = F.greatest(F.lit(BLOCK_VALUES // BLOCK), F.col("length")).cast("long")
    numbered = prefix_scan(asked.withColumn("_hash", F.xxhash64("vec_id", "v")), ["length", "_hash", "vec_id"],
                           number=Sum(F.lit(1)), upto=Sum(cost))
    numbered = stored(numbered.withColumn("block", F.floor(F.col("upto") / BLOCK_VALUES)), "queries")
    kind = tab.rows.schema["vec_id"].dataType.simpleString()
    schema = f"number long, query_id {kind}, vec_id {kind}, score long"
    last = numbered.agg(F.max("block")).first()[0]
    for block in range(-1 if last is None else int(last) + 1):  # bounded blocks, each over all candidates
        by_length = defaultdict(list)
        for r in numbered.filter(F.col("block") == block).collect():
            by_length[r["length"]].append(r)
        blocks = {n: _Block(rows, n, tab, k) for n, rows in by_length.items()}
        _search(tab.rows, blocks, schema, k).write.mode("append").parquet(path)
    if last is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    found = spark.read.schema(schema).parquet(path)
    order = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, blocks: dict[int, _Block], schema: str, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: [[] for _ in b.ids] for n, b in blocks.items()}  # (score, vec_id), at most k and ties a query
        bars = {n: list(b.bars) for n, b in blocks.items()}
        for batch in batches:
            for n in set(batch.column("length").to_pylist()) & set(blocks):
                part = batch.filter(pa.compute.equal(batch.column("length"), n))
                x, block = _matrix(part.column("v"), n), blocks[n]
                xd = np.ascontiguousarray(_matrix(part.column("d"), block.d.shape[1]).T)
                names = part.column("vec_id").to_pylist()
                ids = np.array(names, dtype=object) if None in names else np.array(names)
                norms = xd[0] ** 2
                for i, own in enumerate(block.ids):
                    found = _eliminate(block.v[i], block.d[i], own, bars[n][i], ids, x, xd, norms, k)
                    if found:
                        mine = best[n][i] + [(s, names[r]) for s, r in found]
                        mine.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
                        best[n][i] = mine[:k]
                        if len(mine) >= k:
                            bars[n][i] = max(mine[k - 1][0], mine[k - 1][0] if bars[n][i] is None else bars[n][i])
        out = [(b.number[i], own, c, s) for n, b in blocks.items() for i, own in enumerate(b.ids) for s, c in best[n][i]]
        if out:
            number, query, found, score = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64())],
                names=["number", "query_id", "vec_id", "score"])
    return rows.mapInArrow(search, schema)


def exact_top_k(vectors: DataFrame, asked: Column, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """Search the rows of vectors (vec_id, embedding) for which asked holds among all of them.

    Vectors that are null, or have a null or non-finite component, take no part; nor do they ask. Components
    whose product with SCALE is beyond a long count as the nearest long. An empty table has no rows.
    Other columns are only seen by asked.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), asked.alias("asks"))
    tab = PivotTable(rows, pivots)
    return top_products(tab, rows.filter("asks"), k)


def op13_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
