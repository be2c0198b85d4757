"""Isolation forest on benign flows, calibration to benign percentiles, explanation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom import fixed_values as V
from packetloom.functions import scalars as S
from packetloom.operators.quantiles import column_quantiles, grid_quantiles
from packetloom.params import Params


# scaling

def robust_fit(df: DataFrame, names: tuple[str, ...] = V.FEATURES) -> DataFrame:
    """(feature, median, scale): scale is the 5-95 % range, 1 where that is zero."""
    q = column_quantiles(df, names, (0.05, 0.5, 0.95))
    spread = F.col("q2") - F.col("q0")
    return q.select(F.col("column").alias("feature"), F.col("q1").alias("median"),
                    F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


def baseline_median(df: DataFrame, names: tuple[str, ...] = V.FEATURES) -> DataFrame:
    q = column_quantiles(df, names, (0.5,))
    return q.select(F.col("column").alias("feature"), F.col("q0").alias("median"))


def in_order(table: DataFrame, names: tuple[str, ...], column: str) -> list[float]:
    """A per-feature table (one row per feature) as a list in vector order."""
    found = {r["feature"]: float(r[column]) for r in table.collect()}
    return [found[n] for n in names]


def robust_scale(vec: Column, medians: list[float], scales: list[float]) -> Column:
    centred = F.zip_with(vec, F.array(*[F.lit(x) for x in medians]), lambda v, m: v - m)
    return F.zip_with(centred, F.array(*[F.lit(x) for x in scales]), lambda v, s: v / s)


# forest

def path_length(n: np.ndarray | float) -> np.ndarray:
    """Average unsuccessful search length in a tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def _grow(x: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """One isolation tree as node rows: random feature, random cut, bounded depth."""
    deepest = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, None)]
    while todo:
        rows, depth, link = todo.pop()
        here = len(nodes)
        if link is not None:
            parent, side = link
            nodes[parent][side] = here
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if depth >= deepest or len(rows) < 2 or not len(open_features):
            nodes.append([-1, 0.0, -1, -1, len(rows), depth])
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[rows, f] <= cut
        if left.all():  # rounding put the cut on the maximum
            cut = float(np.nextafter(hi[f], lo[f]))
            left = x[rows, f] <= cut
        nodes.append([f, cut, -1, -1, len(rows), depth])
        todo += [(rows[~left], depth + 1, (here, 3)), (rows[left], depth + 1, (here, 2))]
    return pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "size", "depth"])


FOREST_BLOCK = 2_048  # rows that go down the trees together; they and one tree stay in the cache

TREES = ("tree int, node int, feature int, split double, left int, right int, "
         "size int, depth int, sample int")


def iforest_fit(vectors: DataFrame, trees: int = 220, sample: int = 4096,
                seed: int = 0) -> DataFrame:
    """Trees as rows. ``vectors``: id and a scaled feature array ``vec``, benign rows only.

    Each tree draws its rows by hash of (id, tree), so the draw does not depend on the
    partitioning. Rows far from the draw are dropped before anything is shuffled.
    """
    n = vectors.count()
    draw = min(sample, n)
    # expected draw plus ample slack; the exact cut to `draw` rows follows per tree
    share = 1.0 if n <= 2 * sample else min(1.0, (sample + 8 * math.sqrt(sample)) / n)
    spin = lambda t: F.xxhash64(F.col("id"), t, F.lit(seed))
    top = int(share * (1 << 62)) * 2 - 1  # share of the positive hash range
    near = lambda t: F.pmod(spin(t), F.lit((1 << 62) * 2 - 1)) <= top
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    picked = vectors.withColumn("tree", F.explode(F.filter(numbers, near))).withColumn(
        "spin", spin(F.col("tree")))
    w = W.partitionBy("tree").orderBy("spin", "id")
    rows = picked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= draw)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("rn")["vec"].to_numpy()).astype(np.float64)
        out = _grow(x, np.random.default_rng([seed, tree]))
        out.insert(0, "node", np.arange(len(out), dtype=np.int32))
        out.insert(0, "tree", tree)
        return out.assign(sample=len(x))

    return rows.select("tree", "rn", "vec").groupBy("tree").applyInPandas(grow, TREES)


class Forest:
    """Tree rows packed as flat arrays for vectorised scoring inside tasks."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["tree", "node"])
        sizes = rows.groupby("tree", sort=True).size().to_numpy()
        base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        leaf = rows["feature"].to_numpy() < 0
        here = np.arange(len(rows))
        # leaves point at themselves, so all rows can take the same number of steps
        left = np.where(leaf, here, rows["left"].to_numpy() + base)
        right = np.where(leaf, here, rows["right"].to_numpy() + base)
        self.child = np.stack([left, right], axis=1).ravel().astype(np.intp)
        self.feature = np.where(leaf, 0, rows["feature"].to_numpy()).astype(np.intp)
        self.split = rows["split"].to_numpy()
        self.reach = rows["depth"].to_numpy() + np.where(leaf, path_length(rows["size"]), 0.0)
        self.roots = np.unique(base)
        self.steps = int(rows["depth"].max())
        self.norm = float(path_length(float(rows["sample"].iloc[0]))) or 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is more anomalous."""
        total = np.zeros(len(x))
        for lo in range(0, len(x), FOREST_BLOCK):
            part = np.ascontiguousarray(x[lo:lo + FOREST_BLOCK])
            values, rows = part.ravel(), np.arange(len(part)) * part.shape[1]
            for root in self.roots:
                at = np.full(len(part), root, np.intp)
                for _ in range(self.steps):
                    go_left = values.take(rows + self.feature.take(at)) <= self.split.take(at)
                    at = self.child.take(2 * at + ~go_left)
                total[lo:lo + FOREST_BLOCK] += self.reach.take(at)
        return np.exp2(-total / len(self.roots) / self.norm)


def load_forest(trees: DataFrame) -> Forest:
    """The model reaches the driver: trees x at most 2 x sample nodes, whatever the data size."""
    return Forest(trees.toPandas())


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


def iforest_score(forest: Forest, df: DataFrame):
    """A pandas UDF: scaled vector to raw score. The forest is sent once per executor."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        for v in vecs:
            yield pd.Series(model.raw(_matrix(v)) if len(v) else [], dtype="float64")

    return score


# calibration

def ecdf_fit(raw: DataFrame, column: str = "raw") -> DataFrame:
    """(i, prob, value, tail_scale): benign quantile grid, forced to increase."""
    grid = grid_quantiles(raw, column, V.GRID_POINTS, V.GRID_TOP)
    median = column_quantiles(raw, [column], (0.5,)).select(F.col("q0").alias("median"))
    # the grid has a fixed number of rows, so one ordered pass over it is small
    upto = W.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rising = F.max("value").over(upto) + F.col("i") * F.lit(1e-12)
    top = F.max("value").over(W.orderBy(F.lit(1)).rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing))
    mid = median.first()["median"]  # one number
    spread = F.when(top - mid == 0, 1.0).otherwise(top - mid)
    return grid.select("i", "prob", rising.alias("value"),
                       F.greatest(spread, F.lit(1e-6)).alias("tail_scale"))


class Calibration:
    def __init__(self, grid: pd.DataFrame):
        grid = grid.sort_values("i")
        self.value, self.prob = grid["value"].to_numpy(), grid["prob"].to_numpy()
        self.tail = float(grid["tail_scale"].iloc[0])

    def apply(self, raw: np.ndarray) -> np.ndarray:
        inside = np.interp(raw, self.value, self.prob)
        beyond = np.maximum(raw - self.value[-1], 0.0) / self.tail
        tail = 1.0 - (1.0 - V.GRID_TOP) * np.exp(-beyond)
        return np.clip(np.where(raw > self.value[-1], tail, inside), 0.0, V.SCORE_CEILING)


def calibrate_score(grid: DataFrame):
    """A pandas UDF: raw score to benign percentile."""
    held = Calibration(grid.toPandas())  # 2001 rows

    @F.pandas_udf("double")
    def calibrated(raw: pd.Series) -> pd.Series:
        return pd.Series(held.apply(raw.to_numpy(dtype=float)))

    return calibrated


# explanation

def occluded_scores(forest: Forest, medians: list[float], df: DataFrame):
    """A pandas UDF: scaled vector to the scores with each feature in turn at its median.

    ``medians`` are in the scaled space. The 52 variants live only inside a batch.
    """
    held = df.sparkSession.sparkContext.broadcast((forest, np.asarray(medians)))

    @F.pandas_udf("array<double>")
    def occluded(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, base = held.value
        width = len(base)
        for v in vecs:
            out = []
            x = _matrix(v) if len(v) else np.empty((0, width))
            for lo in range(0, len(x), 256):
                part = x[lo:lo + 256]
                wide = np.repeat(part, width, axis=0)
                wide[np.arange(len(wide)), np.tile(np.arange(width), len(part))] = np.tile(
                    base, len(part))
                out += list(model.raw(wide).reshape(len(part), width))
            yield pd.Series(out, dtype=object)

    return occluded


def explain(alerts: DataFrame, occluded: Column, raw: Column, vec: Column,
            medians: list[float], names: tuple[str, ...] = V.FEATURES, top: int = 4) -> DataFrame:
    """Add ``contributions``: the features whose replacement lowers the score most."""
    base = F.array(*[F.lit(float(m)) for m in medians])
    label = F.array(*[S.feature_label(F.lit(n)) for n in names])
    # the UDF result is kept in a column of its own: nested lambdas would call it again
    prepared = alerts.withColumns({"_occ": occluded, "_raw": raw, "_vec": vec})
    drops = F.transform("_occ", lambda o: F.col("_raw") - o)
    prepared = prepared.withColumn("_drops", drops)
    total = F.aggregate("_drops", F.lit(0.0), lambda a, d: a + F.greatest(d, F.lit(0.0)))
    ranked = F.slice(F.array_sort(F.transform(
        "_drops", lambda d, i: F.struct((-d).alias("k"), i.alias("i")))), 1, top)
    kept = F.filter(ranked, lambda r: -r["k"] > 1e-9)
    prepared = prepared.withColumn("_total", F.when(total == 0, 1.0).otherwise(total))

    def line(r: Column) -> Column:
        value, mid = F.get("_vec", r["i"]).cast("double"), F.get(base, r["i"])
        return F.struct(
            F.get(label, r["i"]).alias("feature"), F.round(value, 4).alias("value"),
            F.round(mid, 4).alias("baseline"),
            F.round(-r["k"] / F.col("_total"), 4).alias("impact"),
            F.when(value >= mid, "above").otherwise("below").alias("direction"))

    return prepared.withColumn("contributions", F.transform(kept, line)).drop(
        "_occ", "_raw", "_vec", "_drops", "_total")


def explain_budget(alerts: DataFrame, batch: list[str], p: Params = Params()) -> DataFrame:
    """Only the highest alerts of a batch are worth explaining."""
    from packetloom.operators.slices import top_per_key

    return top_per_key(alerts, batch, [F.desc("score"), F.col("seq")], p.explain_per_batch,
                       ["seq"])
