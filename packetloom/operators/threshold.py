"""Adaptive alert threshold: an ordered fold per host over its own quiet scores."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from packetloom.functions import scalars as S
from packetloom.operators.ordered_fold import ordered_fold
from packetloom.operators.slices import top_per_key
from packetloom.params import Params


class HostScores:
    """What one host remembers: its learned count, latest scores and current threshold."""

    def __init__(self, p: Params, learned: int = 0, scores: tuple = (), cached: float | None = None):
        self.p, self.learned, self.cached = p, learned, cached
        self.scores = deque(scores, maxlen=p.score_memory)

    def threshold(self) -> float:
        if len(self.scores) < self.p.min_samples:
            return self.p.base_threshold
        if self.cached is None:
            self._refresh()
        return self.cached

    def learn(self, score: float) -> None:
        self.scores.append(score)
        self.learned += 1
        past = self.learned - self.p.min_samples
        # the first value appears when it is first asked for, then every so many scores
        if past > 0 and past % self.p.recompute_every == 0:
            self._refresh()

    def _refresh(self) -> None:
        q = float(np.quantile(np.fromiter(self.scores, float), self.p.host_quantile))
        self.cached = min(max(q, self.p.base_threshold, self.p.min_threshold),
                          self.p.max_threshold)

    def pack(self) -> tuple:
        return self.learned, tuple(self.scores), self.cached


def _fold(p: Params):
    def fold(state, rows: pd.DataFrame):
        host = HostScores(p, *(state or ()))
        n = len(rows)
        limits, alerts, quiet = np.empty(n), np.empty(n, bool), np.empty(n, bool)
        veto = rows["veto"].to_numpy()
        for i, score in enumerate(rows["score"].to_numpy()):
            # read, decide, then learn; only scores that did not alert are learned
            limit = host.threshold()
            raised = score >= limit
            limits[i], quiet[i] = limit, raised and veto[i]
            alerts[i] = raised and not veto[i]
            if not alerts[i]:
                host.learn(float(score))
        out = rows.drop(columns=["_part"], errors="ignore").assign(
            threshold=limits, is_alert=alerts, suppressed=quiet)
        return out, host.pack()

    return fold


def _propagate(p: Params):
    """Start state of the next piece, if this piece had started from ``now`` instead."""

    def propagate(used, end, now):
        if now is None or used == now:
            return end
        fresh = end[0] - (used[0] if used else 0)
        scores = (*now[1], *end[1])[-p.score_memory:] if fresh < p.score_memory else end[1]
        return now[0] + fresh, tuple(scores), end[2] if end[2] is not None else now[2]

    return propagate


def adaptive_threshold(scored: DataFrame, order: list[str], p: Params = Params(),
                       keys: tuple[str, ...] = ("capture_id", "src"), pieces: int | None = None) -> DataFrame:
    """Add threshold, is_alert and suppressed. ``scored`` should be narrow: it crosses Arrow.

    Every capture has host states of its own unless other keys are given.

    Needs ``score`` and a boolean ``veto`` (an alert here would be silenced as benign).
    """
    schema = T.StructType([
        *scored.schema.fields,
        T.StructField("threshold", T.DoubleType()),
        T.StructField("is_alert", T.BooleanType()),
        T.StructField("suppressed", T.BooleanType())])
    return ordered_fold(scored, keys, order, _fold(p), schema, p.group_rows, pieces,
                        _propagate(p))


def with_veto(scored: DataFrame, p: Params = Params()) -> DataFrame:
    return scored.withColumn("veto", F.coalesce(S.vetoable(
        F.col("score"), F.col("family"), F.col("confidence"), p), F.lit(False)))


def threshold_snapshot(quiet: DataFrame, order: list[str], p: Params = Params(),
                       keys: tuple[str, ...] = ("capture_id", "src")) -> DataFrame:
    """Host rows for inspection: the remembered scores, and the threshold now in force.

    The threshold was taken when the learned count last was a whole number of refresh
    steps past the minimum; the few scores learned since then are left out of it.
    """
    counts = quiet.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    newest = [F.col(c).desc() for c in order]
    kept = top_per_key(quiet, keys, newest, p.score_memory + p.recompute_every, order,
                       rank="_rank").join(counts, list(keys))
    late = F.when(F.col("_n") >= p.min_samples,
                  (F.col("_n") - p.min_samples) % p.recompute_every).otherwise(0)
    held = F.when(F.col("_rank") <= p.score_memory, F.col("score"))
    judged = F.when((F.col("_rank") > late) & (F.col("_rank") <= late + p.score_memory),
                    F.col("score"))
    # at most score_memory + recompute_every values per host
    rows = kept.groupBy(*keys[:-1], F.col(keys[-1]).alias("host")).agg(
        F.least(F.max("_n"), F.lit(p.score_memory)).alias("samples"),
        F.percentile(held, F.array(F.lit(0.5), F.lit(0.99))).alias("q"),
        F.percentile(judged, F.lit(p.host_quantile)).alias("own"))
    ready = F.col("samples") >= p.min_samples
    bounded = F.least(
        F.greatest(F.col("own"), F.lit(p.base_threshold), F.lit(p.min_threshold)),
        F.lit(p.max_threshold))
    limit = F.when(ready, bounded).otherwise(p.base_threshold)
    return rows.select(
        *keys[:-1], "host", "samples", F.col("q")[0].alias("median"), F.col("q")[1].alias("p99"),
        limit.alias("threshold"), ready.alias("calibrated"),
        (limit > p.base_threshold + 1e-9).alias("raised"),
    ).orderBy(F.desc("samples"), "host")
