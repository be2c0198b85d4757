"""Byte entropy of payload samples, natively and as a vectorised UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def payload_entropy(payload: Column) -> Column:
    """Normalised Shannon entropy (0..1) of a short byte string, JVM-side.

    The bytes are sorted; each run of equal bytes contributes once, at its last position.
    Samples are at most 256 bytes, so the array stays small.
    """
    size = F.octet_length(payload)
    symbols = F.array_sort(F.regexp_extract_all(F.hex(payload), F.lit("(..)"), F.lit(1)))
    start = F.struct(
        F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def closed(acc: Column) -> Column:
        run = acc["run"]
        return acc["total"] + F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        return F.struct(
            x.alias("last"),
            F.when(same, acc["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same, acc["total"]).otherwise(closed(acc)).alias("total"),
        )

    # sum over symbols of c*log2(c), then H = log2(n) - that / n
    weighted = F.aggregate(symbols, start, step, closed)
    n = size.cast("double")
    bits = F.log2(n) - weighted / n
    return F.when(size > 0, F.greatest(bits, F.lit(0.0)) / 8.0).otherwise(0.0)


BATCH = 4096


def _entropies(payloads: list[bytes]) -> np.ndarray:
    """All samples of a batch at once: one count over (sample, byte) pairs."""
    sizes = np.array([len(p) for p in payloads])
    symbols = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    owner = np.repeat(np.arange(len(payloads)), sizes)
    counts = np.bincount(owner * 256 + symbols, minlength=len(payloads) * 256)
    cells = np.flatnonzero(counts)
    weight = counts[cells] * np.log2(counts[cells])
    total = np.bincount(cells >> 8, weights=weight, minlength=len(payloads))
    n = np.maximum(sizes, 1)
    return np.where(sizes > 0, np.maximum(np.log2(n) - total / n, 0.0) / 8.0, 0.0)


@F.pandas_udf(T.DoubleType())
def payload_entropy_arrow(payload: pd.Series) -> pd.Series:
    """The same value, vectorised over Arrow batches: faster from a few bytes on."""
    raw = [p or b"" for p in payload]
    parts = [_entropies(raw[i:i + BATCH]) for i in range(0, len(raw), BATCH)]
    return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")
