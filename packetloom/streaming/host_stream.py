"""Behaviour features and alert thresholds kept per host on a stream of flows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom import fixed_values as V
from packetloom.operators.host_arrays import Hosts, coded
from packetloom.operators.threshold import HostScores
from packetloom.params import Params

GROUPS = 512     # groups of hosts whose windows are one state
SLICE = 65_536   # rows handed back at once
OWN = "packetloom_"
# per side: what a row gets, and how long a silent host is kept
PROFILES = {"src": (V.HOST_FEATURES, lambda p: p.long_s), "dst": (V.DST_FEATURES, lambda p: p.short_s)}


class _Host(StatefulProcessor):
    """Ordered walk over a host's flows; the state is dropped once the host falls silent."""

    names: tuple[str, ...] = ()  # what ``step`` adds to a row

    def __init__(self, p: Params, columns: list[str], order: list[str], keep_s: int | None):
        self.p, self.columns, self.order, self.keep_s = p, columns, order, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("host", "state binary, alarm long")

    def fresh(self):
        raise NotImplementedError

    def step(self, state, row: Row) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        blob, alarm = self.held.get() if self.held.exists() else (None, None)
        state = pickle.loads(blob) if blob else self.fresh()
        shape, last = Row(*self.columns, *self.names), 0
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            last = max(last, row.end_us)
            yield shape(*[row[c] for c in self.columns], *self.step(state, row))
        if alarm:
            self.handle.deleteTimer(alarm)
        alarm = alarm or 0
        if self.keep_s is not None:  # a late row never brings the alarm forward
            alarm = max(alarm, last // 1000 + self.keep_s * 1000 + 1)
            self.handle.registerTimer(alarm)
        self.held.update((pickle.dumps(state), alarm))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # every flow of the host has left its windows
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class ThresholdProcessor(_Host):
    names = ("threshold", "is_alert", "suppressed")

    def fresh(self):
        return HostScores(self.p)

    def step(self, state, row):
        limit = state.threshold()
        raised = row.score >= limit
        if not raised or row.veto:
            state.learn(row.score)
        return limit, raised and not row.veto, bool(raised and row.veto)


def _run(flows: DataFrame, keys: list[str], make: type[_Host], kind: list[T.DataType], p: Params,
         order: tuple[str, ...], keep_s: int | None) -> DataFrame:
    added = [T.StructField(n, k) for n, k in zip(make.names, kind)]
    return flows.groupBy(*keys).transformWithState(
        make(p, flows.columns, list(order), keep_s),
        T.StructType([*flows.schema.fields, *added]), "append", "EventTime")


class _Packed:
    """The columns of flows in a form that is quickly handed to Python and comes back unchanged.

    Whole numbers, flags and times travel as one array, which costs as much as one column. Pandas
    has no null in them; what was null is a bit of the last elements.
    """

    def __init__(self, fields: list[T.StructField]):
        kinds = lambda *k: [f.name for f in fields if isinstance(f.dataType, k)]
        self.fields = fields
        self.whole = kinds(T.IntegralType, T.BooleanType, T.TimestampType)
        masked = [*self.whole, *kinds(T.FloatType, T.DoubleType)]
        self.bits = {c: (i // 60, i % 60) for i, c in enumerate(masked)}
        self.masks = [f"{OWN}nulls_{i}" for i in range(len(masked) // 60 + 1)]
        self.rest = [f.name for f in fields if f.name not in self.whole]

    def pack(self) -> list[Column]:
        def whole(f: T.StructField) -> Column:
            c = F.col(f"`{f.name}`")
            c = F.unix_micros(c) if isinstance(f.dataType, T.TimestampType) else c.cast("long")
            return F.coalesce(c, F.lit(0).cast("long"))

        def mask(k: int) -> Column:
            bits = [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                    for c, (m, i) in self.bits.items() if m == k]
            return reduce(Column.bitwiseOR, bits, F.lit(0).cast("long"))

        numbers = [*[whole(f) for f in self.fields if f.name in self.whole],
                   *[mask(k) for k in range(len(self.masks))]]
        return [F.array(*numbers).alias(f"{OWN}whole"), *[F.col(f"`{c}`") for c in self.rest]]

    def unpack(self) -> list[Column]:
        def one(f: T.StructField) -> Column:
            c = F.col(f"`{f.name}`")
            if f.name not in self.bits:
                return c
            if isinstance(f.dataType, T.TimestampType):
                c = F.timestamp_micros(c)
            elif isinstance(f.dataType, T.FractionalType):  # Python hands back a null for it
                c = F.coalesce(c, F.lit(float("nan")).cast(f.dataType))
            m, i = self.bits[f.name]
            return F.when(F.col(self.masks[m]).bitwiseAND(F.lit(1 << i)) == 0, c).alias(f.name)

        return [*map(one, self.fields)]

    def returned(self) -> list[T.StructField]:
        """Of the frame that Python hands back."""
        wide = lambda k: T.LongType() if isinstance(k, T.TimestampType) else k
        return [*[T.StructField(f.name, wide(f.dataType)) for f in self.fields],
                *[T.StructField(m, T.LongType()) for m in self.masks]]

    def frame(self, rows: pd.DataFrame) -> pd.DataFrame:
        numbers = np.stack(rows[f"{OWN}whole"].to_numpy())
        flags = {f.name for f in self.fields if isinstance(f.dataType, T.BooleanType)}
        columns = {c: numbers[:, i].astype(bool) if c in flags else numbers[:, i]
                   for i, c in enumerate([*self.whole, *self.masks])}
        return pd.DataFrame({f.name: columns[f.name] if f.name in columns else rows[f.name].to_numpy()
                             for f in self.returned()})

    def missing(self, frame: pd.DataFrame, name: str) -> np.ndarray:
        mask, bit = self.bits[name]
        return frame[self.masks[mask]].to_numpy() & (1 << bit) != 0


class ProfileProcessor(StatefulProcessor):
    """Windows of one group of hosts: a state, and a timer at the first moment one of them is empty.

    A call to the state store costs more than the flows of a usual host, so many hosts share one.
    """

    def __init__(self, p: Params, side: str, packed: _Packed, sent: list[str], order: list[str]):
        self.p, self.side, self.packed, self.sent, self.order = p, side, packed, sent, order
        self.names, self.keep_s = PROFILES[side][0], PROFILES[side][1](p)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hosts", "held binary, alarm long")

    def _load(self) -> tuple[Hosts, int | None]:
        held = self.state.get()
        return Hosts(self.p, self.side, self.keep_s, pickle.loads(held[0]) if held else None), held and held[1]

    def _keep(self, hosts: Hosts, alarm: int | None, passed_ms: int, rung: bool = False) -> None:
        due = hosts.forget(passed_ms)
        if due != alarm:
            if alarm is not None and not rung:
                self.handle.deleteTimer(alarm)
            if due is not None:
                self.handle.registerTimer(due)
        if due is not None:
            self.state.update((pickle.dumps(hosts.held), due))
        elif alarm is not None:
            self.state.clear()

    def _flows(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        missing = lambda c: self.packed.missing(rows, c)
        if missing("end_us").any():
            raise ValueError("a flow without end_us")
        value, named = lambda c: rows[c].to_numpy(), lambda c: rows[c].to_numpy().astype(object)
        own, peer = ("src", "dst") if self.side == "src" else ("dst", "src")
        lasted = np.maximum(value("end_us") - value("start_us"), 0)
        return {
            "capture": named("capture_id"), "host": named(own), "peer": named(peer),
            "port": np.where(missing("dport"), np.iinfo(np.int64).min, value("dport")),
            "at": value("end_us"), "us": np.where(missing("start_us"), 0, lasted),
            "syn": value("had_syn"), "failed": value("had_syn") & ~value("handshake"),
            "new": value("new_pair") if "new_pair" in rows else np.zeros(len(rows), bool),
            "out": value("bytes_out"), "into": value("bytes_in")}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hosts, alarm = self._load()
        found = self.packed.frame(pd.concat([r.set_axis(self.sent, axis=1) for r in rows], ignore_index=True))
        flows = self._flows(found)
        ranks = [found[c].to_numpy() for c in self.order]
        ranks = [pd.factorize(r, sort=True)[0] if r.dtype == object else r for r in ranks]
        by = np.lexsort([*ranks[::-1], coded(flows["host"])[0], coded(flows["capture"])[0]])
        features = hosts.observe({c: v[by] for c, v in flows.items()})
        self._keep(hosts, alarm, timerValues.getCurrentWatermarkInMs())
        for a in range(0, len(by), SLICE):
            yield pd.concat([found.iloc[by[a:a + SLICE]].reset_index(drop=True),
                             pd.DataFrame(features[a:a + SLICE], columns=list(self.names))], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hosts, alarm = self._load()
        self._keep(hosts, alarm, timerValues.getCurrentWatermarkInMs(), rung=True)
        return iter(())

    def close(self) -> None:
        pass


def host_profile_stream(flows: DataFrame, side: str = "src", p: Params = Params(),
                        order: tuple[str, ...] = ("end_us", "seq")) -> DataFrame:
    """Add the 15 source or 4 destination features. ``flows`` carries a watermark on ``ts``."""
    names, packed, group = PROFILES[side][0], _Packed(flows.schema.fields), f"{OWN}group"
    sent = flows.select(
        F.pmod(F.xxhash64("capture_id", side), F.lit(GROUPS)).alias(group), *packed.pack(),
        F.col("ts"))  # late flows are known by their ``ts``
    added = [T.StructField(n, T.DoubleType()) for n in names]
    out = sent.groupBy(group).transformWithStateInPandas(
        ProfileProcessor(p, side, packed, sent.columns, list(order)),
        T.StructType([*packed.returned(), *added]), "append", "EventTime")
    return out.select(*packed.unpack(), *names)


def threshold_stream(scored: DataFrame, p: Params = Params(),
                     order: tuple[str, ...] = ("end_us", "seq")) -> DataFrame:
    """Add threshold, is_alert and suppressed.

    A host of a capture is forgotten once it was silent for ``forget_s``, so that state does not grow
    with all hosts ever seen; if it comes back, it starts afresh.
    """
    kinds = [T.DoubleType(), T.BooleanType(), T.BooleanType()]
    return _run(scored, ["capture_id", "src"], ThresholdProcessor, kinds, p, order, p.forget_s)
