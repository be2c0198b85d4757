"""Where flows begin, as one scan over packets in order of key and time.

Packets are cut into even ranges of (key, time), so that a key with most of the packets spans many
ranges. Each range is walked by itself, as if its first packet began a flow. That guess matters
only up to the first packet at which a flow begins whatever was before (a new key, a reset, a
silence), so the state at the end of a range hardly ever depends on it. A range in which no such
packet is leaves a summary instead: for every packet at which an unknown flow could be cut, the
flow that is open at the end. Summaries compose, so one fold over them, a row for each range, tells
the open flow at the start of each range, and the packets before the first certain one are walked
again from there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from packetloom import fixed_values as V
from packetloom.params import Params
from packetloom.session import materialise

LONG_AGO = -(1 << 62)
NUMBERS = ("_b_k1", "_b_k2", "ts_us", "seq", "_b_clock", "_b_kind")
SYN_ALONE, FIN, RST, LOWER = 1, 2, 4, 8  # bits of _b_kind; LOWER: sent by the lower end of the key
ADDED = "_b_flow bigint, _b_lower boolean, _b_begins boolean, _b_iat bigint"
OWN = f"{ADDED}, _b_part int, _b_place bigint, _b_head boolean, _b_summary binary"


@dataclass
class Open:
    """The flow that is open behind a packet."""
    key: tuple[int, int]
    start: int
    flow: int
    lower: bool
    fins: int
    packets: int
    alone: bool     # it began with a SYN without ACK
    last: int
    reset: bool


@dataclass
class Rules:
    idle: int
    syn: int
    active: int

    @classmethod
    def of(cls, p: Params) -> Rules:
        return cls(p.idle_us, p.syn_us, p.active_us)

    def ends(self, o: Open, clock: int) -> bool:
        """Is o closed before a packet at that clock, by what needs no look at later packets?"""
        waited = o.packets == 1 and o.alone and clock >= o.last + self.syn
        return o.reset or o.fins >= 2 or clock >= o.last + self.idle or waited or clock >= o.start + self.active

    def first_cut(self, o: Open, clock: np.ndarray, fins: np.ndarray) -> int:
        """The first of the packets at which o is cut, or their number; fins are the places of FINs."""
        if not len(clock) or self.ends(o, int(clock[0])):
            return 0
        second = 1 - o.fins
        closed = int(fins[second]) + 1 if second < len(fins) else len(clock)
        return min(closed, int(np.searchsorted(clock, o.start + self.active)), len(clock))


def _after(o: Open | None, key, n: int, at: int, ts, seq, kind) -> Open:
    """The open flow behind n packets: the one that begins at `at`, or o if that is negative."""
    fins = int(np.count_nonzero(kind[max(at, 0):n] & FIN))
    last, reset = int(ts[n - 1]), bool(kind[n - 1] & RST)
    if at < 0:
        return Open(key, o.start, o.flow, o.lower, o.fins + fins, o.packets + n, o.alone, last, reset)
    return Open(key, int(ts[at]), int(seq[at]), bool(kind[at] & LOWER), fins, n - at, bool(kind[at] & SYN_ALONE), last, reset)


@dataclass
class Summary:
    """What a range does to the flow that is open before it.

    ``out`` is the flow that is open behind it if its first packet begins one. Only a range of one
    key in which that depends on the state before has the arrays: ``final[i]`` is where the
    open flow began if one begins at packet i.
    """
    first: tuple[int, int]
    out: Open
    whole: tuple[np.ndarray, ...] | None = None   # ts, seq, clock, kind
    final: np.ndarray | None = None

    def after(self, o: Open | None, rules: Rules) -> Open:
        if self.whole is None or o is None or o.key != self.first:
            return self.out
        ts, seq, clock, kind = self.whole
        cut = rules.first_cut(o, clock, np.flatnonzero(kind & FIN))
        at = -1 if cut == len(ts) else int(self.final[cut])
        return _after(o, o.key, len(ts), at, ts, seq, kind)


def _finals(rules: Rules, ts, clock, kind) -> np.ndarray:
    """For each packet: where the flow open at the end began, if one begins at that packet."""
    n, here = len(ts), np.arange(len(ts))
    fins = np.append(np.flatnonzero(kind & FIN), [n - 1, n - 1])
    nxt = np.minimum(fins[np.searchsorted(fins[:-2], here) + 1] + 1, np.searchsorted(clock, ts + rules.active))
    waited = (kind[:-1] & SYN_ALONE > 0) & (clock[1:] >= ts[:-1] + rules.syn)
    nxt[:-1] = np.where(waited, here[1:], nxt[:-1])
    nxt = np.where(nxt < n, nxt, here)
    while True:
        further = nxt[nxt]
        if (further == nxt).all():
            return nxt
        nxt = further


@dataclass
class Walk:
    """Walks packets in order of key and time, batch by batch."""
    rules: Rules
    open: Open | None = None
    certain: bool = False        # has a flow begun whatever was before?
    seen: int = 0
    first: tuple[int, int] | None = None
    kept: list = field(default_factory=list)

    def batch(self, k1, k2, ts, seq, clock, kind):
        """flow, lower, begins, gap (0 for none), head (its flow may depend on what was before the first batch)."""
        n, o, r = len(ts), self.open, self.rules
        new = np.ones(n, bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        key = (int(k1[0]), int(k2[0]))
        if o is not None and o.key != key:
            o = None
        new[0] = o is None
        before = np.concatenate([[o.last if o else LONG_AGO], ts[:-1]])
        was_reset = np.concatenate([[bool(o and o.reset)], kind[:-1] & RST > 0])
        hard = new | was_reset | (clock >= before + r.idle)
        alone = np.concatenate([[bool(o and o.packets == 1 and o.alone)], kind[:-1] & SYN_ALONE > 0])
        waited = ~hard & alone & (clock >= before + r.syn)

        starts = np.flatnonzero(hard)
        if not hard[0]:
            starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], n)
        fin = (kind & FIN > 0).astype(np.int64)
        closing, began = np.add.reduceat(fin, starts), ts[starts]
        if not hard[0]:
            closing[0] += o.fins
            began = np.concatenate([[o.start], began[1:]])
        split = (closing >= 2) | (clock[ends - 1] >= began + r.active) | np.logical_or.reduceat(waited, starts)
        begins, places = hard.copy(), np.flatnonzero(fin)
        for a, b in zip(starts[split].tolist(), ends[split].tolist()):
            at = a
            if not hard[a]:
                at = a + r.first_cut(o, clock[a:b], places[np.searchsorted(places, a):np.searchsorted(places, b)] - a)
            while at < b:
                begins[at] = True
                one = Open(key, int(ts[at]), 0, False, int(fin[at]), 1, bool(kind[at] & SYN_ALONE), int(ts[at]), False)
                k = np.searchsorted(places, at + 1)
                at += 1 + r.first_cut(one, clock[at + 1:b], places[k:np.searchsorted(places, b)] - at - 1) if at + 1 < b else 1

        row = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        flow, lower = seq[np.maximum(row, 0)], kind[np.maximum(row, 0)] & LOWER > 0
        if row[0] < 0:
            flow, lower = np.where(row < 0, o.flow, flow), np.where(row < 0, o.lower, lower)
        gap = np.where(begins, 0, ts - before)

        sure = hard.copy()
        if not self.seen:
            sure[0], self.first = False, key
        head = np.zeros(n, bool) if self.certain else np.cumsum(sure) == 0
        if not self.certain:
            self.certain = not head[-1]
            self.kept = [] if self.certain else [*self.kept, (ts, seq, clock, kind)]
        self.seen += n
        same = int(np.flatnonzero(new)[-1]) if new.any() else 0  # rows of the last key
        self.open = _after(None if new.any() else o, (int(k1[-1]), int(k2[-1])), n - same, int(row[-1]) - same if row[-1] >= 0 else -1,
                           ts[same:], seq[same:], kind[same:])
        return flow, lower, begins, gap, head

    def summary(self) -> Summary:
        if self.certain:
            return Summary(self.first, self.open)
        whole = tuple(np.concatenate(x) for x in zip(*self.kept))
        return Summary(self.first, self.open, whole, _finals(self.rules, whole[0], whole[2], whole[3]))


def _numbers(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in NUMBERS]


def _found(flow, lower, begins, gap) -> list[pa.Array]:
    return [pa.array(flow), pa.array(lower), pa.array(begins), pa.array(gap, mask=gap <= 0)]


def mark_flows(packets: DataFrame, p: Params) -> DataFrame:
    """Add _b_flow (seq of the flow's first packet), _b_lower (sent by the lower end of the key), _b_begins
    and _b_iat to packets, which have the columns NUMBERS. Rows with the same _b_k1 and _b_k2 are of one key."""
    spark, rules, given = packets.sparkSession, Rules.of(p), packets.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_b_k1", "_b_k2", "ts_us", "seq"]
    ranged = packets.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema.fields)
    names = [*given, *(x.split()[0] for x in OWN.split(", "))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, walk, none = TaskContext.get().partitionId(), Walk(rules), None
        for b in batches:
            if not (n := b.num_rows):
                continue
            at = walk.seen
            *found, head = walk.batch(*_numbers(b))
            none = b.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *_found(*found), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(head),
                 pa.nulls(n, pa.binary())], names=names)
        if walk.seen:  # one more row, which carries the summary of the range
            blob = pickle.dumps(walk.summary())
            yield pa.RecordBatch.from_arrays(
                [*none.columns, pa.array([0]), pa.array([False]), pa.array([False]), pa.nulls(1, pa.int64()),
                 pa.array([part], pa.int32()), pa.array([-1]), pa.array([False]), pa.array([blob], pa.binary())], names=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, starts = None, []
        for b in batches:
            for part, blob in zip(b.column("_b_part").to_pylist(), b.column("_b_summary")):
                s = pickle.loads(blob.as_py())
                if before is not None and before.key == s.first:
                    starts.append((part, pickle.dumps(before)))
                before = s.after(before, rules)
        if starts:
            part, state = zip(*starts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(state, pa.binary())], names=["part", "state"])

    local = materialise(ranged.mapInArrow(scan, f"{listed}, {OWN}"), "boundaries")
    summaries = local.where("_b_place < 0").select("_b_part", "_b_summary")
    folded = summaries.repartition(1).sortWithinPartitions("_b_part").mapInArrow(fold, "part int, state binary")
    states = {r["part"]: r["state"] for r in folded.collect()}  # at most one small row per range
    rows = local.where("_b_place >= 0")
    again = F.col("_b_head") & F.col("_b_part").isin(list(states))
    if not states:
        return rows.select(*given, "_b_flow", "_b_lower", "_b_begins", "_b_iat")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now = None, None
        for b in batches:
            part = b.column("_b_part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if part[lo] != now:
                    now = part[lo]
                    walk = Walk(rules, pickle.loads(states[int(now)]), certain=True)
                piece = b.slice(lo, hi - lo)
                *found, _ = walk.batch(*_numbers(piece))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in given), *_found(*found)], names=[*given, *(x.split()[0] for x in ADDED.split(", "))])

    mended = (rows.where(again).select(*given, "_b_part", "_b_place").repartition(parts, "_b_part")
              .sortWithinPartitions("_b_part", "_b_place").mapInArrow(mend, f"{listed}, {ADDED}"))
    return rows.where(~again).select(*mended.columns).unionByName(mended)
