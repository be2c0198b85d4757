"""Flow assembly on a stream: open flows as state of groups of keys, deadlines as event-time timers.

A stream has no capture-wide packet clock, so deadlines are judged on the packet's own
time and the watermark (``clock='deadline'`` of the batch operators).
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom import fixed_values as V
from packetloom.functions.payload import payload_entropy
from packetloom.operators.assembly import KEY, canonical_key, flow_features
from packetloom.params import Params


TIMER_US = 2_000  # how much later than the deadline a timer may be
GROUPS = 1_024    # groups of keys whose open flows are one state


@dataclass(slots=True)
class OpenFlow:
    """Running sums of one flow: the columns ``flow_sums`` produces in batch."""

    flow_id: int
    src: str
    sport: int
    dst: str
    dport: int
    start: int
    last: int
    last_seq: int = 0
    n: int = 0
    n_fwd: int = 0
    b_fwd: int = 0
    b_bwd: int = 0
    size_sq: int = 0
    size_min: int = 1 << 31
    size_max: int = 0
    iat_n: int = 0
    iat_us: int = 0
    iat_sq: float = 0.0
    iat_min: int = 1 << 62
    iat_max: int = 0
    bits: list[int] = field(default_factory=lambda: [0] * 6)
    fwd_syn: bool = False
    synack_at: tuple | None = None
    ack_at: tuple | None = None
    payload_sum: int = 0
    payload_n: int = 0
    entropy_sum: float = 0.0
    label: str = V.BENIGN

    def closed(self) -> bool:
        syn, ack, fin, rst, psh, urg = self.bits
        return rst > 0 or fin >= 2

    def deadline(self, p: Params) -> int:
        lone = self.n == 1 and self.fwd_syn
        return min(self.last + (p.syn_us if lone else p.idle_us), self.start + p.active_us)

    def absorb(self, x: Row) -> None:
        forward = x.src == self.src and x.sport == self.sport
        if self.n and x.ts_us > self.last:
            gap = x.ts_us - self.last
            self.iat_n += 1
            self.iat_us += gap
            self.iat_sq += (gap / 1e6) ** 2
            self.iat_min, self.iat_max = min(self.iat_min, gap), max(self.iat_max, gap)
        self.last, self.last_seq = max(self.last, x.ts_us), max(self.last_seq, x.seq)
        self.n += 1
        self.n_fwd += forward
        if forward:
            self.b_fwd += x.size
        else:
            self.b_bwd += x.size
        self.size_sq += x.size * x.size
        self.size_min, self.size_max = min(self.size_min, x.size), max(self.size_max, x.size)
        for i, bit in enumerate((V.SYN, V.ACK, V.FIN, V.RST, V.PSH, V.URG)):
            self.bits[i] += bool(x.flags & bit)
        syn, ack, at = x.flags & V.SYN, x.flags & V.ACK, (x.ts_us, x.seq)
        self.fwd_syn = self.fwd_syn or bool(forward and syn and not ack)
        if not forward and syn and ack and self.synack_at is None:
            self.synack_at = at
        if forward and ack:
            self.ack_at = at
        if x.payload_len:
            self.payload_sum += x.payload_len
            self.payload_n += 1
            self.entropy_sum += x.entropy
        if x.label != V.BENIGN:
            self.label = x.label

    def row(self, key: tuple, export_us: int) -> Row:
        at = lambda t: None if t is None else Row(ts_us=t[0], seq=t[1])
        syn, ack, fin, rst, psh, urg = self.bits
        return Row(
            capture_id=key[0], flow_id=self.flow_id, src=self.src, dst=self.dst,
            sport=self.sport, dport=self.dport, proto=key[5], start_us=self.start,
            end_us=self.last, last_seq=self.last_seq, n=self.n, n_fwd=self.n_fwd,
            b_fwd=self.b_fwd, b_bwd=self.b_bwd, size_sum=self.b_fwd + self.b_bwd,
            size_sq=self.size_sq, min_pkt_size=self.size_min, max_pkt_size=self.size_max,
            iat_n=self.iat_n, iat_us=self.iat_us, iat_sq=float(self.iat_sq),
            min_iat=self.iat_min / 1e6 if self.iat_n else 0.0, max_iat=self.iat_max / 1e6,
            syn_count=syn, ack_count=ack, fin_count=fin, rst_count=rst, psh_count=psh,
            urg_count=urg, fwd_syn=self.fwd_syn, synack_at=at(self.synack_at),
            ack_at=at(self.ack_at), payload_sum=self.payload_sum, payload_n=self.payload_n,
            entropy_sum=float(self.entropy_sum), label=self.label, export_us=export_us,
            ts=dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=export_us + TIMER_US))


_AT = "struct<ts_us:long,seq:long>"
SUMS = (
    "capture_id string, flow_id long, src string, dst string, sport int, dport int, proto string, "
    "start_us long, end_us long, last_seq long, n long, n_fwd long, b_fwd long, b_bwd long, "
    "size_sum long, size_sq long, min_pkt_size int, max_pkt_size int, iat_n long, iat_us long, "
    "iat_sq double, min_iat double, max_iat double, syn_count long, ack_count long, "
    "fin_count long, rst_count long, psh_count long, urg_count long, fwd_syn boolean, "
    f"synack_at {_AT}, ack_at {_AT}, payload_sum long, payload_n long, entropy_sum double, "
    "label string, export_us long")


class FlowProcessor(StatefulProcessor):
    """Open flows of one group of keys: a state, and a timer at the first of their deadlines.

    A call to the state store costs more than the packets of a usual flow, so many keys share one.
    """

    def __init__(self, p: Params):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "flows binary, alarm long")

    def _load(self) -> tuple[dict[tuple, OpenFlow], int | None]:
        held = self.open.get()
        return (pickle.loads(held[0]), held[1]) if held else ({}, None)

    def _due(self, flow: OpenFlow) -> int:
        return _alarm(flow.deadline(self.p))

    def _keep(self, flows: dict[tuple, OpenFlow], alarm: int | None, rung: bool = False) -> None:
        due = min(map(self._due, flows.values()), default=None)
        if due != alarm:
            if alarm is not None and not rung:
                self.handle.deleteTimer(alarm)
            if due is not None:
                self.handle.registerTimer(due)
        if flows:
            self.open.update((pickle.dumps(flows), due))
        elif alarm is not None:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        flows, alarm = self._load()
        packets: dict[tuple, list[Row]] = {}
        for x in rows:
            packets.setdefault(tuple(x[c] for c in KEY), []).append(x)
        for k, found in packets.items():
            flow = flows.pop(k, None)
            for x in sorted(found, key=lambda r: (r.ts_us, r.seq)):
                if flow and x.ts_us >= flow.deadline(self.p):
                    yield flow.row(k, max(flow.deadline(self.p), flow.last))
                    flow = None
                if flow is None:
                    flow = OpenFlow(x.seq, x.src, x.sport, x.dst, x.dport, x.ts_us, x.ts_us)
                flow.absorb(x)
                if flow.closed():
                    yield flow.row(k, flow.last)
                    flow = None
            if flow:
                flows[k] = flow
        self._keep(flows, alarm)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        flows, alarm = self._load()
        rung, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        over = [k for k, flow in flows.items() if self._due(flow) <= rung or self._due(flow) < passed]
        for k in over:
            flow = flows.pop(k)
            yield flow.row(k, max(flow.deadline(self.p), flow.last))
        self._keep(flows, alarm, rung=True)

    def close(self) -> None:
        pass


def _alarm(us: int) -> int:
    return us // 1000 + 1


def flow_stream(packets: DataFrame, p: Params = Params(), lateness: str = "10 seconds") -> DataFrame:
    """Streaming packets (with ``ts``) to exported flows with the 33 features.

    The flows carry an event time ``ts`` of their own, so that stateful operators can follow: the export
    time, later by the same moment for all. Timers count whole milliseconds, so a flow may come out
    that much after its deadline, which must not make it late.
    """
    slim = canonical_key(packets).withColumns({
        "payload_len": F.octet_length("payload"), "entropy": payload_entropy(F.col("payload")),
    }).drop("payload").withWatermark("ts", lateness)
    grouped = slim.withColumn("_group", F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)))
    sums = grouped.groupBy("_group").transformWithState(
        FlowProcessor(p), f"{SUMS}, ts timestamp", "append", "EventTime", eventTimeColumnName="ts")
    return flow_features(sums, extra=("export_us", "ts")).drop("_reset", "_finished", "_lone_syn")
