import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from model import packet_frame
from test_assembly import random_capture
from packetloom import fixed_values as V
from packetloom.functions import scalars as S
from packetloom.operators.assembly import assemble_flows
from packetloom.operators.host_arrays import Hosts
from packetloom.operators.host_state import DestinationState, SourceState, seen
from packetloom.params import SECOND, Params
from packetloom.plans.registry import landed, stream_of
from packetloom.streaming.flow_stream import flow_stream
from packetloom.streaming.sinks import run_to_end


def test_flow_stream_equals_batch_on_the_same_files(spark):
    packets = packet_frame(spark, random_capture(5, 120))
    batch = assemble_flows(packets, clock="deadline")
    path = landed(packets, "stream-test")
    out = spark.read.parquet(run_to_end(flow_stream(stream_of(packets, path)), "stream-out"))
    names = ["flow_id", "src", "dst", "start_us", "end_us", "export_us", "label",
             *[F.round(n, 6).alias(n) for n in V.FLOW_FEATURES]]
    a = batch.select(*names)
    b = out.where("flow_id >= 0").select(*names)
    assert a.count() == b.count() > 20
    assert a.exceptAll(b).count() == 0


def test_many_keys_share_a_state(spark, monkeypatch):
    """Also with all keys in three groups every flow comes out once, whatever its neighbours do."""
    from packetloom.streaming import flow_stream as module
    monkeypatch.setattr(module, "GROUPS", 3)
    packets = packet_frame(spark, random_capture(8, 90))
    names = ["flow_id", "start_us", "end_us", "export_us", *[F.round(n, 6).alias(n) for n in V.FLOW_FEATURES]]
    batch = assemble_flows(packets, clock="deadline").select(*names)
    out = spark.read.parquet(run_to_end(flow_stream(stream_of(packets, landed(packets, "groups"))), "groups-out"))
    got = out.where("flow_id >= 0").select(*names)
    assert sorted(got.collect()) == sorted(batch.collect()) and got.count() > 20


class Calls:
    """A state store that counts what is asked of it."""

    def __init__(self):
        self.n, self.held = 0, None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.n += 1
        return self.held

    def exists(self):
        self.n += 1
        return self.held is not None

    def update(self, value):
        self.n, self.held = self.n + 1, value

    def clear(self):
        self.n, self.held = self.n + 1, None

    def registerTimer(self, at):
        self.n += 1

    deleteTimer = registerTimer


def test_calls_to_the_state_store_do_not_grow_with_keys():
    from packetloom.streaming.flow_stream import FlowProcessor
    store, processor = Calls(), FlowProcessor(Params())
    processor.init(store)
    row = lambda i: Row(capture_id="c", key_lo="a", key_hi="b", key_lo_port=1, key_hi_port=i, proto="udp", src="a", dst="b",
                        sport=1, dport=i, seq=i, ts_us=i, size=60, flags=0, payload_len=0, entropy=0.0, label=V.BENIGN)
    assert not list(processor.handleInputRows((0,), iter([row(i) for i in range(200)]), None))
    assert store.n <= 5

    class Now:
        getExpiryTimeInMs = lambda self: 15_001
        getCurrentWatermarkInMs = lambda self: 99_999

    flows = list(processor.handleExpiredTimer((0,), Now(), Now()))
    assert sorted(f.flow_id for f in flows) == list(range(200)) and store.held is None and store.n <= 10


FLOW = ("capture_id string, seq long, src string, dst string, dport int, start_us long, end_us long, "
        "had_syn boolean, handshake boolean, bytes_out long, bytes_in long, new_pair boolean, note double")
RECORD = [f.split()[0] for f in FLOW.split(", ")]


def random_flows(seed, n, hosts, first=0, us=200_000):
    """Flows in order of time, some at the same moment; ports, handshakes and starts may be null."""
    r, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += r.choice((0, us, 3 * us, 40 * us))
        at += r.choice((0, 70 * SECOND)) if r.random() < 0.02 else 0
        out.append((r.choice(("c1", "c2")), 2 ** 60 + first + i, f"h{r.randrange(hosts)}", r.choice(("a", "b", "c")),
                    r.choice((80, 443, None)), None if r.random() < 0.1 else at - r.randrange(SECOND), at,
                    r.random() < 0.6, r.choice((True, False, None)), r.randrange(9_000), r.randrange(3) * 400,
                    r.random() < 0.3, r.choice((None, float("nan"), 0.5))))
    return [Row(*RECORD)(*x) for x in out]


def walked(flows, side, p=Params()):
    """Features by seq, by the plain walk over the flows in the order in which they stand."""
    make, own, peer = ((SourceState, "src", "dst") if side == "src" else (DestinationState, "dst", "src"))
    states, out = {}, {}
    for x in flows:
        state = states.setdefault((x.capture_id, x[own]), make(p))
        out[x.seq] = state.observe(seen(x if x.start_us is not None else Row(**{**x.asDict(), "start_us": x.end_us}), peer))
    return out


def arrays(flows, side):
    own, peer = ("src", "dst") if side == "src" else ("dst", "src")
    rows = [(x.capture_id, x[own], x[peer], *seen(x, peer)[2:3], *seen(x, peer)[:1], *seen(x, peer)[3:]) for x in flows]
    names = ("capture", "host", "peer", "port", "at", "syn", "failed", "out", "into", "us", "new")
    return {n: np.array([*c], object if n in names[:3] else np.int64) for n, c in zip(names, zip(*rows))}


@pytest.mark.parametrize("side", ["src", "dst"])
def test_hosts_walked_at_once_equal_the_walk_of_each(side):
    """Over batches whose first flows are older than the last of the batch before."""
    for seed in range(12):
        flows = [x for x in random_flows(seed, 160, 3, us=(1, 200_000, SECOND)[seed % 3]) if x.dport and x.start_us is not None]
        for i in range(20, len(flows) - 5, 40):
            flows[i], flows[i + 1], flows[i + 4] = flows[i + 4], flows[i], flows[i + 1]
        hosts, got = Hosts(Params(), side, 60), {}
        for i in range(0, len(flows), 40):
            batch = sorted(flows[i:i + 40], key=lambda x: (x.capture_id, x[side]))
            got |= dict(zip([x.seq for x in batch], hosts.observe(arrays(batch, side))))
        want = walked(flows, side)
        for x in flows:
            assert got[x.seq] == pytest.approx(want[x.seq], abs=1e-12), (seed, x)


@pytest.mark.parametrize("side", ["src", "dst"])
def test_host_profile_stream_equals_the_walk(spark, monkeypatch, side):
    """With all hosts in three groups; the columns of the flows come back as they were."""
    from packetloom.streaming import host_stream as module
    monkeypatch.setattr(module, "GROUPS", 3)
    flows = random_flows(4, 300, 9)
    rows = spark.createDataFrame(flows, FLOW)
    feed = stream_of(rows, landed(rows, "profile")).withWatermark("ts", "1 hour")
    out = spark.read.parquet(run_to_end(module.host_profile_stream(feed, side), "profile-out")).where("seq >= 0")
    names = V.HOST_FEATURES if side == "src" else V.DST_FEATURES
    assert out.columns == [*RECORD, "ts", *names]
    got, want = out.collect(), walked(flows, side)
    assert sorted(map(repr, (r[:len(RECORD)] for r in got))) == sorted(map(repr, (x[:] for x in flows)))
    for r in got:
        assert micros(r.ts) == r.end_us and r[-len(names):] == pytest.approx(want[r.seq], abs=1e-12)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_to_the_state_store_do_not_grow_with_hosts():
    from pyspark.sql import types as T
    from packetloom.streaming.host_stream import ProfileProcessor, _Packed
    packed = _Packed(T.StructType.fromDDL(FLOW).fields)
    number = {"had_syn": 1, "handshake": 0, "new_pair": 0, "dport": 80, "bytes_out": 5, "bytes_in": 5}

    def frame(at, hosts):
        whole = lambda h: np.array([{"seq": h, "start_us": at, "end_us": at + h, **number}[c] for c in packed.whole] + [0])
        return pd.DataFrame({"group": 0, "whole": [whole(h) for h in hosts], "capture_id": "c", "src": [f"h{h}" for h in hosts],
                             "dst": "b", "note": 0.5, "ts": 0})

    sent = ["group", "packetloom_whole", "capture_id", "src", "dst", "note", "ts"]
    store, processor = Calls(), ProfileProcessor(Params(), "src", packed, sent, ["end_us", "seq"])
    processor.init(store)
    many = pd.concat(processor.handleInputRows((0,), iter([frame(0, range(200)), frame(0, range(200, 400))]), Clock(0)))
    assert list(many["host_flows_60s"]) == [1.0] * 400 and store.n <= 5
    again = pd.concat(processor.handleInputRows((0,), iter([frame(SECOND, range(100))]), Clock(0)))
    assert list(again["host_flows_60s"]) == [2.0] * 100 and store.n <= 10
    # each host is forgotten once its own windows are empty, the state with the last of them
    assert not list(processor.handleExpiredTimer((0,), Clock(60_003), None)) and store.held is not None
    late = pd.concat(processor.handleInputRows((0,), iter([frame(2 * SECOND, (50, 350))]), Clock(60_003)))
    assert list(late["host_flows_60s"]) == [3.0, 1.0]
    assert not list(processor.handleExpiredTimer((0,), Clock(99_999), None)) and store.held is None


def test_packets_to_incidents_in_one_query(spark):
    """The chained stream equals batch flows and sessions counted in plain Python, on three captures."""
    from packetloom.plans.flagship import rule_alerts
    from packetloom.streaming.sinks import packets_to_incidents_stream
    parts = [packet_frame(spark, random_capture(seed, 90)).withColumn("capture_id", F.lit(f"c{seed}")) for seed in (5, 6, 7)]
    packets = parts[0].unionByName(parts[1]).unionByName(parts[2])
    p = Params(base_threshold=0.7, min_threshold=0.7)
    alerts_of = lambda flows: rule_alerts(flows, p)
    alerts = alerts_of(assemble_flows(packets, p, "deadline")).withColumn("dedup_key", S.dedup_key()).collect()
    want, last = {}, {}
    for a in sorted(alerts, key=lambda a: (a.at_us, a.seq)):
        key = (a.capture_id, a.dedup_key)
        if key not in last or a.at_us - want[last[key]][2] > p.dedup_s * 1_000_000:
            last[key] = (*key, a.at_us)
            want[last[key]] = [0, 0, a.at_us]
        w = want[last[key]]
        want[last[key]] = [w[0] + 1, w[1] + a.bytes, a.at_us]
    counts = {}
    feed = stream_of(packets, landed(packets, "chain-test"))
    out = spark.read.parquet(run_to_end(packets_to_incidents_stream(feed, alerts_of, p), "chain-out", counts=counts))
    got = {(r.capture_id, r.dedup_key, micros(r.first_seen)): [r.occurrences, r.total_bytes, micros(r.last_seen)]
           for r in out.collect() if micros(r.first_seen) < 10 ** 10}
    assert got == {k: v for k, v in want.items()} and len(got) > 20 and counts["late"] == 0


def micros(t):
    return round(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
