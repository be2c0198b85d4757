import random

import numpy as np
import pytest

from model import ACK, FIN, PSH, RST, SYN, event_loop, packet, packet_frame
from packetloom import fixed_values as V
from packetloom.operators import boundaries
from packetloom.operators.assembly import assemble_flows, flow_boundaries
from packetloom.params import Params


def flows(spark, packets, **kw):
    out = assemble_flows(packet_frame(spark, packets), kw.pop("p", Params()), **kw)
    return sorted(out.collect(), key=lambda r: r.flow_id)


def back(t, flags, **kw):
    return packet(t, "b", "a", 80, 1000, flags, **kw)


def test_two_directions_make_one_flow(spark):
    rows = flows(spark, [packet(0, flags=SYN), back(.1, SYN | ACK), packet(.2, flags=ACK)])
    assert len(rows) == 1
    f = rows[0]
    assert (f.fwd_packets, f.bwd_packets, f.handshake_complete) == (2, 1, 1)
    assert (f.src, f.dport, f.syn_count, f.ack_count) == ("a", 80, 2, 2)


def test_lone_syn_has_no_handshake(spark):
    f = flows(spark, [packet(0, flags=SYN)])[0]
    assert (f.handshake_complete, f.syn_count, f.total_packets) == (0, 1, 1)
    assert f.pkts_per_sec == 1000  # a zero-length flow is charged one millisecond


def test_reset_exports_and_the_next_packet_opens_a_flow(spark):
    rows = flows(spark, [packet(0, flags=SYN), back(1, RST | ACK), back(2, PSH)])
    assert [r.total_packets for r in rows] == [2, 1]
    assert rows[0].export_us == 1_000_000
    assert rows[1].src == "b"


def test_second_fin_closes_in_either_direction(spark):
    rows = flows(spark, [packet(0, flags=ACK), packet(1, flags=FIN), packet(2, flags=FIN),
                         packet(3, flags=ACK)])
    assert [r.total_packets for r in rows] == [3, 1]


@pytest.mark.parametrize("clock_s, exported", [(2.9, False), (3.1, True)])
def test_syn_timeout_needs_the_clock(spark, clock_s, exported):
    other = [packet(clock_s, "x", "y", 5, 6)]
    f = flows(spark, [packet(0, flags=SYN), *other, packet(2.95 if not exported else 3.2, "x", "y", 5, 6)])[0]
    assert f.export_us == (3_100_000 if exported else 2_950_000)


def test_a_silence_alone_does_not_split(spark):
    # nothing else was seen in between, so the late packet is still absorbed
    assert len(flows(spark, [packet(0, flags=ACK), packet(40, flags=ACK)])) == 1
    seen = [packet(0, flags=ACK), packet(20, "x", "y", 5, 6), packet(40, flags=ACK)]
    assert len(flows(spark, seen)) == 3
    alone = [packet(0, flags=ACK), packet(40, flags=ACK)]
    assert len(flows(spark, alone, clock="deadline")) == 2


def test_features_are_the_fixed_list(spark):
    f = flows(spark, [packet(0, payload=bytes(range(256)), label="PORT_SCAN"), packet(1)])[0]
    assert set(V.FLOW_FEATURES) <= set(f.asDict())
    assert len(set(V.FEATURES)) == 52
    assert f.payload_entropy == pytest.approx(1.0)
    assert f.empty_payload_ratio == 0.5
    assert f.label == "PORT_SCAN"


def random_capture(seed, n=160):
    rng = random.Random(seed)
    t, out = 0.0, []
    for _ in range(n):
        t += rng.choice([0, .01, .4, 1, 2.9, 3, 4, 14, 15, 16, 50])
        a, b, flip = rng.choice("ab"), rng.choice("xy"), rng.random() < .4
        ends = (b, a, 80, 1000) if flip else (a, b, 1000, 80)
        flags = rng.choice([SYN, SYN, SYN | ACK, ACK, ACK, PSH | ACK, FIN | ACK, FIN, RST])
        out.append(packet(t, *ends, flags=flags, label=rng.choice(["BENIGN", "DOS_FLOOD"])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_event_loop_on_random_captures(spark, seed):
    packets = random_capture(seed)
    got = [(r.flow_id, int(r.total_packets), r.start_us, r.end_us, r.export_us)
           for r in flows(spark, packets)]
    assert got == event_loop(packets)


def one_key(seed, n=500):
    """Packets of one key without a pause, so that ranges have no certain begin of a flow."""
    rng = random.Random(seed)
    t, out = 0.0, []
    for _ in range(n):
        t += rng.choice([0, .5, 2.9, 3, 9, 14])
        flags = rng.choice([ACK] * 30 + [SYN, FIN, SYN | FIN] + [RST] * (seed % 2))
        out.append(packet(t, *(("b", "a", 80, 1000) if rng.random() < .4 else ()), flags=flags))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("parts", [3, 40])
def test_ranges_of_one_key_pass_on_their_open_flow(spark, seed, parts):
    packets = one_key(seed) if seed < 4 else random_capture(seed, 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = flow_boundaries(packet_frame(spark, packets), Params()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    flows, last = {}, {}
    for r in sorted(got, key=lambda r: r.seq):
        f = flows.setdefault(r.flow_id, [0, r.ts_us, r.src, r.sport])
        f[0] += 1
        assert (r.init_src, r.init_sport) == tuple(f[2:])
        key = (r.key_lo, r.key_hi, r.key_lo_port, r.key_hi_port)
        gap = r.ts_us - last.get(key, r.ts_us)
        assert r.iat_us == (gap if r.seq != r.flow_id and gap > 0 else None)
        last[key] = r.ts_us
    assert [(k, n, s) for k, (n, s, *_) in sorted(flows.items())] == [x[:3] for x in event_loop(packets)]


def test_summaries_compose():
    """Walking a key in pieces from the summaries' states equals walking it whole."""
    rng = np.random.default_rng(3)
    rules = boundaries.Rules.of(Params())
    for turn in range(60):
        n = int(rng.integers(2, 400))
        ts = np.cumsum(rng.choice([0, 400_000, 2_900_000, 3_000_000, 9_000_000], n))
        clock = np.concatenate([[boundaries.LONG_AGO], ts[:-1]])
        kind = rng.choice([0] * 20 + [1, 2, 3, 8, 10], n).astype(np.int64)
        columns = (np.zeros(n, np.int64), np.zeros(n, np.int64), ts, np.arange(n), clock, kind)
        whole = boundaries.Walk(rules).batch(*columns)[0]
        cuts = [0, *sorted(rng.choice(np.arange(1, n), min(n - 1, 5), replace=False).tolist()), n]
        state, flows = None, []
        for a, b in zip(cuts, cuts[1:]):
            piece = [c[a:b] for c in columns]
            flows += boundaries.Walk(rules, state, certain=True).batch(*piece)[0].tolist()
            guess = boundaries.Walk(rules)
            for lo, hi in ((a, (a + b) // 2), ((a + b) // 2, b)):
                if hi > lo:
                    guess.batch(*[c[lo:hi] for c in columns])
            state = guess.summary().after(state, rules)
        assert flows == whole.tolist()
