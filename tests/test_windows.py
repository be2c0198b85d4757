import random

import pytest
from pyspark.sql import functions as F

from model import S, strict_windows
from packetloom import fixed_values as V
from packetloom.operators import windows as WN
from packetloom.operators.host_state import ContactWindow, strict_features
from packetloom.params import Params

COLUMNS = ("capture_id string, seq long, src string, dst string, dport int, start_us long, "
           "end_us long, had_syn boolean, handshake boolean, bytes_out long, bytes_in long")


def flow(t, src="h", dst="v", dport=80, syn=True, shake=False, out=10, back=3):
    return dict(capture_id="c", src=src, dst=dst, dport=dport, start_us=round(t * S) - 1000,
                end_us=round(t * S), had_syn=syn, handshake=shake, bytes_out=out, bytes_in=back)


def frame(spark, flows):
    flows = sorted(flows, key=lambda f: f["end_us"])
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [tuple(dict(f, seq=i)[n] for n in names) for i, f in enumerate(flows)]
    return WN.new_pair_flag(spark.createDataFrame(rows, COLUMNS)), flows


def features(spark, flows, p=Params()):
    df, _ = frame(spark, flows)
    return sorted(WN.behaviour_features(df, p).collect(), key=lambda r: r.seq)


def test_scan_is_seen_at_the_source(spark):
    rows = features(spark, [flow(i / 100, dport=i) for i in range(1, 60)])
    assert rows[-1].host_distinct_dport_10s == 59
    assert rows[-1].host_failed_handshake_ratio_10s == 1.0
    assert rows[-1].host_new_pair_ratio_60s == 1.0


def test_flood_is_seen_at_the_victim(spark):
    rows = features(spark, [flow(i / 50, src=f"s{i}") for i in range(80)])
    assert rows[-1].dst_distinct_src_10s == 80
    assert rows[-1].host_flows_10s == 1


def test_beacons(spark):
    steady = features(spark, [flow(30 * i) for i in range(10)])
    assert steady[-1].host_beacon_regularity == pytest.approx(1.0)
    jumpy = features(spark, [flow(t) for t in (0, 3, 40, 41, 90, 140, 141, 142)])
    assert jumpy[-1].host_beacon_regularity < 0.5


def test_window_returns_to_one(spark):
    w = ContactWindow(60 * S)
    for i in range(50):
        w.add((i * S, "v", i % 7, True, True, 1, 1, 0, False))
    w.add((10_000 * S, "v", 1, True, True, 1, 1, 0, False))
    assert (len(w.rows), len(w.peers), len(w.ports), w.busiest, w.sums[1]) == (1, 1, 1, 1, 1)


def traffic(seed, n=220):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([.001, .5, 1, 2, 9.999, 10, 20, 59, 61])
        out.append(flow(t + i * 1e-5, src=rng.choice("hk"), dst=rng.choice("vwxyz"),
                        dport=rng.choice([22, 53, 80]), syn=rng.random() < .6,
                        shake=rng.random() < .5, out=rng.randrange(1000), back=rng.randrange(9)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_event_time_and_strict_walk_agree_without_ties(spark, seed):
    df, flows = frame(spark, traffic(seed))
    wide = {r.seq: r for r in WN.behaviour_features(df).collect()}
    strict = strict_features(strict_features(df, WN.ORDER, "src"), WN.ORDER, "dst").collect()
    for r in strict:
        for name in V.HOST_FEATURES + V.DST_FEATURES:
            assert wide[r.seq][name] == pytest.approx(r[name], abs=1e-9), (name, r.seq)
    scan = strict_windows(flows, 60 * S, "src", "dst")
    assert [(wide[i].host_flows_60s, wide[i].host_distinct_dst_60s) for i in range(len(scan))] == scan


@pytest.mark.parametrize("seed", range(2))
def test_layout_does_not_change_results(spark, seed):
    df, _ = frame(spark, traffic(seed + 10))
    tiny = Params(slice_s=61, group_rows=3)
    names = [*V.HOST_FEATURES, *V.DST_FEATURES]
    wide = WN.behaviour_features(df).select("seq", *names)
    sliced = WN.behaviour_features(df, tiny).select("seq", *names)
    rounded = lambda d: d.select("seq", *[F.round(n, 9).alias(n) for n in names])
    assert rounded(wide).exceptAll(rounded(sliced)).count() == 0
    folded = strict_features(df, WN.ORDER, "src", tiny).select("seq", *V.HOST_FEATURES)
    plain = strict_features(df, WN.ORDER, "src").select("seq", *V.HOST_FEATURES)
    assert plain.exceptAll(folded).count() == 0


def test_ties_see_each_other(spark):
    df, _ = frame(spark, [flow(1, dport=1), flow(1, dport=2), flow(1, dport=2)])
    rows = WN.behaviour_features(df).collect()
    assert {r.host_flows_10s for r in rows} == {3.0}
    assert {r.host_distinct_dport_10s for r in rows} == {2.0}
    assert {r.host_dst_repeat_max_60s for r in rows} == {2.0}


def test_a_key_with_most_rows_is_cut_by_density(spark):
    """One host has 90 % of the flows, all in one burst: the scans' ranges stay even, the counts right."""
    rng = random.Random(2)
    flows = [flow(50 + rng.random() * 5, src="hot" if i % 10 else f"h{i}", dst=rng.choice("vwxyz"), dport=rng.randrange(4))
             for i in range(3_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df, ordered = frame(spark, flows)
        tables = [WN.source_sums(df), WN.source_distinct(df), WN.source_pair_repeat(df)]
        for t in tables:
            sizes = [r["count"] for r in t.groupBy(F.input_file_name()).count().collect()]
            # of eight ranges about three hold arrivals, which are asked for, and the others departures
            assert max(sizes) <= 0.45 * sum(sizes) and len(sizes) >= 3
        sums, distinct, repeat = ({(r.src, r.end_us): r for r in t.collect()} for t in tables)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for f in rng.sample(ordered, 60):
        seen = [g for g in ordered if g["src"] == f["src"] and f["end_us"] - 10 * S <= g["end_us"] <= f["end_us"]]
        key = (f["src"], f["end_us"])
        pairs = [(g["dst"], g["dport"]) for g in seen]
        assert sums[key].host_flows_10s == len(seen) and distinct[key].host_distinct_dst_10s == len({g["dst"] for g in seen})
        assert repeat[key].host_dst_repeat_max_60s == max(map(pairs.count, pairs))
