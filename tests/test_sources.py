import random
import struct

import pytest

from packetloom import schemas
from packetloom.functions.payload import payload_entropy, payload_entropy_arrow
from packetloom.sources import capture as source
from packetloom.sources.pcap import decode_frames, pcap_scan, pcap_stream, pcap_unsupported
from packetloom.sources.tables import Batches, dataset_read, dataset_write


def ipv4(proto, body, src="1.2.3.4", dst="5.6.7.8", options=0):
    head = bytes([0x45 + options]) + bytes(8) + bytes([proto]) + bytes(2)
    quad = lambda a: bytes(int(x) for x in a.split("."))
    return head + quad(src) + quad(dst) + bytes(4 * options) + body


def tcp(sport, dport, flags, payload=b"", options=0):
    return (struct.pack("!HH", sport, dport) + bytes(8) + bytes([(5 + options) << 4, flags]) + bytes(6)
            + bytes(4 * options) + payload)


def ether(packet, kind=0x0800, tags=()):
    vlan = b"".join(struct.pack("!HH", t, 7) for t in tags)
    return bytes(12) + vlan + struct.pack("!H", kind) + packet


def capture(frames, order="<", magic=0xA1B2C3D4, link=1, tail=b""):
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for sec, frac, frame in frames:
        out += struct.pack(f"{order}IIII", sec, frac, len(frame), len(frame) + 5) + frame
    return out + tail


def scan(spark, folder, **kw):
    return sorted(pcap_scan(spark, str(folder), **kw).collect(), key=lambda r: (r.capture_id, r.seq))


def test_header_fields(spark, tmp_path):
    frames = [
        (10, 5, ether(ipv4(6, tcp(1234, 443, 0xD2, b"hello", options=1), options=1))),
        (11, 6, ether(ipv4(17, struct.pack("!HHHH", 53, 9999, 0, 0) + b"q" * 300), tags=(0x8100,))),
        (12, 7, ether(ipv4(1, bytes([8, 0, 0, 0, 0, 0, 0, 0]) + b"ping"), tags=(0x88A8, 0x8100))),
        (13, 8, ether(ipv4(47, b"tunnel"))),
        (14, 9, ether(b"", kind=0x86DD)),
        (15, 9, ether(ipv4(6, b"short"))),
    ]
    (tmp_path / "a.pcap").write_bytes(capture(frames, tail=b"\x01\x02cut off"))
    rows = scan(spark, tmp_path)
    assert [(r.proto, r.sport, r.dport, r.flags) for r in rows] == [
        ("tcp", 1234, 443, 0x12), ("udp", 53, 9999, 0), ("icmp", 0, 8, 0), ("other", 0, 47, 0),
        ("other", 0, 6, 0)]
    assert bytes(rows[0].payload) == b"hello" and bytes(rows[1].payload) == b"q" * 256
    assert bytes(rows[2].payload) == b"ping" and bytes(rows[3].payload) == b""
    assert (rows[0].ts_us, rows[0].src, rows[0].dst) == (10_000_005, "1.2.3.4", "5.6.7.8")
    assert rows[0].size == len(frames[0][2]) + 5
    assert rows[0].asDict().keys() == set(schemas.PACKETS.names)


@pytest.mark.parametrize("order, magic, ticks", [
    ("<", 0xA1B23C4D, 1000), (">", 0xA1B2C3D4, 1), (">", 0xA1B23C4D, 1000)])
def test_byte_orders_and_clocks(spark, tmp_path, order, magic, ticks):
    raw = ipv4(6, tcp(1, 2, 2))
    (tmp_path / "a.pcap").write_bytes(capture([(3, 250 * ticks, raw)], order, magic, link=101))
    assert [(r.ts_us, r.sport) for r in scan(spark, tmp_path)] == [(3_000_250, 1)]


def test_unsupported_files_are_reported(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(40))
    (tmp_path / "b.pcap").write_bytes(capture([], link=105))
    (tmp_path / "c.pcap").write_bytes(capture([(1, 1, ether(ipv4(47, b"")))]))
    assert len(scan(spark, tmp_path)) == 1
    assert sorted(r.reason for r in pcap_unsupported(spark, str(tmp_path)).collect()) == [
        "link type 105 is not supported", "not a classic pcap file"]


def baited():
    """Payloads that look like record headers, to lead the search astray."""
    bait = struct.pack("<IIII", 5, 5, 30, 30) + bytes(30)
    return [(5, i, ether(ipv4(6, tcp(i % 60000, 80, 16, bait * (1 + i % 9))))) for i in range(150)]


def test_ranges_of_one_file_give_every_record_once(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(baited()))
    whole = scan(spark, tmp_path)
    assert len(whole) == 150 and whole == scan(spark, tmp_path, split_bytes=5000)


@pytest.mark.parametrize("order, seed", [("<", 1), (">", 2), ("<", 3)])
def test_records_are_found_from_anywhere(tmp_path, order, seed):
    """Every split of a file gives every record once, also where zeros and bait look like records."""
    rng = random.Random(seed)
    bait = struct.pack(f"{order}IIII", 5, 5, 30, 30)
    body = lambda: rng.choice([bytes(rng.randrange(200)), bait * rng.randrange(9), bait + bytes(30), rng.randbytes(rng.randrange(120))])
    frames = [(rng.randrange(2**32), rng.randrange(10**6), ether(ipv4(6, tcp(1, 2, 16, body())))) for _ in range(120)]
    raw = capture(frames, order, tail=b"\1" * rng.randrange(9))
    (file := tmp_path / "a.pcap").write_bytes(raw)
    want = [r.as_py() for b in source.packets(source.Range(str(file), 0, len(raw)), 600) for r in b.column("seq")]
    assert len(want) == 120
    for split in (97, 700, 2500):
        parts = source.cut({str(file): len(raw)}, split)
        assert [r.as_py() for p in parts for b in source.packets(p, 600) for r in b.column("seq")] == want


def test_a_chain_of_bait_across_records_is_seen_through(tmp_path):
    """Records written so that a false chain goes on from one payload into the next one."""
    frames, false = [], struct.pack("<IIII", 5, 5, 84, 84)
    for i in range(60):  # each payload holds one false header that ends at the one of the next record
        frames.append((9, i, bytes(20) + false + bytes(48)))
    raw = capture(frames, link=101)
    (file := tmp_path / "a.pcap").write_bytes(raw)
    buffered = source.Buffered(str(file), 100)
    for lo in range(400, len(raw) - 200, 37):
        data, base, at = buffered.range(lo, len(raw))
        assert (at - 24) % 100 == 0 and at + 100 > lo >= at and base == 24


def test_chains_that_end_do_not_send_the_search_to_the_start(tmp_path):
    """False chains of several hops, and records longer than they say they were on the wire."""
    false = struct.pack("<IIII", 5, 5, 684, 684)  # leads into the record seven further on
    raw = capture([], link=101)
    for i in range(900):
        frame = bytes(20) + (false if i % 40 < 35 else b"\xff" * 16) + bytes(48)
        raw += struct.pack("<IIII", 9, i, 84, 40 if i % 3 else 90) + frame
    (file := tmp_path / "a.pcap").write_bytes(raw)
    buffered = source.Buffered(str(file), 700)
    for lo in range(30_000, len(raw) - 200, 1717):
        data, base, at = buffered.range(lo, len(raw))
        assert (at - 24) % 100 == 0 and at + 100 > lo >= at and base >= lo - 32 * 716 and len(data) <= 33 * 716


def test_a_range_is_held_in_blocks(tmp_path, monkeypatch):
    raw = capture(baited())
    (file := tmp_path / "a.pcap").write_bytes(raw)
    seqs = lambda lo: [r.as_py() for b in source.packets(source.Range(str(file), lo, len(raw)), 600) for r in b.column("seq")]
    want = seqs(0), seqs(9_000)
    asked, read = [], source.Buffered.bytes
    monkeypatch.setattr(source, "BLOCK", 100)  # less than a record
    monkeypatch.setattr(source.Buffered, "bytes", lambda f, a, b: asked.append(b - a) or read(f, a, b))
    assert (seqs(0), seqs(9_000)) == want and len(want[0]) == 150
    assert max(asked) <= 33 * 616


def test_decoding_in_numpy_equals_column_expressions(spark, tmp_path):
    rng = random.Random(4)
    frames = []
    for i in range(300):
        ip = ipv4(rng.choice([1, 6, 17, 47]), rng.randbytes(rng.randrange(60)), f"{i % 256}.2.3.4", options=rng.randrange(3))
        whole = ether(ip, rng.choice([0x0800, 0x0800, 0x86DD]), rng.choice([(), (0x8100,), (0x88A8, 0x8100)]))
        frames.append((i, i, whole[:rng.choice([len(whole), rng.randrange(len(whole))])]))
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    at, rows = 24, []
    for i, _, f in frames:
        rows.append(("a", at, i * 1_000_001, len(f) + 5, 1, bytearray(f)))
        at += 16 + len(f)
    plain = decode_frames(spark.createDataFrame(rows, "path string, seq long, ts_us long, wire int, link int, frame binary"))
    names = [c for c in schemas.PACKETS.names if c != "capture_id"]
    assert sorted(plain.select(names).collect()) == sorted(pcap_scan(spark, str(tmp_path)).select(names).collect())


def test_patterns_folders_and_hidden_files(spark, tmp_path):
    one = capture([(3, 250, ether(ipv4(6, tcp(1, 2, 2))))])
    for name in ("a.pcap", "b.cap", ".c.pcap", "_d.pcap", "sub/e.pcap"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(one)
    found = lambda path: sorted(r.capture_id.rsplit("/", 1)[1] for r in pcap_scan(spark, path).collect())
    assert found(str(tmp_path)) == ["a.pcap", "b.cap", "e.pcap"]
    assert found(f"{tmp_path}/*.pcap") == ["a.pcap", "e.pcap"] and found(f"file://{tmp_path}/b.cap") == ["b.cap"]


def test_a_stream_follows_a_capture_that_grows(spark, tmp_path):
    frames = baited()
    raw, folder = capture(frames), tmp_path / "in"
    folder.mkdir()
    seen = []
    for k, size in enumerate((10, 400, 2_000, 2_001, 20_000, len(raw))):  # cut in headers and frames
        (folder / "a.pcap").write_bytes(raw[:size])
        query = (pcap_stream(spark, str(folder), 3000).select("seq").writeStream.format("parquet")
                 .option("checkpointLocation", str(tmp_path / "ckpt")).option("path", str(tmp_path / "out"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        seen.append(spark.read.schema("seq long").parquet(str(tmp_path / "out")).count())
    want = sorted(r.seq for r in scan(spark, folder))
    assert sorted(r.seq for r in spark.read.schema("seq long").parquet(str(tmp_path / "out")).collect()) == want
    assert len(want) == 150 and seen[0] == 0 and seen == sorted(seen) and seen[4] > seen[3]


def test_entropy(spark):
    cases = [b"a" * 256, bytes(range(256)), b"", b"abab"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, p binary")
    both = df.select("i", payload_entropy(df.p).alias("a"), payload_entropy_arrow(df.p).alias("b"))
    got = {r.i: (r.a, r.b) for r in both.collect()}
    for i, want in enumerate([0.0, 1.0, 0.0, 1 / 8]):
        assert got[i] == (pytest.approx(want), pytest.approx(want))


def test_dataset_refuses_another_feature_list(spark, tmp_path):
    df = spark.createDataFrame([("BENIGN", 1.0, 2.0)], "label string, a double, b double")
    dataset_write(df, str(tmp_path / "d"), ("a", "b"))
    assert dataset_read(spark, str(tmp_path / "d"), ("a", "b")).count() == 1
    with pytest.raises(ValueError):
        dataset_read(spark, str(tmp_path / "d"), ("b", "a"))


def test_a_batch_that_runs_again_replaces_its_own_rows(spark, tmp_path):
    t = Batches(spark, str(tmp_path / "t"))
    assert t.read() is None and t.last() is None
    t.write(spark.range(3), 0)
    t.write(spark.range(9), 1)  # half done, say
    t.write(t.last(before=1).limit(2), 1)
    assert t.read().count() == 5 and t.last().count() == 2 and t.read(before=1).count() == 3


def test_captures_of_one_name_in_two_folders_differ(spark, tmp_path):
    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "x.pcap").write_bytes(capture([(3, 250, ether(ipv4(6, tcp(1, 2, 2))))]))
    assert len({r.capture_id for day in ("day1", "day2") for r in scan(spark, tmp_path / day)}) == 2
