"""Packets to bidirectional flows.

Packets get the time of the packet before them in their capture, whatever its key, and are walked
in order of key and time (`boundaries`); a flow is named by the sequence number of its first
packet. Sums per flow give the features, and the capture's clock tells when a flow is exported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom import fixed_values as V
from packetloom.functions import scalars as S
from packetloom.functions.payload import payload_entropy_arrow
from packetloom.operators import boundaries as B
from packetloom.operators.clocks import export_clock
from packetloom.operators.prefix import Before, prefix_scan
from packetloom.params import Params
from packetloom.session import materialise

KEY = ["capture_id", "key_lo", "key_hi", "key_lo_port", "key_hi_port", "proto"]
ORDER = ["ts_us", "seq"]


def canonical_key(packets: DataFrame) -> DataFrame:
    return packets.withColumns(S.canonical_columns())


def flow_boundaries(packets: DataFrame, p: Params = Params(), clock: str = "capture") -> DataFrame:
    """Add ``flow_id``, the flow's initiator and ``iat_us`` to every packet.

    ``capture`` cuts a flow only once some packet of the capture has passed its deadline,
    ``deadline`` by the packet's own time.
    """
    if clock == "capture":
        clocked = prefix_scan(packets, ORDER, ["capture_id"], _b_clock=Before(F.col("ts_us")))
    elif clock == "deadline":
        clocked = packets.withColumn("_b_clock", F.col("ts_us"))
    else:
        raise ValueError("clock must be 'capture' or 'deadline'")
    flags, bit = F.coalesce("flags", F.lit(0)), lambda on, value: F.when(on, F.lit(value)).otherwise(F.lit(0))
    kind = (bit(S.has_flag(flags, V.SYN) & ~S.has_flag(flags, V.ACK), B.SYN_ALONE) + bit(S.has_flag(flags, V.FIN), B.FIN)
            + bit(S.has_flag(flags, V.RST), B.RST) + bit(S.lower_end_is_source(), B.LOWER))
    keyed = canonical_key(clocked).withColumns({
        "_b_k1": F.xxhash64(*KEY), "_b_k2": F.xxhash64(F.lit(1), *KEY), "_b_kind": kind,
        "_b_clock": F.coalesce("_b_clock", F.lit(B.LONG_AGO))})
    marked = B.mark_flows(keyed, p)
    end = lambda low, high: F.when(F.col("_b_lower"), F.col(low)).otherwise(F.col(high))
    return marked.select(
        *packets.columns, *[k for k in KEY if k not in packets.columns], F.col("_b_flow").alias("flow_id"),
        end("key_lo", "key_hi").alias("init_src"), end("key_lo_port", "key_hi_port").alias("init_sport"),
        end("key_hi", "key_lo").alias("init_dst"), end("key_hi_port", "key_lo_port").alias("init_dport"),
        F.col("_b_iat").alias("iat_us"))


def flow_direction(bounded: DataFrame) -> DataFrame:
    return bounded.withColumn(
        "forward",
        (F.col("src") == F.col("init_src")) & (F.col("sport") == F.col("init_sport")))


def moments(prefix: str, n: str, total: Column, squares: str) -> dict[str, Column]:
    """Mean and population deviation from sums."""
    mean = F.coalesce(S.safe_div(total, F.col(n)), F.lit(0.0))
    var = F.coalesce(S.safe_div(F.col(squares), F.col(n)), F.lit(0.0)) - mean * mean
    std = F.when(F.col(n) < 2, 0.0).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return {f"mean_{prefix}": mean, f"std_{prefix}": std}


def measured(packets: DataFrame) -> DataFrame:
    """Length and entropy in place of the payload, so that no shuffle carries it."""
    if "payload" not in packets.columns:
        return packets
    return packets.withColumns({
        "payload_len": F.octet_length("payload").cast("long"),
        "entropy": payload_entropy_arrow("payload")}).drop("payload")


def flow_sums(directed: DataFrame) -> DataFrame:
    """One aggregate per flow: everything the features and the clock need."""
    fwd, flags = F.col("forward"), F.col("flags")
    bit = lambda b: S.has_flag(flags, b)
    size = F.col("size").cast("long")
    length = F.col("payload_len")
    iat = S.seconds(F.col("iat_us"))
    at = F.struct(*ORDER)
    some = length > 0
    flag_sums = {
        name: S.count_if(bit(b)) for name, b in (
            ("syn_count", V.SYN), ("ack_count", V.ACK), ("fin_count", V.FIN),
            ("rst_count", V.RST), ("psh_count", V.PSH), ("urg_count", V.URG))}
    aggs = {
        "src": F.first("init_src"), "dst": F.first("init_dst"),
        "sport": F.first("init_sport"), "dport": F.first("init_dport"),
        "proto": F.first("proto"),
        "start_us": F.min("ts_us"), "end_us": F.max("ts_us"), "last_seq": F.max("seq"),
        "n": F.count(F.lit(1)),
        "n_fwd": S.count_if(fwd), "b_fwd": F.sum(F.when(fwd, size).otherwise(0)),
        "b_bwd": F.sum(F.when(fwd, 0).otherwise(size)),
        "size_sum": F.sum(size), "size_sq": F.sum(size * size),
        "min_pkt_size": F.min(size), "max_pkt_size": F.max(size),
        "iat_n": F.count("iat_us"), "iat_us": F.sum("iat_us"), "iat_sq": F.sum(iat * iat),
        "min_iat": F.coalesce(F.min(iat), F.lit(0.0)),
        "max_iat": F.coalesce(F.max(iat), F.lit(0.0)),
        **flag_sums,
        "fwd_syn": F.max(fwd & bit(V.SYN) & ~bit(V.ACK)),
        "synack_at": F.min(F.when(~fwd & bit(V.SYN) & bit(V.ACK), at)),
        "ack_at": F.max(F.when(fwd & bit(V.ACK), at)),
        "payload_sum": F.sum(length), "payload_n": S.count_if(some),
        "entropy_sum": F.sum("entropy"),
        # the last label that is not benign
        "label": F.coalesce(
            F.max_by("label", F.when(F.col("label") != V.BENIGN, at)), F.lit(V.BENIGN)),
    }
    return measured(directed).groupBy("capture_id", "flow_id").agg(
        *[c.alias(k) for k, c in aggs.items()])


def flow_features(sums: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The 33 per-flow features, plus identity, clock inputs and label."""
    duration = S.seconds(F.col("end_us") - F.col("start_us"))
    charged = S.charged_seconds(duration)
    n, nf = F.col("n"), F.col("n_fwd")
    nb = n - nf
    bf, bb = F.col("b_fwd"), F.col("b_bwd")
    shake = F.coalesce(
        F.col("fwd_syn") & (F.col("ack_at") > F.col("synack_at")), F.lit(False))
    features = {
        "duration": duration, "fwd_packets": nf, "bwd_packets": nb, "total_packets": n,
        "fwd_bytes": bf, "bwd_bytes": bb, "total_bytes": bf + bb,
        "pkts_per_sec": n / charged, "bytes_per_sec": (bf + bb) / charged,
        "fwd_bwd_pkt_ratio": S.ratio_floor_one(nf, nb),
        "down_up_byte_ratio": S.ratio_floor_one(bb, bf),
        **moments("pkt_size", "n", F.col("size_sum"), "size_sq"),
        **moments("iat", "iat_n", S.seconds(F.col("iat_us")), "iat_sq"),
        "handshake_complete": shake, **S.protocol_columns(),
        "mean_payload_len": F.col("payload_sum") / n,
        "payload_entropy": S.safe_div(F.col("entropy_sum"), F.col("payload_n")),
        "empty_payload_ratio": (n - F.col("payload_n")) / n,
    }
    feature = lambda f: features.get(f, F.col(f)).cast("double").alias(f)
    return sums.select(
        "capture_id", "flow_id", "src", "dst", "sport", "dport", "proto",
        "start_us", "end_us", "last_seq", "label", *extra,
        (F.col("rst_count") > 0).alias("_reset"), (F.col("fin_count") >= 2).alias("_finished"),
        ((n == 1) & F.col("fwd_syn")).alias("_lone_syn"),
        *[feature(f) for f in V.FLOW_FEATURES],
    )


def flow_export(flows: DataFrame, packets: DataFrame, p: Params = Params(),
                clock: str = "capture") -> DataFrame:
    """Add ``export_us``: the closing packet, else the clock passing the deadline, else the end."""
    idle = F.when(F.col("_lone_syn"), F.lit(p.syn_us)).otherwise(F.lit(p.idle_us))
    deadline = F.least(F.col("end_us") + idle, F.col("start_us") + p.active_us)
    closed = F.col("_reset") | F.col("_finished")
    due = flows.withColumn("deadline_us", F.when(closed, F.col("end_us")).otherwise(deadline))
    if clock == "deadline":
        out = due.withColumn("export_us", F.greatest("deadline_us", "end_us"))
    else:
        end = packets.groupBy("capture_id").agg(F.max("ts_us").alias("_end"))  # row per capture
        out = export_clock(due, packets).join(end, "capture_id", "left").withColumn(
            "export_us", F.when(closed, F.col("end_us")).otherwise(
                F.greatest(F.coalesce("clock_us", "_end"), F.col("end_us"))))
    return out.drop("deadline_us", "clock_us", "_end", "_reset", "_finished", "_lone_syn")


def assemble_flows(packets: DataFrame, p: Params = Params(), clock: str = "capture") -> DataFrame:
    """Packets of any number of captures to exported flows with 33 features."""
    # stored, since ranges are drawn from a sample of it before the rows move
    slim = materialise(measured(packets), "packets")
    directed = flow_direction(flow_boundaries(slim, p, clock))
    # one narrow row per flow, read twice by the clock look-up
    flows = materialise(flow_features(flow_sums(directed)), "flows")
    return flow_export(flows, slim, p, clock)
