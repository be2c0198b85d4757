"""Behaviour of source and destination hosts in the 10 s and 60 s before each flow ends.

Input flows carry: capture_id, seq, src, dst, dport, start_us, end_us, had_syn, handshake,
bytes_out, bytes_in, new_pair. Frames include both ends; ties on ``end_us`` see each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from packetloom.functions import scalars as S
from packetloom.operators.sliding import (
    sliding_distinct, sliding_max, sliding_max_count, sliding_sums,
)
from packetloom.operators.slices import (
    Last, Prev, RunSum, flag_first, has_group_over, running, time_slice,
)
from packetloom.params import SECOND, Params

SRC = ["capture_id", "src"]
DST = ["capture_id", "dst"]
PAIR = ["capture_id", "src", "dst", "dport"]
ORDER = ["end_us", "seq"]

BEACON_TIMES = 13    # fixed value: contact times remembered per pair
BEACON_CHUNK = 4096  # rows of one pair handled together


def flow_records(flows: DataFrame) -> DataFrame:
    """What the windows need, from assembled flows."""
    records = flows.select(
        "capture_id", F.col("flow_id").alias("seq"), "src", "dst", "dport",
        "start_us", "end_us", "export_us",
        (F.col("syn_count") > 0).alias("had_syn"),
        (F.col("handshake_complete") > 0).alias("handshake"),
        F.col("fwd_bytes").cast("long").alias("bytes_out"),
        F.col("bwd_bytes").cast("long").alias("bytes_in"))
    return new_pair_flag(records, ["export_us", "end_us", "seq"])


def new_pair_flag(flows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First time a (src, dst, dport) is exported."""
    return flag_first(flows, PAIR, order or ORDER, "new_pair")


def _one(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _failed() -> Column:
    return F.col("had_syn") & ~F.col("handshake")


def _sums_by_source(flows: DataFrame, p: Params) -> DataFrame:
    short, long = p.short_s * SECOND, p.long_s * SECOND
    return sliding_sums(flows, SRC, "end_us", {
        "_n10": (short, F.lit(1)), "_syn10": (short, _one(F.col("had_syn"))),
        "_failed10": (short, _one(_failed())),
        "_n60": (long, F.lit(1)), "_out60": (long, F.col("bytes_out")),
        "_in60": (long, F.col("bytes_in")),
        "_us60": (long, F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0))),
        "_new60": (long, _one(F.col("new_pair"))),
    })


def host_sum_features(p: Params) -> dict[str, Column]:
    c = F.col
    return {
        "host_flows_10s": c("_n10").cast("double"),
        "host_flows_60s": c("_n60").cast("double"),
        "host_syn_only_rate_10s": c("_failed10") / F.lit(float(p.short_s)),
        "host_failed_handshake_ratio_10s": S.safe_div(c("_failed10"), c("_syn10")),
        "host_bytes_out_60s": c("_out60").cast("double"),
        "host_bytes_in_60s": c("_in60").cast("double"),
        "host_out_in_ratio_60s": S.ratio_floor_one(c("_out60"), c("_in60")),
        "host_new_pair_ratio_60s": S.safe_div(c("_new60"), c("_n60")),
        "host_mean_flow_duration_60s": S.safe_div(S.seconds(c("_us60")), c("_n60")),
    }


def source_sums(flows: DataFrame, p: Params = Params()) -> DataFrame:
    sums = _sums_by_source(flows, p)
    return sums.select(*SRC, "end_us", *[c.alias(n) for n, c in host_sum_features(p).items()])


def source_distinct(flows: DataFrame, p: Params = Params()) -> DataFrame:
    short, long = p.short_s * SECOND, p.long_s * SECOND
    counts = sliding_distinct(flows, SRC, "end_us", {
        "host_distinct_dst_10s": (short, F.col("dst")),
        "host_distinct_dst_60s": (long, F.col("dst")),
        "host_distinct_dport_10s": (short, F.col("dport")),
        "host_distinct_dport_60s": (long, F.col("dport")),
    })
    return counts.select(*[F.col(c).cast("double").alias(c) if c.startswith("host_") else F.col(c)
                           for c in counts.columns])


def source_pair_repeat(flows: DataFrame, p: Params = Params()) -> DataFrame:
    name = "host_dst_repeat_max_60s"
    out = sliding_max_count(flows, SRC, ["dst", "dport"], "end_us", p.long_s * SECOND, name)
    return out.withColumn(name, F.col(name).cast("double"))


def destination_window(flows: DataFrame, p: Params = Params()) -> DataFrame:
    short = p.short_s * SECOND
    sums = sliding_sums(flows, DST, "end_us", {
        "_n": (short, F.lit(1)), "_syn": (short, _one(F.col("had_syn"))),
        "_failed": (short, _one(_failed()))})
    peers = sliding_distinct(flows, DST, "end_us", {"_src": (short, F.col("src"))})
    return sums.join(peers, [*DST, "end_us"]).select(
        *DST, "end_us",
        F.col("_n").cast("double").alias("dst_flows_10s"),
        F.col("_src").cast("double").alias("dst_distinct_src_10s"),
        (F.col("_failed") / F.lit(float(p.short_s))).alias("dst_syn_only_rate_10s"),
        S.safe_div(F.col("_failed"), F.col("_syn")).alias("dst_failed_handshake_ratio_10s"))


def _regularity(times: Column) -> Column:
    """1 - CV of the positive gaps of ordered times; 0 with too few of them."""
    pairs = F.zip_with(F.slice(times, 2, BEACON_TIMES), times, lambda b, a: b - a)
    # zip_with pads the shorter side with NULL, which the filter removes
    gaps = F.filter(pairs, lambda g: g > 0)
    n = F.size(gaps)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = total(gaps, lambda g: g.cast("double")) / n
    var = total(gaps, lambda g: (g - mean) * (g - mean)) / n
    # times >= 4 is implied by three gaps
    return F.when(n >= 3, S.clamp01(1.0 - F.sqrt(var) / mean)).otherwise(0.0)


def pair_contacts(flows: DataFrame, p: Params = Params()) -> DataFrame:
    """Per flow: length and regularity of its pair's remembered contact times.

    The memory of a pair is dropped once another flow of the host shows that the pair's
    last contact left the window; ``g`` is the host's flow just before this one.
    """
    span = p.long_s * SECOND
    slim = flows.select(*PAIR, *ORDER)
    busy = has_group_over(slim, SRC, p.group_rows)
    part = time_slice(F.col("end_us"), p.slice_s * SECOND) if busy else None
    host = running(slim, SRC, ORDER, part, g=Prev(F.col("end_us")))
    pair = running(host, PAIR, ORDER, part,
                   a=Prev(F.col("end_us")), pos=RunSum(F.lit(1).cast("long")))
    broke = F.col("a").isNull() | (F.col("g") > F.col("a") + span)
    based = running(pair, PAIR, ORDER, part, island=Last(
        F.when(broke, F.struct(F.col("end_us").alias("us"), F.col("seq").alias("seq"),
                               F.col("pos").alias("pos")))))
    # chunks of consecutive rows of one pair, each preceded by the rows it looks back on
    chunk = F.floor((F.col("pos") - 1) / F.lit(BEACON_CHUNK))
    ahead = F.floor((F.col("pos") - 1 + BEACON_TIMES - 1) / F.lit(BEACON_CHUNK))
    if busy:
        near = W.partitionBy(*PAIR, "_chunk").orderBy("pos").rowsBetween(1 - BEACON_TIMES, 0)
        spread = based.withColumn("_home", chunk).withColumn(
            "_chunk", F.explode(F.sequence(chunk, ahead)))
        listed = spread.withColumn("_times", F.collect_list("end_us").over(near)).where(
            F.col("_chunk") == F.col("_home"))
    else:
        near = W.partitionBy(*PAIR).orderBy("pos").rowsBetween(1 - BEACON_TIMES, 0)
        listed = based.withColumn("_times", F.collect_list("end_us").over(near))
    length = F.least(F.col("pos") - F.col("island")["pos"] + 1, F.lit(BEACON_TIMES))
    own = F.slice(F.col("_times"), -length.cast("int"), length.cast("int"))
    return listed.select(
        *PAIR, *ORDER, length.alias("length"), _regularity(own).alias("regularity"),
        F.col("island")["us"].alias("island_us"), F.col("island")["seq"].alias("island_seq"))


def source_beacon(flows: DataFrame, p: Params = Params()) -> DataFrame:
    """Regularity of the host's most-contacted pair (ties: the pair remembered longest)."""
    best = F.struct(
        "length", (-F.col("island_us")).alias("i"), (-F.col("island_seq")).alias("j"),
        "end_us", "seq", "regularity")
    top = sliding_max(pair_contacts(flows, p), SRC, "end_us", p.long_s * SECOND, best, "_best")
    return top.select(*SRC, "end_us", F.col("_best")["regularity"].alias("host_beacon_regularity"))


def _attach(flows: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of one row per host and time are merged first, then joined to the flows once."""
    merged = reduce(lambda a, b: a.join(b, keys), tables)
    return flows.join(merged, keys)


def host_window_sums(flows: DataFrame, p: Params = Params()) -> DataFrame:
    return _attach(flows, [source_sums(flows, p)], [*SRC, "end_us"])


def host_window_distinct(flows: DataFrame, p: Params = Params()) -> DataFrame:
    return _attach(flows, [source_distinct(flows, p)], [*SRC, "end_us"])


def pair_repeat_max(flows: DataFrame, p: Params = Params()) -> DataFrame:
    return _attach(flows, [source_pair_repeat(flows, p)], [*SRC, "end_us"])


def beacon_regularity(flows: DataFrame, p: Params = Params()) -> DataFrame:
    return _attach(flows, [source_beacon(flows, p)], [*SRC, "end_us"])


def dst_window(flows: DataFrame, p: Params = Params()) -> DataFrame:
    return _attach(flows, [destination_window(flows, p)], [*DST, "end_us"])


def behaviour_features(flows: DataFrame, p: Params = Params()) -> DataFrame:
    """All 15 source and 4 destination features."""
    at_source = _attach(
        flows, [source_sums(flows, p), source_distinct(flows, p),
                source_pair_repeat(flows, p), source_beacon(flows, p)], [*SRC, "end_us"])
    return _attach(at_source, [destination_window(flows, p)], [*DST, "end_us"])


def host_window_frames(flows: DataFrame, p: Params = Params()) -> DataFrame:
    """The same distinct counts as plain RANGE frames: simplest form, for small hosts only."""
    def frame(span_s: int) -> W:
        return W.partitionBy(*SRC).orderBy("end_us").rangeBetween(-span_s * SECOND, 0)

    size = lambda c, s: F.size(F.collect_set(c).over(frame(s))).cast("double")
    return flows.withColumns({
        "host_distinct_dst_10s": size("dst", p.short_s),
        "host_distinct_dst_60s": size("dst", p.long_s),
        "host_distinct_dport_10s": size("dport", p.short_s),
        "host_distinct_dport_60s": size("dport", p.long_s),
    })
