"""Named queries: each operator over the whole ``events`` table, with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from packetloom import fixed_values as V
from packetloom.functions import payload as PL, scalars as S
from packetloom.operators import (
    anomaly as A, assembly as AS, classify as C, clocks, datasets as DS, detect as D, dims,
    evaluate as E, incidents as I, quantiles as Q, readmodels as R, rollups as RU,
    threshold as TH, triage as TR, windows as WN,
)
from packetloom.params import Params
from packetloom.plans import views as VW
from packetloom.plans.oracle import INCIDENT_ID, NOW, OPEN, sql
from packetloom.session import materialise, ship

P = Params()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_STORED: dict[tuple, DataFrame | str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: wide integers, rounded doubles, times in microseconds."""
    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        match f.dataType:
            case T.IntegerType() | T.ShortType() | T.ByteType():
                c = c.cast("long")
            case T.DoubleType() | T.FloatType():
                c = F.round(c.cast("double"), 6) + F.lit(0.0)
            case T.TimestampType():
                c = F.unix_micros(c)
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = sql(oracle)
        return fn
    return add


def stored(view: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view written once per session, as flows and packets are in practice."""
    key = (spark.sparkContext.applicationId, view.__name__, sf_dir)
    if key not in _STORED:
        df = view(spark, sf_dir)
        at = next((c for c in ("ts_us", "end_us") if c in df.columns), None)
        if at:  # laid out by time, in enough files to read in parallel
            df = df.repartitionByRange(spark.sparkContext.defaultParallelism, at)
        _STORED[key] = materialise(df, view.__name__)
    return _STORED[key]


def packets(s, d):
    return stored(VW.packet_view, s, d)


def flows(s, d):
    return stored(VW.flow_view, s, d)


def paired(s, d):
    return stored(VW.paired_flow_view, s, d)


def sessions(s, d):
    return stored(VW.session_view, s, d)


def incidents(s, d):
    return stored(VW.incident_view, s, d)


def bounded_view(s, d):
    return AS.flow_boundaries(packets(s, d), P)


def bounded(s, d):
    return stored(bounded_view, s, d)


def directed(s, d):
    return AS.flow_direction(bounded(s, d))


def triage_log(s, d):
    return VW.triage_view(s, d, incidents(s, d))


PACKET_COLUMNS = "capture_id, seq, ts_us, src, dst, proto, sport, dport, size, flags, payload, label"
readable = lambda df: df.withColumn("payload", F.col("payload").cast("string"))

# ---- scans and stores

@query("packets_scan", f"SELECT {PACKET_COLUMNS} FROM packets WHERE proto = 'tcp' AND size >= 200")
def packets_scan(s, d):
    from packetloom.sources.packets import packets_scan as scan, write_packets
    path = write_packets(VW.packet_view(s, d))
    return readable(scan(s, path).where("proto = 'tcp' and size >= 200"))


DECODED = "src, dst, proto, sport, dport, size, flags, payload"


@query("frame_decode", f"SELECT seq, ts_us, {DECODED} FROM packets")
def frame_decode(s, d):
    from packetloom.sources.pcap import decode_frames
    return readable(decode_frames(VW.frame_view(packets(s, d)))).drop("capture_id", "label")


def captures(s, d) -> str:
    """The packets as capture files, written once per session."""
    key = (s.sparkContext.applicationId, "captures", d)
    if key not in _STORED:
        _STORED[key] = VW.write_captures(packets(s, d))
    return _STORED[key]


@query("pcap_scan", f"SELECT ts_us, {DECODED} FROM packets")
def pcap_scan(s, d):
    from packetloom.sources.pcap import pcap_scan as scan
    return readable(scan(s, captures(s, d))).drop("capture_id", "label", "seq")


@query("pcap_ranges", f"SELECT ts_us, {DECODED} FROM packets")
def pcap_ranges(s, d):
    """The same in byte ranges that are far smaller than a file."""
    from packetloom.sources.pcap import pcap_scan as scan
    return readable(scan(s, captures(s, d), split_bytes=100_000)).drop("capture_id", "label", "seq")


@query("pcap_stream", f"SELECT ts_us, {DECODED} FROM packets")
def pcap_stream(s, d):
    """The folder of captures followed as a stream."""
    from packetloom.sources.pcap import pcap_stream as source
    from packetloom.streaming.sinks import run_to_end
    out = run_to_end(source(s, captures(s, d)).drop("ts"), "captures-out")
    return readable(s.read.parquet(out)).drop("capture_id", "label", "seq")


@query("alerts_append_capped", """SELECT incident_id, seq, row_number() OVER (
    PARTITION BY incident_id ORDER BY wall_us, seq) AS place, wall_us AS at_us FROM sessions
    QUALIFY place <= 3""")
def alerts_append_capped(s, d):
    capped = I.alerts_append_capped(sessions(s, d), Params(alerts_per_incident=3))
    from pyspark.sql.window import Window as W
    w = W.partitionBy("incident_id").orderBy("at_us", "seq")  # at most three rows each
    return capped.select("incident_id", "seq", F.row_number().over(w).alias("place"), "at_us")


@query("alerts_dropped", """SELECT incident_id, greatest(count(*) - 3, 0) AS dropped
    FROM sessions GROUP BY 1""")
def alerts_dropped(s, d):
    return I.alerts_dropped(sessions(s, d), Params(alerts_per_incident=3))


BUCKET_SQL = """SELECT ts_us AS ts, flows, packets, bytes, alerts, round(score_mean, 6) AS score_mean,
    round(score_max, 6) AS score_max, round(threshold_mean, 6) AS threshold_mean FROM buckets"""


@query("bucket_rollup", BUCKET_SQL)
def bucket_rollup(s, d):
    return RU.bucket_rollup(flows(s, d))


@query("buckets_append", BUCKET_SQL)
def buckets_append(s, d):
    """Rollups of whole seconds appended in two runs."""
    from packetloom.session import scratch_path
    path, early = scratch_path(s, "buckets"), F.col("at_us") < 500_000_000
    for part in (early, ~early):
        RU.bucket_rollup(flows(s, d).where(part)).write.mode("append").parquet(path)
    return s.read.parquet(path)


@query("host_rollup", """SELECT ip, flows_out, flows_in, bytes_out, bytes_in, alerts,
    round(score_sum, 6) AS score_sum, score_n, round(threshold, 6) AS threshold, first_us, last_us
    FROM hosts""")
def host_rollup(s, d):
    return RU.host_rollup(flows(s, d)).drop("calibrated")


HOST_SQL = """SELECT ip, asset_name, criticality, last_us, flows_out, flows_in, bytes_out, bytes_in,
    alerts, round(score_mean, 6) AS score_mean, round(coalesce(threshold, 0), 6) AS threshold
    FROM named_hosts"""
HOST_COLUMNS = ["ip", "asset_name", "criticality", "last_us", "flows_out", "flows_in", "bytes_out",
                "bytes_in", "alerts", "score_mean", "threshold"]


def hosts_view(s, d):
    return RU.host_table(flows(s, d), dims.default_assets(s), P)


def hosts(s, d):
    return stored(hosts_view, s, d)


@query("hosts_table", HOST_SQL)
def hosts_table(s, d):
    return hosts(s, d).select(*HOST_COLUMNS)


@query("hosts_upsert", """SELECT ip, flows_out, flows_in, bytes_out, bytes_in, alerts, last_us,
    round(coalesce(threshold, 0), 6) AS threshold, round(((CASE WHEN n1 > 0 THEN s1 / t1 ELSE 0 END)
      * greatest(flows_out + flows_in - n2, 0) * CAST(n2 > 0 AS INT) + s2)
      / CASE WHEN n2 > 0 THEN flows_out + flows_in ELSE 1 END
      + CASE WHEN n2 = 0 AND n1 > 0 THEN s1 / t1 ELSE 0 END, 6) AS score_mean
    FROM hosts JOIN (SELECT ip,
      coalesce(sum(score) FILTER (at_us < 500000000), 0) s1, count(score) FILTER (at_us < 500000000) n1,
      count(*) FILTER (at_us < 500000000) t1,
      coalesce(sum(score) FILTER (at_us >= 500000000), 0) s2, count(score) FILTER (at_us >= 500000000) n2
      FROM hostsides GROUP BY ip) USING (ip)""")
def hosts_upsert(s, d):
    """Two flushes: the second dilutes the running mean by the host's new totals."""
    assets, early = dims.default_assets(s), F.col("at_us") < 500_000_000
    first = RU.host_table(flows(s, d).where(early), assets, P).drop("asset_name", "criticality")
    both = RU.hosts_upsert(first, RU.host_rollup(flows(s, d).where(~early)), assets, P)
    return both.select("ip", "flows_out", "flows_in", "bytes_out", "bytes_in", "alerts", "last_us",
                       "threshold", "score_mean")


@query("host_score_mean", "SELECT ip, round(score_mean, 6) AS score_mean FROM named_hosts")
def host_score_mean(s, d):
    return hosts(s, d).select("ip", "score_mean")


@query("audit_append", "SELECT * FROM audit")
def audit_append(s, d):
    from packetloom.session import scratch_path
    path, log = scratch_path(s, "audit"), VW.audit_view(s, d)
    for rest in (0, 1):
        log.where(F.col("id") % 2 == rest).write.mode("append").parquet(path)
    return s.read.parquet(path)


@query("audit_read", "SELECT * FROM audit ORDER BY ts DESC, id DESC LIMIT 200")
def audit_read(s, d):
    return R.audit_read(VW.audit_view(s, d))


INCIDENT_SQL = """SELECT id, dedup_key, family, src, dst, dport, proto,
    epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, occurrences,
    round(score_max, 6) AS score_max, round(score_mean, 6) AS score_mean,
    round(threshold, 6) AS threshold, round(confidence, 6) AS confidence, severity, priority,
    CAST(criticality AS BIGINT) AS criticality, asset_name, mitre_technique, mitre_tactic, status,
    verdict, total_bytes, total_packets, distinct_dports, distinct_peers,
    epoch_us(closed_at) AS closed_at FROM incidents"""
INCIDENT_COLUMNS = [
    "id", "dedup_key", "family", "src", "dst", "dport", "proto", "first_seen", "last_seen",
    "occurrences", "score_max", "score_mean", "threshold", "confidence", "severity", "priority",
    "criticality", "asset_name", "mitre_technique", "mitre_tactic", "status", "verdict",
    "total_bytes", "total_packets", "distinct_dports", "distinct_peers", "closed_at"]


@query("incidents", INCIDENT_SQL)
def incidents_all(s, d):
    return VW.incident_view(s, d).select(*INCIDENT_COLUMNS)


def three_captures(alerts: DataFrame) -> DataFrame:
    """Sequence numbers that start anew in each of three captures."""
    return alerts.withColumn("capture_id", F.concat(F.lit("cap"), F.col("seq") % 3)).withColumn(
        "seq", F.expr("seq div 3"))


BY_CAPTURE_SQL = """WITH {prefix}, al AS (
      SELECT * REPLACE ('cap' || (seq % 3) AS capture_id, seq // 3 AS seq) FROM alerts),
    br AS (SELECT *, CASE WHEN end_us - lag(end_us) OVER (PARTITION BY capture_id, dedup_key
        ORDER BY end_us, seq) <= 60000000 THEN 0 ELSE 1 END brk FROM al),
    gr AS (SELECT *, sum(brk) OVER (PARTITION BY capture_id, dedup_key ORDER BY end_us, seq) part FROM br),
    se AS (SELECT *, ID incident_id FROM gr
        WINDOW g AS (PARTITION BY capture_id, dedup_key, part ORDER BY end_us, seq))
    SELECT incident_id AS id, any_value(capture_id) AS capture_id, any_value(dedup_key) AS dedup_key,
      count(*) AS occurrences, CAST(sum(bytes) AS BIGINT) AS total_bytes, round(max(score), 6) AS score_max,
      min(seq) AS first_seq FROM se GROUP BY incident_id""".replace("ID", INCIDENT_ID, 1)
BY_CAPTURE = ["id", "capture_id", "dedup_key", "occurrences", "total_bytes", "score_max", "first_seq"]


@query("incidents_by_capture", BY_CAPTURE_SQL)
def incidents_by_capture(s, d):
    """Captures whose sequence numbers overlap keep incidents of their own."""
    alerts = three_captures(VW.alert_view(s, d))
    return I.build_incidents(alerts, dims.default_assets(s), P, at="end_us").select(*BY_CAPTURE)


@query("incidents_by_capture_stream", BY_CAPTURE_SQL)
def incidents_by_capture_stream(s, d):
    from packetloom.streaming.sinks import IncidentSink, run_to_end
    rows = three_captures(flows(s, d)).select(
        *VERDICT, "sport", "dport", "proto", "confidence", "label", "start_us")
    sink = IncidentSink(s, dims.default_assets(s), P)
    run_to_end(stream_of(rows, landed(rows, "verdicts-in")).where("seq >= 0"), "incidents-out", sink)
    return sink.incidents.last().select(*BY_CAPTURE)


@query("incidents_upsert", INCIDENT_SQL)
def incidents_upsert(s, d):
    """An older state of half the incidents, then the final state of all."""
    from packetloom.sources.tables import Batches
    final = incidents(s, d)
    older = final.where("id % 2 = 0").withColumn("occurrences", F.lit(1).cast("long"))
    table = Batches.scratch(s, "incidents")
    table.write(older, 0)
    table.write(I.incidents_upsert(table.last(before=1), final), 1)
    return table.last().select(*INCIDENT_COLUMNS)


@query("incident_export", """SELECT id, i.family, occurrences, occurrences AS alerts,
    least(distinct_dports, 20) AS ports, round(top_score, 4) AS top_score, mitre_technique AS technique
    FROM incidents i JOIN (SELECT incident_id, max(score) top_score FROM stored GROUP BY 1) a
    ON a.incident_id = i.id""")
def incident_export(s, d):
    """Documents, read back by path."""
    docs = R.incident_export(incidents(s, d), I.alert_rows(sessions(s, d)))
    at = lambda path: F.get_json_object("document", path)
    size = lambda path: F.json_array_length(at(path)).cast("long")
    return docs.select(
        "id", at("$.family").alias("family"), at("$.occurrences").cast("long").alias("occurrences"),
        size("$.alerts").alias("alerts"), size("$.ports").alias("ports"),
        F.round(at("$.alerts[0].score").cast("double"), 4).alias("top_score"),
        at("$.guidance.technique").alias("technique"))


@query("dataset_roundtrip", """SELECT capture_id, seq, label, packets, bytes,
    round(score, 6) AS score FROM flows""")
def dataset_roundtrip(s, d):
    from packetloom.sources.tables import dataset_read, dataset_write
    from packetloom.session import scratch_path
    names = ("packets", "bytes", "score")
    path = scratch_path(s, "dataset")
    dataset_write(flows(s, d).select("capture_id", "seq", "label", *names), path, names)
    return dataset_read(s, path, names)


# ---- columns

@query("canonical_key", """SELECT seq, key_lo, key_hi, key_lo_port, key_hi_port, proto FROM keyed""")
def canonical_key(s, d):
    return AS.canonical_key(packets(s, d)).select(
        "seq", "key_lo", "key_hi", "key_lo_port", "key_hi_port", "proto")


@query("flow_label", """SELECT seq, src || ':' || sport || ' -> ' || dst || ':' || dport || '/' || proto
    AS flow FROM flows""")
def flow_label(s, d):
    return flows(s, d).select("seq", S.flow_label().alias("flow"))


FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")


@query("tcp_flag_counts", f"""SELECT flow_id, {', '.join(f'{f}_count' for f in FLAGS)} FROM sums""")
def tcp_flag_counts(s, d):
    return AS.flow_sums(directed(s, d)).select("flow_id", *[f"{f}_count" for f in FLAGS])


@query("payload_entropy", """SELECT seq, round(entropy, 6) AS entropy
    FROM packets JOIN entropies USING (payload)""")
def payload_entropy(s, d):
    return packets(s, d).select("seq", PL.payload_entropy(F.col("payload")).alias("entropy"))


@query("payload_entropy_arrow", """SELECT seq, round(entropy, 6) AS entropy
    FROM packets JOIN entropies USING (payload)""")
def payload_entropy_arrow(s, d):
    return packets(s, d).select("seq", PL.payload_entropy_arrow("payload").alias("entropy"))


@query("safe_div", """SELECT seq, CASE WHEN bwd_bytes <> 0 THEN round(fwd_bytes / bwd_bytes, 6)
    ELSE 0 END AS ratio FROM flows""")
def safe_div(s, d):
    return flows(s, d).select("seq", S.safe_div(F.col("fwd_bytes"), F.col("bwd_bytes")).alias("ratio"))


def features_view(s, d):
    return AS.flow_features(AS.flow_sums(directed(s, d)))


def features(s, d):
    return stored(features_view, s, d)


SPAN = "CASE WHEN end_us > start_us THEN (end_us - start_us) / 1e6 ELSE 1e-3 END"


@query("flow_rates", f"""SELECT flow_id, round(n / {SPAN}, 6) AS pkts_per_sec,
    round((bf + bb) / {SPAN}, 6) AS bytes_per_sec FROM sums""")
def flow_rates(s, d):
    return features(s, d).select("flow_id", "pkts_per_sec", "bytes_per_sec")


@query("flow_ratios", """SELECT flow_id, round(nf / greatest(n - nf, 1), 6) AS fwd_bwd_pkt_ratio,
    round(bb / greatest(bf, 1), 6) AS down_up_byte_ratio, 0.0::DOUBLE AS empty_payload_ratio
    FROM sums""")
def flow_ratios(s, d):
    return features(s, d).select(
        "flow_id", "fwd_bwd_pkt_ratio", "down_up_byte_ratio", "empty_payload_ratio")


@query("protocol_onehot", """SELECT seq, CAST(proto = 'tcp' AS DOUBLE) AS is_tcp,
    CAST(proto = 'udp' AS DOUBLE) AS is_udp, CAST(proto = 'icmp' AS DOUBLE) AS is_icmp,
    CAST(dport < 1024 AS DOUBLE) AS dport_is_system FROM flows""")
def protocol_onehot(s, d):
    return flows(s, d).select("seq", *[c.alias(n) for n, c in S.protocol_columns().items()])


@query("handshake_complete", """SELECT flow_id, CAST(coalesce(fwd_syn AND ack_at > synack_at, FALSE)
    AS DOUBLE) AS handshake_complete FROM sums""")
def handshake_complete(s, d):
    return features(s, d).select("flow_id", "handshake_complete")


@query("vectorize", """SELECT seq, round(CAST(greatest(least(score * 2e9, 1e9), -1e9) AS FLOAT)::DOUBLE, 6) AS v0,
    CAST(CAST(bytes AS FLOAT) AS DOUBLE) AS v1, 0.0::DOUBLE AS v2,
    CAST(CAST(packets AS FLOAT) AS DOUBLE) AS v3 FROM flows""")
def vectorize(s, d):
    odd = flows(s, d).withColumns({
        "a": F.col("score") * 2e9, "b": F.col("bytes"),
        "c": F.when(F.col("seq") % 2 == 0, F.lit(float("nan"))), "d": F.col("packets")})
    vec = odd.withColumn("vec", S.vectorize(("a", "b", "c", "d")))
    return vec.select("seq", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)])


@query("feature_labels", "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'nombre de SYN' "
       "WHEN seq % 3 = 1 THEN 'max iat' ELSE family_name END AS label "
       "FROM (SELECT seq, lower(replace(family, '_', ' ')) AS family_name FROM flows)")
def feature_labels(s, d):
    name = F.when(F.col("seq") % 3 == 0, "syn_count").when(F.col("seq") % 3 == 1, "max_iat")
    return flows(s, d).select(
        "seq", S.feature_label(F.coalesce(name, F.lower("family"))).alias("label"))


@query("verdict_severity", """SELECT seq, CASE WHEN score < limit_ THEN 'INFO'
    WHEN score >= 0.92 OR score - limit_ >= 0.25 THEN 'CRITICAL'
    WHEN score - limit_ >= 0.10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM (SELECT seq, score, 0.5::DOUBLE AS limit_ FROM flows)""")
def verdict_severity(s, d):
    score, limit = F.col("score"), F.lit(0.5)
    return flows(s, d).select(
        "seq", S.verdict_severity(score, limit, score >= limit).alias("severity"))


VETO_FAMILY = "CASE WHEN seq % 4 = 0 THEN 'BENIGN' ELSE family END"


@query("cascade_veto", f"""SELECT seq, score >= threshold AND NOT quiet AS is_alert,
    score >= threshold AND quiet AS suppressed FROM (SELECT *, {VETO_FAMILY} = 'BENIGN'
    AND confidence >= 0.90 AND score < 0.9975 AS quiet FROM flows)""")
def cascade_veto(s, d):
    named = flows(s, d).drop("is_alert", "suppressed").withColumn("family", F.expr(VETO_FAMILY))
    return named.select("seq", *[c.alias(n) for n, c in S.cascade_veto(P).items()])


@query("unknown_floor", """SELECT seq, CASE WHEN confidence < 0.55 THEN 'UNKNOWN' ELSE family END
    AS family FROM flows""")
def unknown_floor(s, d):
    return flows(s, d).select(
        "seq", S.unknown_floor(F.col("family"), F.col("confidence"), P).alias("family"))


@query("dedup_key", "SELECT seq, dedup_key FROM alerts")
def dedup_key(s, d):
    return flows(s, d).where("is_alert").select("seq", S.dedup_key().alias("dedup_key"))


@query("incident_margin", "SELECT id, round(margin, 6) AS margin FROM judged")
def incident_margin(s, d):
    return incidents(s, d).select(
        "id", S.incident_margin(F.col("score_max"), F.col("threshold")).alias("margin"))


@query("incident_priority", "SELECT id, priority FROM prioritised")
def incident_priority(s, d):
    return incidents(s, d).select("id", "priority")


@query("incident_severity", "SELECT id, severity FROM stated")
def incident_severity(s, d):
    return incidents(s, d).select("id", S.incident_severity(F.col("priority")).alias("severity"))


PAYLOAD_COLUMNS = """id, family, family_title, src, dst, dport, proto,
    epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, occurrences,
    round(score_max, 4) AS score_max, round(score_mean, 4) AS score_mean,
    round(threshold, 4) AS threshold, round(confidence, 4) AS confidence, severity, priority,
    CAST(criticality AS BIGINT) AS criticality, asset_name, status, assignee, verdict, note,
    mitre_technique, mitre_tactic, total_bytes, total_packets, distinct_dports, distinct_peers"""


@query("incident_payload", f"SELECT {PAYLOAD_COLUMNS} FROM incidents")
def incident_payload(s, d):
    return I.incident_payload(incidents(s, d))


@query("incident_filter", f"""SELECT id FROM incidents WHERE status IN ({OPEN}) AND severity = 'CRITICAL'
    AND dst LIKE '%1.1%' AND last_seen >= {NOW} - INTERVAL 480 HOUR
    AND (src LIKE '%SCAN%' OR dst LIKE '%SCAN%' OR family LIKE '%SCAN%' OR asset_name LIKE '%SCAN%'
         OR mitre_technique LIKE '%SCAN%')""")
def incident_filter(s, d):
    return R.incident_filter(incidents(s, d), VW.NOW, open_only=True, severity="critical",
                             dst="1.1", hours=480, q="SCAN").select("id")


FILTERS = {  # one at a time: arguments, and the same in SQL
    "open": (dict(open_only=True), f"status IN ({OPEN})"), "status": (dict(status="new"), "status = 'NEW'"),
    "severity": (dict(severity="medium"), "severity = 'MEDIUM'"), "family": (dict(family="port_scan"), "family = 'PORT_SCAN'"),
    "src": (dict(src="1.1"), "src LIKE '%1.1%'"), "dst": (dict(dst="1.1"), "dst LIKE '%1.1%'"),
    "text": (dict(q="SCAN"), "(src LIKE '%SCAN%' OR dst LIKE '%SCAN%' OR family LIKE '%SCAN%' OR asset_name LIKE '%SCAN%' "
             "OR mitre_technique LIKE '%SCAN%')")}


@query("incident_filter_each", " UNION ALL ".join(
    f"SELECT '{name}' AS filter, id FROM incidents WHERE {sql}" for name, (_, sql) in FILTERS.items()))
def incident_filter_each(s, d):
    each = [R.incident_filter(incidents(s, d), VW.NOW, **how).select(F.lit(name).alias("filter"), "id")
            for name, (how, _) in FILTERS.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


@query("alert_row", """SELECT incident_id, seq, epoch_us(ts) AS ts, round(flow_start, 6) AS flow_start,
    round(flow_end, 6) AS flow_end, src, sport, dst, dport, proto, round(score, 6) AS score,
    round(threshold, 6) AS threshold, family, round(confidence, 6) AS confidence, severity, packets,
    bytes, round(duration, 6) AS duration, truth FROM stored""")
def alert_row(s, d):
    return I.alert_rows(sessions(s, d)).drop("contributions")


@query("host_payload", """SELECT ip, asset_name, criticality, last_us AS last_seen, flows_out, flows_in,
    bytes_out, bytes_in, alerts, round(score_mean, 4) AS score_mean,
    round(coalesce(threshold, 0), 4) AS threshold FROM named_hosts""")
def host_payload(s, d):
    return R.host_payload(hosts(s, d)).drop("first_seen", "calibrated")


@query("host_filter", "SELECT ip FROM named_hosts WHERE ip LIKE '%.1%' OR asset_name LIKE '%.1%'")
def host_filter(s, d):
    return R.host_filter(hosts(s, d), ".1").select("ip")


# ---- joins

@query("asset_lookup", """SELECT seq, coalesce(name, 'Inconnu') AS asset_name,
    CAST(coalesce(criticality, 1) AS BIGINT) AS asset_criticality FROM (
      SELECT x.seq, a.name, a.criticality, row_number() OVER (
        PARTITION BY x.seq ORDER BY a.bits DESC) AS rn
      FROM (SELECT seq, CASE seq % 3 WHEN 0 THEN src WHEN 1 THEN dst ELSE '192.168.1.' || (seq % 400) END ip FROM flows) x
      LEFT JOIN (SELECT *, CAST(split_part(cidr, '/', 2) AS INT) bits,
          list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda o: o::BIGINT),
                      lambda a, b: a * 256 + b) net FROM assets) a
      ON (try_cast(split_part(x.ip, '.', 4) AS INT) <= 255 AND
          list_reduce(list_transform(string_split(x.ip, '.'), lambda o: o::BIGINT), lambda a, b: a * 256 + b)
            // (2 ** (32 - a.bits))::BIGINT = a.net // (2 ** (32 - a.bits))::BIGINT))
    WHERE rn = 1""")
def asset_lookup(s, d):
    ip = F.expr("case seq % 3 when 0 then src when 1 then dst "
                "else concat('192.168.1.', seq % 400) end")  # includes impossible addresses
    named = dims.asset_lookup(flows(s, d).withColumn("ip", ip), "ip", dims.default_assets(s), P)
    return named.select("seq", "asset_name", "asset_criticality")


@query("assets_replace", """SELECT cidr, name, greatest(1, least(5, criticality + n)) AS criticality
    FROM (SELECT cidr, name, CAST(criticality AS BIGINT) criticality,
          (SELECT count(*) // 10000 - 3 FROM flows) n FROM assets)""")
def assets_replace(s, d):
    shift = flows(s, d).count() // 10_000 - 3
    return dims.assets_replace(dims.default_assets(s).withColumn(
        "criticality", F.col("criticality") + F.lit(shift).cast("int"))).select(
        "cidr", "name", "criticality")


FAMILY_CASE = "CASE WHEN seq % 7 = 0 THEN 'NEWCOMER' ELSE family END"


@query("family_info", f"""SELECT seq, family_title, mitre_technique, mitre_tactic,
    CAST(default_criticality AS BIGINT) AS default_criticality FROM (SELECT seq, {FAMILY_CASE} AS name
    FROM flows) x JOIN families f ON f.family = CASE WHEN name = 'NEWCOMER' THEN 'UNKNOWN' ELSE name END""")
def family_info(s, d):
    named = flows(s, d).select("seq", F.expr(FAMILY_CASE).alias("family"))
    return dims.family_info(named).drop("family")


@query("incident_alerts", """SELECT s.incident_id, s.seq FROM sessions s JOIN incidents i
    ON i.id = s.incident_id WHERE i.status = 'NEW'""")
def incident_alerts(s, d):
    picked = incidents(s, d).where("status = 'NEW'")
    return R.incident_alerts(picked, sessions(s, d)).select("incident_id", "seq")


TOUCHING = """(SELECT src ip, * FROM incidents UNION ALL
    SELECT dst ip, * FROM incidents WHERE src <> dst) QUALIFY row_number() OVER (
    PARTITION BY ip ORDER BY last_seen DESC, id) <= 50"""


@query("host_incidents", f"SELECT ip, id FROM {TOUCHING}")
def host_incidents(s, d):
    return R.host_incidents(incidents(s, d), hosts(s, d)).select("ip", "id")


@query("host_families", f"""SELECT ip, family, CAST(sum(occurrences) AS BIGINT) AS occurrences
    FROM (SELECT src ip, * FROM incidents UNION ALL
      SELECT dst ip, * FROM incidents WHERE src <> dst) GROUP BY ip, family""")
def host_families(s, d):
    return R.host_families(incidents(s, d), hosts(s, d))


@query("export_clock", "SELECT flow_id, export_us FROM flowout")
def export_clock(s, d):
    return AS.flow_export(features(s, d), packets(s, d), P).select("flow_id", "export_us")


@query("global_prev_ts", "SELECT seq, g AS g_us FROM clocked")
def global_prev_ts(s, d):
    return clocks.global_prev_ts(packets(s, d)).select("seq", "g_us")


@query("first_contact", """SELECT src, dst, dport, min(seq) AS seq FROM flows GROUP BY ALL
    HAVING min(end_us) >= 500000000""")
def first_contact(s, d):
    """Pairs first seen in the second half, by anti-join against the known-pairs table."""
    late = F.col("end_us") >= 500_000_000
    known = flows(s, d).where(~late).select(*WN.PAIR).distinct()
    fresh = flows(s, d).where(late).join(known, WN.PAIR, "left_anti")
    return fresh.groupBy("src", "dst", "dport").agg(F.min("seq").alias("seq"))


@query("attack_window_latency", """SELECT capture_id, family, start_us,
    round((first_us - start_us) / 1e6, 6) AS latency_s FROM windows JOIN (
      SELECT capture_id, label family, min(export_us) first_us FROM captures
      WHERE is_alert AND label <> 'BENIGN' GROUP BY ALL) USING (capture_id, family)
    WHERE first_us >= start_us""")
def attack_window_latency(s, d):
    return E.attack_window_latency(VW.capture_view(s, d), VW.attack_windows(s, d))


@query("attack_window_latency_each", """SELECT capture_id, family, start_us,
    round((min(c.export_us) - start_us) / 1e6, 6) AS latency_s FROM windows w JOIN (
      SELECT capture_id, label family, export_us FROM captures WHERE is_alert) c
      USING (capture_id, family)
    WHERE c.export_us BETWEEN w.start_us AND w.end_us GROUP BY capture_id, family, start_us""")
def attack_window_latency_each(s, d):
    return E.attack_window_latency_each(VW.capture_view(s, d), VW.attack_windows(s, d))


@query("truth_join", "SELECT seq, label AS truth, is_alert FROM flows")
def truth_join(s, d):
    verdicts = flows(s, d).select("capture_id", "seq", "is_alert")
    return E.truth_join(flows(s, d), verdicts, ["capture_id", "seq"]).drop("capture_id")


# ---- flow assembly

@query("flow_boundaries", "SELECT seq, flow_id FROM bounded")
def flow_boundaries(s, d):
    return bounded_view(s, d).select("seq", "flow_id")


@query("flow_direction", "SELECT seq, flow_id, forward FROM directed")
def flow_direction(s, d):
    return directed(s, d).select("seq", "flow_id", "forward")


FLOW_SQL = f"""round((end_us - start_us) / 1e6, 6) AS duration,
    nf::DOUBLE AS fwd_packets, (n - nf)::DOUBLE AS bwd_packets, n::DOUBLE AS total_packets,
    bf::DOUBLE AS fwd_bytes, bb::DOUBLE AS bwd_bytes, (bf + bb)::DOUBLE AS total_bytes,
    round(n / {SPAN}, 6) AS pkts_per_sec, round((bf + bb) / {SPAN}, 6) AS bytes_per_sec,
    round(nf / greatest(n - nf, 1), 6) AS fwd_bwd_pkt_ratio,
    round(bb / greatest(bf, 1), 6) AS down_up_byte_ratio,
    round(mean_pkt_size, 6) AS mean_pkt_size,
    CASE WHEN n < 2 THEN 0 ELSE round(sd, 6) END AS std_pkt_size,
    min_pkt_size::DOUBLE AS min_pkt_size, max_pkt_size::DOUBLE AS max_pkt_size,
    round(mean_iat * 1000, 6) AS mean_iat_ms,
    CASE WHEN iat_n < 2 THEN 0 ELSE round(isd * 1000, 6) END AS std_iat_ms,
    round(min_iat, 6) AS min_iat, round(max_iat, 6) AS max_iat,
    {', '.join(f'{f}_count::DOUBLE AS {f}_count' for f in FLAGS)},
    CAST(coalesce(fwd_syn AND ack_at > synack_at, FALSE) AS DOUBLE) AS handshake_complete,
    CAST(proto = 'tcp' AS DOUBLE) AS is_tcp, CAST(proto = 'udp' AS DOUBLE) AS is_udp,
    CAST(proto = 'icmp' AS DOUBLE) AS is_icmp, round(mean_payload_len, 6) AS mean_payload_len,
    round(payload_entropy, 6) AS payload_entropy, 0::DOUBLE AS empty_payload_ratio,
    CAST(dport < 1024 AS DOUBLE) AS dport_is_system"""


def in_ms(df):
    """Half microseconds are ties at six decimals of a second; compare milliseconds."""
    ms = {f"{c}_iat_ms": F.col(f"{c}_iat") * 1000 for c in ("mean", "std")}
    return df.withColumns(ms).drop("mean_iat", "std_iat")


def span_ms(df):
    mean = "host_mean_flow_duration_60s"
    return df.withColumn("host_mean_flow_duration_ms", F.col(mean) * 1000).drop(mean)


@query("flow_aggregate", f"""SELECT flow_id, src, dst, sport, dport, proto, start_us, end_us, label,
    {FLOW_SQL} FROM sums""")
def flow_aggregate(s, d):
    return in_ms(AS.flow_features(AS.flow_sums(directed(s, d))).select(
        "flow_id", "src", "dst", "sport", "dport", "proto", "start_us", "end_us", "label",
        *V.FLOW_FEATURES))


@query("flow_assembly", f"""SELECT flow_id, src, dst, sport, dport, proto, start_us, end_us, export_us,
    label, {FLOW_SQL} FROM flowout""")
def flow_assembly(s, d):
    """Packets to exported flows in one go."""
    return in_ms(AS.assemble_flows(packets(s, d), P).select(
        "flow_id", "src", "dst", "sport", "dport", "proto", "start_us", "end_us", "export_us",
        "label", *V.FLOW_FEATURES))


@query("stat_moments", """SELECT flow_id, round(mean_pkt_size, 6) AS mean_pkt_size,
    CASE WHEN n < 2 THEN 0 ELSE round(sd, 6) END AS std_pkt_size, min_pkt_size::DOUBLE AS min_pkt_size,
    max_pkt_size::DOUBLE AS max_pkt_size FROM sums""")
def stat_moments(s, d):
    return features(s, d).select(
        "flow_id", "mean_pkt_size", "std_pkt_size", "min_pkt_size", "max_pkt_size")


@query("inter_arrival", "SELECT seq, round(iat_us / 1e6, 6) AS iat FROM directed")
def inter_arrival(s, d):
    return bounded(s, d).select("seq", S.seconds(F.col("iat_us")).alias("iat"))


@query("flow_flush", """SELECT flow_id, export_us FROM flowout WHERE NOT closed AND deadline_us >
    (SELECT max(ts_us) FROM packets)""")
def flow_flush(s, d):
    """Flows still open when the capture ends."""
    out = AS.flow_export(features(s, d), packets(s, d), P)
    end = packets(s, d).agg(F.max("ts_us")).first()[0]  # one number
    closed = (F.col("rst_count") > 0) | (F.col("fin_count") >= 2)
    lone = (F.col("total_packets") == 1) & (F.col("syn_count") > 0) & (F.col("ack_count") == 0)
    idle = F.when(lone, P.syn_us).otherwise(P.idle_us)
    due = F.least(F.col("end_us") + idle, F.col("start_us") + P.active_us)
    return out.where(~closed & (due > end)).select("flow_id", "export_us")




# ---- behaviour windows

FRAME = {
    "s10": "(PARTITION BY src ORDER BY end_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)",
    "s60": "(PARTITION BY src ORDER BY end_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)",
    "d10": "(PARTITION BY dst ORDER BY end_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)",
}
WINDOWS = "WINDOW " + ", ".join(f"{k} AS {v}" for k, v in FRAME.items())


def sums_sql(table: str) -> str:
    return f"""SELECT seq, n10::DOUBLE AS host_flows_10s, n60::DOUBLE AS host_flows_60s,
    round(f10 / 10, 6) AS host_syn_only_rate_10s,
    CASE WHEN y10 = 0 THEN 0 ELSE round(f10 / y10, 6) END AS host_failed_handshake_ratio_10s,
    o60::DOUBLE AS host_bytes_out_60s, i60::DOUBLE AS host_bytes_in_60s,
    round(o60 / greatest(i60, 1), 6) AS host_out_in_ratio_60s,
    round(p60 / n60, 6) AS host_new_pair_ratio_60s,
    round(d60 / 1e3 / n60, 6) AS host_mean_flow_duration_ms
    FROM (SELECT seq, count(*) OVER s10 n10, count(*) OVER s60 n60,
      count(*) FILTER (had_syn) OVER s10 y10, count(*) FILTER (had_syn AND NOT handshake) OVER s10 f10,
      sum(fwd_bytes) OVER s60 o60, sum(bwd_bytes) OVER s60 i60,
      count(*) FILTER (new_pair) OVER s60 p60, sum(end_us - start_us) OVER s60 d60
      FROM {table} {WINDOWS})"""


@query("host_window_sums", sums_sql("paired"))
def host_window_sums(s, d):
    return span_ms(WN.host_window_sums(paired(s, d), P).select("seq", *WN.host_sum_features(P)))


def distinct_sql(table: str) -> str:
    return f"""SELECT seq, (count(DISTINCT dst) OVER s10)::DOUBLE AS host_distinct_dst_10s,
    (count(DISTINCT dst) OVER s60)::DOUBLE AS host_distinct_dst_60s,
    (count(DISTINCT dport) OVER s10)::DOUBLE AS host_distinct_dport_10s,
    (count(DISTINCT dport) OVER s60)::DOUBLE AS host_distinct_dport_60s FROM {table} {WINDOWS}"""


DISTINCT_COLUMNS = [f"host_distinct_{c}_{w}s" for c in ("dst", "dport") for w in (10, 60)]


@query("host_window_distinct", distinct_sql("flows"))
def host_window_distinct(s, d):
    return WN.host_window_distinct(flows(s, d), P).select("seq", *DISTINCT_COLUMNS)


@query("host_window_distinct_frames", distinct_sql("flows"))
def host_window_distinct_frames(s, d):
    return WN.host_window_frames(flows(s, d), P).select("seq", *DISTINCT_COLUMNS)


def dst_sql(table: str) -> str:
    return f"""SELECT seq, n::DOUBLE AS dst_flows_10s, p::DOUBLE AS dst_distinct_src_10s,
    round(f / 10, 6) AS dst_syn_only_rate_10s,
    CASE WHEN y = 0 THEN 0 ELSE round(f / y, 6) END AS dst_failed_handshake_ratio_10s
    FROM (SELECT seq, count(*) OVER d10 n, count(DISTINCT src) OVER d10 p,
      count(*) FILTER (had_syn) OVER d10 y, count(*) FILTER (had_syn AND NOT handshake) OVER d10 f
      FROM {table} {WINDOWS})"""


@query("dst_window", dst_sql("flows"))
def dst_window(s, d):
    return WN.dst_window(flows(s, d), P).select("seq", *V.DST_FEATURES)


def repeat_sql(table: str) -> str:
    return f"""SELECT q.seq, max(c)::DOUBLE AS host_dst_repeat_max_60s FROM (
      SELECT a.seq, count(*) c FROM {table} a JOIN {table} b ON a.src = b.src
        AND b.end_us BETWEEN a.end_us - 60000000 AND a.end_us
      GROUP BY a.seq, b.dst, b.dport) q GROUP BY q.seq"""


@query("pair_repeat_max", repeat_sql("flows"))
def pair_repeat_max(s, d):
    return WN.pair_repeat_max(flows(s, d), P).select("seq", "host_dst_repeat_max_60s")


def beacon_sql(table: str) -> str:
    return f"""SELECT seq, round(max_by_.r, 6) AS host_beacon_regularity FROM (
    SELECT seq, max({{'len': len, 'a': -island_us, 'b': -island_seq, 't': end_us, 's': seq, 'r': r}})
      OVER (PARTITION BY src ORDER BY end_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) max_by_
    FROM (SELECT *, CASE WHEN len(gaps) < 3 THEN 0 ELSE greatest(0, least(1, 1 - sqrt(list_sum(
        list_transform(gaps, lambda g: (g - list_avg(gaps)) * (g - list_avg(gaps)))) / len(gaps))
        / list_avg(gaps))) END r
      FROM (SELECT *, list_filter(list_transform(range(2, len(own) + 1), lambda i: own[i] - own[i - 1]),
          lambda g: g > 0) gaps
        FROM (SELECT *, times[-len:] own FROM (
          SELECT *, least(pos - island_pos + 1, 13) len, list(end_us) OVER (PARTITION BY src, dst, dport
            ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) times
          FROM (SELECT *, max(CASE WHEN broke THEN pos END) OVER o island_pos,
              max(CASE WHEN broke THEN end_us END) OVER o island_us,
              max(CASE WHEN broke THEN seq END) OVER o island_seq
            FROM (SELECT *, a IS NULL OR g > a + 60000000 broke FROM (
              SELECT seq, src, dst, dport, end_us,
                lag(end_us) OVER (PARTITION BY src ORDER BY end_us, seq) g,
                lag(end_us) OVER pr a, row_number() OVER pr pos FROM {table}
                WINDOW pr AS (PARTITION BY src, dst, dport ORDER BY end_us, seq)))
            WINDOW o AS (PARTITION BY src, dst, dport ORDER BY pos)))))))"""


@query("beacon_regularity", beacon_sql("flows"))
def beacon_regularity(s, d):
    return WN.beacon_regularity(flows(s, d), P).select("seq", "host_beacon_regularity")


SOURCE_COLUMNS = [c.replace("duration_60s", "duration_ms") for c in V.HOST_FEATURES]


def source_sql(table: str) -> str:
    """All 15 source features; equal to the strict walk where no two flows end together."""
    parts = (sums_sql, distinct_sql, repeat_sql, beacon_sql)
    joined = " JOIN ".join(f"({f(table)}) p{i}" + (" USING (seq)" if i else "")
                           for i, f in enumerate(parts))
    return f"SELECT seq, {', '.join(SOURCE_COLUMNS)} FROM {joined}"


DATASET_COLUMNS = [c for c in (*V.FLOW_FEATURES, *SOURCE_COLUMNS, *V.DST_FEATURES)
                   if c not in ("mean_iat", "std_iat")]


@query("flow_dataset", f"""WITH RECURSIVE {{prefix}}, flowrec AS (
      SELECT *, row_number() OVER (PARTITION BY src, dst, dport ORDER BY export_us, end_us, seq) = 1 new_pair
      FROM (SELECT flow_id seq, src, dst, dport, start_us, end_us, export_us, syn_count > 0 had_syn,
        coalesce(fwd_syn AND ack_at > synack_at, FALSE) handshake, bf fwd_bytes, bb bwd_bytes FROM flowout))
    SELECT flow_id, label, {', '.join(DATASET_COLUMNS)}, mean_iat_ms, std_iat_ms FROM (
      SELECT flow_id, label, {FLOW_SQL} FROM flowout)
      JOIN ({source_sql("flowrec")}) h ON h.seq = flow_id
      JOIN ({dst_sql("flowrec")}) x ON x.seq = flow_id""")
def flow_dataset(s, d):
    """Packets to all 52 features."""
    return span_ms(in_ms(DS.flow_dataset(packets(s, d), P).select(
        "flow_id", "label", *V.FEATURES)))


@query("new_pair_flag", "SELECT seq, new_pair FROM paired")
def new_pair_flag(s, d):
    return VW.paired_flow_view(s, d).select("seq", "new_pair")


def scored_slim(s, d):
    named = flows(s, d).drop("threshold", "is_alert", "suppressed").withColumn(
        "family", F.expr(VETO_FAMILY))
    return TH.with_veto(named, P).select("capture_id", "src", "end_us", "seq", "score", "veto")


QUIET = f"{VETO_FAMILY} = 'BENIGN' AND confidence >= 0.90 AND score < 0.9975"


def threshold_sql(rows: str, phase: int = 0) -> str:
    return f"""WITH RECURSIVE {{prefix}} , hosts_rows AS (
      SELECT src, seq, score, veto, phase, row_number() OVER (PARTITION BY src ORDER BY phase, end_us, seq) pos
      FROM ({rows})),
    state AS (
      SELECT src, 0 phase, 0::BIGINT pos, 0::BIGINT seq, 0::DOUBLE score, FALSE veto, []::DOUBLE[] kept,
        0::BIGINT n, NULL::DOUBLE cached, 0::DOUBLE lim FROM hosts_rows WHERE pos = 1
      UNION ALL
      SELECT src, phase, pos, seq, score, veto,
        CASE WHEN score >= lim AND NOT veto THEN kept
             ELSE list_append(kept, score)[-512:] END,
        CASE WHEN score >= lim AND NOT veto THEN n ELSE n + 1 END,
        CASE WHEN NOT (score >= lim AND NOT veto) AND n + 1 > 60 AND (n + 1 - 60) % 16 = 0
          THEN least(greatest(list_aggregate(list_append(kept, score)[-512:],
                'quantile_cont', 0.99), 0.98), 0.995)
          WHEN n >= 60 THEN lim END, lim
      FROM (SELECT r.src, r.phase, r.pos, r.seq, r.score, r.veto, s.kept, s.n,
          CASE WHEN s.n < 60 THEN 0.98::DOUBLE ELSE coalesce(s.cached,
            least(greatest(list_aggregate(s.kept, 'quantile_cont', 0.99), 0.98), 0.995)) END lim
        FROM state s JOIN hosts_rows r ON r.src = s.src AND r.pos = s.pos + 1))
    SELECT seq, round(lim, 6) AS threshold, score >= lim AND NOT veto AS is_alert,
      score >= lim AND veto AS suppressed FROM state WHERE pos > 0 AND phase = {phase}"""


ONE_PHASE = f"SELECT src, seq, end_us, score, {QUIET} veto, 0 phase FROM flows"


@query("adaptive_threshold", threshold_sql(ONE_PHASE))
def adaptive_threshold(s, d):
    out = TH.adaptive_threshold(scored_slim(s, d), ["end_us", "seq"], P)
    return out.select("seq", "threshold", "is_alert", "suppressed")


CAPTURE_PHASE = ONE_PHASE.replace("SELECT src", "SELECT capture_id || '|' || src AS src").replace("FROM flows", "FROM captures")


def captured_slim(s, d):
    named = VW.capture_view(s, d).drop("threshold", "is_alert", "suppressed").withColumn(
        "family", F.expr(VETO_FAMILY))
    return TH.with_veto(named, P).select("capture_id", "src", "end_us", "seq", "score", "veto", "label")


@query("threshold_by_capture", threshold_sql(CAPTURE_PHASE))
def threshold_by_capture(s, d):
    """Captures do not share what they learn about a host."""
    out = TH.adaptive_threshold(captured_slim(s, d).drop("label"), ["end_us", "seq"], P)
    return out.select("seq", "threshold", "is_alert", "suppressed")


@query("threshold_snapshot", """SELECT host, samples, round(median, 6) AS median, round(p99, 6) AS p99,
    round(CASE WHEN samples >= 60 THEN least(greatest(own, 0.98), 0.995) ELSE 0.98 END, 6) AS threshold,
    samples >= 60 AS calibrated, samples >= 60 AND own > 0.98 + 1e-9 AS raised FROM (
      SELECT src host, least(max(n), 512) samples,
        quantile_cont(score, 0.5) FILTER (rn <= 512) median,
        quantile_cont(score, 0.99) FILTER (rn <= 512) p99,
        quantile_cont(score, 0.99) FILTER (rn > late AND rn <= late + 512) own
      FROM (SELECT *, CASE WHEN n >= 60 THEN (n - 60) % 16 ELSE 0 END late FROM (
        SELECT src, score, row_number() OVER (PARTITION BY src ORDER BY end_us DESC, seq DESC) rn,
          count(*) OVER (PARTITION BY src) n FROM flows WHERE NOT is_alert)) GROUP BY src)""")
def threshold_snapshot(s, d):
    return TH.threshold_snapshot(flows(s, d).where("not is_alert"), ["end_us", "seq"], P).drop("capture_id")


@query("incident_sessions", "SELECT seq, dedup_key, incident_id FROM sessions")
def incident_sessions(s, d):
    return VW.session_view(s, d, P).select("seq", "dedup_key", "incident_id")


@query("pr_curve", """SELECT round(score, 6) AS score, CAST(tp AS BIGINT) AS tp,
    CAST(seen AS BIGINT) AS seen, pos, round(tp / seen, 6) AS precision,
    round(tp / (SELECT count(*) FROM ranking WHERE truth), 6) AS recall FROM steps""")
def pr_curve(s, d):
    return E.pr_curve(ranking(s, d))


def ranking(s, d):
    return flows(s, d).select((F.col("label") != V.BENIGN).alias("truth"), "score")


@query("average_precision", """SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision
    FROM steps""")
def average_precision(s, d):
    return E.average_precision(ranking(s, d))


@query("roc_auc", """SELECT round((sum(r) FILTER (truth) - p * (p + 1) / 2) / (p * (c - p)), 6) AS roc_auc
    FROM (SELECT truth, avg(rn) OVER (PARTITION BY score) r,
        count(*) FILTER (truth) OVER () p, count(*) OVER () c
      FROM (SELECT truth, score, row_number() OVER (ORDER BY score) rn FROM ranking))
    GROUP BY p, c""")
def roc_auc(s, d):
    return E.roc_auc(ranking(s, d))


# ---- incidents

@query("incident_aggregate", """SELECT id AS incident_id, dedup_key, family, src, dst, dport, proto,
    epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, occurrences,
    round(score_max, 6) AS score_max, round(score_mean, 6) AS score_mean, total_bytes, total_packets,
    distinct_dports, distinct_peers FROM gathered""")
def incident_aggregate(s, d):
    return I.incident_aggregate(sessions(s, d)).drop("capture_id", "first_seq")


@query("incident_peak", """SELECT incident_id, seq, round(limit_, 6) AS threshold FROM (
    SELECT incident_id, seq, 0.98 + (seq % 10) / 1000.0 AS limit_, row_number() OVER (
      PARTITION BY incident_id ORDER BY score DESC, wall_us, seq) rn FROM sessions) WHERE rn = 1""")
def incident_peak(s, d):
    varied = sessions(s, d).withColumn("threshold", F.expr("0.98D + (seq % 10) / 1000.0D"))
    peak = I.incident_peak(varied)
    at = varied.groupBy("incident_id").agg(F.max_by("seq", I._peak()).alias("seq"))
    return peak.join(at, "incident_id").select("incident_id", "seq", "threshold")


@query("incident_confidence", "SELECT incident_id, round(confidence, 6) AS confidence FROM conf")
def incident_confidence(s, d):
    return I.incident_confidence(sessions(s, d), P)


@query("incident_criticality", """SELECT id, CAST(criticality AS BIGINT) AS criticality, asset_name
    FROM judged""")
def incident_criticality(s, d):
    first = I.incident_aggregate(sessions(s, d)).withColumnRenamed("incident_id", "id")
    return I.incident_criticality(first, dims.default_assets(s), P).select(
        "id", "criticality", "asset_name")


@query("incident_truth", """SELECT incident_id, label AS truth, count(*) AS n FROM sessions
    GROUP BY ALL""")
def incident_truth(s, d):
    return I.incident_truth(sessions(s, d))


@query("truth_purity", """SELECT incident_id, round(count(*) FILTER (label <> 'BENIGN') / count(*), 6)
    AS share FROM sessions GROUP BY 1""")
def truth_purity(s, d):
    return R.truth_purity(I.alert_rows(sessions(s, d)))


@query("count_incidents", """SELECT count(DISTINCT incident_id) AS incidents FROM sessions""")
def count_incidents(s, d):
    return I.count_incidents(flows(s, d), (), P)


# ---- read models

RECENT = f"FROM incidents WHERE last_seen >= {NOW} - INTERVAL 72 HOUR"
CLOSED = f"FROM incidents WHERE closed_at >= {NOW} - INTERVAL 240 HOUR"


@query("overview_severity", f"SELECT severity, count(*) AS n FROM incidents WHERE status IN ({OPEN}) GROUP BY 1")
def overview_severity(s, d):
    return R.overview_severity(incidents(s, d))


@query("overview_status", "SELECT status, count(*) AS n FROM incidents GROUP BY 1")
def overview_status(s, d):
    return R.overview_status(incidents(s, d))


@query("overview_family", f"SELECT family, count(*) AS n {RECENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def overview_family(s, d):
    return R.overview_family(incidents(s, d), VW.NOW, 72)


@query("overview_sources", f"""SELECT src AS ip, count(*) AS incidents,
    CAST(sum(occurrences) AS BIGINT) AS alerts,
    CAST(max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) - 1) AS BIGINT) AS max_severity
    {RECENT} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 8""")
def overview_sources(s, d):
    return R.overview_sources(incidents(s, d), VW.NOW, 72)


@query("overview_targets", f"""SELECT dst AS ip, count(*) AS incidents, max(asset_name) AS asset,
    CAST(max(criticality) AS BIGINT) AS criticality {RECENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def overview_targets(s, d):
    return R.overview_targets(incidents(s, d), VW.NOW, 72)


@query("overview_totals", f"""SELECT count(*) AS incidents,
    CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS alerts {RECENT}""")
def overview_totals(s, d):
    return R.overview_totals(incidents(s, d), VW.NOW, 72)


@query("mean_time_to_close", f"""SELECT count(*) AS closed,
    round(avg(epoch_us(closed_at) - epoch_us(first_seen)) / 6e7, 1) AS minutes {CLOSED}""")
def mean_time_to_close(s, d):
    return R.mean_time_to_close(incidents(s, d), VW.NOW, 240)


@query("feedback_precision", f"""SELECT count(*) FILTER (verdict = 'TP') AS tp,
    count(*) FILTER (verdict = 'FP') AS fp, round(count(*) FILTER (verdict = 'TP')
    / nullif(count(*) FILTER (verdict IN ('TP', 'FP')), 0), 4) AS precision {CLOSED}""")
def feedback_precision(s, d):
    return R.feedback_precision(incidents(s, d), VW.NOW, 240)


@query("hourly_heatmap", f"""SELECT epoch_us(date_trunc('hour', last_seen)) AS hour,
    {', '.join(f"count(*) FILTER (severity = '{x}') AS {x.lower()}" for x in V.SEVERITIES)},
    count(*) AS total {RECENT} GROUP BY 1""")
def hourly_heatmap(s, d):
    return R.hourly_heatmap(incidents(s, d), VW.NOW, 72)


@query("overview_bytes", f"""SELECT (SELECT CAST(sum(bytes) AS BIGINT) FROM buckets) AS bytes,
    (SELECT count(*) FROM incidents WHERE status IN ({OPEN})) AS open""")
def overview_bytes(s, d):
    return R.overview_bytes(RU.bucket_rollup(flows(s, d)), incidents(s, d))


def stored_alerts(s, d):
    return I.alert_rows(sessions(s, d))


@query("incident_timeline", """SELECT incident_id, epoch_us(date_trunc('second', ts)) AS second,
    count(*) AS n, round(max(score), 6) AS score_max FROM stored GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY second) <= 500""")
def incident_timeline(s, d):
    return R.incident_timeline(stored_alerts(s, d))


@query("incident_ports", """SELECT incident_id, dport AS port, count(*) AS n FROM stored GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY n DESC, port) <= 20""")
def incident_ports(s, d):
    return R.incident_ports(stored_alerts(s, d))


@query("incident_peers", """SELECT incident_id, src AS ip, count(*) AS n FROM stored GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY n DESC, ip) <= 20""")
def incident_peers(s, d):
    return R.incident_peers(stored_alerts(s, d))


@query("incident_page", f"""SELECT {PAYLOAD_COLUMNS} FROM (SELECT * FROM incidents
    ORDER BY priority DESC, last_seen DESC, id LIMIT 50 OFFSET 10)""")
def incident_page(s, d):
    return R.incident_page(incidents(s, d), "priority", 50, 10)


@query("incident_total", "SELECT count(*) AS total FROM incidents WHERE family = 'PORT_SCAN'")
def incident_total(s, d):
    return R.incident_total(R.incident_filter(incidents(s, d), family="port_scan"))


@query("top_alerts", """SELECT incident_id, seq, round(score, 6) AS score FROM stored
    QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, seq) <= 2""")
def top_alerts(s, d):
    return R.top_alerts(stored_alerts(s, d), 2).select("incident_id", "seq", "score")


@query("host_list", """SELECT ip, asset_name, criticality, last_us AS last_seen, flows_out, flows_in,
    bytes_out, bytes_in, alerts, round(score_mean, 4) AS score_mean,
    round(coalesce(threshold, 0), 4) AS threshold FROM named_hosts WHERE ip LIKE '%10.%'
    ORDER BY alerts DESC, last_us DESC, ip LIMIT 100""")
def host_list(s, d):
    return R.host_list(hosts(s, d), "10.", 100).drop("first_seen", "calibrated")


@query("host_total", "SELECT count(*) AS total FROM named_hosts")
def host_total(s, d):
    return R.host_total(hosts(s, d))


@query("last_buckets", BUCKET_SQL + " ORDER BY ts_us DESC LIMIT 600")
def last_buckets(s, d):
    return R.last_buckets(RU.bucket_rollup(flows(s, d)))


@query("recent_ticks", BUCKET_SQL + " ORDER BY ts_us DESC LIMIT 180")
def recent_ticks(s, d):
    return R.recent_ticks(RU.bucket_rollup(flows(s, d)))


@query("latest_incidents", """SELECT incident_id AS id, seq, at_us, round(score, 6) AS score FROM (
    SELECT incident_id, seq, wall_us AS at_us, score FROM sessions QUALIFY row_number() OVER (
      PARTITION BY incident_id ORDER BY wall_us DESC, seq DESC) = 1)
    ORDER BY at_us DESC, seq DESC LIMIT 60""")
def latest_incidents(s, d):
    events = sessions(s, d).select(F.col("incident_id").alias("id"), "seq", "at_us", "score")
    return R.latest_incidents(events)


@query("explain_budget", """SELECT batch, seq FROM (SELECT seq // 512 AS batch, seq, score FROM flows
    WHERE is_alert) QUALIFY row_number() OVER (PARTITION BY batch ORDER BY score DESC, seq) <= 6""")
def explain_budget(s, d):
    alerts = flows(s, d).where("is_alert").withColumn("batch", F.expr("seq div 512"))
    return A.explain_budget(alerts, ["batch"], P).select("batch", "seq")


@query("time_order", """SELECT seq, capture_id, ts_us FROM (
    SELECT seq, 'a' capture_id, ts_us FROM packets UNION ALL
    SELECT seq, 'b', ts_us + 1000 FROM packets) ORDER BY ts_us, capture_id, seq""")
def time_order(s, d):
    one = packets(s, d).withColumn("capture_id", F.lit("a"))
    two = packets(s, d).withColumn("capture_id", F.lit("b")).withColumn(
        "ts_us", F.col("ts_us") + 1000)
    return DS.time_order(DS.stack_captures(one, two)).select("seq", "capture_id", "ts_us")


# ---- sets

@query("stack_captures", """SELECT capture_id, label, count(*) AS n FROM captures GROUP BY ALL""")
def stack_captures(s, d):
    caps = VW.capture_view(s, d)
    parts = [caps.where(F.col("capture_id") == f"cap{i}") for i in range(3)]
    return DS.stack_captures(*parts).groupBy("capture_id", "label").agg(F.count(F.lit(1)).alias("n"))


def split_table(s):
    return s.createDataFrame([("cap0", "train"), ("cap1", "train"), ("cap2", "test")],
                             "capture_id string, part string")


@query("capture_split", """SELECT CASE WHEN capture_id = 'cap2' THEN 'test' ELSE 'train' END AS part,
    label, count(*) AS n FROM captures GROUP BY ALL""")
def capture_split(s, d):
    train, test = DS.capture_split(VW.capture_view(s, d), split_table(s))
    sides = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return sides.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("split_overlap", "SELECT capture_id FROM captures WHERE FALSE")
def split_overlap(s, d):
    return DS.split_overlap(*DS.capture_split(VW.capture_view(s, d), split_table(s)))


SIGNATURE = ["src", "dst", "dport", "packets", "bytes"]


@query("flow_multiset_diff", """SELECT *, 'left' AS side FROM (
      SELECT src, dst, dport, packets, bytes FROM flows EXCEPT ALL
      SELECT src, dst, dport, packets, CASE WHEN seq % 100 = 0 THEN bytes + 1 ELSE bytes END FROM flows)
    UNION ALL SELECT *, 'right' FROM (
      SELECT src, dst, dport, packets, CASE WHEN seq % 100 = 0 THEN bytes + 1 ELSE bytes END FROM flows
      EXCEPT ALL SELECT src, dst, dport, packets, bytes FROM flows)""")
def flow_multiset_diff(s, d):
    other = flows(s, d).withColumn(
        "bytes", F.expr("case when seq % 100 = 0 then bytes + 1 else bytes end"))
    return DS.flow_multiset_diff(flows(s, d), other, SIGNATURE)


# ---- model

MODEL_FEATURES = ("packets", "fwd_bytes", "bwd_bytes", "score", "seconds", "dport")


def model_rows_view(s, d):
    return flows(s, d).withColumns({
        "id": F.col("seq"), "seconds": S.seconds(F.col("end_us") - F.col("start_us"))})


def model_rows(s, d):
    return stored(model_rows_view, s, d)


_DETECTORS: dict[tuple, D.Detector] = {}


def detector(s, d) -> D.Detector:
    key = (s.sparkContext.applicationId, d)
    if key not in _DETECTORS:
        benign = model_rows(s, d).where(F.col("label") == V.BENIGN)
        model = D.fit_anomaly(benign, MODEL_FEATURES, trees=100, sample=1024)
        capped = C.class_cap(model_rows(s, d), P.class_cap)
        model.classifier = C.classifier_fit(
            capped.withColumn("vec", S.vectorize(MODEL_FEATURES)), trees=20, depth=6)
        _DETECTORS[key] = model
    return _DETECTORS[key]


SCALED = ("packets", "fwd_bytes", "bwd_bytes", "score")


@query("robust_scale", "SELECT seq, " + ", ".join(
    f"round(({c} - quantile_cont({c}, 0.5) OVER ()) / (quantile_cont({c}, 0.95) OVER () "
    f"- quantile_cont({c}, 0.05) OVER ()), 6) AS {c}" for c in SCALED) + " FROM flows")
def robust_scale(s, d):
    fitted = A.robust_fit(flows(s, d), SCALED)
    medians, scales = (A.in_order(fitted, SCALED, c) for c in ("median", "scale"))
    exact = F.array(*[F.col(c).cast("double") for c in SCALED])
    out = flows(s, d).withColumn("v", A.robust_scale(exact, medians, scales))
    return out.select("seq", *[F.col("v")[i].alias(c) for i, c in enumerate(SCALED)])


@query("baseline_median", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median FROM flows" for c in SCALED))
def baseline_median(s, d):
    return A.baseline_median(flows(s, d), SCALED)


@query("baseline_median_ranked", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median FROM flows" for c in SCALED))
def baseline_median_ranked(s, d):
    """Of rows that came in another order and in many files."""
    return A.baseline_median(flows(s, d).repartition(16, "seq"), SCALED)


GRID = """SELECT i, i * 0.999 / 2000 AS prob, max(q) OVER (ORDER BY i) + i * 1e-12 AS value,
    max(q) OVER () - (SELECT quantile_cont(score, 0.5) FROM flows) AS tail
    FROM (SELECT unnest(range(2001)) i, unnest(quantile_cont(score,
      list_transform(range(2001), lambda i: i * 0.999 / 2000))) q FROM flows)"""


@query("ecdf_fit", f"""SELECT i, round(prob * 10, 6) AS prob, round(value, 6) AS value,
    round(greatest(tail, 1e-6), 6) AS tail_scale FROM ({GRID})""")
def ecdf_fit(s, d):
    grid = A.ecdf_fit(flows(s, d), "score")
    return grid.withColumn("prob", F.col("prob") * 10)  # grid steps end in the seventh decimal


@query("ecdf_fit_ranked", f"""SELECT i, round(prob * 10, 6) AS prob, round(value, 6) AS value,
    round(greatest(tail, 1e-6), 6) AS tail_scale FROM ({GRID})""")
def ecdf_fit_ranked(s, d):
    grid = A.ecdf_fit(flows(s, d).repartition(16, "seq"), "score")
    return grid.withColumn("prob", F.col("prob") * 10)


@query("calibrate_score", f"""WITH {{prefix}}, grid AS ({GRID}), lines AS (SELECT *, lead(value) OVER (ORDER BY i) v2,
      lead(prob) OVER (ORDER BY i) p2 FROM grid)
    SELECT x.seq, round(least(greatest(CASE WHEN x.raw > (SELECT max(value) FROM grid)
        THEN 1 - 0.001 * exp(-(x.raw - (SELECT max(value) FROM grid)) / (SELECT max(tail) FROM grid))
      WHEN g.i IS NULL THEN 0 WHEN g.v2 IS NULL THEN g.prob
      ELSE g.prob + (x.raw - g.value) * (g.p2 - g.prob) / (g.v2 - g.value) END, 0), 1 - 1e-9), 6) AS score
    FROM (SELECT seq, score * 1.02 - 0.01 AS raw FROM flows) x
    ASOF LEFT JOIN lines g ON x.raw >= g.value""")
def calibrate_score(s, d):
    grid = A.ecdf_fit(flows(s, d), "score")
    raw = F.col("score") * 1.02 - 0.01
    return flows(s, d).select("seq", A.calibrate_score(grid)(raw).alias("score"))


@query("iforest_fit")
def iforest_fit(s, d):
    return detector(s, d).trees


@query("iforest_score")
def iforest_score(s, d):
    return D.anomaly_scores(model_rows(s, d), detector(s, d)).select("seq", "raw", "score")


@query("occlusion_cross")
def occlusion_cross(s, d):
    """Alerts by feature: the score left when that feature is replaced by its median."""
    model = detector(s, d)
    forest, medians, scales = model.parts()
    alerts = D.anomaly_scores(model_rows(s, d).where("is_alert"), model)
    occluded = A.occluded_scores(forest, [0.0] * len(medians), alerts)("scaled")
    names = F.array(*[F.lit(n) for n in MODEL_FEATURES])
    return alerts.withColumn("o", occluded).select(
        "seq", "raw", F.posexplode("o").alias("i", "occluded")).select(
        "seq", F.get(names, F.col("i")).alias("feature"), (F.col("raw") - F.col("occluded")).alias("delta"))


@query("explain")
def explain(s, d):
    model = detector(s, d)
    alerts = D.anomaly_scores(model_rows(s, d).where("is_alert"), model)
    out = D.explained(alerts, model, P)
    return out.select("seq", F.posexplode("contributions").alias("place", "c")).select(
        "seq", "place", "c.*")


@query("explain_top_features")
def explain_top_features(s, d):
    """Explanations of the alerts inside the budget only."""
    model = detector(s, d)
    chosen = A.explain_budget(
        model_rows(s, d).where("is_alert").withColumn("batch", F.expr("seq div 512")), ["batch"], P)
    out = D.explained(D.anomaly_scores(chosen, model), model, P)
    return out.select("seq", F.size("contributions").alias("n"),
                      F.col("contributions.feature").cast("string").alias("features"))


@query("classify")
def classify(s, d):
    rows = model_rows(s, d).drop("confidence").withColumn("vec", S.vectorize(MODEL_FEATURES))
    return C.classify(rows, detector(s, d).classifier, "vec", P).select(
        "seq", "raw_family", "confidence")


@query("classifier_fit")
def classifier_fit(s, d):
    """Training-set confusion of a fresh fit."""
    rows = model_rows(s, d).drop("confidence").withColumn("vec", S.vectorize(MODEL_FEATURES))
    model = C.classifier_fit(rows, trees=10, depth=5)
    return C.classify(rows, model, "vec", P).groupBy("label", "raw_family").agg(
        F.count(F.lit(1)).alias("n"))


@query("score_flows")
def score_flows(s, d):
    rows = model_rows(s, d).drop("score", "threshold", "is_alert", "suppressed", "family", "confidence")
    rows = rows.withColumn("score", flows_score())
    model = detector(s, d)
    renamed = rows.withColumnRenamed("score", "activity")
    shifted = D.Detector(tuple("activity" if n == "score" else n for n in model.features),
                         model.trees, model.grid,
                         model.scaling.replace("score", "activity", "feature"), model.classifier)
    out = D.score_flows(renamed, shifted, ["export_us", "end_us", "seq"], P)
    return out.select("seq", "score", "threshold", "is_alert", "suppressed", "family", "confidence")


def flows_score():
    return F.col("fwd_bytes") / (F.col("fwd_bytes") + 20.0)


@query("model_roundtrip")
def model_roundtrip(s, d):
    from packetloom.session import scratch_path
    path = scratch_path(s, "model")
    D.model_save(detector(s, d), path)
    loaded = D.model_load(s, path, MODEL_FEATURES)
    return D.anomaly_scores(model_rows(s, d), loaded).select("seq", "score")


# ---- evaluation

@query("class_counts", "SELECT label, count(*) AS n FROM flows GROUP BY 1")
def class_counts(s, d):
    return C.class_counts(flows(s, d))


@query("class_cap_rows", """SELECT label, seq FROM flows QUALIFY row_number() OVER (
    PARTITION BY label ORDER BY md5(concat_ws('|', capture_id, seq, '0')), seq) <= 300""")
def class_cap_rows(s, d):
    return C.class_cap(flows(s, d), 300).select("label", "seq")


@query("class_cap", """SELECT label, least(count(*), 300) AS n FROM flows GROUP BY 1""")
def class_cap(s, d):
    return C.class_counts(C.class_cap(flows(s, d), 300))


TRUTHS = """tp, fp, fn, tn FROM (SELECT count(*) FILTER (is_alert AND label <> 'BENIGN') tp,
    count(*) FILTER (is_alert AND label = 'BENIGN') fp,
    count(*) FILTER (NOT is_alert AND label <> 'BENIGN') fn,
    count(*) FILTER (NOT is_alert AND label = 'BENIGN') tn FROM flows)"""


@query("evaluate", f"""SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1, {TRUTHS}""")
def evaluate(s, d):
    return E.evaluate(flows(s, d))


@query("benign_rates", """SELECT CAST(sum(flows) AS BIGINT) AS benign_flows,
    round(avg(alerts / (span / 3600.0)), 6) AS alerts_per_hour,
    round(avg(coalesce(incidents, 0) / (span / 3600.0)), 6) AS incidents_per_hour,
    round(avg(alerts / flows), 6) AS fp_rate FROM (
      SELECT capture_id, count(*) flows, count(*) FILTER (is_alert) alerts,
        (max(end_us) - arg_min(start_us, seq)) / 1e6 span FROM captures GROUP BY 1) LEFT JOIN (
      SELECT capture_id, CAST(sum(brk) AS BIGINT) incidents FROM (
        SELECT 'cap' || (u % 3) capture_id, CASE WHEN end_us - lag(end_us) OVER (
          PARTITION BY u % 3, dedup_key ORDER BY end_us, seq) <= 60000000 THEN 0 ELSE 1 END brk
        FROM alerts) GROUP BY 1) USING (capture_id)""")
def benign_rates(s, d):
    return E.benign_rates(VW.capture_view(s, d), P)


@query("hosts_raised", """SELECT count(*) FILTER (n >= 60 AND own > 0.98 + 1e-9) AS hosts_raised FROM (
      SELECT src, max(n) n, quantile_cont(score, 0.99) FILTER (rn > late AND rn <= late + 512) own
      FROM (SELECT *, CASE WHEN n >= 60 THEN (n - 60) % 16 ELSE 0 END late FROM (
        SELECT src, score, row_number() OVER (PARTITION BY src ORDER BY end_us DESC, seq DESC) rn,
          count(*) OVER (PARTITION BY src) n FROM flows)) GROUP BY src)""")
def hosts_raised(s, d):
    return E.hosts_raised(TH.threshold_snapshot(flows(s, d), ["end_us", "seq"], P))


LATENCY = """(SELECT (first_us - start_us) / 1e6 latency_s, family FROM windows JOIN (
      SELECT capture_id, label family, min(export_us) first_us FROM captures
      WHERE is_alert AND label <> 'BENIGN' GROUP BY ALL) USING (capture_id, family)
    WHERE first_us >= start_us)"""


@query("latency_summary", f"""SELECT count(*) AS n, round(quantile_cont(latency_s, 0.5), 6) AS p50,
    round(quantile_cont(latency_s, 0.95), 6) AS p95 FROM {LATENCY}""")
def latency_summary(s, d):
    return E.latency_summary(attack_window_latency(s, d))


@query("family_latency", f"""SELECT family, round(quantile_cont(latency_s, 0.5), 2) AS median_s,
    count(*) AS n FROM {LATENCY} GROUP BY 1""")
def family_latency(s, d):
    return E.family_latency(attack_window_latency(s, d))


RECALL = """SELECT label AS family, count(*) FILTER ({hit}) AS hits, count(*) AS support,
    round(count(*) FILTER ({hit}) / count(*), 4) AS recall FROM flows WHERE label <> 'BENIGN' GROUP BY 1"""


@query("family_recall", RECALL.format(hit="is_alert"))
def family_recall(s, d):
    return E.family_recall(flows(s, d))


@query("class_report", """SELECT label, CASE WHEN named = 0 THEN 0 ELSE round(hits / named, 6) END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE round(hits / support, 6) END AS recall,
    round(2 * hits / (support + named), 6) AS f1, support FROM (
      SELECT f.family label, (SELECT count(*) FROM attacks WHERE truth = f.family) support,
        (SELECT count(*) FROM attacks WHERE predicted = f.family) named,
        (SELECT count(*) FROM attacks WHERE predicted = f.family AND truth = f.family) hits
      FROM families f WHERE f.family NOT IN ('UNKNOWN', 'BENIGN')) WHERE support + named > 0""")
def class_report(s, d):
    return E.class_report(VW.prediction_view(s, d))


@query("macro_f1", """SELECT round(avg(2 * hits / (support + named)), 6) AS macro_f1 FROM (
      SELECT f.family label, (SELECT count(*) FROM attacks WHERE truth = f.family) support,
        (SELECT count(*) FROM attacks WHERE predicted = f.family) named,
        (SELECT count(*) FROM attacks WHERE predicted = f.family AND truth = f.family) hits
      FROM families f WHERE f.family NOT IN ('UNKNOWN', 'BENIGN'))""")
def macro_f1(s, d):
    return E.macro_f1(E.class_report(VW.prediction_view(s, d)))


ALL_LABELS = [*V.ATTACK_FAMILIES, V.UNKNOWN, V.BENIGN]
MATRIX = "SELECT f.family AS truth, " + ", ".join(
    f"count(*) FILTER (predicted = '{x}') AS {x}" for x in ALL_LABELS) + (
    " FROM families f LEFT JOIN attacks p ON p.truth = f.family GROUP BY 1")


@query("confusion_matrix", MATRIX)
def confusion_matrix(s, d):
    return E.confusion_matrix(VW.prediction_view(s, d))


@query("confusion_shares", "SELECT truth, " + ", ".join(
    f"CASE WHEN total = 0 THEN 0 ELSE round({x} / total, 6) END AS {x}" for x in ALL_LABELS)
    + f" FROM (SELECT *, {' + '.join(ALL_LABELS)} AS total FROM ({MATRIX}))")
def confusion_shares(s, d):
    return E.confusion_shares(E.confusion_matrix(VW.prediction_view(s, d)))


@query("benchmark_tables", f"""SELECT l.family, mitre_technique AS technique, l.recall AS recall_loud,
    coalesce(q.recall, 0) AS recall_stealth, l.support FROM ({RECALL.format(hit='is_alert')}) l
    LEFT JOIN ({RECALL.format(hit='score >= 0.99')}) q USING (family) JOIN families USING (family)""")
def benchmark_tables(s, d):
    quiet = flows(s, d).withColumn("is_alert", F.col("score") >= 0.99)
    return E.benchmark_table(E.family_recall(flows(s, d)), E.family_recall(quiet))


@query("replay", threshold_sql(
    ONE_PHASE + " WHERE label = 'BENIGN' UNION ALL " + ONE_PHASE.replace("0 phase", "1 phase"), 1))
def replay(s, d):
    """Benign flows warm the hosts up; labelled flows are then judged by the same state."""
    slim = scored_slim(s, d).join(flows(s, d).select("seq", "label"), "seq")
    benign = slim.where(F.col("label") == V.BENIGN)
    phased = DS_replay(benign, slim)
    out = TH.adaptive_threshold(phased, ["phase", "end_us", "seq"], P)
    return out.where("phase = 1").select("seq", "threshold", "is_alert", "suppressed")


DS_replay = E.replay_phases


@query("replay_by_capture", threshold_sql(
    CAPTURE_PHASE + " WHERE label = 'BENIGN' UNION ALL " + CAPTURE_PHASE.replace("0 phase", "1 phase"), 1))
def replay_by_capture(s, d):
    """Each capture is warmed up by its own benign flows and judged by its own state."""
    slim = captured_slim(s, d)
    phased = DS_replay(slim.where(F.col("label") == V.BENIGN), slim)
    out = TH.adaptive_threshold(phased, ["phase", "end_us", "seq"], P)
    return out.where("phase = 1").select("seq", "threshold", "is_alert", "suppressed")


@query("train_evaluate")
def train_evaluate(s, d):
    """Fit on two captures, judge the third."""
    train, test = DS.capture_split(
        model_rows(s, d).withColumn("capture_id", F.concat(F.lit("cap"), F.col("u") % 3))
        .drop("threshold", "is_alert", "suppressed", "family", "confidence")
        .withColumnRenamed("score", "activity"), split_table(s))
    names = tuple("activity" if n == "score" else n for n in MODEL_FEATURES)
    model = D.fit_anomaly(train.where(F.col("label") == V.BENIGN), names, trees=50, sample=512)
    capped = C.class_cap(train, P.class_cap)
    model.classifier = C.classifier_fit(
        capped.withColumn("vec", S.vectorize(names)), trees=10, depth=5)
    return E.evaluate(D.score_flows(test, model, ["export_us", "end_us", "seq"], P))


@query("engine_stats", """SELECT CAST(sum(packets) AS BIGINT) AS packets, count(*) AS flows,
    count(*) FILTER (is_alert) AS alerts, CAST(sum(bytes) AS BIGINT) AS bytes,
    round((max(end_us) - min(start_us)) / 1e6, 2) AS span, round(avg(score), 4) AS score_mean,
    round(max(score), 4) AS score_max, round(count(*) FILTER (is_alert)
      / ((max(end_us) - min(start_us)) / 1e6 / 3600), 2) AS alerts_per_hour, 0::BIGINT AS suppressed,
    (SELECT count(*) FROM (SELECT DISTINCT family FROM flows WHERE is_alert)) AS families FROM flows""")
def engine_stats(s, d):
    return RU.engine_stats(flows(s, d)).withColumn(
        "families", F.size("by_family").cast("long")).drop("by_family")


# ---- triage

@query("triage_apply", """SELECT i.id, coalesce(n.status_n, i.status) AS status,
    coalesce(n.verdict_n, i.verdict) AS verdict, coalesce(n.assignee_n, i.assignee) AS assignee,
    CASE WHEN n.moved_at IS NULL THEN epoch_us(i.closed_at)
         WHEN coalesce(n.status_n, i.status) = 'CLOSED' THEN epoch_us(n.moved_at) END AS closed_at,
    n.notes AS note FROM incidents i LEFT JOIN (
      SELECT incident_id id, arg_max(status_a, seq) FILTER (status_a IS NOT NULL) status_n,
        arg_max(verdict, seq) FILTER (verdict IS NOT NULL) verdict_n,
        arg_max(assignee, seq) FILTER (assignee IS NOT NULL) assignee_n,
        max(ts) FILTER ((status IS NOT NULL AND status <> status_b)
          OR (judges AND coalesce(status, status_b) <> 'CLOSED')) moved_at,
        string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M') || ' ' || actor || '] ' || note, chr(10) || chr(10)
          ORDER BY ts, seq) FILTER (note IS NOT NULL) notes
      FROM effects GROUP BY 1) n USING (id)""")
def triage_apply(s, d):
    return TR.triage_apply(incidents(s, d), triage_log(s, d)).select(
        "id", "status", "verdict", "assignee", "closed_at", "note")


@query("triage_diff", """SELECT incident_id, seq, 'status' AS field, status_b AS old, status AS new
      FROM effects WHERE status IS NOT NULL AND status <> status_b
    UNION ALL SELECT incident_id, seq, 'assignee', assignee_b, assignee FROM effects
      WHERE assignee IS NOT NULL AND assignee IS DISTINCT FROM assignee_b
    UNION ALL SELECT incident_id, seq, 'verdict', verdict_b, verdict FROM effects WHERE judges
    UNION ALL SELECT incident_id, seq, 'note', NULL, 'true' FROM effects WHERE note IS NOT NULL""")
def triage_diff(s, d):
    return TR.triage_diff(incidents(s, d), triage_log(s, d))


@query("triage_bulk", """SELECT id, CASE WHEN family = 'DOS_FLOOD' THEN 'CLOSED' ELSE status END AS status,
    CASE WHEN family = 'DOS_FLOOD' THEN 'FP' ELSE verdict END AS verdict FROM incidents""")
def triage_bulk(s, d):
    """Every flood incident judged a false positive, in requests of at most 500 ids."""
    rows = incidents(s, d)
    # requests are cut by first alert; a range holds at most 500 ids
    ids = rows.where("family = 'DOS_FLOOD'").groupBy(F.expr("first_seq div 500").alias("batch")).agg(
        F.collect_list("id").alias("ids"))
    events = TR.triage_bulk(ids, F.lit(VW.NOW), F.col("batch"), "analyst", verdict="FP")
    return TR.triage_apply(rows, events).select("id", "status", "verdict")


@query("retraining_labels", """SELECT s.incident_id, s.seq, i.verdict, CASE WHEN i.verdict = 'TP'
    THEN i.family ELSE 'BENIGN' END AS training_label FROM sessions s JOIN incidents i
    ON i.id = s.incident_id WHERE i.verdict IS NOT NULL""")
def retraining_labels(s, d):
    return TR.retraining_labels(sessions(s, d).drop("verdict"), incidents(s, d)).select(
        "incident_id", "seq", "verdict", "training_label")


# ---- streams
#
# Each drains the whole table once, in several micro-batches, then reads what was written.
# A last row far in the future moves the watermark past every deadline.

FUTURE_US = 10_000_000_000


def landed(df: DataFrame, name: str) -> str:
    """The rows as files that arrive in time order, the closing row last.

    Time is cut so that a file holds about a million rows: files, unlike the partitions
    of one write, reach the stream in order.
    """
    from packetloom.session import scratch_path
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    at = "ts_us" if "ts_us" in df.columns else "end_us"
    lo, hi, n = df.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    files = max(3, n // 1_000_000)
    step = (hi - lo) // files + 1
    for i in range(files):
        inside = F.col(at).between(lo + i * step, lo + (i + 1) * step - 1)
        df.where(inside).coalesce(1).write.mode("append").parquet(path)
    closing = df.limit(1).withColumns({at: F.lit(FUTURE_US), "seq": F.lit(-1).cast("long")})
    closing.write.mode("append").parquet(path)
    return path


def stream_of(df: DataFrame, path: str) -> DataFrame:
    at = "ts_us" if "ts_us" in df.columns else "end_us"
    return (df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 2)
            .parquet(path).withColumn("ts", F.timestamp_micros(at)))


@query("packets_stream", f"SELECT {PACKET_COLUMNS} FROM packets")
def packets_stream(s, d):
    from packetloom.sources.packets import packets_stream as source, write_packets
    from packetloom.streaming.sinks import run_to_end
    path = write_packets(packets(s, d))
    out = run_to_end(source(s, path, files_per_trigger=2).drop("ts"), "packets-out")
    return readable(s.read.parquet(out))


DCUTS = """dcuts AS (
      SELECT k, pos, seq, seq flow_id, ts_us start_us, ts_us last_us, 1 n,
        (flags & 2) > 0 AND (flags & 16) = 0 lone, flags & 1 fins, (flags & 4) > 0 reset
      FROM numbered WHERE pos = 1
      UNION ALL
      SELECT k, pos, seq, CASE WHEN cut THEN seq ELSE flow_id END,
        CASE WHEN cut THEN ts_us ELSE start_us END, ts_us, CASE WHEN cut THEN 1 ELSE n + 1 END,
        CASE WHEN cut THEN (flags & 2) > 0 AND (flags & 16) = 0 ELSE lone END,
        CASE WHEN cut THEN flags & 1 ELSE fins + (flags & 1) END, (flags & 4) > 0
      FROM (SELECT c.k, x.pos, c.flow_id, c.start_us, c.n, c.lone, c.fins, x.seq, x.ts_us, x.flags,
          c.reset OR c.fins >= 2 OR x.ts_us >= least(c.last_us +
            CASE WHEN c.n = 1 AND c.lone THEN 3000000 ELSE 15000000 END, c.start_us + 120000000) cut
        FROM dcuts c JOIN numbered x ON x.k = c.k AND x.pos = c.pos + 1))"""


@query("flow_stream", f"""WITH RECURSIVE {{prefix}}, {DCUTS}
    SELECT flow_id, count(*)::DOUBLE AS total_packets, min(p.ts_us) AS start_us, max(p.ts_us) AS end_us,
      sum(size)::DOUBLE AS total_bytes FROM dcuts c JOIN packets p USING (seq) GROUP BY flow_id""")
def flow_stream(s, d):
    from packetloom.streaming.flow_stream import flow_stream as assemble
    from packetloom.streaming.sinks import run_to_end
    rows = packets(s, d)
    flows_out = assemble(stream_of(rows, landed(rows, "packets-in")), P)
    out = s.read.parquet(run_to_end(flows_out, "flows-out"))
    return out.where("flow_id >= 0").select(
        "flow_id", "total_packets", "start_us", "end_us", "total_bytes")


@query("packets_to_incidents_stream", f"""WITH RECURSIVE {{prefix}}, {DCUTS},
    flw AS (SELECT flow_id, min(p.ts_us) start_us, max(p.ts_us) end_us, count(*) n, sum(size) total,
        sum(p.flags & 1) >= 2 OR bool_or((p.flags & 4) > 0) closed, arg_min(p.src, p.seq) src, arg_min(p.dst, p.seq) dst,
        bool_or(p.seq = flow_id AND (p.flags & 2) > 0 AND (p.flags & 16) = 0) began_syn,
        coalesce(arg_max(p.label, (p.ts_us, p.seq)) FILTER (p.label <> 'BENIGN'), 'UNKNOWN') family
      FROM dcuts c JOIN packets p USING (seq) GROUP BY flow_id),
    al AS (SELECT *, CASE family WHEN 'DOS_FLOOD' THEN 'DOS_FLOOD|*|' || dst
        WHEN 'PORT_SCAN' THEN 'PORT_SCAN|' || src || '|*' ELSE 'UNKNOWN|' || src || '|' || dst END dedup_key,
        CASE WHEN closed THEN end_us ELSE greatest(end_us, least(start_us + 120000000,
          end_us + CASE WHEN n = 1 AND began_syn THEN 3000000 ELSE 15000000 END)) END at_us,
        total / (total + 20.0::DOUBLE) score FROM flw WHERE total / (total + 20.0::DOUBLE) >= 0.98),
    br AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY dedup_key ORDER BY at_us, flow_id)
        <= 60000000 THEN 0 ELSE 1 END brk FROM al),
    gr AS (SELECT *, sum(brk) OVER (PARTITION BY dedup_key ORDER BY at_us, flow_id) part FROM br)
    SELECT ('0x' || substr(md5(concat_ws('|', 'events', dedup_key, min(at_us), arg_min(flow_id, (at_us, flow_id)))), 1, 15))::BIGINT
        AS incident_id, dedup_key, count(*) AS occurrences, round(max(score), 6) AS score_max,
      CAST(sum(total) AS BIGINT) AS total_bytes, min(at_us) AS first_seen, max(at_us) AS last_seen
    FROM gr GROUP BY dedup_key, part""")
def packets_to_incidents_stream(s, d):
    """One streaming query with two stateful operators behind each other."""
    from packetloom.plans.flagship import rule_alerts
    from packetloom.streaming.sinks import packets_to_incidents_stream as chain, run_to_end
    rows = packets(s, d)
    feed = stream_of(rows, landed(rows, "packets-in"))
    out = s.read.parquet(run_to_end(chain(feed, lambda flows: rule_alerts(flows, P), P), "chained-out"))
    return out.where(F.unix_micros("first_seen") < FUTURE_US).drop("capture_id")


RECORD = ["capture_id", "seq", "src", "dst", "dport", "start_us", "end_us", "had_syn", "handshake",
          "bytes_out", "bytes_in"]


@query("host_profile_stream", source_sql("paired"))
def host_profile_stream(s, d):
    from packetloom.streaming.host_stream import host_profile_stream as profile
    from packetloom.streaming.sinks import run_to_end
    rows = paired(s, d).select(*RECORD, "new_pair")
    feed = stream_of(rows, landed(rows, "flows-in")).withWatermark("ts", "10 seconds")
    out = s.read.parquet(run_to_end(profile(feed, "src", P), "profiles"))
    return span_ms(out.where("seq >= 0").select("seq", *V.HOST_FEATURES))


@query("dst_profile_stream", dst_sql("paired"))
def dst_profile_stream(s, d):
    from packetloom.streaming.host_stream import host_profile_stream as profile
    from packetloom.streaming.sinks import run_to_end
    rows = paired(s, d).select(*RECORD, "new_pair")
    feed = stream_of(rows, landed(rows, "flows-in")).withWatermark("ts", "10 seconds")
    out = s.read.parquet(run_to_end(profile(feed, "dst", P), "profiles"))
    return out.where("seq >= 0").select("seq", *V.DST_FEATURES)


@query("host_features_strict", source_sql("paired"))
def host_features_strict(s, d):
    """The same walk in batch: ordered fold per host."""
    from packetloom.operators.host_state import strict_features
    rows = paired(s, d).select(*RECORD, "new_pair")
    return span_ms(strict_features(rows, ["end_us", "seq"], "src", P).select(
        "seq", *V.HOST_FEATURES))


@query("threshold_stream")
def threshold_stream(s, d):
    from packetloom.streaming.host_stream import threshold_stream as judge
    from packetloom.streaming.sinks import run_to_end
    rows = scored_slim(s, d)
    feed = stream_of(rows, landed(rows, "scores-in")).withWatermark("ts", "10 seconds")
    out = s.read.parquet(run_to_end(judge(feed, P), "judged"))
    return out.where("seq >= 0").select("seq", "threshold", "is_alert", "suppressed")


VERDICT = ["capture_id", "seq", "end_us", "at_us", "src", "dst", "fwd_bytes", "bwd_bytes", "packets", "bytes",
           "score", "threshold", "is_alert", "family"]


@query("buckets_stream", BUCKET_SQL)
def buckets_stream(s, d):
    from packetloom.streaming.sinks import buckets_stream as rollup, run_to_end
    rows = flows(s, d).select(*VERDICT)
    out = run_to_end(rollup(stream_of(rows, landed(rows, "verdicts-in"))), "buckets-out")
    return s.read.parquet(out).where(F.unix_micros("ts") < FUTURE_US)


@query("incident_session_stream", """SELECT incident_id, any_value(dedup_key) AS dedup_key,
    count(*) AS occurrences, round(max(score), 6) AS score_max, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    min(end_us) AS first_seen, max(end_us) AS last_seen FROM sessions GROUP BY incident_id""")
def incident_session_stream(s, d):
    from packetloom.streaming.sinks import incident_session_stream as merge, run_to_end
    rows = flows(s, d).where("is_alert").select(*VERDICT)
    out = run_to_end(merge(stream_of(rows, landed(rows, "alerts-in")), P), "sessions-out")
    return s.read.parquet(out).where(F.unix_micros("first_seen") < FUTURE_US).drop("capture_id")


@query("hosts_stream", """SELECT ip, flows_out, flows_in, bytes_out, bytes_in, alerts, last_us
    FROM hosts""")
def hosts_stream(s, d):
    from packetloom.streaming.sinks import HostSink, run_to_end
    rows = flows(s, d).select(*VERDICT)
    sink = HostSink(s, dims.default_assets(s), P)
    feed = stream_of(rows, landed(rows, "verdicts-in")).where("seq >= 0")
    run_to_end(feed, "hosts-out", sink)
    return sink.table.last().select(
        "ip", "flows_out", "flows_in", "bytes_out", "bytes_in", "alerts", "last_us")


@query("tick_stream", """SELECT count(*) AS flows, count(*) FILTER (is_alert) AS alerts,
    CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, max(end_us) AS at_us
    FROM flows""")
def tick_stream(s, d):
    """Ticks add up to the whole run, however it is cut into micro-batches."""
    from packetloom.streaming.sinks import TickSink, run_to_end
    rows = flows(s, d).select(*VERDICT)
    sink = TickSink(s, P)
    run_to_end(stream_of(rows, landed(rows, "verdicts-in")).where("seq >= 0"), "ticks-out", sink)
    return sink.ticks.read().agg(
        F.max("flows_total").alias("flows"), F.max("alerts_total").alias("alerts"),
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.max("at_us").alias("at_us"))


@query("incidents_stream", """SELECT id, dedup_key, family, src, occurrences, severity, priority,
    total_bytes FROM incidents""")
def incidents_stream(s, d):
    from packetloom.streaming.sinks import IncidentSink, run_to_end
    rows = flows(s, d).select(*VERDICT, "sport", "dport", "proto", "confidence", "label", "start_us")
    sink = IncidentSink(s, dims.default_assets(s), P)
    run_to_end(stream_of(rows, landed(rows, "verdicts-in")).where("seq >= 0"), "incidents-out", sink)
    return sink.incidents.last().select(
        "id", "dedup_key", "family", "src", "occurrences", "severity", "priority", "total_bytes")


ORACLE["threshold_stream"] = ORACLE["adaptive_threshold"]

# ---- end to end

FLAGSHIP_SQL = """WITH RECURSIVE {prefix}, scored AS (
      SELECT *, (bf + bb) / (bf + bb + 20.0::DOUBLE) score,
        CASE WHEN label = 'BENIGN' THEN 'UNKNOWN' ELSE label END family FROM flowout),
    al AS (SELECT *, CASE family WHEN 'DOS_FLOOD' THEN 'DOS_FLOOD|*|' || dst
        WHEN 'PORT_SCAN' THEN 'PORT_SCAN|' || src || '|*' ELSE 'UNKNOWN|' || src || '|' || dst END dedup_key
        FROM scored WHERE score >= 0.98),
    br AS (SELECT *, CASE WHEN export_us - lag(export_us) OVER (PARTITION BY dedup_key
        ORDER BY export_us, flow_id) <= 60000000 THEN 0 ELSE 1 END brk FROM al),
    gr AS (SELECT *, sum(brk) OVER (PARTITION BY dedup_key ORDER BY export_us, flow_id) part FROM br),
    inc AS (SELECT ('0x' || substr(md5(concat_ws('|', 'events', dedup_key, min(export_us),
          arg_min(flow_id, (export_us, flow_id)))), 1, 15))::BIGINT id, dedup_key, any_value(family) family,
        arg_min(dst, (export_us, flow_id)) dst, min(export_us) first_seen, max(export_us) last_seen,
        count(*) occurrences, max(score) score_max, CAST(sum(bf + bb) AS BIGINT) total_bytes,
        count(DISTINCT dport) distinct_dports FROM gr GROUP BY dedup_key, part),
    pri AS (SELECT *, CAST(round_even(100 * least(1, 0.50::DOUBLE * least(greatest(
          (score_max - 0.98::DOUBLE) / greatest(1 - 0.98::DOUBLE, 1e-6), 0), 1)
        + 0.30::DOUBLE * (greatest(CASE dst WHEN '192.168.1.10' THEN 5 WHEN '192.168.1.11' THEN 5
            WHEN '192.168.1.12' THEN 4 WHEN '192.168.1.13' THEN 4 ELSE 3 END,
            CASE family WHEN 'DOS_FLOOD' THEN 5 ELSE 3 END) / 5.0::DOUBLE)
        + 0.12::DOUBLE * 0.5::DOUBLE + least(occurrences / 200.0::DOUBLE, 1) * 0.08::DOUBLE), 0) AS BIGINT)
        priority FROM inc)
    SELECT id, dedup_key, family, occurrences, priority, CASE WHEN priority >= 75 THEN 'CRITICAL'
      WHEN priority >= 58 THEN 'HIGH' WHEN priority >= 38 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      first_seen, last_seen, total_bytes, distinct_dports, round(score_max, 6) AS score_max FROM pri"""


@query("packets_to_verdicts")
def packets_to_verdicts(s, d):
    """The whole main path: every flow with its score, family and judgement, on all features."""
    from packetloom.plans.flagship import packets_to_verdicts as judge
    return judge(packets(s, d), P).select(
        "flow_id", "score", "threshold", "is_alert", "suppressed", "family", "confidence", "label")


@query("packets_to_incidents", FLAGSHIP_SQL)
def packets_to_incidents(s, d):
    from packetloom.plans.flagship import packets_to_incidents as flagship
    return flagship(s, d)
