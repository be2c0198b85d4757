"""Packet, flow and incident views over an ``events`` table.

The tables at hand hold no packets, so one is derived from the other by integer
arithmetic: every event is one packet and one flow. Rules are in FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom import fixed_values as V
from packetloom.operators.dims import default_assets
from packetloom.operators.incidents import alert_rows, build_incidents, incident_sessions
from packetloom.operators.slices import Last, running
from packetloom.operators.windows import new_pair_flag
from packetloom.params import Params

NOW = dt.datetime(2024, 1, 31)  # the constant "now" of the read models
EPOCH_US = 1_704_067_200_000_000
HOURS = 24 * 30


def _array(values) -> str:
    return "array(" + ", ".join(repr(v) for v in values) + ")"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_events(events)


def from_events(events: DataFrame) -> DataFrame:
    wall = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"),
        F.col("event_type").alias("et"), F.col("value").alias("v"), "props",
        wall.alias("wall_us"),
    ).withColumn("t", F.expr(f"(wall_us - {EPOCH_US}) div 2592")).withColumn(
        "m", F.expr("t div 60000000"))


ENDS = {
    "a_src": "concat('10.', (u div 65536) % 256, '.', (u div 256) % 256, '.', u % 256)",
    "a_dst": "concat('192.168.1.', 10 + (u + m) % 4)",
    "a_dport": "array(80, 443, 22, 53, 445)[cast((u + m div 2) % 5 as int)]",
    "a_sport": "cast(40000 + u % 20000 as int)",
}
TRUTH = "case u % 20 when 3 then 'PORT_SCAN' when 7 then 'DOS_FLOOD' else 'BENIGN' end"


def packet_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(base(spark, sf_dir))


def packets_from(rows: DataFrame) -> DataFrame:
    ends = rows.withColumns({k: F.expr(x) for k, x in ENDS.items()})
    back = "et = 'view'"
    pick = lambda x, y: f"case when {back} then {x} else {y} end"
    udp = "a_dport = 53"
    return ends.selectExpr(
        "'events' as capture_id", "e as seq", "t as ts_us",
        f"{pick('a_dst', 'a_src')} as src", f"{pick('a_src', 'a_dst')} as dst",
        f"case when {udp} then 'udp' else 'tcp' end as proto",
        f"{pick('a_dport', 'a_sport')} as sport", f"{pick('a_sport', 'a_dport')} as dport",
        "cast(54 + floor(v * 10) as int) as size",
        f"""cast(case when {udp} then 0 else case et when 'signup' then 2 when 'view' then 18
             when 'click' then 16 when 'purchase' then 24 else 20 end end as int) as flags""",
        "encode(props, 'UTF-8') as payload", f"{TRUTH} as label")


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow and its verdict per event."""
    ends = base(spark, sf_dir).withColumns({k: F.expr(x) for k, x in ENDS.items()})
    flows = ends.selectExpr(
        "'events' as capture_id", "e as seq", "e as flow_id", "a_src as src", "a_dst as dst",
        "a_sport as sport", "a_dport as dport",
        "case when a_dport = 53 then 'udp' else 'tcp' end as proto",
        "t - (e % 7) * 100000 as start_us", "t as end_us", "t as export_us", "t as at_us",
        "wall_us", "u", "et in ('signup', 'error') as had_syn",
        "et = 'signup' and e % 2 = 0 as handshake",
        "54 + cast(floor(v * 10) as bigint) as fwd_bytes", "e % 1000 as bwd_bytes",
        "2 + e % 5 as packets", "v / (v + 2) as score", "0.98D as threshold",
        f"{_array(V.ATTACK_FAMILIES)}[cast(e % 9 as int)] as family",
        "(e % 100) / 100.0D as confidence", f"{TRUTH} as label")
    return flows.withColumns({
        "bytes": F.col("fwd_bytes") + F.col("bwd_bytes"),
        "bytes_out": F.col("fwd_bytes"), "bytes_in": F.col("bwd_bytes"),
        "is_alert": F.col("score") >= F.col("threshold"), "suppressed": F.lit(False)})


def paired_flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_pair_flag(flow_view(spark, sf_dir))


def capture_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view split into three captures by source."""
    return flow_view(spark, sf_dir).withColumn(
        "capture_id", F.concat(F.lit("cap"), F.col("u") % 3))


def verdict_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_view(spark, sf_dir)


def alert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on the wall clock; sessions are measured on the capture clock."""
    return flow_view(spark, sf_dir).where("is_alert").withColumn("at_us", F.col("wall_us"))


def session_view(spark: SparkSession, sf_dir: str, p: Params = Params()) -> DataFrame:
    return incident_sessions(alert_view(spark, sf_dir), p, at="end_us")


def stored_alert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_rows(session_view(spark, sf_dir))


def incident_view(spark: SparkSession, sf_dir: str, p: Params = Params()) -> DataFrame:
    """Incidents with a spread of analyst states."""
    rows = build_incidents(alert_view(spark, sf_dir), default_assets(spark), p, at="end_us")
    status = f"{_array(('NEW', 'ACK', 'INVESTIGATING', 'CLOSED'))}[cast(id % 4 as int)]"
    verdict = f"{_array(('TP', 'FP', 'BENIGN'))}[cast(id % 3 as int)]"
    closed = "status = 'CLOSED'"
    return rows.withColumn("status", F.expr(status)).withColumns({
        "verdict": F.expr(f"case when {closed} then {verdict} end"),
        "closed_at": F.expr(
            f"case when {closed} then timestamp_micros(unix_micros(last_seen) "
            "+ (id % 600) * 1000000) end")})


def prediction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = f"{_array(V.ATTACK_FAMILIES)}[cast((seq * 7) % 9 as int)]"
    predicted = f"""case when seq % 97 = 0 then 'UNKNOWN'
                    when seq % 5 = 0 then {wrong} else family end"""
    return flow_view(spark, sf_dir).select(
        "capture_id", "seq", F.expr("case when seq % 13 = 0 then 'BENIGN' else family end").alias("truth"),
        F.expr(predicted).alias("predicted"), "score")


def triage_view(spark: SparkSession, sf_dir: str, incidents: DataFrame) -> DataFrame:
    """Error events as analyst actions on the incident that opens next."""
    actions = base(spark, sf_dir).where("et = 'error'").select(
        (-F.col("e")).alias("neg"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"),
        "e", "u", "wall_us")
    marks = incidents.select(
        (-F.col("first_seq")).alias("neg"), F.lit(0).alias("kind"), "id",
        F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("u"),
        F.lit(None).cast("long").alias("wall_us"))
    found = running(actions.unionByName(marks), [], ["neg", "kind"],
                    F.floor(F.col("neg") / F.lit(1_000_000)), incident_id=Last(F.col("id")))
    states = _array(("NEW", "ACK", "INVESTIGATING", "CLOSED"))
    judgements = _array(("TP", "FP", "BENIGN"))
    return found.where("kind = 1 and incident_id is not null").selectExpr(
        "incident_id", "timestamp_micros(wall_us) as ts", "e as seq",
        "concat('analyst', u % 5) as actor",
        f"case when e % 2 = 0 then {states}[cast(e div 2 % 4 as int)] end as status",
        "case when e % 6 = 0 then concat('analyst', e % 4) when e % 6 = 1 then ' ' end as assignee",
        f"case when e % 5 = 0 then {judgements}[cast(e % 3 as int)] end as verdict",
        "case when e % 7 = 0 then concat('note ', e) end as note")


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).selectExpr(
        "e as id", "timestamp_micros(wall_us) as ts", "concat('analyst', u % 5) as actor",
        "concat('incident.', et) as action", "cast(e div 10 as string) as target",
        "props as detail")


def attack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack windows of 100 s per labelled family and capture, from the flows' own span."""
    flows = capture_view(spark, sf_dir).where(F.col("label") != V.BENIGN)
    slot = F.floor(F.col("end_us") / F.lit(100_000_000))
    return flows.select(
        "capture_id", F.col("label").alias("family"), slot.alias("slot"),
    ).distinct().select(
        "capture_id", "family", (F.col("slot") * 100_000_000).alias("start_us"),
        ((F.col("slot") + 1) * 100_000_000 - 1).alias("end_us"))


def _hex(value: str, digits: int) -> str:
    return f"lpad(hex(cast({value} as bigint)), {digits}, '0')"


def frame_view(packets: DataFrame) -> DataFrame:
    """The packet view as Ethernet frames: one VLAN tag on every third, TCP or UDP over IPv4."""
    ip = lambda c: "concat(" + ", ".join(
        _hex(f"split({c}, '[.]')[{i}]", 2) for i in range(4)) + ")"
    vlan = "case when seq % 3 = 0 then '8100000A' else '' end"
    number = "case when proto = 'tcp' then 6 else 17 end"
    header = ("case when proto = 'tcp' then concat('0000000000000000', '50', "
              f"{_hex('flags', 2)}, '000000000000') else '00000000' end")
    frame = (
             f"unhex(concat('000000000001000000000002', {vlan}, '0800', '4500000000000000', "
             f"'40', {_hex(number, 2)}, '0000', {ip('src')}, {ip('dst')}, {_hex('sport', 4)}, "
             f"{_hex('dport', 4)}, {header}, hex(payload)))")
    return packets.selectExpr("'events' as path", "seq", "ts_us", "size as wire", "1 as link",
                              f"{frame} as frame")


def write_captures(packets: DataFrame, files: int = 5) -> str:
    """The frames as capture files in scratch space, one per slice of time."""
    import pandas as pd
    from pyarrow import fs as afs
    from packetloom.session import scratch_path

    folder = scratch_path(packets.sparkSession, "captures")
    folder = folder if "://" in folder else f"file://{folder}"
    record = ("concat(unhex(concat(" + ", ".join(
        _hex(x, 8) for x in ("ts_us div 1000000", "ts_us % 1000000", "octet_length(frame)", "wire"))
        + ")), frame)")
    rows = frame_view(packets).selectExpr("ts_us", "seq", f"{record} as record").repartitionByRange(
        files, "ts_us", "seq").sortWithinPartitions("ts_us", "seq")

    def save(batches):
        from pyspark import TaskContext
        where, base = afs.FileSystem.from_uri(folder)
        where.create_dir(base)
        name = f"{base}/part{TaskContext.get().partitionId()}.pcap"
        count = 0
        with where.open_output_stream(name) as out:
            out.write(bytes.fromhex("A1B2C3D4000200040000000000000000FFFFFFFF00000001"))
            for pdf in batches:
                out.write(b"".join(pdf["record"]))
                count += len(pdf)
        yield pd.DataFrame({"n": [count]})

    rows.mapInPandas(save, "n long").count()
    return folder
