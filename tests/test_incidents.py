import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import dims, incidents as I, readmodels as R, triage as TR
from packetloom.operators.slices import top_per_key
from packetloom.params import SECOND, Params

COLUMNS = ("seq long, at_us long, src string, dst string, sport int, dport int, proto string, "
           "family string, score double, threshold double, confidence double, label string, "
           "packets long, bytes long, start_us long, end_us long")


def alert(i, t, family="PORT_SCAN", src="10.0.0.5", dst="192.168.1.10", dport=80, score=.99,
          confidence=.8):
    us = round(t * SECOND)
    return (i, us, src, dst, 4000, dport, "tcp", family, score, .98, confidence, family, 2, 100,
            us - 10, us)


def build(spark, alerts, p=Params(), **kw):
    df = spark.createDataFrame(alerts, COLUMNS)
    return I.build_incidents(df, dims.default_assets(spark), p, **kw).collect()


def test_scan_becomes_one_incident(spark):
    rows = build(spark, [alert(i, i * .1, dport=i) for i in range(400)], with_truth=True)
    assert [(r.occurrences, r.distinct_dports) for r in rows] == [(400, 400)]
    assert rows[0].truth == {"PORT_SCAN": 400} and rows[0].mitre_technique == "T1046"


def test_flood_groups_on_the_victim(spark):
    rows = build(spark, [alert(i, i * .1, "DOS_FLOOD", src=f"10.1.0.{i}") for i in range(200)])
    assert [(r.occurrences, r.distinct_peers) for r in rows] == [(200, 200)]
    assert rows[0].asset_name == "Serveur web" and rows[0].criticality == 5


def test_brute_force_stays_apart(spark):
    rows = build(spark, [alert(1, 0, "SSH_BRUTEFORCE", src="10.0.0.1"),
                         alert(2, 1, "SSH_BRUTEFORCE", src="10.0.0.2")])
    assert len(rows) == 2


def test_gap_of_exactly_the_limit_merges(spark):
    assert len(build(spark, [alert(1, 0), alert(2, 60)])) == 1
    assert len(build(spark, [alert(1, 0), alert(2, 30), alert(3, 91)])) == 2
    assert len(build(spark, [alert(1, 0.5), alert(2, 60.500001)])) == 2


def test_confidence_counts_record_alerts_only(spark):
    rows = build(spark, [alert(1, 0, score=.985, confidence=.3), alert(2, 1, score=.99, confidence=.6),
                         alert(3, 2, score=.988, confidence=.99)])
    assert rows[0].confidence == .6


@pytest.mark.parametrize("seed", range(3))
def test_sessions_equal_a_walk(spark, seed):
    rng, t, alerts = random.Random(seed), 0.0, []
    for i in range(300):
        t += rng.choice([0, 1, 29, 30, 31, 59.999999, 60, 60.000001, 100])
        alerts.append(alert(i, t, src=rng.choice(["10.0.0.1", "10.0.0.2"]), score=rng.uniform(.98, 1)))
    want, last = {}, {}
    for a in alerts:
        key = a[2]
        if key not in last or a[1] - last[key][1] > 60 * SECOND:
            last[key] = (a[0], a[1])
        last[key] = (last[key][0], a[1])
        want[a[0]] = last[key][0]
    df = spark.createDataFrame(alerts, COLUMNS)
    got = {r.seq: r.incident_id for r in I.incident_sessions(df).collect()}
    assert len(set(got.values())) == len(set(want.values()))
    assert all(got[seq] == got[first] for seq, first in want.items())
    busy = I.incident_records(I.incident_sessions(df), Params(group_rows=2))
    plain = I.incident_records(I.incident_sessions(df))
    assert {r.seq for r in busy.collect()} == {r.seq for r in plain.collect()}


def test_storage_cap_keeps_the_first(spark):
    df = I.incident_sessions(spark.createDataFrame([alert(i, i * .01) for i in range(50)], COLUMNS))
    p = Params(alerts_per_incident=20)
    assert sorted(r.seq for r in I.alerts_append_capped(df, p).collect()) == list(range(20))
    assert I.alerts_dropped(df, p).first().dropped == 30


def test_captures_with_the_same_sequence_numbers_stay_apart(spark):
    df = spark.createDataFrame([alert(24, 0), alert(24, 1, src="10.0.0.9", family="UNKNOWN"), alert(60, 2)], COLUMNS)
    three = df.withColumn("capture_id", F.lit("a")).unionByName(
        df.withColumn("capture_id", F.lit("b"))).unionByName(df.withColumn("capture_id", F.lit("c")))
    rows = I.build_incidents(three, dims.default_assets(spark)).collect()
    assert len(rows) == 6 == len({r.id for r in rows})
    assert sorted((r.capture_id, r.family, r.occurrences) for r in rows) == [
        (c, f, n) for c in "abc" for f, n in (("PORT_SCAN", 2), ("UNKNOWN", 1))]


def test_an_alert_that_bridges_two_incidents_leaves_one(spark, tmp_path):
    from packetloom.sources.tables import Batches
    from packetloom.streaming.sinks import IncidentSink
    sink = IncidentSink(spark, dims.default_assets(spark))
    sink.alerts, sink.incidents = (Batches(spark, str(tmp_path / x)) for x in ("alerts", "incidents"))
    feed = lambda *rows: spark.createDataFrame(rows, COLUMNS).withColumn("is_alert", F.lit(True))
    batches = [feed(alert(1, 0), alert(3, 100)), feed(alert(9, 50, family="UNKNOWN")), feed(alert(2, 50))]
    for number, batch in enumerate(batches):
        sink(batch, number)
    sink(batches[2], 2)  # run again after a failure
    got = sorted((r.family, r.occurrences) for r in sink.incidents.last().collect())
    assert got == [("PORT_SCAN", 3), ("UNKNOWN", 1)]
    assert sink.alerts.read().count() == 4


def test_bulk_requests_are_never_dropped(spark):
    rows = lambda *sizes: spark.createDataFrame([(list(range(n)),) for n in sizes], "ids array<bigint>")
    patch = lambda df: TR.triage_bulk(df, F.current_timestamp(), F.lit(1), "ann", status="ACK").count()
    assert patch(rows(1, 500)) == 501
    for bad in (rows(501), rows(3, 0)):
        with pytest.raises(Exception, match="1 to 500 ids"):
            TR.triage_bulk(bad, F.current_timestamp(), F.lit(1), "ann", status="ACK").collect()


def test_family_sums_of_a_host_cover_all_its_incidents(spark):
    rows = [(i, "10.0.0.1", f"9.9.9.{i}", "PORT_SCAN", 2, i) for i in range(120)]
    incidents = spark.createDataFrame(rows, "id long, src string, dst string, family string, occurrences long, last_seen long")
    hosts = spark.createDataFrame([("10.0.0.1",)], "ip string")
    assert R.host_families(incidents, hosts).first().occurrences == 240
    assert R.host_incidents(incidents, hosts).count() == 50


def test_asset_lookup_small_and_large_inventories_agree(spark):
    assets = dims.default_assets(spark)
    ips = ["192.168.1.10", "192.168.1.77", "10.9.9.9", "8.8.8.8", "nonsense", "300.1.1.1", None]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    small = dims.asset_lookup(df, "ip", assets).collect()
    large = dims.asset_lookup(df, "ip", assets, Params(dimension_rows=1)).collect()
    found = {r.ip: (r.asset_name, r.asset_criticality) for r in small}
    assert found == {r.ip: (r.asset_name, r.asset_criticality) for r in large}
    assert found["192.168.1.77"] == ("Poste de travail", 2)
    assert found["8.8.8.8"] == ("Hôte externe", 1)
    assert found["300.1.1.1"] == found[None] == ("Inconnu", 1)


def test_bad_networks_are_skipped_and_the_first_of_equals_wins(spark):
    rows = [("10.0.0.7/8", "first", 9, []), ("10.0.0.0/8", "second", 2, []), ("x/8", "bad", 1, []),
            ("fe80::/10", "six", 1, []), ("10.0.0.0/40", "long", 1, [])]
    assets = dims.assets_replace(spark.createDataFrame(rows, "cidr string, name string, criticality int, tags array<string>"))
    df = spark.createDataFrame([("10.1.1.1",), ("11.1.1.1",)], "ip string")
    got = {r.ip: (r.asset_name, r.asset_criticality) for r in dims.asset_lookup(df, "ip", assets).collect()}
    assert got == {"10.1.1.1": ("first", 5), "11.1.1.1": ("Inconnu", 1)}


def test_triage_rules(spark):
    state = ("id long, status string, assignee string, verdict string, note string, closed_at timestamp")
    incidents = spark.createDataFrame([(1, "NEW", None, None, None, None), (2, "NEW", None, None, "old", None)], state)
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([
        (1, at(1), 1, "ann", "ACK", " ", None, None),
        (1, at(2), 2, "bob", None, "bob", "TP", "seen"),       # judging closes
        (1, at(3), 3, "bob", None, None, "TP", "again"),       # same verdict changes nothing
        (2, at(1), 4, "ann", "CLOSED", None, None, None),
        (2, at(2), 5, "ann", "NEW", None, None, "back"),       # reopening clears the closing time
    ], "incident_id long, ts timestamp, seq long, actor string, status string, assignee string, verdict string, note string")
    got = {r.id: r for r in TR.triage_apply(incidents, log).collect()}
    assert (got[1].status, got[1].verdict, got[1].assignee, got[1].closed_at) == ("CLOSED", "TP", "bob", at(2))
    assert got[1].note == "[2024-01-01 00:02 bob] seen\n\n[2024-01-01 00:03 bob] again"
    assert (got[2].status, got[2].closed_at) == ("NEW", None)
    assert got[2].note == "old\n\n[2024-01-01 00:02 ann] back"
    sliced = TR.triage_apply(incidents, log, Params(group_rows=1)).collect()
    assert sorted(sliced) == sorted(got.values())


def test_salted_top_equals_plain_sort(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id"), F.hash("id").alias("v"))
    got = sorted(r.id for r in top_per_key(df, ["k"], [F.col("v"), F.col("id")], 7, ["id"]).collect())
    rows = df.collect()
    want = [r.id for k in (0, 1) for r in sorted((x for x in rows if x.k == k), key=lambda x: (x.v, x.id))[:7]]
    assert got == sorted(want)


def test_export_holds_the_detail(spark):
    import json
    df = spark.createDataFrame([alert(i, i, dport=i) for i in range(12)], COLUMNS)
    incidents = I.build_incidents(df, dims.default_assets(spark))
    doc = json.loads(R.incident_export(incidents, I.alert_rows(I.incident_sessions(df))).first().document)
    assert len(doc["alerts"]) == 12 and doc["occurrences"] == 12
    assert doc["ground_truth"] == {"PORT_SCAN": 12} and doc["guidance"]["technique"] == "T1046"
