"""The same queries as SQL for DuckDB, over the same views built from ``events``.

Fragments are common table expressions; ``sql`` pulls in the ones a query names.
"""

from __future__ import annotations

import re

from packetloom import fixed_values as V


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
                           for v in values) + "]"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _rows(rows) -> str:
    one = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


TRUTH = "CASE u % 20 WHEN 3 THEN 'PORT_SCAN' WHEN 7 THEN 'DOS_FLOOD' ELSE 'BENIGN' END"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
VICTIM, SOURCE = _quoted(V.VICTIM_FAMILIES), _quoted(V.SOURCE_FAMILIES)
OPEN = _quoted(V.OPEN_STATUSES)

ASSET_CASE = """CASE dst WHEN '192.168.1.10' THEN 'Serveur web'
  WHEN '192.168.1.11' THEN 'Base de données' WHEN '192.168.1.12' THEN 'Serveur DNS'
  ELSE 'Serveur de fichiers' END"""

INCIDENT_ID = """('0x' || substr(md5(concat_ws('|', capture_id, dedup_key, first_value(end_us) OVER g,
        first_value(seq) OVER g)), 1, 15))::BIGINT"""
CTE: dict[str, str] = {
    "base0": """SELECT event_id e, user_id u, event_type et, value v, props, ts wall,
        (epoch_us(ts) - 1704067200000000) // 2592 t FROM events""",
    "base": """SELECT *, t // 60000000 m,
        '10.' || ((u // 65536) % 256) || '.' || ((u // 256) % 256) || '.' || (u % 256) a_src,
        '192.168.1.' || (10 + (u + t // 60000000) % 4) a_dst,
        [80, 443, 22, 53, 445][1 + (u + (t // 60000000) // 2) % 5] a_dport,
        40000 + u % 20000 a_sport FROM base0""",
    "packets": f"""SELECT 'events' capture_id, e seq, t ts_us,
        CASE WHEN et = 'view' THEN a_dst ELSE a_src END src,
        CASE WHEN et = 'view' THEN a_src ELSE a_dst END dst,
        CASE WHEN a_dport = 53 THEN 'udp' ELSE 'tcp' END proto,
        CAST(CASE WHEN et = 'view' THEN a_dport ELSE a_sport END AS BIGINT) sport,
        CAST(CASE WHEN et = 'view' THEN a_sport ELSE a_dport END AS BIGINT) dport,
        54 + CAST(floor(v * 10) AS BIGINT) size,
        CAST(CASE WHEN a_dport = 53 THEN 0 ELSE CASE et WHEN 'signup' THEN 2 WHEN 'view' THEN 18
          WHEN 'click' THEN 16 WHEN 'purchase' THEN 24 ELSE 20 END END AS BIGINT) flags,
        props payload, {TRUTH} label FROM base""",
    "keyed": """SELECT *,
        CASE WHEN (src, sport) <= (dst, dport) THEN src ELSE dst END key_lo,
        CASE WHEN (src, sport) <= (dst, dport) THEN dst ELSE src END key_hi,
        CASE WHEN (src, sport) <= (dst, dport) THEN sport ELSE dport END key_lo_port,
        CASE WHEN (src, sport) <= (dst, dport) THEN dport ELSE sport END key_hi_port
        FROM packets""",
    "clocked": """SELECT *, lag(ts_us) OVER (PARTITION BY capture_id ORDER BY ts_us, seq) g
        FROM keyed""",
    # flow cuts, packet by packet along every key at once
    "numbered": """SELECT *, row_number() OVER (
        PARTITION BY key_lo, key_hi, key_lo_port, key_hi_port, proto ORDER BY ts_us, seq) pos,
        dense_rank() OVER (ORDER BY key_lo, key_hi, key_lo_port, key_hi_port, proto) k
        FROM clocked""",
    "cuts": """SELECT k, pos, seq flow_id, ts_us start_us, ts_us last_us, 1 n,
          (flags & 2) > 0 AND (flags & 16) = 0 lone, flags & 1 fins, (flags & 4) > 0 reset, seq
        FROM numbered WHERE pos = 1
        UNION ALL
        SELECT k, pos, CASE WHEN cut THEN seq ELSE flow_id END,
          CASE WHEN cut THEN ts_us ELSE start_us END, ts_us,
          CASE WHEN cut THEN 1 ELSE n + 1 END,
          CASE WHEN cut THEN (flags & 2) > 0 AND (flags & 16) = 0 ELSE lone END,
          CASE WHEN cut THEN flags & 1 ELSE fins + (flags & 1) END, (flags & 4) > 0, seq
        FROM (SELECT c.k, x.pos, c.flow_id, c.start_us, c.n, c.lone, c.fins, x.seq, x.ts_us, x.flags,
            c.reset OR c.fins >= 2 OR coalesce(x.g, -1) >= least(c.last_us +
              CASE WHEN c.n = 1 AND c.lone THEN 3000000 ELSE 15000000 END,
              c.start_us + 120000000) cut
          FROM cuts c JOIN numbered x ON x.k = c.k AND x.pos = c.pos + 1)""",
    "bounded": """SELECT p.*, c.flow_id,
        first_value(p.src) OVER f init_src, first_value(p.sport) OVER f init_sport,
        first_value(p.dst) OVER f init_dst, first_value(p.dport) OVER f init_dport,
        p.ts_us - lag(p.ts_us) OVER f raw_iat
        FROM numbered p JOIN cuts c ON p.seq = c.seq
        WINDOW f AS (PARTITION BY c.flow_id ORDER BY p.ts_us, p.seq)""",
    "directed": """SELECT *, src = init_src AND sport = init_sport forward,
        CASE WHEN raw_iat > 0 THEN raw_iat END iat_us,
        row_number() OVER (PARTITION BY flow_id ORDER BY ts_us, seq) place FROM bounded""",
    "bytecount": """SELECT DISTINCT payload, ch, count(*) OVER (PARTITION BY payload, ch) c,
        count(*) OVER (PARTITION BY payload) n
        FROM (SELECT payload, unnest(regexp_extract_all(hex(encode(payload)), '..')) ch
              FROM (SELECT DISTINCT payload FROM packets))""",
    "entropies": """SELECT payload, -sum(c / n * log2(c / n)) / 8 entropy
        FROM (SELECT payload, ch, CAST(c AS DOUBLE) c, n FROM bytecount) GROUP BY payload""",
    "sums": """SELECT flow_id, any_value(capture_id) capture_id, any_value(init_src) src,
        any_value(init_dst) dst, any_value(init_sport) sport, any_value(init_dport) dport,
        any_value(proto) proto, min(ts_us) start_us, max(ts_us) end_us, count(*) n,
        count(*) FILTER (forward) nf, coalesce(sum(size) FILTER (forward), 0) bf,
        coalesce(sum(size) FILTER (NOT forward), 0) bb,
        avg(size) mean_pkt_size, sqrt(greatest(avg(size * size) - avg(size) * avg(size), 0)) sd,
        min(size) min_pkt_size, max(size) max_pkt_size,
        coalesce(avg(iat_us / 1e6), 0) mean_iat, count(iat_us) iat_n,
        sqrt(greatest(avg((iat_us / 1e6) * (iat_us / 1e6)) - avg(iat_us / 1e6) * avg(iat_us / 1e6), 0)) isd,
        coalesce(min(iat_us / 1e6), 0) min_iat, coalesce(max(iat_us / 1e6), 0) max_iat,
        count(*) FILTER (flags & 2 > 0) syn_count, count(*) FILTER (flags & 16 > 0) ack_count,
        count(*) FILTER (flags & 1 > 0) fin_count, count(*) FILTER (flags & 4 > 0) rst_count,
        count(*) FILTER (flags & 8 > 0) psh_count, count(*) FILTER (flags & 32 > 0) urg_count,
        bool_or(forward AND flags & 2 > 0 AND flags & 16 = 0) fwd_syn,
        min(place) FILTER (NOT forward AND flags & 2 > 0 AND flags & 16 > 0) synack_at,
        max(place) FILTER (forward AND flags & 16 > 0) ack_at,
        avg(length(payload)) mean_payload_len, avg(entropy) payload_entropy,
        coalesce(arg_max(label, place) FILTER (label <> 'BENIGN'), 'BENIGN') label
        FROM directed JOIN entropies USING (payload) GROUP BY flow_id""",
    "flowdue": """SELECT *, CASE WHEN rst_count > 0 OR fin_count >= 2 THEN end_us ELSE
        least(end_us + CASE WHEN n = 1 AND fwd_syn THEN 3000000 ELSE 15000000 END,
              start_us + 120000000) END deadline_us,
        rst_count > 0 OR fin_count >= 2 closed FROM sums""",
    "flowout": """SELECT d.*, CASE WHEN closed THEN end_us ELSE greatest(end_us, coalesce(p.ts_us,
        (SELECT max(ts_us) FROM packets))) END export_us
        FROM flowdue d ASOF LEFT JOIN (SELECT DISTINCT ts_us FROM packets) p
        ON d.deadline_us <= p.ts_us""",
    "flows": f"""SELECT 'events' capture_id, e seq, u, a_src src, a_dst dst,
        CAST(a_sport AS BIGINT) sport, CAST(a_dport AS BIGINT) dport,
        CASE WHEN a_dport = 53 THEN 'udp' ELSE 'tcp' END proto,
        t - (e % 7) * 100000 start_us, t end_us, t export_us, wall, epoch_us(wall) wall_us,
        et IN ('signup', 'error') had_syn, et = 'signup' AND e % 2 = 0 handshake,
        54 + CAST(floor(v * 10) AS BIGINT) fwd_bytes, e % 1000 bwd_bytes,
        2 + e % 5 packets, 54 + CAST(floor(v * 10) AS BIGINT) + e % 1000 bytes,
        v / (v + 2) score, 0.98::DOUBLE threshold, v / (v + 2) >= 0.98::DOUBLE is_alert,
        {_list(V.ATTACK_FAMILIES)}[1 + e % 9] family, (e % 100) / 100.0::DOUBLE confidence,
        {TRUTH} label FROM base""",
    "paired": """SELECT *, row_number() OVER (PARTITION BY src, dst, dport ORDER BY end_us, seq) = 1
        new_pair FROM flows""",
    "alerts": f"""SELECT *, family || '|' || CASE WHEN family IN ({VICTIM}) THEN '*|' || dst
        WHEN family IN ({SOURCE}) THEN src || '|*' ELSE src || '|' || dst END dedup_key
        FROM flows WHERE is_alert""",
    "broken": """SELECT *, CASE WHEN end_us - lag(end_us) OVER w <= 60000000 THEN 0 ELSE 1 END brk
        FROM alerts WINDOW w AS (PARTITION BY dedup_key ORDER BY end_us, seq)""",
    "grouped": """SELECT *, sum(brk) OVER (PARTITION BY dedup_key ORDER BY end_us, seq) part
        FROM broken""",
    "sessions": f"""SELECT *, {INCIDENT_ID} incident_id FROM grouped
        WINDOW g AS (PARTITION BY capture_id, dedup_key, part ORDER BY end_us, seq)""",
    "ranked": """SELECT *, max(score) OVER (PARTITION BY incident_id ORDER BY wall_us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best FROM sessions""",
    "records": "SELECT * FROM ranked WHERE best IS NULL OR score > best",
    "conf": "SELECT incident_id, max(confidence) confidence FROM records GROUP BY incident_id",
    "families": f"""SELECT * FROM (VALUES {_rows(V.FAMILIES)})
        f(family, family_title, mitre_technique, mitre_tactic, default_criticality)""",
    "assets": f"""SELECT * FROM (VALUES {_rows([(c, n, k) for c, n, k, _ in V.DEFAULT_ASSETS])})
        a(cidr, name, criticality)""",
    "gathered": f"""SELECT incident_id id, any_value(dedup_key) dedup_key, any_value(s.family) family,
        min(seq) first_seq, arg_min(src, seq) src, arg_min(dst, seq) dst, arg_min(dport, seq) dport,
        arg_min(proto, seq) proto, min(wall) first_seen, max(wall) last_seen,
        count(*) occurrences, max(score) score_max, avg(score) score_mean,
        arg_max(threshold, score) threshold, CAST(sum(bytes) AS BIGINT) total_bytes,
        CAST(sum(packets) AS BIGINT) total_packets, count(DISTINCT dport) distinct_dports,
        count(DISTINCT CASE WHEN s.family IN ({VICTIM}) THEN src ELSE dst END) distinct_peers
        FROM sessions s GROUP BY incident_id""",
    "judged": f"""SELECT g.*, c.confidence, {ASSET_CASE} asset_name, f.family_title, f.mitre_technique,
        f.mitre_tactic,
        greatest(CASE WHEN dst IN ('192.168.1.10', '192.168.1.11') THEN 5 ELSE 4 END,
                 default_criticality) criticality,
        least(greatest((score_max - threshold) / greatest(1 - threshold, 1e-6), 0), 1) margin
        FROM gathered g JOIN conf c ON c.incident_id = g.id JOIN families f USING (family)""",
    "prioritised": """SELECT *, CAST(round_even(100 * least(1, 0.50::DOUBLE * margin
        + 0.30::DOUBLE * (criticality / 5.0::DOUBLE) + 0.12::DOUBLE * confidence
        + least(occurrences / 200.0::DOUBLE, 1) * 0.08::DOUBLE), 0) AS BIGINT) priority
        FROM judged""",
    "stated": """SELECT *, CASE WHEN priority >= 75 THEN 'CRITICAL' WHEN priority >= 58 THEN 'HIGH'
        WHEN priority >= 38 THEN 'MEDIUM' ELSE 'LOW' END severity,
        ['NEW', 'ACK', 'INVESTIGATING', 'CLOSED'][1 + id % 4] status FROM prioritised""",
    "incidents": """SELECT *, CASE WHEN status = 'CLOSED' THEN ['TP', 'FP', 'BENIGN'][1 + id % 3] END
        verdict, CASE WHEN status = 'CLOSED' THEN last_seen + to_seconds(id % 600) END closed_at,
        CAST(NULL AS VARCHAR) assignee, CAST(NULL AS VARCHAR) note FROM stated""",
    "stored": """SELECT incident_id, seq, wall ts, start_us / 1e6 flow_start, end_us / 1e6 flow_end,
        src, sport, dst, dport, proto, score, threshold, family, confidence,
        CASE WHEN score >= 0.92 OR score - threshold >= 0.25 THEN 'CRITICAL'
             WHEN score - threshold >= 0.10 THEN 'HIGH' ELSE 'MEDIUM' END severity,
        packets, bytes, greatest(end_us - start_us, 0) / 1e6 duration, label truth FROM sessions""",
    "attacks": "SELECT * FROM predictions WHERE truth <> 'BENIGN'",
    "predictions": f"""SELECT capture_id, seq, CASE WHEN seq % 13 = 0 THEN 'BENIGN' ELSE family END truth, CASE WHEN seq % 97 = 0 THEN 'UNKNOWN'
        WHEN seq % 5 = 0 THEN {_list(V.ATTACK_FAMILIES)}[1 + (seq * 7) % 9] ELSE family END predicted,
        score FROM flows""",
    "ranking": "SELECT label <> 'BENIGN' truth, score FROM flows",
    "steps": """SELECT score, pos, n, sum(pos) OVER (ORDER BY score DESC) tp,
        sum(n) OVER (ORDER BY score DESC) seen FROM (SELECT score,
        count(*) FILTER (truth) pos, count(*) n FROM ranking GROUP BY score)""",
    "captures": "SELECT * REPLACE ('cap' || (u % 3) AS capture_id) FROM flows",
    "windows": """SELECT DISTINCT capture_id, label family,
        (end_us // 100000000) * 100000000 start_us,
        (end_us // 100000000 + 1) * 100000000 - 1 end_us FROM captures WHERE label <> 'BENIGN'""",
    "actions": """SELECT i.id incident_id, b.wall ts, b.e seq, 'analyst' || (u % 5) actor,
        CASE WHEN e % 2 = 0 THEN ['NEW', 'ACK', 'INVESTIGATING', 'CLOSED'][1 + (e // 2) % 4] END status,
        CASE WHEN e % 6 = 0 THEN 'analyst' || (e % 4) END assignee,
        CASE WHEN e % 5 = 0 THEN ['TP', 'FP', 'BENIGN'][1 + e % 3] END verdict,
        CASE WHEN e % 7 = 0 THEN 'note ' || e END note
        FROM (SELECT * FROM base WHERE et = 'error') b
        ASOF JOIN (SELECT id, first_seq FROM incidents) i ON b.e <= i.first_seq""",
    "acted": """SELECT a.*, i.status status_0, i.verdict verdict_0, i.assignee assignee_0,
        last_value(a.verdict IGNORE NULLS) OVER w pv, last_value(a.assignee IGNORE NULLS) OVER w pa
        FROM actions a JOIN incidents i ON i.id = a.incident_id
        WINDOW w AS (PARTITION BY incident_id ORDER BY ts, seq
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "weighed": """SELECT *, coalesce(pv, verdict_0) verdict_b, coalesce(pa, assignee_0) assignee_b,
        verdict IS NOT NULL AND verdict IS DISTINCT FROM coalesce(pv, verdict_0) judges FROM acted""",
    "moved": """SELECT *, CASE WHEN judges THEN 'CLOSED' ELSE status END status_a FROM weighed""",
    "effects": """SELECT *, coalesce(last_value(status_a IGNORE NULLS) OVER (PARTITION BY incident_id
        ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), status_0) status_b
        FROM moved""",
    "hostsides": """SELECT src ip, 1 o, 0 i, fwd_bytes bo, 0 bi, CAST(is_alert AS BIGINT) a, score,
          threshold, end_us at_us, seq FROM flows
        UNION ALL SELECT dst, 0, 1, 0, bwd_bytes, 0, NULL, NULL, end_us, seq FROM flows""",
    "hosts": """SELECT ip, CAST(sum(o) AS BIGINT) flows_out, CAST(sum(i) AS BIGINT) flows_in,
        CAST(sum(bo) AS BIGINT) bytes_out, CAST(sum(bi) AS BIGINT) bytes_in,
        CAST(sum(a) AS BIGINT) alerts, sum(score) score_sum, count(score) score_n,
        arg_max(threshold, seq) FILTER (threshold IS NOT NULL) threshold,
        min(at_us) first_us, max(at_us) last_us FROM hostsides GROUP BY ip""",
    "named_hosts": """SELECT h.*, CASE WHEN ip LIKE '192.168.1.%' THEN
          CASE ip WHEN '192.168.1.10' THEN 'Serveur web' WHEN '192.168.1.11' THEN 'Base de données'
               WHEN '192.168.1.12' THEN 'Serveur DNS' ELSE 'Serveur de fichiers' END
          ELSE 'Réseau interne' END asset_name,
        CAST(CASE WHEN ip IN ('192.168.1.10', '192.168.1.11') THEN 5
             WHEN ip LIKE '192.168.1.%' THEN 4 ELSE 3 END AS BIGINT) criticality,
        CASE WHEN score_n > 0 THEN score_sum / (flows_out + flows_in) ELSE 0 END score_mean
        FROM hosts h""",
    "buckets": """SELECT (end_us // 1000000) * 1000000 ts_us, count(*) flows,
        CAST(sum(packets) AS BIGINT) packets, CAST(sum(bytes) AS BIGINT) bytes,
        count(*) FILTER (is_alert) alerts, avg(score) score_mean, max(score) score_max,
        avg(threshold) threshold_mean FROM flows GROUP BY 1""",
    "audit": """SELECT e id, epoch_us(wall) ts, 'analyst' || (u % 5) actor, 'incident.' || et action,
        CAST(e // 10 AS VARCHAR) target, props detail FROM base""",
}


def sql(body: str) -> str:
    """A query with the fragments it needs, in dependency order."""
    wanted: list[str] = []

    def visit(text: str, skip: str | None = None) -> None:
        for name in CTE:
            if name != skip and name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTE[name], name)
                wanted.append(name)

    visit(body)
    if not wanted:
        return body
    fragments = ",\n".join(f"{n} AS ({CTE[n]})" for n in wanted)
    if "{prefix}" in body:  # the query brings fragments of its own
        return body.replace("{prefix}", fragments)
    recursive = "RECURSIVE " if "cuts" in wanted else ""
    return f"WITH {recursive}{fragments}\n{body}"
