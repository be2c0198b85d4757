"""Small restatements of the rules in plain Python, used only to check the Spark jobs."""

from __future__ import annotations

S = 1_000_000
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def packet(t, src="a", dst="b", sport=1000, dport=80, flags=0, proto="tcp", size=60, payload=b"",
           label="BENIGN"):
    """Time in seconds; the sequence number is added by ``numbered``."""
    return dict(capture_id="c", ts_us=round(t * S), src=src, dst=dst, proto=proto, sport=sport,
                dport=dport, size=size, flags=flags, payload=payload, label=label)


def numbered(packets):
    ordered = sorted(packets, key=lambda p: p["ts_us"])
    return [dict(p, seq=i) for i, p in enumerate(ordered)]


def packet_frame(spark, packets):
    from packetloom import schemas

    rows = numbered(packets)
    names = schemas.PACKETS.names
    return spark.createDataFrame([tuple(p[n] for n in names) for p in rows], schemas.PACKETS)


def event_loop(packets, idle=15 * S, syn=3 * S, active=120 * S):
    """Flows by walking the capture: absorb the packet, then export what is due.

    Returns sorted (flow_id, packet count, start, end, export).
    """
    table, done, last_seen = {}, [], 0
    for p in numbered(packets):
        now = p["ts_us"]
        last_seen = max(last_seen, now)
        ends = sorted([(p["src"], p["sport"]), (p["dst"], p["dport"])])
        key = (*ends, p["proto"])
        f = table.setdefault(key, dict(id=p["seq"], n=0, start=now, fins=0, rst=False, lone=False))
        f["n"] += 1
        f["last"] = now
        f["fins"] += bool(p["flags"] & FIN)
        f["rst"] |= bool(p["flags"] & RST)
        f["lone"] = f["n"] == 1 and p["flags"] & SYN and not p["flags"] & ACK
        if f["rst"] or f["fins"] >= 2:
            done.append((f["id"], f["n"], f["start"], f["last"], now))
            del table[key]
        for k, f in list(table.items()):
            if now - f["last"] >= (syn if f["lone"] else idle) or now - f["start"] >= active:
                done.append((f["id"], f["n"], f["start"], f["last"], now))
                del table[k]
    done += [(f["id"], f["n"], f["start"], f["last"], last_seen) for f in table.values()]
    return sorted(done)


def strict_windows(flows, span, key, value):
    """For each flow in order: rows and distinct values of its key in the window, by scanning."""
    out = []
    for i, f in enumerate(flows):
        inside = [g for g in flows[:i + 1] if g[key] == f[key] and g["end_us"] >= f["end_us"] - span]
        out.append((len(inside), len({g[value] for g in inside})))
    return out
