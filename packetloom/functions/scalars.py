"""Column expressions: no joins, no shuffles, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from packetloom import fixed_values as V
from packetloom.params import SECOND, Params

DEFAULTS = Params()


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def seconds(us: Column) -> Column:
    return us / F.lit(float(SECOND))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


# keys and labels

def lower_end_is_source() -> Column:
    src, dst = F.col("src"), F.col("dst")
    return (src < dst) | ((src == dst) & (F.col("sport") <= F.col("dport")))


def canonical_columns() -> dict[str, Column]:
    """Direction-free 5-tuple; ends are ordered as (ip text, port)."""
    first = lower_end_is_source()
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return {
        "key_lo": pick("src", "dst"),
        "key_hi": pick("dst", "src"),
        "key_lo_port": pick("sport", "dport"),
        "key_hi_port": pick("dport", "sport"),
    }


def flow_label() -> Column:
    return F.concat(
        F.col("src"), F.lit(":"), F.col("sport"), F.lit(" -> "),
        F.col("dst"), F.lit(":"), F.col("dport"), F.lit("/"), F.col("proto"),
    )


def feature_label(name: Column) -> Column:
    pairs = [F.lit(x) for kv in V.FEATURE_LABELS.items() for x in kv]
    # try_element_at: the names outside the table fall through to the rule
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name),
                      F.translate(name, "_", " "))


# flow arithmetic

def charged_seconds(duration_s: Column) -> Column:
    """A zero-length flow is charged one millisecond."""
    return F.when(duration_s > 0, duration_s).otherwise(F.lit(1e-3))


def ratio_floor_one(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def protocol_columns() -> dict[str, Column]:
    out = {f"is_{p}": (F.col("proto") == p).cast("double") for p in ("tcp", "udp", "icmp")}
    out["dport_is_system"] = (F.col("dport") < 1024).cast("double")
    return out


def vectorize(names: tuple[str, ...] = V.FEATURES) -> Column:
    """Fixed-order ARRAY<FLOAT>: null and NaN to 0, values clipped."""
    lo, hi = F.lit(-V.VECTOR_CLIP), F.lit(V.VECTOR_CLIP)

    def one(name: str) -> Column:
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return F.least(F.greatest(F.nanvl(x, F.lit(0.0)), lo), hi).cast("float")

    return F.array(*[one(n) for n in names])


# detection

def verdict_severity(score: Column, threshold: Column, is_alert: Column) -> Column:
    margin = score - threshold
    return (
        F.when(~is_alert, "INFO")
        .when((score >= 0.92) | (margin >= 0.25), "CRITICAL")
        .when(margin >= 0.10, "HIGH")
        .otherwise("MEDIUM")
    )


def vetoable(score: Column, family: Column, confidence: Column, p: Params = DEFAULTS) -> Column:
    """Would the classifier's confident BENIGN silence an alert on this row?"""
    return (
        (family == V.BENIGN) & (confidence >= p.veto_confidence) & (score < p.override_score)
    )


def cascade_veto(p: Params = DEFAULTS) -> dict[str, Column]:
    score, family, conf = F.col("score"), F.col("family"), F.col("confidence")
    raised = score >= F.col("threshold")
    veto = vetoable(score, family, conf, p)
    return {"is_alert": raised & ~veto, "suppressed": raised & veto}


def unknown_floor(family: Column, confidence: Column, p: Params = DEFAULTS) -> Column:
    return F.when(confidence < p.unknown_below, V.UNKNOWN).otherwise(family)


# incidents

def dedup_key() -> Column:
    family = F.col("family")
    return (
        F.when(family.isin(*V.VICTIM_FAMILIES), F.concat_ws("|", family, F.lit("*"), F.col("dst")))
        .when(family.isin(*V.SOURCE_FAMILIES), F.concat_ws("|", family, F.col("src"), F.lit("*")))
        .otherwise(F.concat_ws("|", family, F.col("src"), F.col("dst")))
    )


def incident_id(*parts: Column) -> Column:
    """A number for capture, dedup key and the time and sequence of the first alert: 60 bits of a hash."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def incident_peer() -> Column:
    return F.when(F.col("family").isin(*V.VICTIM_FAMILIES), F.col("src")).otherwise(F.col("dst"))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def incident_margin(score_max: Column, threshold: Column) -> Column:
    return clamp01((score_max - threshold) / F.greatest(1.0 - threshold, F.lit(1e-6)))


def incident_priority(margin: Column, criticality: Column, confidence: Column,
                      occurrences: Column) -> Column:
    volume = F.least(occurrences / F.lit(200.0), F.lit(1.0)) * 0.08
    blend = margin * 0.50 + (criticality / F.lit(5.0)) * 0.30 + confidence * 0.12 + volume
    # half-even, as in banker's rounding
    return F.bround(F.least(blend, F.lit(1.0)) * 100, 0).cast("int")


def incident_severity(priority: Column) -> Column:
    return (
        F.when(priority >= 75, "CRITICAL").when(priority >= 58, "HIGH")
        .when(priority >= 38, "MEDIUM").otherwise("LOW")
    )


def severity_rank(severity: Column) -> Column:
    expr = F.lit(0)
    for rank, name in enumerate(V.SEVERITIES):
        expr = F.when(severity == name, F.lit(rank)).otherwise(expr)
    return expr


# IPv4

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad to BIGINT; NULL for anything else."""
    octets = F.split(ip, r"\.")
    part = lambda i: F.get(octets, i).try_cast("long")
    value = part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3)
    return F.when(ip.rlike(IPV4), value)


def ipv4_text(number: Column) -> Column:
    octet = lambda shift: F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))
