"""Schemas of the tables at rest. They are declared, never inferred."""

from pyspark.sql import types as T

L, D, S, I, B = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PACKETS = _schema(
    capture_id=S, seq=L, ts_us=L, src=S, dst=S, proto=S, sport=I, dport=I,
    size=I, flags=I, payload=T.BinaryType(), label=S,
)

CONTRIBUTIONS = T.ArrayType(_schema(feature=S, value=D, baseline=D, impact=D, direction=S))

ASSETS = _schema(cidr=S, name=S, criticality=I, tags=T.ArrayType(S))

TRIAGE_EVENTS = _schema(
    incident_id=L, ts=T.TimestampType(), actor=S, status=S, assignee=S, verdict=S, note=S,
)

AUDIT = _schema(ts=T.TimestampType(), actor=S, action=S, target=S, detail=S)
