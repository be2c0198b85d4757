"""Analyst actions as an event log folded into incident state.

Events: incident_id, ts, seq, actor, and any of status, assignee, verdict, note. Within an
event the status patch applies first; a changed verdict then closes the incident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from packetloom.operators.slices import PrevLast, has_group_over, running
from packetloom.params import Params

ORDER = ["ts", "seq"]
DAY_US = 86_400_000_000


def normalised(events: DataFrame) -> DataFrame:
    """Blank assignees and notes count as absent."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return events.withColumns({"assignee": clean("assignee"), "note": clean("note")})


def _effects(incidents: DataFrame, events: DataFrame, p: Params) -> DataFrame:
    """Each event with the state before it and what it really changed."""
    before = incidents.select(F.col("id").alias("incident_id"),
                              *[F.col(c).alias(f"{c}_0") for c in ("status", "assignee", "verdict")])
    known = normalised(events).join(before, "incident_id")
    # sliced by day if some incident has more events than one task should order
    busy = has_group_over(events, ["incident_id"], p.group_rows)
    day = F.floor(F.unix_micros("ts") / F.lit(DAY_US)) if busy else None
    judged = running(known, ["incident_id"], ORDER, day,
                     verdict_b=PrevLast(F.col("verdict")), assignee_b=PrevLast(F.col("assignee")))
    judged = judged.withColumns({
        "verdict_b": F.coalesce("verdict_b", "verdict_0"),
        "assignee_b": F.coalesce("assignee_b", "assignee_0"),
    })
    judged = judged.withColumn(
        "judges",
        F.col("verdict").isNotNull() & ~F.col("verdict").eqNullSafe(F.col("verdict_b")))
    after = F.when(F.col("judges"), F.lit("CLOSED")).otherwise(F.col("status"))
    held = running(judged.withColumn("status_a", after), ["incident_id"], ORDER, day,
                   status_b=PrevLast(F.col("status_a")))
    held = held.withColumn("status_b", F.coalesce("status_b", "status_0"))
    patched = F.col("status").isNotNull() & (F.col("status") != F.col("status_b"))
    # a judgement closes unless the status patch left the incident closed already
    open_now = F.coalesce("status", "status_b") != "CLOSED"
    return held.withColumns({"patched": patched, "closes": F.col("judges") & open_now})


def triage_apply(incidents: DataFrame, events: DataFrame, p: Params = Params()) -> DataFrame:
    """Incidents after all events."""
    effects = _effects(incidents, events, p)
    at = F.struct(*ORDER)
    moved = F.col("patched") | F.col("closes")
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" "),
                    F.col("actor"), F.lit("] "), F.col("note"))
    lines = F.array_sort(F.collect_list(F.when(
        F.col("note").isNotNull(), F.struct(*ORDER, line.alias("line")))))
    final = effects.groupBy(F.col("incident_id").alias("id")).agg(
        F.max_by("status_a", F.when(F.col("status_a").isNotNull(), at)).alias("status_n"),
        F.max_by("assignee", F.when(F.col("assignee").isNotNull(), at)).alias("assignee_n"),
        F.max_by("verdict", F.when(F.col("verdict").isNotNull(), at)).alias("verdict_n"),
        F.max(F.when(moved, F.col("ts"))).alias("moved_at"),
        # the note column itself holds every note, so its text is the size of the result
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("notes"))
    out = incidents.join(final, "id", "left")
    status = F.coalesce("status_n", "status")
    closed = F.when(F.col("moved_at").isNull(), F.col("closed_at")).when(
        status == "CLOSED", F.col("moved_at"))
    return out.withColumns({
        "closed_at": closed, "status": status,
        "assignee": F.coalesce("assignee_n", "assignee"),
        "verdict": F.coalesce("verdict_n", "verdict"),
        "note": F.nullif(F.concat_ws("\n\n", F.nullif(F.col("note"), F.lit("")),
                                     F.nullif(F.col("notes"), F.lit(""))), F.lit("")),
    }).select(*incidents.columns)


def triage_bulk(ids: DataFrame, ts: Column, seq: Column, actor: str, status: str | None = None,
                assignee: str | None = None, verdict: str | None = None,
                limit: int = 500) -> DataFrame:
    """One patch on a list of incidents, as events. ``ids``: one ``ids`` array per request.

    A request of no or more than ``limit`` ids is an error of the whole call.
    """
    text = lambda v: F.lit(v).cast("string")
    wrong = F.raise_error(F.concat(F.lit(f"a request needs 1 to {limit} ids and has "),
                                   F.coalesce(F.size("ids"), F.lit(0)).cast("string")))
    return ids.select(
        F.explode(F.when(F.size("ids").between(1, limit), F.array_distinct("ids")).otherwise(
            wrong.cast("array<bigint>"))).alias("incident_id"), ts.alias("ts"),
        seq.alias("seq"), F.lit(actor).alias("actor"), text(status).alias("status"),
        text(assignee).alias("assignee"), text(verdict).alias("verdict"),
        F.lit(None).cast("string").alias("note"))


def triage_diff(incidents: DataFrame, events: DataFrame, p: Params = Params()) -> DataFrame:
    """(incident_id, seq, field, old, new) for every field an event changed."""
    e = _effects(incidents, events, p)
    text = lambda c: F.col(c).cast("string")
    change = lambda field, cond, old, new: F.when(cond, F.struct(
        F.lit(field).alias("field"), old.alias("old"), new.alias("new")))
    assigned = F.col("assignee").isNotNull() & ~F.col("assignee").eqNullSafe(F.col("assignee_b"))
    changes = F.array(
        change("status", F.col("patched"), text("status_b"), text("status")),
        change("assignee", assigned, text("assignee_b"), text("assignee")),
        change("verdict", F.col("judges"), text("verdict_b"), text("verdict")),
        change("note", F.col("note").isNotNull(), F.lit(None).cast("string"), F.lit("true")))
    return e.select("incident_id", "seq", F.explode(changes).alias("c")).where(
        F.col("c").isNotNull()).select("incident_id", "seq", "c.*")


def retraining_labels(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Alerts of judged incidents with the label the judgement implies."""
    judged = incidents.where(F.col("verdict").isNotNull()).select(
        F.col("id").alias("incident_id"), "verdict", F.col("family").alias("family_judged"))
    label = F.when(F.col("verdict") == "TP", F.col("family_judged")).otherwise("BENIGN")
    return alerts.join(judged, "incident_id").withColumn("training_label", label).drop(
        "family_judged")
