"""Captures as data: stacking, splitting, comparing, ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from packetloom.operators.assembly import assemble_flows
from packetloom.operators.windows import behaviour_features, flow_records
from packetloom.params import Params
from packetloom.session import materialise


def stack_captures(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def capture_split(flows: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test by capture, never by row. ``split``: capture_id, part."""
    tagged = flows.join(split, "capture_id")
    side = lambda name: tagged.where(F.col("part") == name).drop("part")
    return side("train"), side("test")


def split_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Captures on both sides; must be empty."""
    return train.select("capture_id").intersect(test.select("capture_id"))


def flow_multiset_diff(a: DataFrame, b: DataFrame, signature: list[str]) -> DataFrame:
    """Rows whose multiplicity differs, with the side that has more."""
    left, right = a.select(*signature), b.select(*signature)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def time_order(packets: DataFrame) -> DataFrame:
    """Captures merged on the clock: a range-partitioned sort."""
    return packets.orderBy("ts_us", "capture_id", "seq")


def flow_dataset(packets: DataFrame, p: Params = Params(), clock: str = "capture") -> DataFrame:
    """Packets of many captures to labelled flows with all 52 features."""
    # each is read several times below
    flows = materialise(assemble_flows(packets, p, clock), "flows")
    records = materialise(flow_records(flows), "records")
    known = [c for c in records.columns if c not in ("capture_id", "seq")]
    behaviour = behaviour_features(records, p).drop(*known).withColumnRenamed("seq", "flow_id")
    return flows.join(behaviour, ["capture_id", "flow_id"])
