"""Prefix scans over range partitions against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators.prefix import Before, Sum, Xor, prefix_scan


@pytest.mark.parametrize("parts", ["1", "7"])
def test_segments_across_ranges(spark, parts):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "a", "a", "b", "c"]), i, rng.choice([None, *range(-3, 40)])) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, t int, v long").repartition(3)
        got = prefix_scan(df, ["t"], ["g"], total=Sum(F.col("v")), mark=Xor(F.col("v")), prev=Before(F.col("v"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, state = {}, {}
    for g, t, v in rows:
        s, x, p = state.get(g, (0, 0, None))
        want[g, t] = (v, s + (v or 0), x ^ (v or 0), p)
        state[g] = (s + (v or 0), x ^ (v or 0), v)
    assert {(r.g, r.t): (r.v, r.total, r.mark, r.prev) for r in got} == want and len(got) == 400


def test_one_order_over_everything_and_nothing(spark):
    df = spark.range(1000).withColumn("v", F.lit(2))
    got = prefix_scan(df, [F.col("id").desc()], n=Sum(F.lit(1)), total=Sum(F.col("v")))
    assert all(r.n == 1000 - r.id and r.total == 2 * r.n for r in got.collect())
    assert prefix_scan(df.where("id < 0"), ["id"], n=Sum(F.lit(1))).count() == 0
