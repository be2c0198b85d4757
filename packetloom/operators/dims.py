"""Look-ups in small dimensions: assets by longest prefix, families by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom import fixed_values as V
from packetloom import schemas
from packetloom.functions import scalars as S
from packetloom.params import Params


def default_assets(spark: SparkSession) -> DataFrame:
    rows = [(c, n, k, list(t)) for c, n, k, t in V.DEFAULT_ASSETS]
    return assets_replace(spark.createDataFrame(rows, schemas.ASSETS))


def assets_replace(assets: DataFrame) -> DataFrame:
    """An inventory as it is kept: criticality clamped to 1..5, rows in their given order."""
    ranked = assets if "ord" in assets.columns else assets.withColumn(
        "ord", F.monotonically_increasing_id())
    return ranked.withColumn(
        "criticality", F.greatest(F.lit(1), F.least(F.lit(5), F.col("criticality"))))


def _mask(number: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    step = F.pow(F.lit(2.0), 32 - length).cast("long")
    return number - F.pmod(number, step)


def _networks(assets: DataFrame) -> DataFrame:
    """One row per distinct (length, network); bad or IPv6 CIDRs drop out, the first row wins."""
    parts = F.split("cidr", "/")
    length = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"),
                        F.when(F.size(parts) == 1, F.lit(32)))
    parsed = assets.withColumns({
        "length": length, "number": S.ipv4_number(F.get(parts, F.lit(0))),
    }).where(F.col("number").isNotNull() & F.col("length").between(0, 32)
             & (F.size(parts) <= 2))
    return (
        parsed.withColumn("network", _mask(F.col("number"), F.col("length")))
        .groupBy("length", "network")
        .agg(F.min_by(F.struct("name", "criticality"), "ord").alias("asset"))
    )


def asset_lookup(df: DataFrame, ip: str, assets: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``asset_name`` and ``asset_criticality`` of the most specific network."""
    nets = _networks(assets)
    name, crit = V.NO_ASSET
    lengths = [r.length for r in nets.select("length").distinct().collect()]  # at most 33
    lengths.sort(reverse=True)
    small = assets.limit(p.dimension_rows + 1).count() <= p.dimension_rows
    number = S.ipv4_number(F.col(ip))
    if small:
        # one map-side equi-join per prefix length that exists; the facts never move
        out = df.withColumn("_num", number)
        for i, length in enumerate(lengths):
            side = nets.where(F.col("length") == length).select(
                F.col("network").alias(f"_n{i}"), F.col("asset").alias(f"_a{i}"))
            out = out.withColumn(f"_m{i}", _mask(F.col("_num"), length)).join(
                F.broadcast(side), F.col(f"_m{i}") == F.col(f"_n{i}"), "left")
        found = F.coalesce(*[F.col(f"_a{i}") for i in range(len(lengths))]) if lengths else \
            F.lit(None).cast("struct<name:string,criticality:int>")
        helpers = [f"_{x}{i}" for i in range(len(lengths)) for x in "mna"]
        return out.withColumns({
            "asset_name": F.coalesce(found["name"], F.lit(name)),
            "asset_criticality": F.coalesce(found["criticality"], F.lit(crit)),
        }).drop("_num", *helpers)
    # large inventory: resolve each distinct address once, by shuffle, then join back
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_num", S.ipv4_number(F.col("_ip")))
    # every address is in 0.0.0.0/0: that one network is a default, not a key
    every = nets.where("length = 0").select(F.col("asset").alias("_every"))
    narrow = [x for x in lengths if x]
    tried = addresses.withColumn(
        "length", F.explode(F.array(*[F.lit(x) for x in narrow]).cast("array<int>"))
    ).withColumn("network", _mask(F.col("_num"), F.col("length")))
    best = tried.join(nets, ["length", "network"]).groupBy("_ip").agg(
        F.max_by("asset", "length").alias("_asset"))
    joined = df.join(best, F.col(ip) == F.col("_ip"), "left")
    if 0 in lengths:
        joined = joined.join(F.broadcast(every), number.isNotNull(), "left").withColumn(
            "_asset", F.coalesce("_asset", "_every")).drop("_every")
    return joined.withColumns({
        "asset_name": F.coalesce(F.col("_asset.name"), F.lit(name)),
        "asset_criticality": F.coalesce(F.col("_asset.criticality"), F.lit(crit)),
    }).drop("_ip", "_asset")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(V.FAMILIES), "family string, family_title string, mitre_technique string, "
        "mitre_tactic string, default_criticality int")


def family_info(df: DataFrame) -> DataFrame:
    """Add title, technique, tactic and default criticality; unknown names as UNKNOWN."""
    table = families(df.sparkSession)  # 11 fixed rows
    listed = F.col("family").isin(*[f[0] for f in V.FAMILIES])
    keyed = df.withColumn("_fam", F.when(listed, F.col("family")).otherwise(V.UNKNOWN))
    return keyed.join(F.broadcast(table.withColumnRenamed("family", "_fam")), "_fam",
                      "left").drop("_fam")
