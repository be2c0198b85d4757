"""Classic pcap captures as packet rows: the scan, the stream, and decoding by column expressions."""

from __future__ import annotations

from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom import fixed_values as V
from packetloom.sources import capture


def pcap_unsupported(spark: SparkSession, path: str) -> DataFrame:
    """Files the reader leaves out, with the reason."""
    def look(batches):
        for pdf in batches:
            found = []
            for p in pdf["path"]:
                where, name = afs.FileSystem.from_uri(p)
                with where.open_input_file(name) as file:
                    found.append(capture.header(file.read_at(capture.HEADER, 0)))
            bad = [isinstance(f, str) for f in found]
            yield pdf[bad].assign(reason=[f for f in found if isinstance(f, str)])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition("path").mapInPandas(look, "path string, reason string")


def _number(at: Column, size: int) -> Column:
    """Big-endian unsigned number at a zero-based offset."""
    return F.conv(F.hex(F.substring("frame", at + 1, F.lit(size))), 16, 10).cast("long")


def decode_frames(frames: DataFrame) -> DataFrame:
    """Frames to packets: IPv4 over Ethernet (up to two VLAN tags), loopback or raw links."""
    tags = (0x8100, 0x88A8)
    lit = lambda n: F.lit(n)
    length = F.octet_length("frame")
    ethernet = F.col("link") == 1
    outer, inner = _number(lit(12), 2), _number(lit(16), 2)
    tagged, twice = outer.isin(*tags), outer.isin(*tags) & inner.isin(*tags)
    tag_count = F.when(twice, 2).when(tagged, 1).otherwise(0)
    kind = _number(12 + 4 * F.col("tags"), 2)
    offset = F.when(ethernet, 14 + 4 * F.col("tags")).otherwise(
        F.when(F.col("link") == 0, 4).otherwise(0))
    net = (
        frames.withColumn("tags", F.when(ethernet, tag_count).otherwise(0))
        .withColumn("ip", offset.cast("int"))
        .where(~ethernet | ((length >= F.col("ip")) & (kind == 0x0800)))
        .where(length >= F.col("ip") + 20)
        .withColumn("vihl", _number(F.col("ip"), 1))
        .withColumn("ihl", (F.col("vihl") % 16 * 4).cast("int"))
        .where((F.floor(F.col("vihl") / 16) == 4) & (F.col("ihl") >= 20)
               & (length >= F.col("ip") + F.col("ihl")))
        .withColumns({"num": _number(F.col("ip") + 9, 1), "at": F.col("ip") + F.col("ihl")})
    )
    at, num = F.col("at"), F.col("num")
    tcp = (num == 6) & (length >= at + 20)
    udp = (num == 17) & (length >= at + 8)
    icmp = (num == 1) & (length >= at + 4)
    port = lambda shift: _number(at + shift, 2)
    data = at + F.when(tcp, (F.floor(_number(at + 12, 1) / 16) * 4).cast("int")).otherwise(8)
    from packetloom.functions.scalars import ipv4_text

    return net.select(
        F.col("path").alias("capture_id"), "seq", "ts_us",  # files of one name in two folders differ
        ipv4_text(_number(F.col("ip") + 12, 4)).alias("src"),
        ipv4_text(_number(F.col("ip") + 16, 4)).alias("dst"),
        F.when(tcp, "tcp").when(udp, "udp").when(icmp, "icmp").otherwise("other").alias("proto"),
        F.when(tcp | udp, port(0)).otherwise(0).cast("int").alias("sport"),
        F.when(tcp | udp, port(2)).when(icmp, _number(at, 1)).otherwise(num)
        .cast("int").alias("dport"),
        F.col("wire").cast("int").alias("size"),
        F.when(tcp, _number(at + 13, 1).bitwiseAND(lit(63))).otherwise(0).cast("int").alias("flags"),
        F.when(tcp | udp | icmp, F.substring("frame", data + 1, lit(V.PAYLOAD_SAMPLE)))
        .otherwise(F.lit(b"")).alias("payload"),
        F.lit(V.BENIGN).alias("label"),
    )


def pcap_scan(spark: SparkSession, path: str, split_bytes: int = capture.SPLIT) -> DataFrame:
    """A folder of captures as packet rows in the standard schema."""
    return capture.register(spark).read.format("capture").option("split", split_bytes).load(path)


def pcap_stream(spark: SparkSession, path: str, split_bytes: int = capture.SPLIT) -> DataFrame:
    """Captures of a folder as they appear and grow."""
    packets = capture.register(spark).readStream.format("capture").option("split", split_bytes).load(path)
    return packets.withColumn("ts", F.timestamp_micros("ts_us"))
