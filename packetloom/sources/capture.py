"""Capture files as a Spark data source: ``spark.read.format("capture")``, also as a stream.

A capture is cut into byte ranges, each read block by block and decoded in numpy. A record belongs to the
range in which it ends, so a file that still grows is read up to its last whole record and the rest
comes with the next batch of a stream.

A range begins somewhere inside a record. Every offset that could be a record header points
to the next one by its length, and headers that lead nowhere drop out. Bytes that only look like
headers lie inside a record and cannot go on past its end unless they join the true chain there, so
chains that begin within one largest record of a point well before the range, of which the true one is
one, have ended or become one when they reach it. If several are left, the search begins further
ahead, so that they have longer to do so, and if need be at the start of the file, where the first
record is certain and the way to the range is walked block by block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from packetloom import fixed_values as V
from packetloom import schemas

# File magic as little-endian reads it -> (byte order, ticks per microsecond).
MAGICS = {0xA1B2C3D4: ("<", 1), 0xA1B23C4D: ("<", 1000), 0xD4C3B2A1: (">", 1), 0x4D3CB2A1: (">", 1000)}
# Link type -> bytes before the network header (Ethernet may add VLAN tags).
LINKS = {1: 14, 0: 4, 101: 0, 12: 0, 14: 0}
HEADER, RECORD = 24, 16
SPLIT = 1 << 25      # bytes of a range
LARGEST = 1 << 18    # the format's largest record; a parameter of the source
BLOCK = 1 << 21      # bytes of a range that are held at once
BATCH = 16_384       # packets decoded at once
AHEAD = (4, 32)      # largest records ahead of a range from which a search begins, before it begins at the file's start
ROOM = 64            # zeros behind the buffer, so that fixed offsets can be read everywhere


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int


@dataclass(frozen=True)
class Header:
    order: str
    ticks: int
    link: int


def header(head: bytes) -> Header | str:
    """What the file header says, or why the file cannot be read."""
    magic = struct.unpack("<I", head[:4])[0] if len(head) == HEADER else None
    if magic not in MAGICS:
        return "not a classic pcap file"
    order, ticks = MAGICS[magic]
    link = struct.unpack(f"{order}I", head[20:24])[0]
    return Header(order, ticks, link) if link in LINKS else f"link type {link} is not supported"


def listed(path: str) -> dict[str, int]:
    """Sizes of the files at a path, a folder or a pattern, without hidden ones."""
    where, base = afs.FileSystem.from_uri(path)
    scheme = path[:len(path) - len(base)] if path.endswith(base) else ""
    wild = min((base.find(c) for c in "*?[" if c in base), default=-1)
    root = base if wild < 0 else base[:base.rfind("/", 0, wild)]
    top = where.get_file_info(root)
    found = [top] if top.is_file else where.get_file_info(afs.FileSelector(root, recursive=True))
    shown = lambda f: not any(x[:1] in "._" for x in f.path[len(root):].split("/")[1:])
    return {scheme + f.path: f.size for f in found
            if f.is_file and (f is top or shown(f)) and (wild < 0 or fnmatch(f.path, base))}


def cut(files: dict[str, int], split: int, done: dict[str, int] | None = None) -> list[Range]:
    done = done or {}
    return [Range(path, lo, min(lo + split, size)) for path, size in sorted(files.items())
            for lo in range(done.get(path, 0), size, split)]


def _headers(data: np.ndarray, order: str, ticks: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that may begin a record, and the record's captured bytes."""
    n = max(0, len(data) - RECORD + 1)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def field(at: int) -> np.ndarray:
        out = np.empty(n, np.uint32)
        for k in range(min(4, n)):  # every fourth offset at a time
            out[k::4] = np.frombuffer(data, f"{order}u4", len(range(k, n, 4)), at + k)
        return out

    # nothing is asked of the length on the wire: some writers give less than they captured
    length = field(8)
    may = np.flatnonzero((length <= largest) & (field(4) < 1_000_000 * ticks))
    return may, length[may].astype(np.int64)


def first_after(data: np.ndarray, edge: int, before: int, head: Header, largest: int) -> set[int]:
    """Where chains that begin before ``before`` have their first record that ends behind ``edge``.

    data begins with the window that is searched and reaches behind the edge.
    """
    at, length = _headers(data[:before + RECORD - 1], head.order, head.ticks, largest)
    if not len(at):
        return set()
    # the last record of each chain that begins before; a chain that leads nowhere goes to an extra last place
    end = at + RECORD + length
    to = np.minimum(np.searchsorted(at, end), len(at) - 1)
    out = np.append(end >= before, True)
    follow = np.append(np.where(out[:-1], np.arange(len(at)), np.where(at[to] == end, to, len(at))), len(at))
    live = np.unique(follow)
    while not out[live].all():
        follow = follow[follow]
        live = np.unique(follow[live])
    # few are left, and each place behind is looked at once
    unpack = struct.Struct(f"{head.order}4xII").unpack_from
    found, seen = set(), set()
    for i in at[live[live < len(at)]].tolist():
        n = unpack(data, i)[1]
        while i not in seen:
            seen.add(i)
            stop = i + RECORD + n
            if stop > edge:
                found.add(i)
                break
            if stop + RECORD > len(data):
                found.add(stop)  # the data end inside the next header
                break
            frac, n = unpack(data, stop)
            if n > largest or frac >= 1_000_000 * head.ticks:
                break
            i = stop
    return found


class Buffered:
    """One file, read in as few pieces as the range needs."""

    def __init__(self, path: str, largest: int):
        where, name = afs.FileSystem.from_uri(path)
        self.file, self.path, self.largest = where.open_input_file(name), path, largest
        self.head = header(self.file.read_at(HEADER, 0))

    def bytes(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(max(0, stop - start), start), np.uint8)

    def range(self, lo: int, hi: int) -> tuple[np.ndarray, int, int]:
        """Bytes that were searched last, the file offset of the first, and that of the first record that ends behind lo."""
        reach = self.largest + RECORD
        for ahead in AHEAD:
            start = lo - ahead * reach
            if start <= HEADER:
                break
            data = self.bytes(start, min(hi, lo + RECORD))
            # chains have the rest of the window to end or to become one
            found = first_after(data, lo - start, reach, self.head, self.largest)
            if len(found) == 1:
                return data, start, start + found.pop()
        data, at = np.zeros(0, np.uint8), HEADER
        if lo > HEADER:
            for base, data, rows in self.records(HEADER, hi):
                for i, _, _, _, n in rows:
                    if base + i + RECORD + n > lo:
                        return data, HEADER, base + i
                at = base + i + RECORD + n
        return data, HEADER, at

    def records(self, at: int, hi: int) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, int, int, int]]]]:
        """Whole records between two offsets, block by block: file offset of the block, its bytes, what ``walk`` gives."""
        size = BLOCK
        while at + RECORD <= hi:
            data = self.bytes(at, min(at + size, hi))
            rows = list(self.walk(data, 0))
            if rows:
                yield at, data, rows
                at, size = at + rows[-1][0] + RECORD + rows[-1][4], BLOCK
            elif len(data) < size:
                return
            else:  # a record longer than the block
                size *= 4

    def walk(self, data: np.ndarray, at: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(offset, seconds, fraction, wire length, captured length) of whole records."""
        record, raw, n = struct.Struct(f"{self.head.order}IIII"), memoryview(data), len(data)
        while at + RECORD <= n:
            sec, frac, length, wire = record.unpack_from(raw, at)
            if at + RECORD + length > n:
                return
            yield at, sec, frac, wire or length, length
            at += RECORD + length


def _number(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(size):
        out = out << 8 | data[at + k]
    return out


def _texts(numbers: np.ndarray) -> pa.Array:
    """Addresses as dotted quads; each different one is written once."""
    different, which = np.unique(numbers, return_inverse=True)
    quads = [f"{a >> 24}.{a >> 16 & 255}.{a >> 8 & 255}.{a & 255}" for a in different.tolist()]
    return pa.array(quads, pa.string()).take(pa.array(which))


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])


def decoded(path: str, base: int, data: np.ndarray, records: np.ndarray, head: Header) -> pa.RecordBatch:
    """Packets of records (offset, seconds, fraction, wire, captured): IPv4 over Ethernet with up to
    two VLAN tags, loopback or raw links; other frames give no row. data ends with ROOM zeros."""
    at, sec, frac, wire, length = records.T
    frame, end = at + RECORD, at + RECORD + length
    last = len(data) - ROOM
    read = lambda where, size: _number(data, np.minimum(where, last), size)
    if head.link == 1:
        tagged = np.isin(read(frame + 12, 2), (0x8100, 0x88A8))
        twice = tagged & np.isin(read(frame + 16, 2), (0x8100, 0x88A8))
        skip = 4 * (tagged.astype(np.int64) + twice)
        ip = frame + 14 + skip
        keep = (ip <= end) & (read(frame + 12 + skip, 2) == 0x0800)
    else:
        ip = frame + LINKS[head.link]
        keep = np.ones(len(at), bool)
    first = read(ip, 1)
    body = ip + first % 16 * 4
    keep &= (end >= ip + 20) & (first >> 4 == 4) & (body >= ip + 20) & (end >= body)
    ip, body, end, at, sec, frac, wire = (x[keep] for x in (ip, body, end, at, sec, frac, wire))
    number = read(ip + 9, 1)
    tcp, udp, icmp = (number == 6) & (end >= body + 20), (number == 17) & (end >= body + 8), (number == 1) & (end >= body + 4)
    ported, known = tcp | udp, tcp | udp | icmp
    payload = np.minimum(body + np.where(tcp, (read(body + 12, 1) >> 4) * 4, 8), end)
    names = np.select([tcp, udp, icmp], [0, 1, 2], 3)
    n, small = len(at), lambda x: pa.array(x.astype(np.int32))
    columns = {
        "capture_id": pa.repeat(pa.scalar(path), n), "seq": pa.array(at + base),
        "ts_us": pa.array(sec * 1_000_000 + frac // head.ticks), "src": _texts(read(ip + 12, 4)), "dst": _texts(read(ip + 16, 4)),
        "proto": pa.array(["tcp", "udp", "icmp", "other"]).take(pa.array(names)),
        "sport": small(np.where(ported, read(body, 2), 0)),
        "dport": small(np.where(ported, read(body + 2, 2), np.where(icmp, read(body, 1), number))), "size": small(wire),
        "flags": small(np.where(tcp, read(body + 13, 1) & 63, 0)),
        "payload": _pieces(data, payload, np.where(known, np.minimum(end - payload, V.PAYLOAD_SAMPLE), 0)),
        "label": pa.repeat(pa.scalar(V.BENIGN), n)}
    return pa.RecordBatch.from_arrays([columns[c] for c in schemas.PACKETS.names], names=schemas.PACKETS.names)


def packets(part: Range, largest: int) -> Iterator[pa.RecordBatch]:
    """Packets of the records that end in a range."""
    file = Buffered(part.path, largest)
    if isinstance(file.head, str):
        return
    at = file.range(part.lo, part.hi)[2]
    for base, data, rows in file.records(at, part.hi):
        padded = np.concatenate([data, np.zeros(ROOM, np.uint8)])
        for k in range(0, len(rows), BATCH):
            yield decoded(part.path, base, padded, np.array(rows[k:k + BATCH], np.int64), file.head)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split, self.largest = int(options.get("split", SPLIT)), int(options.get("largest", LARGEST))


class CaptureReader(_Options, DataSourceReader):
    def partitions(self) -> list[Range]:
        return cut(listed(self.path), self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from packets(partition, self.largest)


class CaptureStream(_Options, DataSourceStreamReader):
    """Captures of a folder as they appear and grow; the offset is how much of each file was read.

    Files that leave the folder leave the offset, so it is as long as the folder's listing.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return cut(end, self.split, start)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from packets(partition, self.largest)


class CaptureSource(DataSource):
    """Options: path (file, folder or pattern), split (bytes of a range), largest (bytes of the largest record)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return schemas.PACKETS

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema: StructType) -> CaptureStream:
        return CaptureStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(CaptureSource)
    return spark
