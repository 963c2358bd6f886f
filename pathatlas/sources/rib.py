"""Route-collector RIB dumps (MRT TABLE_DUMP_V2, RFC 6396 and RFC 8050) as a DataFrame.

Files are read by Spark's ``binaryFile`` source, so any Hadoop file system works and no
listing passes through the driver; each task decodes its files and streams Arrow batches.
Only the byte decoding is Python; everything after it is JVM work.
"""

from __future__ import annotations

import bz2
import gzip
import io
import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ip

# Fixed values of the format: record type, subtypes -> (family, add-path), attribute code.
TABLE_DUMP_V2, PEER_INDEX = 13, 1
RIB_SUBTYPES = {2: (4, False), 4: (6, False), 8: (4, True), 10: (6, True)}
AS_PATH = 2

SCHEMA = ("file string, family int, plen int, addr binary, peer_asn bigint, peer_ip string, path array<bigint>")
_ARROW = pa.schema([("file", pa.string()), ("family", pa.int32()), ("plen", pa.int32()), ("addr", pa.binary()),
                    ("peer_asn", pa.int64()), ("peer_ip", pa.string()), ("path", pa.list_(pa.int64()))])
_BATCH = 50_000
COLLECTOR = r"(?s)^(?:.*/)?([^/]++)/[^/]++$"  # the folder of a file; linear in the length of the name


def _open(name: str, content: bytes):
    raw = io.BytesIO(content)
    if name.endswith(".gz"):
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if name.endswith(".bz2") else raw


def _records(stream) -> Iterator[tuple[int, memoryview]]:
    """(subtype, body) of every table record; a cut-off file simply ends."""
    while True:
        try:
            head = stream.read(12)
            if len(head) < 12:
                return
            kind, subtype, size = struct.unpack(">4xHHI", head)
            body = stream.read(size)
        except (EOFError, OSError):
            return
        if len(body) < size:
            return
        if kind == TABLE_DUMP_V2:
            yield subtype, memoryview(body)


def _peers(body: memoryview) -> list[tuple[int, str]]:
    (view,) = struct.unpack_from(">H", body, 4)
    (count,) = struct.unpack_from(">H", body, 6 + view)
    at, out = 8 + view, []
    for _ in range(count):
        flags = body[at]
        size = 16 if flags & 1 else 4
        width = ">I" if flags & 2 else ">H"
        address = ipaddress.ip_address(bytes(body[at + 5:at + 5 + size]))
        (asn,) = struct.unpack_from(width, body, at + 5 + size)
        out.append((asn, str(address)))
        at += 5 + size + struct.calcsize(width)
    return out


def _as_path(attrs: memoryview) -> list[int]:
    """All segments of the first AS_PATH attribute in one list (set members inline)."""
    at = 0
    while at + 3 <= len(attrs):
        long_form = bool(attrs[at] & 0x10)
        if long_form and at + 4 > len(attrs):
            break
        code = attrs[at + 1]
        size = struct.unpack_from(">H", attrs, at + 2)[0] if long_form else attrs[at + 2]
        start = at + (4 if long_form else 3)
        if code != AS_PATH:
            at = start + size
            continue
        value, pos, asns = attrs[start:start + size], 0, []
        while pos + 2 <= len(value):
            n = min(value[pos + 1], (len(value) - pos - 2) // 4)
            asns.extend(struct.unpack_from(f">{n}I", value, pos + 2))
            pos += 2 + 4 * value[pos + 1]
        return asns
    return []


def rib_rows(subtype: int, body: memoryview, peers: list[tuple[int, str]]) -> Iterator[tuple]:
    """Rows (family, plen, addr, peer_asn, peer_ip, path) of one record; default routes and empty paths skipped."""
    family, add_path = RIB_SUBTYPES[subtype]
    plen = body[4]
    if plen == 0:
        return
    at = 5 + (plen + 7) // 8
    addr = bytes(body[5:at])
    (entries,) = struct.unpack_from(">H", body, at)
    at += 2
    gap = 10 if add_path else 6
    for _ in range(entries):
        if at + gap + 2 > len(body):
            break
        (peer,) = struct.unpack_from(">H", body, at)
        (size,) = struct.unpack_from(">H", body, at + gap)
        path = _as_path(body[at + gap + 2:at + gap + 2 + size])
        at += gap + 2 + size
        if path:
            asn, text = peers[peer] if peer < len(peers) else (None, None)
            yield family, plen, addr, asn, text, path


def decode_rib(name: str, content: bytes) -> Iterator[tuple]:
    """The rows of a whole file's content."""
    peers: list[tuple[int, str]] = []
    for subtype, body in _records(_open(name, content)):
        if subtype == PEER_INDEX:
            peers = _peers(body)
        elif subtype in RIB_SUBTYPES:
            yield from rib_rows(subtype, body, peers)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _decode_batches(batches):
    rows: list[tuple] = []
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content")):
            name = name.as_py()
            for row in decode_rib(name, content.as_py()):
                rows.append((name, *row))
                if len(rows) >= _BATCH:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def rib_entries(files: DataFrame) -> DataFrame:
    """(path, content) of RIB files -> raw entries."""
    return files.select("path", "content").mapInArrow(_decode_batches, SCHEMA)


def typed_entries(entries: DataFrame, family: int, collector_pattern: str = COLLECTOR) -> DataFrame:
    """Entries of one family with bounds: collector, snap_ts, prefix, ip_start, ip_end, family, plen, peer, path."""
    d = entries.where(F.col("family") == family).withColumn("_b", ip.prefix_from_bytes("addr", "plen", family == 6))
    return d.select(
        F.regexp_extract("file", collector_pattern, 1).alias("collector"), snap_ts("file").alias("snap_ts"),
        F.col("_b.prefix").alias("prefix"), F.col("_b.start").alias("ip_start"), F.col("_b.end").alias("ip_end"),
        "family", "plen", "peer_asn", "peer_ip", "path")


def all_entries(entries: DataFrame, collector_pattern: str = COLLECTOR) -> DataFrame:
    """Entries of both families from one decode: bounds as 128-bit ``start128`` and ``end128``, as the address tables of both have them."""
    v4 = ip.prefix_from_bytes("addr", "plen", False)
    v6 = ip.prefix_from_bytes("addr", "plen", True)
    four = ip.let(v4, lambda b: F.struct(b["prefix"].alias("prefix"), ip.as_u128(b["start"], False).alias("start"), ip.as_u128(b["end"], False).alias("end")))
    six = ip.let(v6, lambda b: F.struct(b["prefix"].alias("prefix"), b["start"].alias("start"), b["end"].alias("end")))
    d = entries.withColumn("_b", F.when(F.col("family") == 4, four).otherwise(six))
    return d.select(F.regexp_extract("file", collector_pattern, 1).alias("collector"), snap_ts("file").alias("snap_ts"), F.col("_b.prefix").alias("prefix"),
                    F.col("_b.start").alias("start128"), F.col("_b.end").alias("end128"), "family", "plen", "peer_asn", "peer_ip", "path")


def src_rib(spark: SparkSession, path: str, family: int, collector_pattern: str = COLLECTOR) -> DataFrame:
    """All files under a path or glob; one file is one unit of work."""
    files = spark.read.format("binaryFile").load(path)
    return typed_entries(rib_entries(files), family, collector_pattern)


def snap_ts(file):
    """Snapshot time from a name with YYYYMMDD.HHMM or YYYYMMDD-HHMM (UTC)."""
    f = F.col(file) if isinstance(file, str) else file
    name = F.substring_index(f, "/", -1)
    parts = [F.regexp_extract(name, r"(\d{8})[.-](\d{4})", i) for i in (1, 2)]
    return F.try_to_timestamp(F.nullif(F.concat(*parts), F.lit("")), F.lit("yyyyMMddHHmm"))


def latest_snapshot(listing: DataFrame) -> DataFrame:
    """(collector, month, name) -> the last name of the newest month that has files."""
    ok = listing.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return ok.groupBy("collector").agg(F.max(F.struct("month", "name")).alias("m")).select("collector", "m.month", "m.name")
