"""RIB dumps as a Spark data source: a plain file in byte ranges, a compressed one as a stream, both families in one pass.

``read_rib(spark, path)`` takes a file or folder (or a comma-separated list) of any file system that pyarrow opens. Rows have the columns of ``rib.SCHEMA``; an equality filter on
``family`` skips the records of the other one before their attributes are decoded.

A range begins at the first place from which a chain of records leads on. Each range also checks that the border at which
it ends is the one that its successor finds, so a place that only looks like a border is an error, never a wrong result.
"""

from __future__ import annotations

import bz2
import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from .rib import _BATCH, PEER_INDEX, RIB_SUBTYPES, SCHEMA, TABLE_DUMP_V2, _batch, _peers, rib_rows

RANGE_BYTES = 64 << 20
KINDS = (11, 12, TABLE_DUMP_V2, 16, 17, 32, 33, 48, 49)  # fixed values: record types of the format
CHAIN = 4  # records that must follow one another from a border
WINDOW = 4 << 20  # bytes searched for a border at once; a chain of records is shorter


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None  # None: a compressed file, read whole


def _filesystem(path: str):
    from pyarrow import fs
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def _packed(path: str) -> bool:
    return path.endswith((".gz", ".bz2"))


def _size(raw: bytes, at: int) -> int | None:
    """Bytes of the body whose header stands at a place, None if none does."""
    kind, subtype, size = struct.unpack_from(">HHI", raw, at + 4)
    known = subtype in RIB_SUBTYPES or subtype == PEER_INDEX if kind == TABLE_DUMP_V2 else kind in KINDS
    return size if known else None


def border(file, start: int, size: int) -> int:
    """The first table record at or after ``start`` from which CHAIN records (or the file's last ones) follow one another."""
    if start <= 0:
        return 0
    while start < size:
        file.seek(start)
        raw = file.read(WINDOW)
        last = start + len(raw) >= size
        mark = struct.pack(">H", TABLE_DUMP_V2)
        at = raw.find(mark, 4)
        while at >= 0:
            place, good = at - 4, 0
            while good < CHAIN and place + 12 <= len(raw):
                body = _size(raw, place)
                if body is None:
                    break
                place, good = place + 12 + body, good + 1
            if good == CHAIN or (good and last and place == len(raw)):
                return start + at - 4
            at = raw.find(mark, at + 1)
        if last:
            break
        start += WINDOW // 2
    return size


class RibReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.family = int(options["family"]) if "family" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("family",) and self.family in (None, f.value):
                self.family = f.value
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        from pyarrow import fs
        out = []
        for path in self.paths:
            files, place = _filesystem(path)
            found = files.get_file_info(place)
            if found.type == fs.FileType.Directory:
                found = [i for i in files.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File]
            else:
                found = [found]
            prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
            for info in found:
                name = prefix + info.path
                if info.base_name.startswith(("_", ".")) or not info.size:
                    continue
                if _packed(name):
                    out.append(Stretch(name, 0, None))
                else:
                    out += [Stretch(name, a, min(a + self.range_bytes, info.size)) for a in range(0, info.size, self.range_bytes)]
        return out

    def read(self, partition: Stretch):
        files, place = _filesystem(partition.path)
        rows = []
        for row in self._whole(files, place) if partition.end is None else self._stretch(files, place, partition):
            rows.append((partition.path, *row))
            if len(rows) >= _BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _whole(self, files, place: str) -> Iterator[tuple]:
        with files.open_input_stream(place, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if place.endswith(".gz") else bz2.BZ2File(raw)
            peers = []
            while record := _next(stream):
                subtype, body = record
                if subtype == PEER_INDEX:
                    peers = _peers(memoryview(body))
                elif self._wanted(subtype):
                    yield from rib_rows(subtype, memoryview(body), peers)

    def _stretch(self, files, place: str, part: Stretch) -> Iterator[tuple]:
        with files.open_input_file(place) as file:
            size = file.size()
            peers = []
            while not peers and (record := _next(file)):  # the peers come first in the file
                if record[0] == PEER_INDEX:
                    peers = _peers(memoryview(record[1]))
            at = border(file, part.start, size)
            if at >= part.end:
                return
            file.seek(at)
            while at < part.end and (record := _next(file)):
                subtype, body = record
                at = file.tell()
                if self._wanted(subtype):
                    yield from rib_rows(subtype, memoryview(body), peers)
            while part.end <= at < size and (record := _next(file)) and record[0] < 0:
                at = file.tell()
            if part.end <= at < size and border(file, part.end, size) != at:
                raise ValueError(f"{part.path}: no clear record border after byte {part.end}; read it with a larger rangeBytes")

    def _wanted(self, subtype: int) -> bool:
        return subtype in RIB_SUBTYPES and self.family in (None, RIB_SUBTYPES[subtype][0])


def _next(stream) -> tuple[int, bytes] | None:
    """(subtype, body) of the next record (-1 for one of another kind); None at the end, also of a cut-off file."""
    try:
        head = stream.read(12)
        if len(head) < 12:
            return None
        kind, subtype, size = struct.unpack(">4xHHI", head)
        body = stream.read(size)
    except (EOFError, OSError):
        return None
    return (subtype if kind == TABLE_DUMP_V2 else -1, body) if len(body) == size else None


class RibSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rib_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RibReader:
        return RibReader(self.options)


def read_rib(spark: SparkSession, path: str, **options) -> DataFrame:
    """All entries under a path through ``RibSource``; switches on the pushdown of filters to Python sources, which it needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RibSource)
    return spark.read.format("rib_dump").options(**options).load(path)
