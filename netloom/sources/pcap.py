"""Classic capture files as a Spark data source, split by record."""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from glob import glob
from itertools import chain, groupby
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..schema import RAW_FRAMES

# The first four bytes of a capture file, its byte order and the
# nanoseconds of a fraction of a second.
MAGICS = {
    b"\xa1\xb2\xc3\xd4": (">", 1000),
    b"\xd4\xc3\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1),
}
NEXT_GENERATION = b"\x0a\x0d\x0d\x0a"
MOST_CAPTURED = 16 << 20
SPLIT_BYTES = 64 << 20
#: Bytes of a file that are read together.
WINDOW = 1 << 20
_NAMES = [x.split()[0] for x in RAW_FRAMES.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


class CaptureError(ValueError):
    """The file is no capture that can be read."""


def read_header(data: bytes) -> tuple[str, int, int]:
    """Byte order, nanoseconds per fraction and link type of a global header."""
    if data[:4] == NEXT_GENERATION:
        raise CaptureError("pcapng captures are not supported")
    if len(data) < 24 or data[:4] not in MAGICS:
        raise CaptureError("no capture file")
    order, unit = MAGICS[data[:4]]
    return order, unit, struct.unpack(order + "I", data[20:24])[0]


def open_file(path: str) -> pa.NativeFile:
    """A capture for random access, by local path or by any URI that Arrow's file systems
    know (``file``, ``hdfs``, ``s3``, ``gs`` …)."""
    system, inside = located(path)
    return system.open_input_file(inside)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def split_records(path: str, size: int, split: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and first packet number of stretches of at least ``split`` bytes. Records have
    no marker to start from, so this follows their lengths from the file's begin; it reads
    headers out of a window and skips what lies beyond it."""
    with open_file(path) as f:
        order, _, _ = read_header(f.read(24))
        length = struct.Struct(order + "i")
        at = start = base = 24
        first = n = 1
        window = b""
        while at + 16 <= size:
            if not base <= at <= base + len(window) - 16:
                f.seek(at)
                base, window = at, f.read(WINDOW)
                if len(window) < 16:
                    break
            (captured,) = length.unpack_from(window, at - base + 8)
            if not 0 <= captured <= MOST_CAPTURED:
                break  # the reading task reports it
            at, n = at + 16 + captured, n + 1
            if at - start >= split:
                yield start, min(at, size), first
                start, first = at, n
        if start < size or size == 24:
            yield start, size, first


def _local(path: str) -> str:
    """A path without scheme and host."""
    scheme = re.match("[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", path)
    return "/" + path[scheme.end() :] if scheme else os.path.abspath(path)


def capture_root(path: str) -> str:
    """The folder below which captures are named: what stands before the first wildcard of a path
    or pattern."""
    local = _local(path)
    fixed = re.split(r"[*?\[{]", local)[0]
    return fixed.rstrip("/") if fixed == local else fixed.rsplit("/", 1)[0]


def capture_name(path: str, root: str) -> str:
    """A capture's id: its file's path below ``root``, so that files of one name in several folders stay
    apart; the file's name where the root is the file itself; else the whole path."""
    local = unquote(_local(path)) if path.startswith("file:") else _local(path)
    if local == root:
        return local.rsplit("/", 1)[-1]
    return local.removeprefix(f"{root}/") if local.startswith(f"{root}/") else path


def read_records(path: str, start: int, end: int, first: int, strict: bool, name: str) -> Iterator[pa.RecordBatch]:
    """The packets of a stretch, as Arrow batches of ``schema.RAW_FRAMES``; ``name`` is the capture's."""
    with open_file(path) as f:
        order, unit, link = read_header(f.read(24))
        head = struct.Struct(order + "IIiI")
        f.seek(start)
        at, index, window, used = start, first, b"", 0
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            stamp, length, original, data = zip(*rows, strict=True)
            columns = [[name] * len(rows), range(index - len(rows), index), stamp, length, original, [link] * len(rows), data]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

        def more(n: int) -> bool:
            nonlocal window, used
            if len(window) - used < n:
                window, used = window[used:] + f.read(max(WINDOW, n)), 0
            return len(window) - used >= n

        while at < end and more(16):
            seconds, fraction, length, original = head.unpack_from(window, used)
            if not 0 <= length <= MOST_CAPTURED:
                raise CaptureError(f"{name}: packet {index} claims {length} bytes")
            if not more(16 + length):
                if strict:
                    raise CaptureError(f"{name}: packet {index} is cut off")
                break
            rows.append((seconds * 1_000_000_000 + fraction * unit, length, original, window[used + 16 : used + 16 + length]))
            at, used, index, held = at + 16 + length, used + 16 + length, index + 1, held + length
            if len(rows) >= 10_000 or held >= WINDOW:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class PcapPartition(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int) -> None:
        self.path, self.start, self.end, self.first = path, start, end, first


#: How a pushed filter bounds a column, ends included.
_BOUNDS = {EqualTo: ">=<", GreaterThan: ">=", GreaterThanOrEqual: ">=", LessThan: "=<", LessThanOrEqual: "=<"}


class PcapReader(DataSourceReader):
    """The source of ``spark.read.format("pcap")``: a task per local file. Options: ``path``
    (file, directory or pattern), ``mode`` (``PERMISSIVE`` ends quietly at a cut-off body,
    ``FAILFAST`` raises), ``maxBytes``, and ``index``, the local folder of an index of the same files
    (``pcap_index.index_captures``), by which files are split. ``read_pcap`` also splits files without one.

    With ``pushFilters`` (and Spark's setting of that name for Python sources), filters on ``capture_id``,
    ``frame_index`` and ``ts_ns`` leave out files and stretches in which no packet can pass; Spark applies them again."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.most = int(options.get("maxbytes", options.get("maxBytes", 0)))
        self.index = options.get("index")
        self.low: dict[str, list] = {}
        self.high: dict[str, list] = {}

    def _may(self, column: str, least, most) -> bool:
        """Whether values from ``least`` to ``most`` (None: unknown) can pass what was pushed."""
        return all(most is None or most >= x for x in self.low.get(column, ())) and all(least is None or least <= x for x in self.high.get(column, ()))

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob(self.path))
        if not files:
            raise CaptureError(f"no file at {self.path}")
        for path in files:
            check_size(path, os.path.getsize(path), self.most)
        known: dict[str, list[dict]] = {}
        for row in pq.read_table(self.index, columns=["path", "start", "end", "first", "length", "modified", "least_ns", "most_ns"]).to_pylist() if self.index else ():
            known.setdefault(unquote(_local(row["path"])), []).append(row)
        root, found = capture_root(self.path), []
        for path in files:
            name, size = capture_name(path, root), os.path.getsize(path)
            own = sorted(known.get(os.path.abspath(path), ()), key=lambda r: r["start"])
            if not own or own[0]["length"] != size or int(own[0]["modified"].timestamp() * 1000) != os.stat(path).st_mtime_ns // 1_000_000:
                own = [{"start": 24, "end": size, "first": 1, "least_ns": None, "most_ns": None}]
            lasts = [*(r["first"] - 1 for r in own[1:]), None]
            for r, last in zip(own, lasts, strict=True):
                if self._may("capture_id", name, name) and self._may("ts_ns", r["least_ns"], r["most_ns"]) and self._may("frame_index", r["first"], last):
                    found.append(PcapPartition(path, r["start"], r["end"], r["first"]))
        return found or [PcapPartition(files[0], 24, 24, 1)]

    def read(self, partition: PcapPartition) -> Iterator[pa.RecordBatch]:
        p = partition
        return read_records(p.path, p.start, p.end, p.first, self.strict, capture_name(p.path, capture_root(self.path)))


class PushedPcapReader(PcapReader):
    """The same with filters, where the option ``pushFilters`` asks for it; Spark refuses such a reader while
    ``spark.sql.python.filterPushdown.enabled`` is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            how = _BOUNDS.get(type(f), "")
            if how and f.attribute in (("capture_id",), ("frame_index",), ("ts_ns",)) and f.value is not None:
                if how[0] == ">":
                    self.low.setdefault(f.attribute[0], []).append(f.value)
                if how[-1] == "<":
                    self.high.setdefault(f.attribute[0], []).append(f.value)
            yield f


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return RAW_FRAMES

    def reader(self, schema) -> DataSourceReader:
        return (PushedPcapReader if self.options.get("pushFilters", "false").lower() == "true" else PcapReader)(self.options)


def check_size(path: str, size: int, most: int) -> None:
    if most and size > most:
        raise CaptureError(f"{path} has {size} bytes, more than {most}")


def read_pcap(spark: SparkSession, path: str, mode: str = "PERMISSIVE", maxBytes: int = 0, splitBytes: int = SPLIT_BYTES) -> DataFrame:
    """Raw packets of the capture files at ``path``, which Spark lists, so that it may be any
    folder or pattern that Spark and Arrow both reach. A capture's id is its file's path below what
    stands before the first wildcard.

    The driver reads no file. Tasks find stretches of about ``splitBytes`` (``stretches.plan_stretches``),
    many of one file at a time; these are dealt out evenly and read by a second stage."""
    from .stretches import plan_stretches

    files = list_captures(spark, path)
    return read_stretches(plan_stretches(files, int(splitBytes), int(maxBytes)), path, mode, int(maxBytes))


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modificationTime`` of files, without their contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def read_stretches(parts: DataFrame, root: str, mode: str = "PERMISSIVE", most: int = 0) -> DataFrame:
    """The raw packets of stretches (``path, start, end, first``)."""
    return stretch_rows(parts, root, mode, most).drop("path", "start")


def stretch_rows(parts: DataFrame, root: str = "/", mode: str = "PERMISSIVE", most: int = 0) -> DataFrame:
    """The same with the ``path`` and ``start`` of each packet's stretch."""
    strict, below = mode.upper() == "FAILFAST", capture_root(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if most:
                    with open_file(file) as f:
                        check_size(file, f.size(), most)
                for found in read_records(file, start, end, first, strict, capture_name(file, below)):
                    place = [pa.repeat(pa.scalar(x, k), found.num_rows) for x, k in ((file, pa.string()), (start, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*found.columns, *place], [*_NAMES, "path", "start"])

    dealt = parts.select("path", "start", "end", "first").repartition(4 * parts.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(read, f"{RAW_FRAMES}, path string, start long")


def write_pcap(raw: DataFrame, folder: str) -> int:
    """Writes captures to ``folder`` (little-endian, microseconds) and returns how many packets.
    Packets are sorted over the cluster and each task writes its stretch of a capture as a
    file of its own, ``<capture>-<first packet>.pcap``, as captures are rotated; a task that
    runs again writes the same files. A capture has one link type."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for capture, packets in groupby(rows, key=lambda r: r[0]):
            first = next(packets)
            system, inside = located(f"{folder}/{capture}-{first[1]:012d}.pcap")
            system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
            count, partial = 0, f"{inside}.{uuid.uuid4().hex}"
            with system.open_output_stream(partial) as f:
                f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 0xFFFF, first[5]))
                for _, _, ts, _, original, _, data in chain([first], packets):
                    seconds, rest = divmod(ts // 1000, 1_000_000)
                    f.write(struct.pack("<IIII", seconds, rest, len(data), original) + data)
                    count += 1
            system.move(partial, inside)
            yield pa.RecordBatch.from_pydict({"packets": [count]})

    rows = raw.select(*_NAMES).repartitionByRange("capture_id", "frame_index").sortWithinPartitions("capture_id", "frame_index")
    return rows.mapInArrow(write, "packets long").agg(F.sum("packets")).first()[0] or 0


def pcap_bytes(raw: DataFrame) -> DataFrame:
    """Each capture as the bytes of a file: ``capture_id, content`` (little-endian,
    microseconds; one link type per capture)."""

    def le(value, n: int):
        text = F.lpad(F.hex(value), 2 * n, "0")
        return F.concat(*[F.unhex(F.substring(text, 2 * i + 1, 2)) for i in reversed(range(n))])

    micros = F.expr("ts_ns div 1000")
    record = F.concat(
        le((micros / 1_000_000).cast("long"), 4), le(micros % 1_000_000, 4), le(F.octet_length("data"), 4), le(F.col("orig_len"), 4), "data"
    )
    head = F.concat(F.unhex(F.lit("D4C3B2A1020004000000000000000000FFFF0000")), le(F.min("link_type"), 4))
    records = raw.withColumn("record", record)
    return records.groupBy("capture_id").agg(
        F.concat(head, F.expr("listagg(record) within group (order by frame_index)")).alias("content")
    )
