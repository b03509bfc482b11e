"""Where the records of capture files begin: found inside any split of a large file by many tasks,
confirmed from the split before, and numbered by a prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .pcap import MOST_CAPTURED, WINDOW, check_size, open_file, read_header, split_records

#: Headers in a row that must be plausible, and the seconds that may lie between two of them.
CHAIN, APART = 16, 86_400
#: Rounds of corrections, after which a file is followed from its begin.
ROUNDS = 8
PLAN = "path string, start long, end long, first long"
_WALKED = "path string, length long, i long, start long, end long, count long, stopped boolean"


class _Headers:
    """Record headers of an open file, read through a window."""

    def __init__(self, path: str, size: int) -> None:
        self.file, self.size = open_file(path), size
        self.order, self.unit, _ = read_header(self.file.read(24))
        self.base, self.window = 0, b""

    def at(self, place: int) -> tuple[int, int, int, int] | None:
        """Seconds, fraction, bytes captured and bytes there were; None behind the last header."""
        if place + 16 > self.size:
            return None
        if not self.base <= place <= self.base + len(self.window) - 16:
            self.base, self.window = place, self.block(place, WINDOW)
        own, kind = place - self.base, f"{self.order}u4"
        return tuple(np.frombuffer(self.window, kind, 4, own).tolist())

    def block(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def plausible(self, head: tuple[int, int, int, int]) -> bool:
        return head[1] < 1_000_000_000 // self.unit and 0 < head[2] <= min(head[3], MOST_CAPTURED)

    def chained(self, place: int) -> bool:
        """Whether plausible records follow each other from here, close in time, up to the file's end
        or for ``CHAIN`` of them."""
        before = None
        for _ in range(CHAIN):
            head = self.at(place)
            if head is None:
                return before is not None and place <= self.size
            if not self.plausible(head) or (before is not None and abs(head[0] - before) > APART):
                return False
            before, place = head[0], place + 16 + head[2]
        return True

    def search(self, low: int, high: int) -> int | None:
        """The first place from ``low`` on, before ``high``, at which a chain begins."""
        for begin in range(low, high, WINDOW):
            data = np.frombuffer(self.block(begin, WINDOW + 15), np.uint8).astype(np.uint32)
            n = min(WINDOW, len(data) - 15, high - begin)
            if n <= 0:
                return None
            shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)

            def word(at: int) -> np.ndarray:
                return sum(data[at + i : at + i + n] << s for i, s in enumerate(shifts))

            captured = word(8)
            likely = (captured > 0) & (captured <= MOST_CAPTURED) & (captured <= word(12)) & (word(4) < 1_000_000_000 // self.unit)
            for place in np.flatnonzero(likely).tolist():
                if self.chained(begin + place):
                    return begin + place
        return None

    def walk(self, start: int, high: int) -> tuple[int, int, bool]:
        """From a record's begin: where the first record from ``high`` on begins, the records before, and
        whether one claims a length that none can have."""
        count = 0
        while start < high and (head := self.at(start)) is not None:
            if head[2] > MOST_CAPTURED:
                return start, count, True
            start, count = start + 16 + head[2], count + 1
        return start, count, False


def _searched(pieces: DataFrame, split: int, most: int) -> DataFrame:
    """Each piece (``path, length, i, start``) walked from ``start``, or, where that is null, from
    where a record is likely to begin."""
    names = [x.split()[0] for x in _WALKED.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length, i, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                check_size(path, length, most)
                headers, high = _Headers(path, length), min((i + 1) * split, length)
                if start is None:
                    start = 24 if i == 0 else headers.search(i * split, high)
                rows.append((path, length, i, start, *(headers.walk(start, high) if start is not None else (None, 0, False))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], names)

    tasks = 4 * pieces.sparkSession.sparkContext.defaultParallelism
    return written(pieces.repartition(tasks, "path", "i").mapInArrow(search, _WALKED), "stretches")


_ARROW = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _followed(files: DataFrame, split: int) -> DataFrame:
    """Stretches of files whose lengths are followed from the begin, one file a task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows := [(path, *part) for part in split_records(path, size, split)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "start", "end", "first"])

    return files.mapInArrow(walk, PLAN)


def plan_stretches(files: DataFrame, split: int, most: int = 0) -> DataFrame:
    """``path, start, end, first`` (the first packet's number) of stretches of about ``split`` bytes of the
    files (``path, length``), each of whole records.

    A file no longer than ``split`` is one stretch, read without being looked at. Of a longer
    one, each split is searched for a chain of plausible record headers and followed to its end, all splits in
    parallel. A split is confirmed where the one before ends just where it begins; a start that
    was guessed wrong, or not at all, is taken from there and followed anew. Packets are
    numbered by the sum of the splits before. So numbers and stretches rest on no guess. The tables
    hold a row for a split and are written to the shared folder; the driver reads counts only.

    After a record with an impossible length nothing is planned; the task that reads it reports it.
    """
    large = files.where(F.col("length") > split)
    small = files.where(F.col("length") <= split).select("path", F.lit(24).cast("long").alias("start"), F.greatest("length", F.lit(25)).alias("end"), F.lit(1).cast("long").alias("first"))
    if large.isEmpty():
        return small
    pieces = large.select("path", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {split}L)")).alias("i"), F.lit(None).cast("long").alias("start"))
    walked = _searched(pieces, split, most)
    order = Window.partitionBy("path").orderBy("i")
    past = order.rowsBetween(Window.unboundedPreceding, -1)

    def judged(walked: DataFrame) -> DataFrame:
        dead = F.coalesce(F.max(F.col("stopped").cast("int")).over(past) == 1, F.lit(False))
        rows = walked.withColumns({"due": F.lag("end").over(order), "dead": dead})
        return rows.withColumn("wrong", (F.col("i") > 0) & ~F.col("dead") & ~F.col("start").eqNullSafe(F.col("due")))

    rows = judged(walked)
    for _ in range(ROUNDS):
        if rows.where("wrong").isEmpty():
            break
        again = rows.where("wrong AND due IS NOT NULL").select("path", "length", "i", F.col("due").alias("start"))
        walked = written(rows.where("NOT wrong OR due IS NULL").select(*walked.columns).unionByName(_searched(again, split, most)), "stretches")
        rows = judged(walked)
    else:
        lost = rows.where("wrong").select("path", "length").distinct()
        small = small.unionByName(_followed(lost, split))
        rows = rows.join(lost, "path", "left_anti")
    first = F.coalesce(F.sum("count").over(past), F.lit(0)) + 1
    found = rows.withColumn("first", first).where("NOT dead AND (count > 0 OR stopped)")
    end = F.when(F.col("stopped"), F.col("end") + 1).otherwise(F.least("end", "length"))
    return small.unionByName(found.select("path", "start", end.alias("end"), "first"))
