"""An index of captures: for each stretch of a file its times, and a Bloom filter of the addresses and
ports in it, so that a filter reads only the stretches that may hold an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import unsigned
from ..operators.dissect import frames
from ..operators.filters import filter_frames, index_filter
from ..shared import written
from .pcap import SPLIT_BYTES, list_captures, read_stretches, stretch_rows
from .stretches import plan_stretches

#: Bits of one of Spark's bitmaps, bitmaps of a stretch, bits set for each item.
BITMAP, BITMAPS, HASHES = 32_768, 16, 4
_STRETCH = ["path", "start", "end", "first"]


def _places(item: Column) -> Column:
    """The bits of an item, from 1."""
    return F.array(*[F.pmod(F.xxhash64(item, F.lit(i)), F.lit(BITMAP * BITMAPS)) + 1 for i in range(HASHES)])


def may_hold(item: str) -> Column:
    """Whether an indexed stretch may hold ``address <ip>`` or ``port <number>``; false only
    where it does not."""

    def bit(place: Column) -> Column:
        own = F.try_element_at(F.col("bits"), F.bitmap_bucket_number(place))
        at = F.bitmap_bit_position(place)
        byte = unsigned(own, F.floor(at / 8).cast("int"), 1)
        return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    return F.forall(_places(F.lit(item)), bit)


def index_captures(spark: SparkSession, path: str, index: str, splitBytes: int = SPLIT_BYTES) -> None:
    """Writes the index of the captures at ``path`` as Parquet to ``index``: ``path, start, end, first``
    of stretches, the file's ``length`` and ``modified`` when it was indexed, ``least_ns`` and ``most_ns``,
    and ``bits``, at most ``BITMAPS`` bitmaps of 4 kB. Packets are read and dissected once."""
    files = list_captures(spark, path)
    parts = written(plan_stretches(files.select("path", "length"), splitBytes), "stretches")
    found = frames(stretch_rows(parts))
    items = F.array_compact(
        F.array(*[F.concat(F.lit("address "), F.col(c)) for c in ("src_ip", "dst_ip")], *[F.concat(F.lit("port "), F.col(c).cast("string")) for c in ("src_port", "dst_port")])
    )
    own = ["path", "start"]
    seen = found.select(*own, "ts_ns", F.explode_outer(items).alias("item")).groupBy(*own, "item").agg(F.min("ts_ns").alias("least"), F.max("ts_ns").alias("most"))
    seen = written(seen, "items")
    times = seen.groupBy(*own).agg(F.min("least").alias("least_ns"), F.max("most").alias("most_ns"))
    places = seen.where("item IS NOT NULL").select(*own, F.explode(_places(F.col("item"))).alias("place"))
    bitmaps = places.groupBy(*own, F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    bits = bitmaps.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("bits"))
    state = files.select("path", "length", F.col("modificationTime").alias("modified"))
    parts.join(state, "path").join(times, own, "left").join(bits, own, "left").write.mode("overwrite").parquet(index)


def read_indexed(
    spark: SparkSession, path: str, index: str, text: str = "", since_ns: int | None = None, until_ns: int | None = None, splitBytes: int = SPLIT_BYTES
) -> DataFrame:
    """The raw packets of all stretches of the captures at ``path`` that may hold a packet that matches
    ``text`` (an expression of ``operators.filters``) and lies between two times, ends included. The
    index decides by Spark filters, before any capture is opened; other packets of a stretch come along, so
    the filter itself must follow (``search_captures``). Files that the index lacks, or that changed since, are read
    whole."""
    files = list_captures(spark, path)
    table = spark.read.parquet(index)
    known = table.select("path", "length", F.col("modified").alias("modificationTime")).distinct()
    same = ["path", "length", "modificationTime"]
    keep = index_filter(text)
    if since_ns is not None:
        keep &= F.col("most_ns") >= since_ns
    if until_ns is not None:
        keep &= F.col("least_ns") <= until_ns
    fresh = table.join(files.toDF("path", "length", "modified"), ["path", "length", "modified"], "left_semi").where(keep).select(*_STRETCH)
    other = plan_stretches(files.join(known, same, "left_anti").select("path", "length"), splitBytes)
    return read_stretches(fresh.unionByName(other), path)


def search_captures(spark: SparkSession, path: str, index: str, text: str, then: Callable[[DataFrame], DataFrame] = frames) -> DataFrame:
    """The dissected packets at ``path`` that match ``text``, reading only stretches that may
    hold one."""
    return filter_frames(then(read_indexed(spark, path, index, text)), text)
