"""Live captures of any length: the datagrams of a trigger are parsed in blocks side by side.

``live.parsed_datagrams`` keeps a capture's state in one task, through which all its datagrams go. Here a datagram
is told apart by itself, the last header before a block and the packets counted up to it are merged over
the blocks (one row each), and a trigger ends by writing where each capture stands, for the next one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.headers import NONE, Packets, _coded
from ..shared import written
from ..sources.pcap import MAGICS, MOST_CAPTURED
from .live import PARSED

#: Arrival numbers of a block.
BLOCK = 1 << 14
_HEAD = "struct<big:boolean,unit:int,link:int>"
STANDING = f"capture_id string, head {_HEAD}, next long, skipped long"
_SEEN = "struct<is_head:boolean,big:boolean,unit:int,link:int,fits_little:boolean,fits_big:boolean,raw_ip:boolean>"
_NUMBERS = "struct<ts_ns:bigint,cap_len:int,orig_len:bigint>"


def _swapped(value: np.ndarray) -> np.ndarray:
    return value.astype(np.uint32).byteswap().astype(np.int64)


def _seen(datagram: pa.Array) -> pa.Array:
    """What a datagram tells by itself: a global header, or whether it is a whole record in either byte order."""
    p = Packets(datagram)
    code = np.where(p.size >= 24, _coded(p.read(0, 4), tuple(int.from_bytes(x, "big") for x in MAGICS)), NONE)
    big = np.array([order == ">" for order, _ in MAGICS.values()])[code]
    link, captured, room = p.read(20, 4, code >= 0), p.read(8, 4), np.minimum(p.size - 16, MOST_CAPTURED)
    out = {
        "is_head": code >= 0, "big": big, "unit": np.array([unit for _, unit in MAGICS.values()], np.int32)[code],
        "link": np.where(big, link, _swapped(link)).astype(np.uint32).view(np.int32), "fits_little": (room >= 0) & (_swapped(captured) <= room),
        "fits_big": (room >= 0) & (captured <= room), "raw_ip": np.isin(p.read(16, 1) >> 4, (4, 6)),
    }
    return pa.StructArray.from_arrays([pa.array(x) for x in out.values()], list(out))


def _numbers(datagram: pa.Array, big: pa.Array, unit: pa.Array) -> pa.Array:
    """The numbers of records of known order and unit."""
    p, order = Packets(datagram), big.to_numpy(zero_copy_only=False).astype(bool)
    seconds, parts, captured, length = (np.where(order, x, _swapped(x)) for x in (p.read(4 * i, 4) for i in range(4)))
    ts_ns = seconds * 1_000_000_000 + parts * unit.to_numpy(zero_copy_only=False)
    captured = np.where(captured <= MOST_CAPTURED, captured, 0).astype(np.int32)  # of a malformed one, shown as null
    return pa.StructArray.from_arrays([pa.array(ts_ns), pa.array(captured), pa.array(length)], ["ts_ns", "cap_len", "orig_len"])


def _read(batch: DataFrame) -> DataFrame:
    seen = F.arrow_udf(_seen, _SEEN).asNondeterministic()("datagram")
    rows = batch.withColumn("_seen", seen).select("capture_id", "arrival", "datagram", "_seen.*").withColumn("block", F.expr(f"arrival div {BLOCK}"))
    return rows.withColumn("own", F.when(F.col("is_head"), F.struct("big", "unit", "link")))


def _counted(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """The rows with the header that holds for each (``head``), and packets (``good``) and malformed ones (``bad``) of their block so far."""
    # A header stands before what has the same number, so that every reading counts alike.
    inside = Window.partitionBy("capture_id", "block").orderBy("arrival", F.desc("is_head")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", F.last("own", ignorenulls=True).over(inside)).join(carried, ["capture_id", "block"])
    rows = rows.withColumn("head", F.coalesce("head", "carried"))
    fits = F.when(F.col("head.big"), F.col("fits_big")).otherwise(F.col("fits_little"))
    rows = rows.withColumns({"is_good": ~F.col("is_head") & fits, "is_bad": ~F.col("is_head") & ~fits})
    return rows.withColumns({n: F.sum(F.col(f"is_{n}").cast("long")).over(inside) for n in ("good", "bad")})


def _blocks(rows: DataFrame, before: DataFrame) -> DataFrame:
    """A row per block: the header that holds at its beginning, the next number and the malformed datagrams there,
    and what it adds to them."""
    per = Window.partitionBy("capture_id").orderBy("block")
    ahead = per.rowsBetween(Window.unboundedPreceding, -1)
    found = rows.groupBy("capture_id", "block").agg(F.max_by("own", F.when(F.col("is_head"), F.col("arrival"))).alias("own"), F.min_by("raw_ip", "arrival").alias("raw_ip"))
    guess = F.struct(F.lit(False).alias("big"), F.lit(1000).alias("unit"), F.when(F.first("raw_ip").over(per), 101).otherwise(1).alias("link"))
    found = found.join(before, "capture_id", "left").withColumn("carried", F.coalesce(F.last("own", ignorenulls=True).over(ahead), F.col("head"), guess))
    found = written(found.select("capture_id", "block", "own", "carried", F.coalesce("next", F.lit(1)).alias("next"), F.coalesce("skipped", F.lit(0)).alias("skipped")), "live-blocks")
    sums = _counted(rows, found.select("capture_id", "block", "carried")).groupBy("capture_id", "block").agg(F.max("good").alias("adds"), F.max("bad").alias("fails"))

    def so_far(start: str, part: str) -> Column:
        return F.col(start) + F.coalesce(F.sum(part).over(ahead), F.lit(0))

    return written(found.join(sums, ["capture_id", "block"]).withColumns({"next": so_far("next", "adds"), "skipped": so_far("skipped", "fails")}), "live-blocks")


def _parsed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    carried = blocks.select("capture_id", "block", "carried", "next", "skipped")
    found = _counted(rows, carried).where("NOT is_head")
    found = found.withColumn("n", F.arrow_udf(_numbers, _NUMBERS).asNondeterministic()("datagram", "head.big", "head.unit"))
    size = F.octet_length("datagram")
    good = {
        "frame_index": (F.col("next") + F.col("good") - 1, F.col("skipped") + F.col("bad")), "ts_ns": (F.col("n.ts_ns"), None), "cap_len": (F.col("n.cap_len"), size),
        "orig_len": (F.col("n.orig_len"), size.cast("long")), "link_type": (F.col("head.link"), None), "data": (F.expr("substring(datagram, 17, n.cap_len)"), F.col("datagram")),
    }
    return found.select("capture_id", *[F.when(F.col("is_good"), a).otherwise(b).alias(name) for name, (a, b) in good.items()], F.col("is_bad").alias("malformed"))


def _standing(blocks: DataFrame, before: DataFrame) -> DataFrame:
    """Where each capture stands behind its last block; captures without a datagram stay as they were."""
    last = blocks.groupBy("capture_id").agg(F.max_by(F.struct(F.coalesce("own", "carried").alias("head"), (F.col("next") + F.col("adds")).alias("next"), (F.col("skipped") + F.col("fails")).alias("skipped")), "block").alias("x"))
    return last.select("capture_id", "x.*").unionByName(before.join(last, "capture_id", "left_anti"))


def parse_in_blocks(stream: DataFrame, standing: str, use: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer of a stream of datagrams that gives ``use`` each trigger's rows of ``live.parsed_datagrams`` and the
    trigger's number. They are the same, in any number of tasks. A trigger that failed is done again with its number, so ``use``
    must replace what it wrote under it. ``standing`` is a folder, shared and kept like the query's checkpoint."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STANDING).parquet(f"{standing}/{number - 1}") if number else spark.createDataFrame([], STANDING)
        rows = _read(batch)
        blocks = _blocks(rows, before)
        use(_parsed(rows, blocks).select(*[x.split()[0] for x in PARSED.split(", ")]), number)
        _standing(blocks, before).write.mode("overwrite").parquet(f"{standing}/{number}")

    return stream.writeStream.foreachBatch(run)
