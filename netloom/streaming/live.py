"""Live captures: datagrams spooled to files, parsed with state per capture.

A socket cannot be read again, so a receiver writes each datagram to the spool first
(columns ``capture_id, arrival, datagram``); the stream reads the spool and can replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from threading import Event, Thread
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.dissect import frames
from ..schema import RAW_FRAMES
from ..shared import shared_path
from ..sources.pcap import MAGICS, MOST_CAPTURED, located
from .spool import SPOOL, receive

STATE = "order string, unit int, link int, next long, skipped long"


def parse_datagram(data: bytes, state: tuple | None) -> tuple[tuple | None, tuple | None]:
    """The new state (byte order, nanoseconds per fraction, link type, next number, skipped)
    and the packet, if the datagram holds one. The first is a global header; where it was
    missed, little-endian microseconds are assumed and the link type is guessed from the
    first byte of the packet. A header that comes later starts anew."""
    if len(data) >= 24 and data[:4] in MAGICS:
        order, unit = MAGICS[data[:4]]
        kind = int.from_bytes(data[20:24], "big" if order == ">" else "little")
        return (order, unit, kind, state[3] if state else 1, state[4] if state else 0), None
    if state is None:
        raw_ip = len(data) > 16 and data[16] >> 4 in (4, 6)
        state = ("<", 1000, 101 if raw_ip else 1, 1, 0)
    order, unit, kind, index, skipped = state
    end = "big" if order == ">" else "little"
    head = [int.from_bytes(data[i : i + 4], end) for i in range(0, 16, 4)]
    if len(data) < 16 or head[2] > min(MOST_CAPTURED, len(data) - 16):
        return (order, unit, kind, index, skipped + 1), None
    packet = (index, head[0] * 1_000_000_000 + head[1] * unit, head[2], head[3], kind, data[16 : 16 + head[2]])
    return (order, unit, kind, index + 1, skipped), packet


PARSED = f"{RAW_FRAMES}, malformed boolean"


def _parse(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values("arrival")
    out, skipped = [], now[4] if now else 0
    for datagram in map(bytes, rows["datagram"]):
        now, packet = parse_datagram(datagram, now)
        if packet:
            out.append((key[0], *packet, False))
        elif now[4] > skipped:
            skipped = now[4]
            out.append((key[0], skipped, None, len(datagram), len(datagram), None, datagram, True))
    state.update(now)
    yield pd.DataFrame(out, columns=[x.split()[0] for x in PARSED.split(", ")])


def parsed_datagrams(stream: DataFrame) -> DataFrame:
    """The packets of a stream of datagrams, in order of arrival within each capture, and, with
    ``malformed``, the datagrams that hold none, numbered for themselves."""
    return stream.groupBy("capture_id").applyInPandasWithState(_parse, PARSED, STATE, "append", "NoTimeout")


def raw_from_datagrams(stream: DataFrame) -> DataFrame:
    """Raw packets of a stream of datagrams; malformed ones are left to
    ``parsed_datagrams``."""
    return parsed_datagrams(stream).where("not malformed").drop("malformed")


def read_spool(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """The spool as a stream, at most ``files`` of its files a trigger."""
    return spark.readStream.schema(SPOOL).option("maxFilesPerTrigger", files).parquet(path)


def live_frames(spark: SparkSession, path: str) -> DataFrame:
    """A streaming DataFrame of dissected packets. As with any live capture there is
    dissection only: no analysis of sessions, no decryption."""
    return frames(raw_from_datagrams(read_spool(spark, path)))


class Progress(StreamingQueryListener):
    """Calls ``tell`` with the number of datagrams read so far, at the first and whenever
    another ``step`` are complete."""

    def __init__(self, tell: Callable[[int], None], step: int = 32) -> None:
        self.tell, self.step, self.count = tell, step, 0

    def onQueryStarted(self, event: Any) -> None:
        self.count = 0

    def onQueryProgress(self, event: Any) -> None:
        before, self.count = self.count, self.count + max(0, event.progress.numInputRows)
        if self.count and (before == 0 or before // self.step < self.count // self.step):
            self.tell(self.count)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass


class LiveCapture:
    """A port and the query over its packets, one at a time: ``start`` ends what ran before and
    begins with an empty spool of its own; ``stop`` lets the query read what has come."""

    def __init__(self, spark: SparkSession, port: int, host: str = "0.0.0.0") -> None:
        self.spark, self.port, self.host = spark, port, host
        self.query = self.thread = None

    def start(self, use: Callable[[DataFrame], Any]) -> str:
        """``use`` starts a query on the packets and returns it. Returns the spool's folder."""
        self.stop()
        self.spool, self.over = shared_path(self.spark, "live-spool"), Event()
        system, inside = located(self.spool)
        system.create_dir(inside, recursive=True)
        self.thread = Thread(target=receive, args=(self.spool, self.port, self.host), kwargs={"stop": self.over, "patience": 0.2}, daemon=True)
        self.thread.start()
        self.query = use(live_frames(self.spark, self.spool))
        return self.spool

    def stop(self) -> None:
        if self.thread:
            self.over.set()
            self.thread.join()
        if self.query:
            self.query.processAllAvailable()
            self.query.stop()
        self.query = self.thread = None


def _record_heads(*numbers: pa.Array) -> pa.Array:
    held = np.stack([x.to_numpy(zero_copy_only=False) for x in numbers], axis=1).astype("<u4")
    return pa.Array.from_buffers(pa.binary(16), len(held), [None, pa.py_buffer(held.tobytes())]).cast(pa.binary())


def spool_table(raw: DataFrame) -> DataFrame:
    """The datagrams a sender would emit for raw packets: one header per capture, then a
    packet in each."""

    def le(value, n: int):
        text = F.lpad(F.hex(value), 2 * n, "0")
        return F.concat(*[F.unhex(F.substring(text, 2 * i + 1, 2)) for i in reversed(range(n))])

    head = F.concat(F.unhex(F.lit("D4C3B2A1020004000000000000000000FFFF0000")), le(F.first("link_type"), 4))
    headers = raw.groupBy("capture_id").agg(F.lit(0).cast("long").alias("arrival"), head.alias("datagram"))
    numbers = ("ts_ns div 1000000000", "ts_ns div 1000 % 1000000", "CAST(octet_length(data) AS BIGINT)", "orig_len")
    record = F.concat(F.arrow_udf(_record_heads, "binary")(*map(F.expr, numbers)), "data")
    return headers.unionByName(raw.select("capture_id", F.col("frame_index").alias("arrival"), record.alias("datagram")))


def traffic_windows(packets: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes per protocol and window of event time, with a watermark."""
    return (
        packets.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "top_protocol")
        .agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"))
        .select(F.col("window.start").alias("start"), "top_protocol", "packets", "bytes")
    )
