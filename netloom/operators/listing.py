"""The packet list: its rows and its order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bytes import cut, hex_lower, mostly_text, utf8_text
from .filters import match_filter

KEYS = {"index": "frame_index", "time": "ts_ns", "protocol": "top_protocol", "length": "orig_len", "info": "info"}


def sort_frames(frames: DataFrame, by: str = "time", descending: bool = True) -> DataFrame:
    """Ordered by one of ``KEYS``. Descending is the reverse of the stable ascending order,
    so that ties come with the later packet first."""
    order = [F.col(KEYS[by]), F.col("frame_index")]
    return frames.orderBy(*[c.desc() if descending else c.asc() for c in order])


def list_rows(frames: DataFrame) -> DataFrame:
    """What the list shows: number, seconds since the capture's first packet (four decimals),
    protocol, length, and the info behind the app's name, or a dash."""
    first = frames.groupBy("capture_id").agg(F.min_by("ts_ns", "frame_index").alias("first_ns"))
    # Tenths of a millisecond, rounded half up, in whole numbers.
    ticks = F.floor((F.col("ts_ns") - F.col("first_ns") + 50_000) / 100_000)
    sign, size = F.when(ticks < 0, "-").otherwise(""), F.abs(ticks)
    whole, rest = F.floor(size / 10_000).cast("string"), F.lpad((size % 10_000).cast("string"), 4, "0")
    seconds = F.concat(sign, whole, F.lit("."), rest)
    info = F.when(F.col("info") == "", "—").otherwise(F.col("info"))
    shown = F.when(F.coalesce(F.col("app_name"), F.lit("")) != "", F.concat(F.lit("["), "app_name", F.lit("] "), info)).otherwise(info)
    return frames.join(first, "capture_id").select(
        "capture_id", "frame_index", seconds.alias("time"), "top_protocol", F.col("orig_len").alias("length"), shown.alias("info")
    )


def frame_payload(frames: DataFrame) -> DataFrame:
    """The packets with ``rest``, the bytes behind the last layer (the trailer aside), null where
    there are none, ``rest_text``, the same as text where mostly printable, and
    ``rest_summary``: size, kind and the first fifty characters of the first line."""
    begins = f"""CASE WHEN l7 = '{C.TLS}' THEN payload_at + 5 + tls_length WHEN l7 IS NOT NULL OR l4 IN ('{C.ICMP}', '{C.ICMPV6}') THEN size
        WHEN l4 IS NOT NULL THEN coalesce(payload_at, size) WHEN l3 IS NOT NULL THEN IF(l3_ok, l4_at, size)
        WHEN l2 IS NOT NULL THEN IF(l2_truncated, size, l3_at) END"""
    rows = frames.withColumn("rest", F.expr(f"IF({begins} < size, substring(data, {begins} + 1, CAST(size - {begins} AS INT)), NULL)"))
    rows = rows.withColumn("rest_text", F.when(mostly_text(F.col("rest")), utf8_text(F.col("rest"))))
    pairs = F.rtrim(F.regexp_replace(hex_lower(cut(F.col("rest"), 0, 17)), "(..)", "$1 "))
    first = F.left(F.regexp_substr(F.col("rest_text"), F.lit("^[^\r\n]*")), F.lit(50))
    size = F.octet_length("rest")
    summary = F.concat(
        size.cast("string"), F.when(size == 1, " byte · ").otherwise(" bytes · "), F.when(F.col("rest_text").isNotNull(), "UTF-8 · ").otherwise("binary · "),
        F.coalesce(first, F.left(pairs, F.lit(50))),
    )
    return rows.withColumn("rest_summary", summary)


def counted(frames: DataFrame, text: str) -> DataFrame:
    """``shown`` and ``total``: how many packets a filter leaves of each capture."""
    return frames.groupBy("capture_id").agg(F.count_if(match_filter(text)).alias("shown"), F.count("*").alias("total"))
