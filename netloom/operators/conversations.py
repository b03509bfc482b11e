"""Conversations: traffic between two endpoints of one transport protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

KEY = ["capture_id", "l4", "ip_a", "port_a", "ip_b", "port_b"]
#: What this module reads of a packet, beside its capture and number.
READ = ["l4", "src_ip", "src_port", "dst_ip", "dst_port", "orig_len", "ts_ns", "app_name"]


def with_endpoints(frames: DataFrame) -> DataFrame:
    """TCP and UDP packets with both endpoints, the smaller (address as text, then port)
    as ``a``; ``from_a`` says who sent."""
    both = frames.where(F.col("l4").isin(C.TCP, C.UDP) & F.col("src_ip").isNotNull() & F.col("src_port").isNotNull())
    from_a = F.struct("src_ip", "src_port") <= F.struct("dst_ip", "dst_port")

    def side(mine: str, other: str) -> Column:
        return F.when(F.col("from_a"), F.col(mine)).otherwise(F.col(other))

    return both.withColumn("from_a", from_a).withColumns(
        {
            "ip_a": side("src_ip", "dst_ip"),
            "port_a": side("src_port", "dst_port"),
            "ip_b": side("dst_ip", "src_ip"),
            "port_b": side("dst_port", "src_port"),
        }
    )


def conversations(frames: DataFrame) -> DataFrame:
    """A row per conversation: packets, bytes, first and last packet, the first app
    named. One shuffle of partial sums; a hot conversation costs no more than another."""
    app = F.struct("frame_index", "app_name")
    named = F.when(F.coalesce(F.col("app_name"), F.lit("")) != "", app)
    return (
        with_endpoints(frames)
        .groupBy(KEY)
        .agg(
            F.count("*").alias("packets"),
            F.sum("orig_len").alias("bytes"),
            F.min("frame_index").alias("first_frame"),
            F.max("frame_index").alias("last_frame"),
            F.min(named)["app_name"].alias("app_name"),
        )
    )


def conversation_stats(frames: DataFrame) -> DataFrame:
    """Packets and bytes each way and the time between the first and last packet."""
    sent = F.col("from_a")
    return (
        with_endpoints(frames)
        .groupBy(KEY)
        .agg(
            F.count_if(sent).alias("packets_ab"),
            F.count_if(~sent).alias("packets_ba"),
            F.sum(F.when(sent, F.col("orig_len")).otherwise(0)).alias("bytes_ab"),
            F.sum(F.when(~sent, F.col("orig_len")).otherwise(0)).alias("bytes_ba"),
            (F.max("ts_ns") - F.min("ts_ns")).alias("duration_ns"),
        )
    )


def conversation_frames(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """The packets of the conversations in ``chosen`` (columns ``KEY``)."""
    return with_endpoints(frames).join(chosen.select(KEY).distinct(), KEY, "left_semi")


def protocol_histogram(frames: DataFrame) -> DataFrame:
    """How many packets have each protocol among their layers."""
    return frames.select(F.explode(F.array_distinct("protocols")).alias("protocol")).groupBy("protocol").agg(F.count("*").alias("packets"))
