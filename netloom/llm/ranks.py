"""Positions of rows in an order, over whole tables and without a window over one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def positions(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, a row's place (from 0) among those with its value of ``group``
    (null is a value) by ``order``, and ``n``, how many there are. The columns are the caller's
    own; names that begin with an underscore are taken.

    The rows are range-partitioned by group, order and, so that repeated rows spread too, their
    place in a written table; each partition counts its rows per group, and a row's place is
    what the partitions before hold and its place inside. The only window goes over these
    counts, one row for a group and partition. An empty table gives no rows.
    """
    tied = materialize(rows.withColumn("_tie", F.monotonically_increasing_id()), "ties")
    keys = [F.col(group).asc_nulls_first(), *order, F.col("_tie").asc()]
    sorted_ = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # The id holds the partition's number above bit 33 and the place in it below.
    placed = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    whole = Window.partitionBy("_group")
    before = F.sum("_own").over(whole.orderBy("_part")) - F.col("_own")
    offsets = counts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_own").over(whole).alias("n"))
    found = placed.join(offsets, placed[group].eqNullSafe(offsets["_group"]) & (part == offsets["_part"]))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")
