"""Places of rows in an order, over whole tables, without a window over one value or capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .listing import KEYS


def placed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 0) among those with their values of ``by``, by ``order``,
    which must tell all rows apart. Names that begin with an underscore are taken.

    Range partitions are sorted and written, each counts its rows, and a row's place is
    what the partitions before hold and its own place there. The one window goes over these
    counts: a row for a partition and value of ``by``. ``rows`` should be a written table, because
    finding the ranges reads it a second time."""
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id holds the partition's number above bit 33 and the place in it below.
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    names = [f"_by{i}" for i in range(len(by))]
    counts = ordered.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(*names).orderBy("_part")) - F.col("_own")
    shifts = counts.select(*names, "_part", (before - F.col("_first")).alias("_shift"))
    same = part == shifts["_part"]
    for c, n in zip(by, names, strict=True):
        same &= ordered[c].eqNullSafe(shifts[n])
    return ordered.join(shifts, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"))


def ranked_frames(frames: DataFrame, by: str = "time", descending: bool = True) -> DataFrame:
    """The packet list in one of its orders (``listing.KEYS``) as a table: ``rank`` from 1 in each
    capture. Descending is the reverse of the stable ascending order, so that ties come with the later
    packet first. Not lazy: the list's columns are written once, so that packets are dissected once."""
    rows = written(frames.select("capture_id", "frame_index", *[c for c in KEYS.values() if c != "frame_index"]), "list")
    order = [F.col(KEYS[by]), F.col("frame_index")]
    found = placed(rows, ["capture_id"], [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in order])
    return found.withColumn("rank", F.col("place") + 1).drop("place")
