"""Running sums, maxima and last values over long ordered groups, cut into blocks.

A window over a whole group is one task's work, however long the group. Here a group is cut into
blocks of packet numbers; blocks are scanned side by side, their totals are merged over the blocks of
a group (one row each), and what the blocks before hold is added to each row. All three
operations are associative, so the answer is that of the whole window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Packet numbers of a block.
BLOCK = 1 << 16


def with_block(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    return rows.withColumn("block", F.expr(f"frame_index div {block}"))


def running(
    rows: DataFrame, by: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
    before: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` (with ``block``) and, over the rows of their values of ``by`` up to each in the order of
    ``frame_index``, the sums (0 for none), maxima and last values that are not null. Names in
    ``before`` leave the row itself out. ``rows`` is read twice: a written table, narrow columns."""
    kinds = [(sums or {}, F.sum), (maxima or {}, F.max), (lasts or {}, lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("frame_index"))))]
    totals = [f(c).alias(f"_{n}") for group, f in kinds for n, c in group.items()]
    per = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_{n}": (F.last(f"_{n}", ignorenulls=True) if n in (lasts or {}) else f(f"_{n}")).over(per) for group, f in kinds for n in group}
    blocks = rows.groupBy(*by, "block").agg(*totals).withColumns(carried)
    inside = Window.partitionBy(*by, "block").orderBy("frame_index")
    upto, ahead = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    local = {n: (F.last(c, ignorenulls=True) if n in (lasts or {}) else f(c)).over(ahead if n in before else upto) for group, f in kinds for n, c in group.items()}
    merged = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in sums or {}}
    merged |= {n: F.greatest(F.col(n), F.col(f"_{n}")) for n in maxima or {}}
    merged |= {n: F.coalesce(F.col(n), F.col(f"_{n}")) for n in lasts or {}}
    found = _joined(rows.withColumns(local), blocks, [*by, "block"])
    return found.withColumns(merged).drop(*carried)


def _joined(rows: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the columns of their block; keys may be null."""
    keys = {c: f"_by_{c}" for c in by}
    blocks = blocks.withColumnsRenamed(keys)
    same = rows[by[0]].eqNullSafe(blocks[keys[by[0]]])
    for c in by[1:]:
        same &= rows[c].eqNullSafe(blocks[keys[c]])
    return rows.join(blocks, same).drop(*keys.values())


def of_group(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """The rows with aggregates of their whole group. They are joined by block, so that no key
    of the join has more rows than a block."""
    blocks = rows.select(*by, "block").distinct()
    whole = _joined(blocks, rows.groupBy(*by).agg(*[c.alias(n) for n, c in values.items()]), by)
    return _joined(rows, whole, [*by, "block"])


def runs(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``run``: how many rows of their group directly before have the same ``value``, across
    blocks. A block counts as one run where all its values are equal, and the run goes on where the
    block before ends with that value."""
    inside = Window.partitionBy(*by, "block").orderBy("frame_index")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = F.coalesce(~F.lag(value).over(inside).eqNullSafe(F.col(value)) | (F.row_number().over(inside) == 1), F.lit(True))
    rows = rows.withColumn("_changed", changed.cast("int")).withColumn("_island", F.sum("_changed").over(upto))
    own = Window.partitionBy(*by, "block", "_island").orderBy("frame_index")
    rows = rows.withColumn("run", F.row_number().over(own) - 1)
    # The last row of a block tells its number of islands and how long the last one is.
    ends = rows.groupBy(*by, "block").agg(
        F.min_by(F.struct(value), "frame_index").alias("_first"), F.max_by(F.struct(value, "_island", "run"), "frame_index").alias("_end")
    )
    order = Window.partitionBy(*by).orderBy("block")
    goes_on = F.coalesce(F.lag(F.col(f"_end.{value}")).over(order).eqNullSafe(F.col(f"_first.{value}")) & F.lag(F.lit(True)).over(order), F.lit(False))
    ends = ends.withColumn("_on", goes_on).withColumn("_break", (~(F.col("_on") & (F.col("_end._island") == 1))).cast("int"))
    ends = ends.withColumn("_group", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = F.sum(F.col("_end.run") + 1).over(Window.partitionBy(*by, "_group").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ends.withColumn("_held", held).withColumn("_carry", F.when(F.col("_on"), F.lag("_held").over(order)).otherwise(0))
    found = _joined(rows, ends.select(*by, "block", "_carry"), [*by, "block"])
    return found.withColumn("run", F.col("run") + F.when(F.col("_island") == 1, F.col("_carry")).otherwise(0)).drop("_changed", "_island", "_carry")
