"""What both repeated-window operators share: row keys, and covered ranges
gathered per document and joined to the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a null id counts as.
LARGEST_ID = (1 << 63) - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``place`` (the id; null counts as the largest), ``text`` (null became empty),
    ``version``, the text's hash, and ``doc_id``. Place and version together name a row
    even where an id repeats."""
    text, own = F.coalesce(docs[text_col], F.lit("")), docs[id_col].cast("long")
    return docs.select(
        F.coalesce(own, F.lit(LARGEST_ID)).alias("place"), text.alias("text"), F.xxhash64(text).alias("version"), own.alias("doc_id")
    )


def with_ranges(source: DataFrame, ranges: DataFrame) -> DataFrame:
    """The source's rows with ``spans``, an array of the (start, end) that ``ranges``
    (``place, version, spans``: arrays) has for them. Rows that repeat an id and text send the
    same arrays, of which a set keeps one, in each task before anything is shuffled; so a list is bounded by
    the document's own length however often the row repeats."""
    gathered = ranges.groupBy("place", "version").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
    return source.join(gathered, ["place", "version"], "left").select("doc_id", "text", "spans")


def span(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + length).cast("int").alias("end"))
