"""Helpers that the corpus operators share: intermediate tables in the
cluster's shared folder, Arrow text blocks, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a task holds.
BLOCK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``. Where that is
    unset, a temporary one in local mode, in which there is only one machine; on a cluster,
    an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("netloom.shared.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="netloom-shared-")
        spark.conf.set("netloom.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors and lets several jobs reuse the result."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table behind a ``materialize``d DataFrame that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``rows`` rows: whole texts are
    long, and a batch lies in the JVM and in the Python worker at once. The session's setting
    stays lowered, because it is read when a query runs, long after it was planned."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def text_blocks(
    batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches (column 1 holds the text, null counts as empty) of
    about ``limit`` bytes with the UTF-8 bytes and the documents' offsets into
    them. A document longer than the limit is a slice of its own."""
    for batch in batches:
        column = batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
        first, n = 0, len(column)
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
            last = min(last, n)
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star
    rounds (Kiveris et al., 2014). ``edges`` has long columns ``a`` and ``b``;
    returns ``node, root`` for each node that has an edge and is not the smallest
    of its component. Every round's edges are written to the shared folder; no
    neighbourhood is ever gathered in one place."""
    stars = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars, old = materialize(low.select("a", F.col("m").alias("b")).unionByName(rest).distinct(), "edges"), stars
        discard(old)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
