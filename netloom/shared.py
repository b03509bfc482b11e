"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder in
    local mode, in which there is only one machine; on a cluster, an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("netloom.shared.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="netloom-shared-")
        spark.conf.set("netloom.shared.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: several jobs use it without making it
    anew, and lost executors lose none of it."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
