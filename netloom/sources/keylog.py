"""TLS key logs: ``LABEL CLIENT_RANDOM SECRET`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_keylog(lines: DataFrame) -> DataFrame:
    """``line_no, label, client_random, secret`` of a table ``line_no, value``; ``line_no`` is of any type that has
    an order. Blank lines,
    comments, wrong numbers of tokens, odd or invalid hexadecimal, and randoms
    other than 32 bytes are left out."""
    token = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select("line_no", token.alias("t")).where((F.size("t") == 3) & ~F.startswith(F.col("t")[0], F.lit("#")))

    def hexadecimal(i: int):
        text = F.col("t")[i]
        return F.when(F.length(text) % 2 == 0, F.try_to_binary(text, F.lit("hex")))

    parsed = rows.select("line_no", F.col("t")[0].alias("label"), hexadecimal(1).alias("client_random"), hexadecimal(2).alias("secret"))
    return parsed.where((F.octet_length("client_random") == 32) & F.col("secret").isNotNull())


def latest_secrets(entries: DataFrame) -> DataFrame:
    """The last secret of each random and label."""
    return entries.groupBy("client_random", "label").agg(F.max_by("secret", "line_no").alias("secret"))


def count_sessions(entries: DataFrame) -> DataFrame:
    """How many sessions (client randoms) and secrets a key log names."""
    return latest_secrets(entries).agg(F.count_distinct("client_random").alias("sessions"), F.count("*").alias("secrets"))


def read_keylog(spark: SparkSession, path: str) -> DataFrame:
    """Parsed entries of key-log files. ``line_no`` orders lines: by file path, then by the place in the file, so that
    the last secret is that of the last file that names it."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return parse_keylog(lines.select(F.struct("file_path", "file_block_start", "line").alias("line_no"), "value"))
