"""A corpus cleaned and packed in five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import exact_dedup as exact
from netloom.llm import language_id, packing, pii
from netloom.llm.common import materialize
from netloom.llm.queries import tokenizer_file
from netloom.llm.repeats import LARGEST_ID
from netloom.llm.simhash_dedup import simhash_dedup, text_version


def _place(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LARGEST_ID))


def _one_of_each(docs: DataFrame, keys: list[Column], kept: DataFrame) -> DataFrame:
    """Of the rows whose ``keys`` are among the rows of ``kept``, one for each, with their own
    columns, whatever those are called."""
    names = [f"_{uuid.uuid4().hex}" for _ in keys]
    found = docs.withColumns(dict(zip(names, keys, strict=True))).join(kept.toDF(*names), names, "left_semi")
    return found.dropDuplicates(names).drop(*names)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised stay; those without a letter go."""
    found = language_id.predict(docs, language_id.fit(docs), carry=True)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays; of rows that repeat one id and
    text, one."""
    kept = exact.exact_dedup(docs).where("kept").select(_place(F.col("doc_id")), "text_sha256").distinct()
    return _one_of_each(docs, [_place(docs.doc_id), F.sha2(exact.normalised(docs.text), 256)], kept)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, that with the smallest id: a null
    id counts as the largest, and of rows with one id the smallest text hash decides."""
    groups = simhash_dedup(docs, carry=True)
    least = F.min(F.struct(_place(F.col("doc_id")).alias("place"), "version")).alias("least")
    kept = groups.groupBy("root").agg(least).select("least.*")
    return _one_of_each(docs, [_place(docs.doc_id), text_version(docs.text)], kept)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by ``<KIND>``; ``n_chars`` follows the text."""
    found = docs.withColumn("text", pii.redacted(docs.text, pii.pii_spans(docs.text)))
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens along the curve."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Fingerprints, learned languages and token ids are beyond SQL; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
