"""Importance resampling towards a target corpus over hashed word features."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ranks import positions

#: Hashed features, longest run of words in one, least words of a document that may be drawn.
BUCKETS, LONGEST, LEAST_WORDS = 10_000, 2, 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A to Z in lower case."""
    small = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def bucket_array(own: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ``longest`` words: checksum of its bytes by ``buckets``."""

    def bucket(run: Column) -> Column:
        return (F.crc32(run.cast("binary")) % buckets).cast("int")

    def runs(k: int) -> Column:
        whole = own
        for back in range(1, k):
            tail = F.slice(own, F.lit(back + 1), F.greatest(F.size(own) - back, F.lit(0)))
            # zip_with fills the shorter array with nulls, which concat passes on.
            whole = F.zip_with(whole, tail, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.transform(F.filter(whole, F.isnotnull) if k > 1 else whole, bucket)

    return F.flatten(F.array(*[runs(k) for k in range(1, longest + 1)]))


def bucketed(docs: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, buckets``, one row per row."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), words(docs[text_col]).alias("words"))
    return own.select("doc_id", F.size("words").cast("long").alias("n_words"), bucket_array(F.col("words"), longest, buckets).alias("buckets"))


def totals(rows: DataFrame) -> dict[int, int]:
    """Features in each bucket. Tasks add up first, so at most one row for a bucket and task is
    shuffled, and at most one for a bucket comes to the driver."""
    return dict(map(tuple, rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Log ratio of target to source in each bucket, one added to every count, in thousandths."""
    n, m = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * n / ((source.get(b, 0) + 1) * m))) for b in range(buckets)]


def literal_array(values: list[int]) -> Column:
    """The values as one constant, which the optimiser folds before the query runs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel number in thousandths out of the id alone, so that any task draws alike."""
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(unit))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row. ``weight`` is the floored mean of its
    features' gains, ``score`` that and the row's noise; of the rows with at least
    ``least_words`` words, the ``percent`` with the highest scores are drawn and ranked from 1, ties to the smaller id;
    the others have no rank.

    Higher-order functions turn each text into an array of buckets, which is written once. The
    totals of ``buckets`` buckets are counted over all rows and come to the driver, as many numbers as
    there are buckets; the gains return as a constant array, and each row is scored in place, with no explode and no join.
    Scores are counted by value (a whole number in a range that the gains bound) to find the last
    score drawn; only rows at or above it are sorted, by ``ranks.positions``.

    Null text has no features: weight 0, never drawn. Rows that repeat an id share its noise and
    are drawn one by one; a null id has the noise of an empty one and stands last among equals. Long
    texts are one array. An empty table gives no rows, an empty target gains of the source alone; further columns are ignored.
    """
    rows = materialize(bucketed(docs, id_col, text_col, longest, buckets), "buckets")
    wanted = bucketed(target.select(F.lit(None).alias("doc_id"), target[target_col].alias("text")), "doc_id", "text", longest, buckets)
    gain = literal_array(gains(totals(rows), totals(wanted), buckets))
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    n = F.size("buckets").cast("long").alias("n_features")
    # Whole-number division rounds towards zero; the remainder tells where the floor is one lower.
    weight = F.when(F.col("n_features") > 0, F.expr("total div n_features - CAST(total % n_features < 0 AS BIGINT)")).otherwise(0)
    scored = rows.select("doc_id", "n_words", n, total.alias("total")).withColumn("weight", weight.cast("long"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored.select("doc_id", "n_words", "n_features", "weight", "score"), "scores")
    fit = scored.where(F.col("n_words") >= least_words)
    tally = sorted(map(tuple, fit.groupBy("score").count().collect()), reverse=True)
    drawn = percent * sum(c for _, c in tally) // 100
    last, seen = None, 0
    for score, count in tally:
        if seen >= drawn:
            break
        last, seen = score, seen + count
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    ranked = positions(scored.where(high).select(*columns, F.lit(0).alias("grp")), "grp", [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    ranked = ranked.select(*columns, F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))
