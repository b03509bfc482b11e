"""The registered query of each operator: it applies the operator to its whole
table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import (
    language_id,
    license_scan,
    merkle,
    oracles,
    packing,
    pii,
    resampling,
    sentencepiece_codec,
    sharding,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    vector_search,
)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    done = sentencepiece_codec.decode(sentencepiece_codec.encode(documents(spark, sf_dir), model), model)
    same = F.col("decoded") == F.replace("text", F.lit(sentencepiece_codec.SPACE), F.lit(" "))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licences(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentences", ",").alias("sentences"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json")).drop("ids")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(documents(spark, sf_dir))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.BASE),
        F.sha2(pii.listing(base), 256).alias("base_sha256"),
        pii.listing(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(documents(spark, sf_dir), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.coalesce(F.crc32(docs.doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.replace(docs.text, F.lit("\n"), F.lit(""))).otherwise(docs.text)
    found = merkle.manifest(docs, merkle.leaf_hash(*fields, docs.text), carry={"now": merkle.leaf_hash(*fields, text)})
    found = found.withColumn("folded_root", merkle.folded(F.col("now"), F.col("path")))
    proof = merkle.siblings_hash(F.col("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_language_id,
        op3_sentencepiece,
        op4_license_scan,
        op5_packing,
        op6_simhash_dedup,
        op7_vector_search,
        op8_pii,
        op9_exact_dedup,
        op10_suffix_dedup,
        op11_sharding,
        op12_merkle_manifest,
        op13_importance_resampling,
    )
}

ORACLE_SQL = {
    # Every window of 50 words, then every word that one of them covers.
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        n AS (SELECT doc_id, words, len(words) AS n FROM w),
        p AS (SELECT doc_id, words, unnest(range(1, n - 48)) AS k FROM n WHERE n >= 50),
        win AS (SELECT doc_id, k, md5(array_to_string(words[k : k + 49], ' ')) AS h FROM p),
        least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
        covered AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM win JOIN least USING (h) WHERE first < doc_id),
        each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, n + 1)) AS pos FROM n),
        kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
        SELECT n.doc_id, n.n AS n_words, n.n - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)
    """,
    # Every string of 400 bytes, cut out of pieces of its text in hexadecimal, then runs of those that occur again.
    "op10_suffix_dedup": r"""
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, length(h) // 2 AS n, h, unnest(range(0, length(h) // 2 - 399, 400)) AS block FROM b WHERE length(h) >= 800),
        q AS (SELECT doc_id, n, block, substr(h, CAST(2 * block + 1 AS BIGINT), 1598) AS part FROM p),
        r AS (SELECT doc_id, block, part, unnest(range(0, least(400, n - 399 - block))) AS j FROM q),
        win AS (SELECT doc_id, block + j AS k, md5(substr(part, CAST(2 * j + 1 AS BIGINT), 800)) AS m FROM r),
        often AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
        hit AS (SELECT doc_id, k FROM win SEMI JOIN often USING (m)),
        island AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 400 THEN 0 ELSE 1 END AS begins FROM hit),
        numbered AS (SELECT doc_id, k, sum(begins) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM island),
        runs AS (SELECT doc_id, min(k) AS first, max(k) + 400 AS last FROM numbered GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, last, lead(first) OVER (PARTITION BY doc_id ORDER BY first) AS next FROM (SELECT * FROM runs UNION ALL SELECT doc_id, -1, 0 FROM b)),
        kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (coalesce(next, length(h) // 2) - last) AS BIGINT)), '' ORDER BY last) AS h FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
        sums AS (SELECT doc_id, sum(last - first) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
        SELECT b.doc_id, length(b.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
        FROM b JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op9_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), grouped AS (
            SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY norm
        )
        SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
               sha256(n.norm) AS text_sha256
        FROM norm n JOIN grouped g ON n.norm = g.norm
    """,
    "op11_sharding": oracles.SHARDING,
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_importance_resampling": oracles.RESAMPLING,
}
