"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, text_blocks

#: Rows of each language that the filters are fitted on at most (about; chosen by a hash of the id).
TRAIN_ROWS = 20_000
#: Cells of the filter, each with one bit per language, and hash functions.
CELL_BITS, HASHES = 20, 3
#: Languages in one word of a cell; a cell has as many words as the languages need.
WORD_BITS = 62
#: An n-gram belongs to a language if this share of its documents has it, and at least
#: this fraction of the share that any other language has.
LEAST_SHARE, LEAST_RATIO = 0.002, 0.2
GRAM = 4
UNKNOWN = "und"
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Bytes as they count in n-grams: letters as they are (texts are lower-cased before),
#: everything else in ASCII as a space.
LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@dataclass
class LanguageFilter:
    """Languages by frequency and the cells, a row for each WORD_BITS languages: bit
    i % WORD_BITS of row i // WORD_BITS stands for language i."""

    languages: list[str]
    cells: np.ndarray

    def false_positive_rates(self) -> np.ndarray:
        words = np.atleast_2d(self.cells)
        return np.array([np.mean((words[i // WORD_BITS] >> (i % WORD_BITS)) & 1) ** HASHES for i in range(len(self.languages))])


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each document of a block, a space added on either side, and the
    documents' bounds among them. Those of spaces alone are left out."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    lengths = np.diff(offsets)
    at = offsets[:-1] + 2 * np.arange(n) + 1
    inside = np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))
    padded[inside] = LETTERS[data]
    if len(padded) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, GRAM)).view("<u4").ravel()
    bounds = offsets + 2 * np.arange(n + 1)
    owner = np.repeat(np.arange(n), np.diff(bounds))[: len(grams)]
    keep = (np.arange(len(grams)) + GRAM <= bounds[1:][owner]) & (grams != 0x20202020)
    return grams[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))])


def _places(grams: np.ndarray) -> list[np.ndarray]:
    wide = grams.astype(np.uint64)
    return [((wide * seed) >> np.uint64(64 - CELL_BITS)).astype(np.int64) for seed in _SEEDS[:HASHES]]


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quota: int = TRAIN_ROWS
) -> LanguageFilter:
    """Learn from the rows that have an id, a text and a language and are not held out,
    at most about ``quota`` of each language: one with fewer rows is learned from all
    of them, however large the others are. An n-gram counts from its second document
    on, so a language of a single row is not learned. Any number of languages fits.
    Counting and the filter's bits are aggregated by Spark; what reaches the driver is
    the cells, at most 2**CELL_BITS for each WORD_BITS languages."""
    doc_id = docs[id_col]
    rows = docs.where(doc_id.isNotNull() & docs[text_col].isNotNull() & docs[lang_col].isNotNull() & ~held_out(doc_id))
    rows = rows.select(docs[lang_col].alias("lang"), F.lower(docs[text_col]).alias("text"), F.xxhash64(doc_id).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    out = np.zeros((max(1, -(-len(languages) // WORD_BITS)), 1 << CELL_BITS), np.int64)
    if not languages:
        return LanguageFilter([], out)
    bounds = {x: -(1 << 63) + (1 << 64) * quota // n for x, n in sizes.items() if n > quota}
    if bounds:
        bound = F.element_at(F.create_map(*[F.lit(y) for x in bounds.items() for y in x]), F.col("lang"))
        rows = rows.where(F.coalesce(F.col("h") < bound, F.lit(True)))
    numbers = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, 1 << 20):
            grams, bounds = _grams(data, offsets)
            lang = np.array([numbers[x] for x in batch.column(0).to_pylist()], np.uint64)
            owner = np.repeat(np.arange(len(lang), dtype=np.uint64), np.diff(bounds))
            once = np.unique((owner << np.uint64(32)) | grams)
            pair, n = np.unique(
                (lang[(once >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (once & np.uint64(0xFFFFFFFF)), return_counts=True
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array((pair >> np.uint64(32)).astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                ["gram", "lang", "n"],
            )

    fitted = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.element_at(F.array(*[F.lit(1.0 / max(1, fitted.get(x, 0))) for x in languages]), F.col("lang") + 1) * F.col("n")
    grams = short_batches(rows.select("lang", "text")).mapInArrow(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("share", share).where((F.col("share") >= LEAST_SHARE) & (F.col("n") > 1))
    best = grams.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("all"))
    kept = best.select("gram", F.explode(F.filter("all", lambda x: x["share"] >= LEAST_RATIO * F.col("best"))["lang"]).alias("lang"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lang") % WORD_BITS)
    masks = kept.select("gram", F.floor(F.col("lang") / WORD_BITS).cast("int").alias("word"), bit.alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in _places(batch.column(0).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column(1), batch.column(2)], ["cell", "word", "mask"])

    cells = masks.mapInArrow(place, "cell long, word int, mask long")
    table = cells.groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[table.column("word").to_numpy(), table.column("cell").to_numpy()] = table.column("mask").to_numpy()
    return LanguageFilter(languages, out)


def predict(
    docs: DataFrame, fitted: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row, from the whole text alone;
    with ``carry`` also ``row``, a struct of all the row's columns.

    The cells that an n-gram's hashes name are combined by AND: the bits left are
    the languages that contain it, all in one look-up. Per language, the bits over all
    n-grams are counted and corrected for the share of n-grams that a filter of its
    fill answers falsely; the largest corrected share of the text's n-grams decides and
    is the score. Ties, and texts of which no n-gram is known, go to the language with
    more training rows. Null texts and those without a letter are ``und`` with score
    0. Repeated rows and null ids are rows like any other; an empty table gives none;
    without any labelled row every text is ``und``. A text of any length counts as a whole:
    one longer than a block is a block of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    names = fitted.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, false = np.atleast_2d(shared.value.cells), shared.value.false_positive_rates()
        cells = cells.astype(np.uint8) if len(names) <= 8 else cells
        for batch, data, offsets in text_blocks(batches, 1 << 20):
            grams, bounds = _grams(data, offsets)
            places = _places(grams)
            n = np.maximum(np.diff(bounds), 1)
            shares = np.zeros((len(names), len(n)))
            for i in range(len(names)):
                if i % WORD_BITS == 0:
                    masks = np.full(len(grams), -1).astype(cells.dtype)
                    for at in places:
                        masks &= cells[i // WORD_BITS][at]
                total = np.concatenate([[0], np.cumsum((masks >> (i % WORD_BITS)) & 1, dtype=np.int64)])
                hits = (total[bounds[1:]] - total[bounds[:-1]]) / n
                shares[i] = np.clip((hits - false[i]) / max(1e-9, 1 - false[i]), 0, 1)
            best = shares.argmax(axis=0) if names else np.zeros(len(n), int)
            letters = batch.column(2).to_numpy(zero_copy_only=False) & bool(names)
            pred = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters, shares.max(axis=0) if names else 0.0, 0.0)
            names_ = ["doc_id", "held_out", "lang_pred", "score", "row"][: 4 + carry]
            columns = [batch.column(0), batch.column(3), pa.array(pred, pa.string()), pa.array(score), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, names_)

    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(
        docs[id_col].alias("doc_id"), F.lower(text).alias("text"), F.regexp_like(text, F.lit(r"\p{L}")).alias("letters"), held_out(docs[id_col]).alias("held_out"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    )
    out = T.StructType([source.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return short_batches(source).mapInArrow(run, out.add(source.schema["row"]) if carry else out)
