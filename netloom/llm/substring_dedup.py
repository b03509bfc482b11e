"""Repeated word windows: a count-min sketch finds those that may repeat, a second
pass groups exactly those."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BYTE_VALUES, Anchors, Powers, Rolling, find_anchors, mix, segment_hashes, words
from .common import materialize, short_batches, text_blocks
from .repeats import keyed, span, with_ranges

#: Rows of the sketch, and the bounds of a row's cells as powers of two: a merged
#: row is a bit per cell, so at most 2 * 32 MB ever reach the driver or an executor.
DEPTH, LEAST_BITS, MOST_BITS = 2, 16, 28
CHUNK_BITS = 16
#: Classes of one anchor that are dealt to one task.
CLASSES = 1024
#: Hot anchors (twelve bytes each) that are broadcast at most.
MOST_HOT = 1 << 18
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def _cells(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(grams ^ seed) >> np.uint64(64 - bits)).astype(np.int64) for seed in _SEEDS]


def _block_anchors(data: np.ndarray, offsets: np.ndarray, powers: Powers, length: int, gram: int) -> tuple[Rolling, np.ndarray, Anchors]:
    starts, ends, bounds = words(data, offsets)
    rolling = Rolling(Rolling(BYTE_VALUES[data], powers)(starts, ends), powers)
    return rolling, bounds, find_anchors(rolling, bounds, length, gram)


def window_sketch(source: DataFrame, length: int, gram: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged count-min sketch, a bit per cell: counted at least
    twice. A window is counted under its anchor's gram, at least as often as it occurs.
    Each partition emits its sketch sparsely, by chunks of cells; chunks are added up
    where they meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), [[] for _ in range(DEPTH)]
        for _, data, offsets in text_blocks(batches):
            _, _, found = _block_anchors(data, offsets, powers, length, gram)
            for cells, all_ in zip(_cells(found.gram, bits), seen, strict=True):
                all_.append(cells)
        for row, all_ in enumerate(seen):
            cells, times = np.unique(np.concatenate(all_) if all_ else np.zeros(0, np.int64), return_counts=True)
            at = np.flatnonzero(np.diff(cells >> CHUNK_BITS, prepend=-1))
            parts = [
                (np.uint16(c & ((1 << CHUNK_BITS) - 1)).tobytes(), np.minimum(t, 2).astype(np.uint8).tobytes())
                for c, t in zip(np.split(cells, at[1:]), np.split(times, at[1:]), strict=True)
            ]
            if len(cells):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(at), pa.int32()),
                        pa.array((cells[at] >> CHUNK_BITS).astype(np.int32)),
                        pa.array([p[0] for p in parts], pa.binary()),
                        pa.array([p[1] for p in parts], pa.binary()),
                    ],
                    ["row", "chunk", "cells", "times"],
                )

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint16)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8)
        bit = np.packbits(np.bincount(cells, weights=times, minlength=1 << CHUNK_BITS) >= 2)
        return pa.table({"row": [key[0].as_py()], "chunk": [key[1].as_py()], "bits": [bit.tobytes()]}, schema=merged)

    merged = pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())])
    parts = source.mapInArrow(count, "row int, chunk int, cells binary, times binary")
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    size = 1 << (CHUNK_BITS - 3)
    for row, chunk, bit in parts.groupBy("row", "chunk").applyInArrow(merge, "row int, chunk int, bits binary").collect():
        out[row][chunk * size : (chunk + 1) * size] = np.frombuffer(bit, np.uint8)
    return out


def substring_dedup(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed`` and ``kept_text``, the words
    that no window of ``length`` words covers which also starts in a document with a
    smaller id, joined by one space. Words are runs of bytes other than ASCII space.

    1. Each partition counts its windows in a count-min sketch; the merged sketch
       never counts too low. Windows are counted under an anchor, a gram chosen by
       content that equal windows share, which takes one update for about twenty.
    2. A second pass over the texts emits only what the sketch estimates as repeated:
       each anchor's place, and once per block its segment (all its windows) with the
       hashes of the windows. Grouping is exact from here: identical segments become
       one class with its smallest id; where an anchor has several classes, their
       windows are grouped and each gets the smallest id of all. A sketch that
       is too full lets more through, and loses none.
    3. In a document with a class's smallest id, the windows that a smaller id has
       are removed; in its others, the whole segment. Ranges go back to the texts.

    The sketch's width follows the text's size up to 2**28 cells a row, the bound of what is
    broadcast; from there on it fills up, and more is grouped exactly. Hashes
    of a window and its anchor are compared together, 128 bits. Null text counts
    as empty, a null id as the largest. Rows with the same id are one document: they
    never remove each other's words. A text below ``length`` words is kept; an
    empty table gives no rows; further columns are ignored.
    """
    source, gram = short_batches(keyed(docs, id_col, text_col)), max(1, length * 2 // 5)
    if sketch_bits is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        anchors = total / 6 * 2 / (length - gram + 2)
        sketch_bits = min(MOST_BITS, max(LEAST_BITS, ceil(log2(8 * anchors + 1))))
    bits = max(CHUNK_BITS, sketch_bits)
    sketch = source.sparkSession.sparkContext.broadcast(window_sketch(source, length, gram, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in text_blocks(batches):
            rolling, bounds, found = _block_anchors(data, offsets, powers, length, gram)
            often = np.ones(len(found.gram), bool)
            for row, cells in zip(sketch.value, _cells(found.gram, bits), strict=True):
                often &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
            found = Anchors(*(x[often] for x in (found.gram, found.doc, found.at, found.first, found.last)))
            if not len(found.gram):
                continue
            segment, place = segment_hashes(rolling, found, length), batch.column(0).to_numpy()[found.doc]
            by = np.lexsort((place, segment, found.gram))
            new = np.concatenate([[True], (segment[by][1:] != segment[by][:-1]) | (found.gram[by][1:] != found.gram[by][:-1])])
            shown = np.zeros(len(by), bool)
            shown[by[new]] = True  # the segment's smallest id in this block
            hashes = rolling.every(length)
            blobs = [
                hashes[x : y + 1].tobytes() if z else None
                for x, y, z in zip(found.first.tolist(), found.last.tolist(), shown.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.gram.view(np.int64)),
                    pa.array(segment.view(np.int64)),
                    pa.array(place),
                    batch.column(2).take(pa.array(found.doc)),
                    pa.array((found.first - bounds[found.doc]).astype(np.int32)),
                    pa.array((found.last - found.first + 1).astype(np.int32)),
                    pa.array(blobs, pa.binary()),
                ],
                ["a", "s", "place", "version", "first", "windows", "hashes"],
            )

    places = source.mapInArrow(emit, "a long, s long, place long, version long, first int, windows int, hashes binary")
    places = materialize(places, "word-anchors")
    classes = places.where("hashes is not null").groupBy("a", "s", "hashes").agg(F.min("place").alias("least"))
    classes = materialize(classes, "word-classes")
    # An anchor may have very many classes; they are dealt to as many tasks as their number asks for.
    several = classes.groupBy("a").count().where("count > 1").select("a", F.ceil(F.col("count") / CLASSES).cast("int").alias("salts"))
    # Few are that hot; while their list is short it goes to every task, so that no join deals classes by anchor.
    hot = materialize(several.where("salts > 1"), "hot-anchors")
    salted = classes.join(F.broadcast(hot) if hot.count() <= MOST_HOT else hot, "a", "left").withColumn("salt", F.pmod("s", F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    several = several.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    each = F.sequence(F.lit(0), (F.length("hashes") / 8).cast("int") - 1)
    windows = salted.join(several, ["a", "salt"]).select(
        "a", "s", "least", F.posexplode(F.transform(each, lambda i: F.substring("hashes", i * 8 + 1, F.lit(8))))
    )
    smallest = windows.groupBy("a", "col").agg(F.min("least").alias("smallest"))
    earlier = (
        windows.join(smallest, ["a", "col"])
        .where("smallest < least")
        .groupBy("a", "s")
        .agg(F.collect_list("pos").alias("earlier"))
    )
    # Written out, so that the join below has two plain sides and a hot segment's can be split.
    known = materialize(classes.select("a", "s", "least").join(earlier, ["a", "s"], "left"), "word-known")
    own = F.transform(F.coalesce("earlier", F.array().cast("array<int>")), lambda i: span(F.col("first") + i, F.lit(length)))
    whole = F.array(span(F.col("first"), F.col("windows") + length - 1))
    ranges = (
        places.select("a", "s", "place", "version", "first", "windows")
        .join(known, ["a", "s"])
        .select("place", "version", F.when(F.col("place") > F.col("least"), whole).otherwise(own).alias("spans"))
        .where("size(spans) > 0")
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                own_words = text.as_buffer().to_pybytes().split()
                counts.append(len(own_words))
                if spans.is_valid:
                    flat = spans.values
                    change = np.zeros(len(own_words) + 1, np.int64)
                    np.add.at(change, flat.field(0).to_numpy(), 1)
                    np.add.at(change, flat.field(1).to_numpy(), -1)
                    left = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                    own_words = [own_words[i] for i in left]
                removed.append(counts[-1] - len(own_words))
                kept.append(b" ".join(own_words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return with_ranges(source, ranges).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
