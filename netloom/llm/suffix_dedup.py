"""Repeated byte strings by interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import BYTE_VALUES, Powers, Rolling, find_anchors, segment_hashes
from .common import materialize, short_batches, text_blocks
from .repeats import keyed, span, with_ranges

GRAM_SHARE = 0.5
#: Bytes that one transform covers, those that one task transforms, about, and the segments
#: of one anchor from which on its windows are grouped by content over the whole cluster.
TRANSFORM_BYTES, TASK_BYTES = 1 << 20, 2 << 20
HOT_SEGMENTS = 2000
#: Tasks of the transforms at most; beyond that each gets more.
MOST_TASKS = 20_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over the suffixes still tied."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = -1
    tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
    step = 1
    while len(tied):
        own = order[tied]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[tied] = own
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~(first & np.concatenate([first[1:], [True]]))]
        step *= 2
    return order


def common_prefix_classes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each of its rows a class: neighbouring rows are in one
    class if their suffixes share at least ``least`` symbols.

    Boundaries between rows are found by increasing length of the common prefix
    (Beller et al., 2013): an interval of the suffixes that begin with w is extended
    backward by each symbol c before it, on the transform alone; the first interval
    to end at a boundary gives its value. The search stops at ``least``."""
    n = len(symbols)
    order = suffix_array(symbols)
    last = symbols[order - 1]
    mapped = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    mapped[np.argsort(last, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        sizes = high - low
        rows = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        whose = np.repeat(np.arange(len(low)), sizes)
        by = np.argsort(mapped[rows])
        to, symbol, whose = mapped[rows[by]], last[rows[by]], whose[by]
        begins = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (whose[1:] != whose[:-1])])
        at = np.flatnonzero(begins)
        low = to[at]
        high = to[np.concatenate([at[1:], [len(to)]]) - 1] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    return order, np.cumsum(known[:n])


def repeated_starts(segments: list[bytes], windows: np.ndarray, weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` positions start a string of
    ``length`` bytes whose weights, over all segments, sum to two or more."""
    count = len(segments)
    sizes = np.array([len(x) for x in segments])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int(sizes.sum()) + count, np.int64)
    ends = begin + sizes
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[ends] = np.arange(count)  # separators, all different
    symbols[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + count
    symbols = symbols.astype(np.uint16) if count + 256 < 1 << 16 else symbols
    order, classes = common_prefix_classes(symbols, length)
    weight = np.zeros(len(symbols), np.int64)
    for b, w, c in zip(begin, windows, weights, strict=True):
        weight[b : b + w] = c
    total = np.bincount(classes, weights=weight[order])
    repeated = np.empty(len(symbols), bool)
    repeated[order] = total[classes] >= 2
    return [repeated[b : b + w] for b, w in zip(begin, windows, strict=True)]


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans`` and ``kept``, the
    bytes not covered by a string of ``length`` bytes that also starts anywhere else.

    1. Every window of ``length`` bytes is assigned to an anchor chosen by content,
       and each anchor's windows form one segment. Identical segments of an anchor
       are one class with a weight. Anchors that occur once are done, and so are those of
       one class, which repeats as a whole: no two suffixes are left to compare.
    2. One segment of each class of all other anchors is fetched, and those of an anchor
       meet in one Burrows-Wheeler transform, whose intervals are expanded backward,
       breadth first, up to ``length``; a window repeats if its interval holds weight
       two. Only anchors with more than HOT_SEGMENTS classes (passages in very many
       contexts) are grouped by window content with partial aggregation, which is as
       exact and gathers nothing in one task.
    3. A class's ranges go to all places of its segment, and from there to the documents.

    Anchors and segments are compared by 64-bit hashes each, together 128 bits.
    Null text counts as empty; a text below ``length`` bytes is kept. Repeated rows
    are documents of their own, so they remove each other. A null id
    counts as an id of its own. An empty table gives no rows;
    further columns are ignored.
    """
    source = short_batches(keyed(docs, id_col, text_col))
    gram = int(length * GRAM_SHARE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in text_blocks(batches):
            rolling = Rolling(BYTE_VALUES[data], powers)
            found = find_anchors(rolling, offsets, length, gram)
            owner = pa.array(found.doc)
            columns = [
                pa.array(found.gram.view(np.int64)),
                pa.array(segment_hashes(rolling, found, length).view(np.int64)),
                batch.column(0).take(owner),
                batch.column(2).take(owner),
                pa.array((found.first - offsets[found.doc]).astype(np.int32)),
                pa.array((found.last - found.first + 1).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["a", "s", "place", "version", "first", "windows"])

    places = source.mapInArrow(scan, "a long, s long, place long, version long, first int, windows int")
    places = materialize(places, "byte-anchors")
    one = F.min(F.struct("place", "version", "first", "windows")).alias("one")
    classes = places.groupBy("a", "s").agg(F.count("*").alias("weight"), one)
    anchors = classes.groupBy("a").agg(
        F.count("*").alias("segments"), F.sum("weight").alias("total"), F.min("weight").alias("least")
    )
    classes = materialize(classes.join(anchors.where("total > 1"), "a"), "byte-classes")
    wanted = classes.where("segments > 1").select("a", "s", "weight", "segments", "one.*")
    alone = classes.where("segments = 1").select("a", "s", F.array(span(F.lit(0), F.col("one.windows") + length - 1)).alias("spans"))
    cut = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("windows") + length - 1).alias("bytes")
    segments = source.join(wanted, ["place", "version"]).select("a", "s", "weight", "segments", "windows", cut)
    # Repeated rows of one id would fetch a segment twice.
    segments = materialize(segments.dropDuplicates(["a", "s"]), "byte-segments")
    size = segments.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = max(1, ceil(size / max(TASK_BYTES, size / MOST_TASKS)))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            a, s, weight, windows, data = zip(*rows, strict=True)
            masks = repeated_starts(list(data), np.array(windows), np.array(weight), length)
            keep = [i for i in range(len(rows)) if masks[i].any()]
            spans = [
                [{"start": x, "end": y + length - 1} for x, y in zip(*_runs(masks[i]), strict=True)] for i in keep
            ]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([s[i] for i in keep], pa.int64()), pa.array(spans, kind)],
                ["a", "s", "spans"],
            )

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > TRANSFORM_BYTES and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)

    found = (
        segments.where(f"segments <= {HOT_SEGMENTS}")
        .select("a", "s", "weight", "windows", "bytes")
        .repartition(tasks, "a")
        .sortWithinPartitions("a")
        .mapInArrow(expand, "a long, s long, spans array<struct<start:int,end:int>>")
    )
    hot = segments.where(f"segments > {HOT_SEGMENTS}").select(
        "a", "s", "weight", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.md5(F.substring("bytes", i + 1, F.lit(length)))))
    )
    often = hot.groupBy("a", "col").agg(F.sum("weight").alias("n")).where("n > 1")
    hot = hot.join(often, ["a", "col"]).groupBy("a", "s").agg(F.collect_list(span(F.col("pos"), F.lit(length))).alias("spans"))
    # Written out, so that the join below has two plain sides and a hot segment's can be split.
    repeated = materialize(found.unionByName(hot).unionByName(alone), "byte-repeated")
    ranges = places.join(repeated, ["a", "s"]).select(
        "place",
        "version",
        F.transform("spans", lambda x: span(F.col("first") + x["start"], x["end"] - x["start"])).alias("spans"),
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, removed, runs, at, reached = [], 0, 0, 0, -1
                if spans.is_valid:
                    flat = spans.values
                    pairs = sorted(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True))
                    for start, end in pairs:
                        if start > reached:  # touching ranges are one run
                            runs += 1
                            kept.append(data[at:start])
                            at = start
                        if end > at:
                            removed += end - at
                            at = end
                        reached = at
                kept.append(data[at:])
                rows.append((len(data), removed, runs, b"".join(kept)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_ranges(source, ranges).mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
