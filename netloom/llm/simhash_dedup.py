"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, short_batches

#: Variants that one bucket should hold on average, and that a task sorts at once.
BUCKET_VARIANTS = 1 << 20
SORT_VARIANTS = 1 << 22


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: a bit is set if it is set in over half the XXH64 (seed 42) of the
    text's word shingles. No word: 0; fewer words than a shingle: one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    parts = map(joined.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def text_version(text: Column) -> Column:
    """The text's hash; with the id it names a row even where the id is null or repeats."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) and ``version``, the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "version"])

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), text_version(docs[text_col]).alias("version"))
    return short_batches(source).mapInArrow(run, "doc_id long, fp long, version long")


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks over ``bits`` low bits with at most ``most`` bits set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _link(fps: np.ndarray, flipped: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that share a variant. All fingerprints lie in one bucket
    after ``flipped`` bits of the bucket's prefix; up to ``half - flipped`` of their
    low ``bits`` may still change. Too many variants are split by further bits."""
    size = sum(int(np.count_nonzero(flipped == d)) * sum(comb(bits, k) for k in range(half - d + 1)) for d in range(half + 1))
    if size > SORT_VARIANTS and bits > 8:
        step, a, b = 6, [], []
        low = np.uint64((1 << (bits - step)) - 1)
        head = (fps >> np.uint64(bits - step)) & np.uint64((1 << step) - 1)
        for part in range(1 << step):
            more = flipped + np.bitwise_count(head ^ np.uint64(part)).astype(flipped.dtype)
            own = np.flatnonzero(more <= half)
            if len(own) > 1:
                x, y = _link(fps[own] & low, more[own], bits - step, half)
                a.append(own[x])
                b.append(own[y])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
    values, owners = [], []
    for d in range(half + 1):
        own = np.flatnonzero(flipped == d)
        masks = _flips(bits, half - d)
        values.append((fps[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    same = np.flatnonzero(values[1:] == values[:-1]) + 1
    if not len(same):
        return (np.zeros(0, np.int64),) * 2
    pairs = np.unique(owners[same - 1] * len(fps) + owners[same])
    return pairs // len(fps), pairs % len(fps)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position is connected to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` that connect exactly the distinct fingerprints (column
    ``fp``) which a chain of steps of at most ``radius`` bits connects.

    Each fingerprint stands for all its variants within half the radius; two
    within the radius share one in the middle. Variants are shuffled by their
    first bits: a fingerprint is sent once to each prefix that its variants have,
    with the flips spent on the prefix, and the variants of the other bits are
    spread out and sorted inside the bucket. The prefix grows with the number of
    fingerprints, so that a bucket holds about BUCKET_VARIANTS; a denser bucket is
    worked off in parts. Colliding pairs are verified and each bucket returns
    a spanning forest, never all pairs of a group."""
    half, n = ceil(radius / 2), distinct.count()
    bits = min(24, max(4, ceil(log2(max(1, n * sum(comb(64, k) for k in range(half + 1)) / BUCKET_VARIANTS)))))
    low = 64 - bits
    masks = [(int(m), int(m).bit_count()) for m in _flips(bits, half)]
    spread = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).cast("byte").alias("k")) for m, k in masks]))
    sent = distinct.select("fp", spread.alias("x")).select(
        F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("x.m")).alias("bucket"), "fp", F.col("x.k").alias("flipped")
    )

    def link(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        flipped = table.column("flipped").to_numpy().astype(np.int64)
        a, b = _link(fps & np.uint64((1 << low) - 1), flipped, low, half)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        root = _forest(len(fps), a[near], b[near])
        own = np.flatnonzero(root != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.table({"a": signed[own], "b": signed[root[own]]})

    return sent.groupBy("bucket").applyInArrow(link, "a long, b long")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, carry: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest id reachable over links of at most ``radius``
    differing bits; with ``carry`` also ``version``, the text's hash, and ``root``, one
    number per component.

    Null and empty texts have fingerprint zero and are linked like any other.
    Copies share a fingerprint and count once in the search. A null id never
    becomes a component id unless its component has no other. Repeated rows give
    repeated rows; an empty table gives none; further columns are ignored. A text of any
    length is read as a whole; its shingles are counted in parts of bounded size.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct, radius))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.join(component, "root").select("fp", "component_id", "root")
    return fps.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["version", "root"] if carry else [])
    )
