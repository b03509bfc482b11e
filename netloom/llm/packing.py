"""Packing documents into token sequences along a Hilbert curve."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_blocks

#: Hashed dimensions of a document vector, dimensions of the curve, bits of each.
HASHED, DIMS, BITS = 256, 4, 12
#: White space in one run from which on the faster library would overflow its stack.
LONG_RUN = 10_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Token ids of whole texts by a byte-level BPE tokenizer file.

    A file of the plain kind (ids in merge order) is run by the faster of the two
    installed libraries, which gives the same ids from the same vocabulary; texts that
    contain one of the file's added tokens or a run of white space that is too long for the
    faster one, and files of another kind, by the file's own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        plain = (
            model.get("type") == "BPE"
            and cutter.get("type") == "ByteLevel"
            and not cutter.get("add_prefix_space")
            and cutter.get("use_regex", True)
            and not spec.get("normalizer")
            and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        )
        if not plain:
            return None
        import public_tokenizers
        import tiktoken

        # Printable bytes stand for themselves in the file, the others for 256 and up.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.added}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.fast is None or any(t in text for t in self.added) or (len(text) > LONG_RUN and _RUN.search(text)):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            out.append(np.array(ids, "<u4"))
        return out


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of rows of coordinates below 2**bits (Skilling's transform,
    2004, over whole columns)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_positions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert key of each document of a text block: hashed counts of its 4-byte
    grams, scaled to unit length, are projected by a fixed random matrix to a few
    dimensions and cut into cells."""
    n = len(offsets) - 1
    counts = np.zeros((n, HASHED))
    if len(data) >= 4:
        gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 4)).view("<u4").ravel()
        cell = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % HASHED
        owner = np.repeat(np.arange(n), np.diff(offsets))[: len(gram)]
        inside = np.arange(len(gram)) + 4 <= offsets[1:][owner]
        counts = np.bincount((owner * HASHED + cell)[inside], minlength=n * HASHED).reshape(n, HASHED).astype(np.float64)
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    low = counts @ np.random.default_rng(7).standard_normal((HASHED, DIMS))
    cells = np.clip(((low + 3) / 6 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def on_curve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` (null became empty), ``key``, the place on the curve, and ``version``,
    the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_blocks(batches, 1 << 20):
            keys = pa.array(curve_positions(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, batch.column(2)], ["doc_id", "text", "key", "version"])

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    source = source.withColumn("version", F.xxhash64("text"))
    return short_batches(source).mapInArrow(run, "doc_id long, text string, key long, version long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of all documents in sequences of at most ``length`` tokens:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Documents are range-partitioned and sorted by Hilbert key, then id, then text hash, so
    that neighbours on the curve share sequences, copies (one key) still spread over
    partitions, and a task that runs again cuts alike. Inside a partition they run on without gaps: each sequence but the
    partition's last is full, and what is left there is cut at powers of two, which
    need no padding. Texts are tokenised only after the shuffle, once, in blocks of
    about a megabyte; the keys, which the range sampling computes a second time,
    need no tokens.

    Null text is an empty document: only ``end_id``. Rows with the same id are
    packed one after the other. An empty table gives no rows; further columns are ignored.
    """
    sizes = [1 << b for b in range(length.bit_length() - 1, -1, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        sequence, filled, open_, ready = TaskContext.get().partitionId() << 40, 0, [], []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def piece(doc, start: int, ids: bytes, tokens: int, at: int) -> tuple:
            return doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, at, ids

        for batch, *_ in text_blocks(batches, 1 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                data, start = ids.tobytes() + end, 0
                tokens = len(data) // 4
                while start < tokens:
                    n = min(tokens - start, length - filled)
                    open_.append((doc, start, data[4 * start : 4 * (start + n)], tokens))
                    filled, start = filled + n, start + n
                    if filled == length:
                        at = 0
                        for d, s, x, t in open_:
                            ready.append(piece(d, s, x, t, at))
                            at += len(x) // 4
                        sequence, filled, open_ = sequence + 1, 0, []
                if len(ready) > 2000:
                    yield emit(ready)
                    ready = []
        for size in sizes:  # the rest, cut at powers of two
            if filled & size:
                at = 0
                while at < size:
                    d, s, x, t = open_.pop(0)
                    n = min(len(x) // 4, size - at)
                    ready.append(piece(d, s, x[: 4 * n], t, at))
                    if 4 * n < len(x):
                        open_.insert(0, (d, s + n, x[4 * n :], t))
                    at += n
                sequence += 1
        if ready:
            yield emit(ready)

    placed = on_curve(docs, id_col, text_col).repartitionByRange("key", "doc_id", "version").sortWithinPartitions("key", "doc_id", "version")
    return placed.mapInArrow(run, PIECES)
