"""Shards of nearly equal bytes by histogram sort."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, short_batches

#: Bytes of a key: text hash (16), id hash (8), place in the written table (8).
KEY_BYTES = 32
#: Probes that one round puts between two bounds of a splitter, and of all splitters together.
PROBES, MOST_PROBES = 64, 65_536
#: Bytes of text that one task of the exchange sorts, and the most such pieces.
PIECE_BYTES, MOST_PIECES = 16 << 20, 65_536


@dataclass
class Cut:
    """A key (as a number) and the exact bytes and rows of the keys below it."""

    key: int
    bytes: int
    rows: int


def sort_key(text: Column, doc_id: Column) -> Column:
    """Equal texts stand together, then equal ids; a place in the table tells repeated rows
    apart, so that no two rows share a key."""
    own = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    of_id = F.substring(F.unhex(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    place = F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    return F.concat(own, of_id, place)


def _numpy_keys(column: pa.Array) -> np.ndarray:
    """A binary column of whole keys as one array of fixed width, which numpy compares bytewise."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", f"S{KEY_BYTES}", len(column), int(first)) if len(column) else np.zeros(0, f"S{KEY_BYTES}")


def _as_bytes(key: int) -> bytes:
    return key.to_bytes(KEY_BYTES, "big")


def _histogram(placed: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Of each stretch between two probes that has rows: number, bytes, rows, least and largest
    key. Tasks add up their own rows; at most one row for a stretch and task is shuffled."""
    bounds = np.array([_as_bytes(p) for p in probes], f"S{KEY_BYTES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        least, most = {}, {}
        for batch in batches:
            key = _numpy_keys(batch.column(0))
            order = np.argsort(key)
            key, own = key[order], np.frombuffer(batch.column(1).buffers()[1], np.int64)[batch.column(1).offset :][: len(key)][order]
            edges = np.concatenate([[0], np.searchsorted(key, bounds), [len(key)]])
            sums = np.concatenate([[0], np.cumsum(own)])
            size += sums[edges[1:]] - sums[edges[:-1]]
            rows += np.diff(edges)
            for i in np.flatnonzero(np.diff(edges)).tolist():
                low, high = bytes(key[edges[i]]).ljust(KEY_BYTES, b"\0"), bytes(key[edges[i + 1] - 1]).ljust(KEY_BYTES, b"\0")
                least[i], most[i] = min(low, least.get(i, low)), max(high, most.get(i, high))
        used = sorted(least)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(used, pa.int64()), "size": pa.array(size[used].tolist(), pa.int64()), "rows": pa.array(rows[used].tolist(), pa.int64()),
             "least": pa.array([least[i] for i in used], pa.binary()), "most": pa.array([most[i] for i in used], pa.binary())}
        )

    parts = placed.select("key", "size").mapInArrow(count, "part long, size long, rows long, least binary, most binary")
    found = parts.groupBy("part").agg(F.sum("size"), F.sum("rows"), F.min("least"), F.max("most")).collect()
    return sorted((r[0], r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in found)


def find_cuts(placed: DataFrame, shards: int, tolerance: float) -> tuple[list[Cut], list[Cut]]:
    """The cuts between the shards, and those between the pieces of the exchange, in order.
    ``placed`` has ``key`` and ``size``.

    A round counts the exact bytes and rows below probes that lie evenly between the known
    bounds of each open splitter, over all partitions, and takes the nearest probes as the new
    bounds; the least and largest key of a stretch draw them closer still, so a hot group of
    equal texts is left behind after few rounds. A splitter is done when a probe misses its
    target by at most ``tolerance`` (a share of a shard's bytes), or when only one row
    is left between its bounds. Rounds grow with the logarithm of the rows; what the driver
    holds is bounded by ``MOST_PROBES``.
    """
    top = 1 << (8 * KEY_BYTES)
    whole = _histogram(placed, [])
    if not whole:
        return [], []
    _, total, rows, least, most = whole[0]
    known = [Cut(least, 0, 0), Cut(most + 1, total, rows)]
    split = max(1, min(-(-total // (shards * PIECE_BYTES)), MOST_PIECES // shards))
    pieces = shards * split
    goals = {-(-j * total // pieces): (tolerance * total / shards if j % split == 0 else total / pieces / 4) for j in range(1, pieces)}
    done: dict[int, Cut] = {}
    while True:
        below = [c.bytes for c in known]
        bounds: dict[tuple[int, int], int] = {}
        kept = set()
        for goal, slack in goals.items():
            if goal in done:
                continue
            at = bisect_left(below, goal)
            low, high = known[at - 1], known[at]
            near = high if high.bytes - goal <= goal - low.bytes or at == 1 else low
            if abs(near.bytes - goal) <= slack or high.rows - low.rows <= 1:
                done[goal] = near if abs(near.bytes - goal) <= slack else high
                continue
            kept |= {at - 1, at}
            bounds[at - 1, at] = bounds.get((at - 1, at), 0) + 1
        if not bounds:
            break
        each = max(2, min(PROBES, MOST_PROBES // sum(bounds.values())))
        probes = set()
        for (i, j), n in bounds.items():
            low, high = known[i].key, known[j].key
            steps = min(n * each, high - low - 1)
            probes |= {low + (high - low) * k // (steps + 1) for k in range(1, steps + 1)}
        ordered = sorted(probes - {top})
        cuts = {known[i].key: known[i] for i in kept}
        size = count = 0
        for part, own, n, low, high in _histogram(placed, ordered):
            for key, s, c in ((low, size, count), (high + 1, size + own, count + n)):
                cuts[key] = Cut(key, s, c)
            size, count = size + own, count + n
        known = sorted(cuts.values(), key=lambda c: c.key)
        below, near = [c.bytes for c in known], set()
        for goal in goals.keys() - done.keys():
            at = bisect_left(below, goal)
            near |= {at - 1, at}
        known = [known[i] for i in sorted(near)]
    # A row larger than a shard is passed by several goals with one cut.
    between = [done[-(-j * total // shards)] for j in range(1, shards)]
    return between, sorted({c.key: c for c in done.values()}.values(), key=lambda c: c.key)


def shard(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.0, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row, and with ``carry`` the whole
    row as ``row``. Shards take stretches of one order of all rows (hash of the text, hash of the
    id, place) with equal bytes: with ``tolerance`` 0 a row goes to the shard in which its first
    byte falls, so two shards differ by less than two documents; otherwise cuts may be off by that
    share of a shard, which saves rounds. ``slot`` counts a shard's rows from 0 in that order.

    Equal texts stand side by side and share a shard but where a cut goes through them, which
    keeps a group of copies as large as a third of all rows from outgrowing a shard.
    Keys and sizes are written once; the rounds of ``find_cuts`` read only these two columns. Then every row
    is exchanged once, to one of many pieces whose bounds and rows are known, so that a
    slot needs no further count. Size is the text's UTF-8 bytes and 1; null text has none, and
    the checksum of an empty one. Null ids and repeated rows are rows like others. An empty
    table gives no rows; further columns are ignored or carried, whatever their names. A text may
    be larger than a shard: the shards that it covers stay empty.
    """
    if shards < 1 or shards > MOST_PIECES:
        raise ValueError(f"1 to {MOST_PIECES} shards")
    raw = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    whole = [F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("row")] if carry else []
    slim = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        sort_key(docs[text_col], docs[id_col]).alias("key"),
        *whole,
    )
    placed = materialize(slim, "shard-keys")
    cuts, pieces = find_cuts(placed, shards, tolerance)
    bounds = np.array([_as_bytes(c.key) for c in pieces], f"S{KEY_BYTES}")
    starts, below = [0, *(c.key for c in pieces)], [0, *(c.rows for c in pieces)]
    keys = [c.key for c in cuts]
    own = [bisect_right(keys, s) for s in starts]
    first: dict[int, int] = {}
    for s, b in zip(own, below, strict=True):
        first.setdefault(s, b)
    of_piece, base = np.array(own, np.int32), np.array([b - first[s] for s, b in zip(own, below, strict=True)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = np.searchsorted(bounds, _numpy_keys(batch.column(3)), side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(piece.astype(np.int32)), pa.array(of_piece[piece]), pa.array(base[piece])],
                [*batch.schema.names, "piece", "shard", "base"],
            )

    kinds = T.StructType([*placed.schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])
    dealt = (short_batches(placed) if carry else placed).mapInArrow(deal, kinds)
    slot = F.col("base") + F.row_number().over(Window.partitionBy("piece").orderBy("key")) - 1
    return dealt.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """The rows as Parquet, a folder ``shard=k`` for each shard with rows; ``slot`` is a column.
    Columns of these two names must be renamed before."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("the columns shard and slot are written here")
    shard(docs, shards, carry=True, **options).select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)
