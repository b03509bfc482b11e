"""A Merkle manifest of a dataset: a tree for each group, a tree over the groups' roots, and an
authentication path for every row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .ranks import positions

#: Levels of an aligned block, which one task walks, and of each subtree stacked in it.
BLOCK_LEVELS, SUBTREE_LEVELS = 7, 3
#: Siblings on both sides, level by level, as hexadecimal text.
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields in order, each its length in UTF-8 bytes, a colon and its value as
    text, or ``-`` where it is null, so that no two rows share an encoding."""

    def encoded(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(encoded, fields)), 256)


def siblings_hash(path: Column) -> Column:
    """SHA-256 of a path's siblings one after the other."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root to which a leaf and its path lead; equal to the manifest's root if, and only if,
    nothing changed."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def _up(run: list[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


def height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class Subtree:
    """The nodes of levels ``low`` to ``high - 1`` below one node, built from leaves that are
    fed in order. Below ``low`` only unfinished runs are kept."""

    def __init__(self, low: int, high: int, arity: int):
        self.low, self.high, self.arity = low, high, arity
        self.runs: list[list[bytes]] = [[] for _ in range(high)]

    def feed(self, node: bytes, level: int = 0) -> None:
        while level < self.high:
            run = self.runs[level]
            run.append(node)
            if level + 1 == self.high or len(run) % self.arity:
                return
            node = _up(run[-self.arity :])
            if level < self.low:
                run.clear()
            level += 1

    def close(self) -> None:
        """The leaves are at an end: last runs become nodes, short as they are."""
        for level in range(self.high - 1):
            run = self.runs[level]
            if rest := len(run) % self.arity:
                self.feed(_up(run[-rest:]), level + 1)
            if level < self.low:
                run.clear()


class Traversal:
    """Successive authentication paths of one block's leaves, after fractal tree traversal
    (Jakobsson, Leighton, Micali and Szydlo, 2003).

    The subtrees above the current leaf are stacked, one for every ``step`` levels. Beside each but the
    topmost grows the next one of its layer, the desired one, by one leaf for each path that is
    emitted, so that it is whole when the walk enters it. Beside the leaves, which
    are read where they lie, memory is two subtrees for each layer.
    """

    def __init__(self, leaves: list[bytes], levels: int, arity: int, step: int):
        self.leaves, self.levels, self.arity = leaves, levels, arity
        self.layers = [(low, min(low + step, levels)) for low in range(0, levels, step)]
        self.spans = [arity**high for _, high in self.layers]
        self.existing = [Subtree(low, high, arity) for low, high in self.layers]
        for tree, span in zip(self.existing, self.spans, strict=True):
            for leaf in leaves[:span] if span < len(leaves) else leaves:
                tree.feed(leaf)
            tree.close()

    def root(self) -> bytes:
        return _up(self.existing[-1].runs[self.levels - 1]) if self.layers else self.leaves[0]

    def paths(self) -> Iterator[list[tuple[bytes, bytes]]]:
        """A list of (left, right) for each leaf, lowest level first; the list is reused."""
        desired = [Subtree(low, high, self.arity) for low, high in self.layers[:-1]]
        path: list[tuple[bytes, bytes]] = [(b"", b"")] * self.levels
        for at in range(len(self.leaves)):
            for layer, (low, high) in enumerate(self.layers):
                tree, inside = self.existing[layer], at % self.spans[layer]
                for level in range(low, high):
                    if at and at % self.arity**level:  # this level and those above are as before
                        break
                    index = inside // self.arity**level
                    first = index - index % self.arity
                    run = tree.runs[level][first : first + self.arity]
                    path[level] = b"".join(run[: index - first]), b"".join(run[index - first + 1 :])
            yield path
            for layer, tree in enumerate(desired):
                span = self.spans[layer]
                if at + span < len(self.leaves):
                    tree.feed(self.leaves[at + span])
                if (at + 1) % span == 0:
                    tree.close()
                    self.existing[layer] = tree
                    desired[layer] = Subtree(*self.layers[layer], self.arity)


def _climbed(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """``rows`` (``grp, pos, n, node`` and others) with ``block``, ``path`` inside the block, and ``top``,
    the block's root. A block is ``arity ** levels`` consecutive nodes of a group, or its last ones; a task holds
    the rows of one block at a time."""
    width = arity**levels
    blocks = rows.withColumn("block", F.expr(f"pos div {width}L"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("pos").combine_chunks()
        leaves = [x.encode() for x in table.column("node").to_pylist()]
        n = table.column("n")[0].as_py()
        depth = min(levels, height(n, arity))
        walker = Traversal(leaves, depth, arity, SUBTREE_LEVELS)
        top, paths = walker.root().decode(), walker.paths()
        for batch in table.to_batches(max_chunksize=2048):
            left, right = [], []
            for _ in range(batch.num_rows):
                for a, b in next(paths):
                    left.append(a.decode())
                    right.append(b.decode())
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            offsets = pa.array(range(0, (batch.num_rows + 1) * depth, depth) if depth else [0] * (batch.num_rows + 1), pa.int32())
            columns = [*batch.columns, pa.ListArray.from_arrays(offsets, pairs), pa.array([top] * batch.num_rows)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "path", "top"])

    side = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
    schema = T.StructType([*blocks.schema.fields, T.StructField("path", T.ArrayType(side)), T.StructField("top", T.StringType())])
    return blocks.groupBy("grp", "block").applyInArrow(walk, schema)


def _trees(rows: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The climbed tables from the leaves up, and ``grp, node``: each group's root."""
    floors = []
    while True:
        floors.append(materialize(_climbed(rows, arity, levels), "merkle"))
        tops = floors[-1].where(F.expr(f"pos % {arity**levels}L = 0"))
        rows = tops.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {arity**levels - 1}L) div {arity**levels}L").alias("n"), F.col("top").alias("node"))
        if rows.where("n > 1").isEmpty():
            return floors, rows.select("grp", "node")


def _paths(floors: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the lowest table with whole paths. ``tops`` has ``grp, path`` (that of the
    group's root) and further columns of groups; they are joined to the blocks' roots, and those
    to the leaves, so that no join has more rows of one key than a block has."""
    kept = [c for c in tops.columns if c not in ("grp", "path")]
    found = tops.withColumn("pos", F.lit(0).cast("long"))
    for floor in reversed(floors):
        up = found.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), F.col("path").alias("_upper"), *kept)
        found = floor.join(up, floor["grp"].eqNullSafe(up["_grp"]) & (floor["block"] == up["_pos"]))
        found = found.withColumn("path", F.concat("path", "_upper")).drop("_grp", "_pos", "_upper")
    return found


def manifest(
    docs: DataFrame, leaf: Column, group: str = "source", id_col: str = "doc_id", arity: int = 3, carry: dict[str, Column] | None = None,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``doc_id, source, leaf, position, path, subroot, root`` for every row, and the columns of
    ``carry``: the row's leaf hash, its place in its group, the siblings of its authentication
    path from the leaf to the root, and the roots.

    A group's leaves ascend by id; ``arity`` consecutive nodes become their hash, a last
    run as short as it is, while more than one remains; the groups' roots, by the group's value
    (null first, bytewise), become the root in the same way. Leaves are numbered by
    ``ranks.positions`` and dealt out in aligned blocks, which tasks walk by fractal traversal;
    the blocks' roots are leaves of the next table, until each group has one. Then the upper
    paths are joined downwards. A hot group is many blocks.

    A null id stands first; rows that repeat an id ascend by leaf hash. A null group is a
    group. A group of one row is its own root. An empty table gives no rows; further columns are ignored.
    """
    extra = carry or {}
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[group].cast("string").alias("grp"), leaf.alias("node"), *[c.alias(k) for k, c in extra.items()])
    floors, subroots = _trees(positions(slim, "grp", [F.col("doc_id").asc_nulls_first(), F.col("node").asc()]), arity, block_levels)
    groups = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "node")
    over, root = _trees(positions(groups, "grp", [F.col("own").asc_nulls_first()]), arity, block_levels)
    root = root.select("grp", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    tops = _paths(over, root).select(F.col("own").alias("grp"), F.col("node").alias("subroot"), "path", "root")
    found = _paths(floors, tops)
    return found.select("doc_id", F.col("grp").alias("source"), F.col("node").alias("leaf"), F.col("pos").alias("position"), "path", "subroot", "root", *extra)
