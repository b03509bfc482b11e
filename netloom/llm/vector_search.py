"""Approximate nearest neighbours over balanced, partly replicated posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors that the centroids are fitted on at most (chosen by a hash of the id), and
#: centroids at most: what the driver holds and every executor gets.
SAMPLE, MOST_LISTS = 20_000, 2048
#: Vectors of a list on average, and of a block into which a longer list is dealt.
LIST_SIZE, BLOCK = 96, 4096
#: A vector joins up to REPLICAS lists whose centroids are within the ratio of
#: its nearest; a query probes every list of its beam within its own ratio.
REPLICAS, STORE_RATIO, PROBE_RATIO = 4, 1.15, 1.35
#: Degree of the centroid graph, beam of a search in it, and the share of all lists that
#: a query's beam holds at least: without clear clusters, what is near lies in many lists.
DEGREE, BEAM, QUERY_SHARE = 24, 48, 1 / 6
#: Vectors that a query's probed lists hold at least, if there are so many.
LEAST_PROBED = 256


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Centroids by repeated 2-means of the largest cluster, so that no list is far
    above the mean; a cluster of one repeated vector is not split."""
    rng = np.random.default_rng(seed)
    clusters, done = [np.arange(len(sample))], []
    while clusters and len(clusters) + len(done) < lists:
        clusters.sort(key=len)
        own = clusters.pop()
        x = sample[own]
        if len(own) < 2 or np.ptp(x, axis=0).max() == 0:
            done.append(own)
            continue
        c = x[rng.choice(len(x), 2, replace=False)]
        side = np.zeros(len(x), bool)
        for _ in range(8):
            gap = x @ (c[1] - c[0])
            side = gap > np.median(gap)
            if side.all() or not side.any():
                side = gap > gap.mean()
            if side.all() or not side.any():
                break
            c = np.array([x[~side].mean(axis=0), x[side].mean(axis=0)])
        if side.all() or not side.any():
            done.append(own)
        else:
            clusters += [own[side], own[~side]]
    means = np.array([sample[c].mean(axis=0) for c in clusters + done])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    return means / np.where(norms > 0, norms, 1)


def centroid_graph(centroids: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones and a few random ones, which keep
    the graph connected and short."""
    n = len(centroids)
    near = min(DEGREE, n - 1)
    rng = np.random.default_rng(5)
    out = np.zeros((n, near + 4), np.int64)
    out[:, near:] = rng.integers(0, n, (n, 4))
    for at in range(0, n, 1024):
        close = centroids[at : at + 1024] @ centroids.T
        close[np.arange(len(close)), np.arange(at, at + len(close))] = -np.inf
        out[at : at + 1024, :near] = np.argsort(-close, axis=1, kind="stable")[:, :near]
    return out


def search_graph(
    x: np.ndarray, centroids: np.ndarray, graph: np.ndarray, beam: int = BEAM
) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for all rows of ``x`` (unit vectors) at once: ids of the nearest
    centroids found and their distances, nearest first."""
    n, beam = len(centroids), min(beam, len(centroids))
    rows = np.arange(len(x))[:, None]
    entry = np.unique(np.linspace(0, n - 1, beam).astype(np.int64))
    ids = np.broadcast_to(entry, (len(x), len(entry))).copy()
    dist = 1 - x @ centroids[entry].T
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = ids[rows, order], dist[rows, order]
    seen = np.zeros((len(x), n), bool)
    seen[rows, ids] = True
    open_ = np.ones(ids.shape, bool)
    while open_.any():
        at = np.where(open_, dist, np.inf).argmin(axis=1)
        active = open_.any(axis=1)
        open_[np.arange(len(x)), at] = False
        next_ = graph[ids[np.arange(len(x)), at]]
        fresh = ~seen[rows, next_] & active[:, None]
        first = np.sort(next_, axis=1)  # a neighbour listed twice counts once
        order = np.argsort(next_, axis=1, kind="stable")
        twice = np.zeros(next_.shape, bool)
        twice[rows, order[:, 1:]] = first[:, 1:] == first[:, :-1]
        fresh &= ~twice
        seen[rows, next_] = True
        near = np.where(fresh, 1 - np.einsum("ij,ikj->ik", x, centroids[next_]), np.inf)
        ids, dist = np.concatenate([ids, next_], axis=1), np.concatenate([dist, near], axis=1)
        open_ = np.concatenate([open_, fresh], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, open_ = ids[rows, order], dist[rows, order], open_[rows, order]
        open_ &= np.isfinite(dist)
    return ids, np.sqrt(np.maximum(2 * dist, 0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows whose vector is not null, not zero and all
    finite."""
    v = vectors[vec_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest of each query by cosine: ``query_id, rank, vec_id, score``, the
    score computed from the original vectors in double precision. Queries are the rows
    whose id is divisible by ``every``, candidates all rows but the query's own.

    The centroids are fitted on a bounded sample; every row is indexed. A vector is
    stored under its nearest centroid and, if it lies near a boundary, under others
    whose distance is within a ratio of the nearest and which do not lie closer to a
    centroid already chosen. Centroids are found through a graph in memory, and a
    query probes all lists of its beam within a ratio of the nearest (and more, until
    they hold LEAST_PROBED vectors). Lists are dealt to tasks in blocks of about
    BLOCK vectors, so that many copies of one vector spread out; each block returns
    its best ``k`` per query and ties go to smaller ids.

    Rows with a null id, or a vector that is null, empty, zero, holds null or non-finite
    components or differs in length from most, take no part. A candidate id that
    repeats counts once with its best score; of repeated query ids the smallest vector
    asks. Fewer candidates than ``k`` are all returned; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    kind = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], kind)
    dim, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    chosen = rows if n <= SAMPLE else rows.where(F.xxhash64("vec_id") < int(-(1 << 63) + (1 << 64) * (SAMPLE / n)))
    table = chosen.orderBy("vec_id").toArrow() if n <= SAMPLE else chosen.toArrow().sort_by("vec_id")
    sample = _units(np.array(table.column("v").combine_chunks().flatten()).reshape(-1, dim))
    centroids = balanced_centroids(sample, max(1, min(MOST_LISTS, n // LIST_SIZE)))
    shared = spark.sparkContext.broadcast((centroids, centroid_graph(centroids)))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, graph = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _units(batch.column(1).flatten().to_numpy().reshape(-1, dim))
                ids, dist = search_graph(x, centroids, graph)
                width = min(16, ids.shape[1])
                taken = np.zeros((len(x), width), bool)
                taken[:, 0] = True
                for j in range(1, width):
                    near = dist[:, j] <= STORE_RATIO * dist[:, 0]
                    between = np.full(len(x), np.inf)
                    for i in range(j):
                        gap = np.linalg.norm(centroids[ids[:, j]] - centroids[ids[:, i]], axis=1)
                        between = np.where(taken[:, i], np.minimum(between, gap), between)
                    taken[:, j] = near & (between > 0.7 * dist[:, j]) & (taken.sum(axis=1) < REPLICAS)
                who, which = np.nonzero(taken)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[who, which]), batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who))],
                    ["list", "vec_id", "v"],
                )

    lists = materialize(rows.mapInArrow(store, "list long, vec_id long, v array<double>"), "posting-lists")
    held = np.zeros(len(centroids), np.int64)
    for r in lists.groupBy("list").count().collect():  # a row per centroid at most
        held[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-held // BLOCK))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, graph = shared.value
        beam = max(BEAM, int(len(centroids) * QUERY_SHARE))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = _units(batch.column(1).flatten().to_numpy().reshape(-1, dim))
                ids, dist = search_graph(x, centroids, graph, beam)
                before = np.cumsum(held[ids], axis=1) - held[ids]
                who, which = np.nonzero((dist <= PROBE_RATIO * dist[:, :1]) | (before < LEAST_PROBED))
                found = ids[who, which]
                again = blocks[found]
                who, found = np.repeat(who, again), np.repeat(found, again)
                block = np.arange(len(found)) - np.repeat(np.cumsum(again) - again, again)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(block), batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who))],
                    ["list", "block", "query_id", "q"],
                )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, q = left.column("query_id").to_numpy(), left.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        own, v = right.column("vec_id").to_numpy(), right.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        out = []
        order = np.argsort(own, kind="stable")
        own, v = own[order], v[order]
        begins = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))  # rows of one id stand together
        if len(own):
            norms = np.sqrt(np.sum(v * v, axis=1))
            for at in range(0, len(asked), 256):
                rough = (q[at : at + 256] @ v.T) / norms
                for i, line in enumerate(rough, at):
                    line[own == asked[i]] = -np.inf
                    each = np.maximum.reduceat(line, begins)
                    least = np.partition(each, -k)[-k] if len(each) > k else -np.inf
                    near = np.flatnonzero((line >= least - 1e-9 * abs(least)) & (line > -np.inf))
                    score = np.sum(v[near] * q[i], axis=1) / (norms[near] * np.sqrt(np.sum(q[i] * q[i])))
                    first = np.lexsort((own[near], -score))
                    _, at_first = np.unique(own[near[first]], return_index=True)
                    out += [(int(asked[i]), int(own[near[j]]), float(score[j])) for j in first[np.sort(at_first)[:k]]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    probes = asking.mapInArrow(probe, "list long, block long, query_id long, q array<double>")
    dealt = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), (F.col("list") + 1).cast("int"))
    stored = lists.withColumn("block", F.pmod(F.xxhash64("vec_id"), dealt.cast("long")))
    found = (
        probes.groupBy("list", "block")
        .cogroup(stored.groupBy("list", "block"))
        .applyInArrow(best, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
