"""Nearest neighbours by inner product with an inverted multi-index.

The two halves of a vector are quantised separately, each by its own k-means codebook of K centroids, so K * K cells
come from two small codebooks. A query sums the inner products of its halves with the centroids and visits cells in
the order of that sum: a heap holds the frontier of centroid pairs (the multi-sequence walk) until the visited cells
hold enough entries. Entries of visited cells are ranked by their exact inner product.

How many entries are enough is measured, at every size alike: ``picked`` queries (by hash) are answered by brute force
in one pass over the entries, and enough is what it takes to meet ``recall`` of their neighbours. On vectors with
clusters that is a small share; on vectors without structure, as random ones in many dimensions, any index must
visit about half. Recall over all queries is measured in the tests and in the README.

Codebooks are fitted on a bounded sample (``sample`` rows are expected, picked by hash); every row is indexed. K is 64 and
grows with the square root of the rows, to ``MOST``. The counts of the K * K cells come to the driver, which deals cells
into shards of bounded size; a cell with more entries is split over several shards by a hash. A task holds the entries of
one shard and lets the queries that visit it stream past, so entries are shuffled once, whatever the number of queries.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null
vec_id. Vectors of another dimension are searched among their equals, by an index of their own. Repeated rows are
entries of their own, but one query; of rows with one vec_id and different vectors the lowest vector asks, and rows with
the query's vec_id are its own. Ties go to the smaller vec_id. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spill
from .vectors import matrix, usable

MOST = 1024
#: Shards for a table that fits them; entries and bytes of a shard, at most; queries that are compared with a shard at a time.
SHARDS, LEAST_SHARD, SHARD_BYTES, QUERIES = 32, 256, 1 << 23, 128


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    centers = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = nearest(rows, centers)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, rows)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * rows @ centers.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: float) -> list[int]:
    """Cells (i * K + j) by falling first[i] + second[j], until they hold enough entries."""
    k1, k2 = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = (-first[k1]).tolist(), (-second[k2]).tolist()
    n = counts[k1][:, k2].tolist()
    heap, reached, seen, out = [(a[0] + b[0], 0, 0)], [-1] * len(a), 0, []
    while heap and seen < enough:
        _, x, y = heapq.heappop(heap)
        reached[x] = y
        if n[x][y]:
            out.append((x, y))
            seen += n[x][y]
        # a pair enters once both pairs before it, (x - 1, y) and (x, y - 1), were visited
        if x + 1 < len(a) and reached[x + 1] == y - 1:
            heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))
        if y + 1 < len(b) and (x == 0 or reached[x - 1] >= y + 1):
            heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
    at = np.array(out, dtype=np.int64).reshape(-1, 2)
    return (k1[at[:, 0]] * len(second) + k2[at[:, 1]]).tolist()


class Index:
    """Codebooks, cell counts, and for each cell its first shard and how many shards share it."""

    def __init__(self, codebooks: tuple[np.ndarray, np.ndarray], half: int):
        self.codebooks, self.half = codebooks, half
        self.counts = np.zeros((len(codebooks[0]), len(codebooks[1])), dtype=np.int64)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return nearest(rows[:, : self.half], self.codebooks[0]) * len(self.codebooks[1]) + nearest(rows[:, self.half :], self.codebooks[1])

    def deal(self, size: int) -> None:
        """Cells, in order, into shards of about ``size`` entries."""
        n = self.counts.ravel()
        self.first, self.share = np.zeros(len(n), dtype=np.int32), np.ones(len(n), dtype=np.int32)
        shard, held = 0, 0
        for cell in np.flatnonzero(n).tolist():
            if held and held + n[cell] > size:
                shard, held = shard + 1, 0
            self.first[cell], self.share[cell] = shard, -(-int(n[cell]) // size)
            held += int(n[cell])
            if self.share[cell] > 1:
                shard, held = shard + int(self.share[cell]), 0


def build(rows: DataFrame, dim: int, sample: int = 20_000) -> tuple[Index, DataFrame]:
    """The index of (vec_id, v) rows of one dimension, and the entries: vec_id, v, cell."""
    total = rows.count()
    some = rows.select("v")
    if total > sample:
        some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * sample / total)).select("v")
    fit = matrix(pa.chunked_array([some.toArrow().column("v").combine_chunks()]).combine_chunks())
    fit, half = fit if len(fit) else np.zeros((1, dim)), dim // 2
    k = min(MOST, len(fit), max(64, math.isqrt(total) // 4))
    index = Index((k_means(fit[:, :half], k), k_means(fit[:, half:], k)), half)
    books = rows.sparkSession.sparkContext.broadcast(index)  # 2 * K centroids

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(books.value.cells(matrix(b.column("v"))), pa.int32())], ["vec_id", "v", "cell"])

    entries = spill(rows.mapInArrow(place, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, cell int"), "entries")
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        index.counts.ravel()[r.cell] = r.n
    index.deal(max(LEAST_SHARD, min(total // SHARDS, SHARD_BYTES // (8 * dim))))
    return index, entries


def ordered_dots_pairs(rows: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k in range(rows.shape[1]):
        out += rows[x, k] * others[y, k]
    return out


def best_of(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, open_: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the ``top`` best open entries of each query, exact, ties to the smaller id."""
    near = np.where(open_ & (ids[None, :] != own[:, None]), queries @ rows.T, -np.inf)
    if near.shape[1] > top:
        low = np.partition(near, near.shape[1] - top, axis=1)[:, -top]
    else:
        low = np.full(len(near), -np.inf)
    # Products of a matrix are rounded in another order, so all that come near the last place are computed anew.
    size = np.abs(queries) @ np.abs(rows).max(axis=0)
    near_enough = near >= np.where(np.isfinite(low), low - 1e-9 * size, -np.inf)[:, None]
    q, e = np.nonzero(near_enough & (near > -np.inf))
    score = np.concatenate([np.zeros(0), *(ordered_dots_pairs(rows, e[i : i + (1 << 18)], queries, q[i : i + (1 << 18)]) for i in range(0, len(q), 1 << 18))])
    order = np.lexsort((ids[e], -score, q))
    q, e, score = q[order], e[order], score[order]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < top
    return q[keep], e[keep], score[keep]


def _rank(top: int):
    """Rows by shard, entries first: they are held while the shard's queries stream past."""

    def run(batches):
        key, held, done = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            shard, asks = b.column("shard").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, stop in zip([0, *cut], [*cut, b.num_rows], strict=True):
                if shard[start] != key:
                    key, held, done = shard[start], [], None
                part = b.slice(start, stop - start)
                if not asks[start]:
                    held.append((part.column("vec_id").to_numpy(), part.column("cell").to_numpy(), matrix(part.column("v"))))
                    continue
                if not held:  # cells that no entry of this shard's part is in
                    continue
                if done is None:
                    done = tuple(map(np.concatenate, zip(*held, strict=True)))
                ids, cells, rows = done
                for at in range(0, part.num_rows, QUERIES):
                    some = part.slice(at, QUERIES)
                    wanted = [np.isin(cells, c) for c in some.column("cells").to_pylist()]
                    q, e, score = best_of(rows, ids, matrix(some.column("v")), own := some.column("vec_id").to_numpy(), np.array(wanted), top)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[e]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _exact(picked, top: int):
    """The best entries of a task for each of the picked queries, with their cells."""

    def run(batches):
        own, queries = picked.value
        best = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                ids, cells, rows = some.column("vec_id").to_numpy(), some.column("cell").to_numpy(), matrix(some.column("v"))
                if best is not None:
                    ids, cells, rows = np.concatenate([best[0], ids]), np.concatenate([best[1], cells]), np.concatenate([best[2], rows])
                q, e, score = best_of(rows, ids, queries, own, np.ones((len(own), len(ids)), dtype=bool), top)
                last = (q, ids[e], cells[e], score)
                keep = np.unique(e)
                best = ids[keep], cells[keep], rows[keep]
        if best is not None:
            q, vec, cell, score = last
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(vec), pa.array(cell), pa.array(score)], ["q", "vec_id", "cell", "score"])

    return run


def reach(index: Index, entries: DataFrame, queries: DataFrame, top: int, recall: float, picked: int) -> int:
    """How many entries a query has to visit so that ``recall`` of the neighbours of ``picked`` queries, found by brute force, are among them."""
    some = queries.orderBy(F.xxhash64("vec_id", F.lit("reach")), "vec_id").limit(picked).collect()
    if not some:
        return 0
    own, rows = np.array([r.vec_id for r in some]), np.array([r.v for r in some], dtype=float)
    shared = entries.sparkSession.sparkContext.broadcast((own, rows))  # picked vectors
    best = entries.select("vec_id", "v", "cell").mapInArrow(_exact(shared, top), "q int, vec_id long, cell int, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = best.withColumn("place", place).where(F.col("place") <= top).select("q", "cell").collect()  # picked * top rows
    needs, n = [], index.counts.ravel()
    for i, row in enumerate(rows):
        first, second = row[: index.half] @ index.codebooks[0].T, row[index.half :] @ index.codebooks[1].T
        order = np.argsort(-(first[:, None] + second[None, :]).ravel(), kind="stable")
        before = np.empty(len(n), dtype=np.int64)
        before[order] = np.cumsum(n[order]) - n[order]
        needs += [int(before[r.cell]) for r in found if r.q == i]
    return sorted(needs)[max(0, math.ceil(recall * len(needs)) - 1)] + 1 if needs else 0


def search(embeddings: DataFrame, is_query, top: int = 20, recall: float = 0.95, picked: int = 64) -> DataFrame:
    """Per query (rows where the column ``is_query`` holds): query_id, rank, vec_id, score."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    dims = [r.d for r in rows.where("asks").select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # a row for each dimension
    best = [_search(rows.where(F.size("v") == d), d, top, recall, picked) for d in dims]
    if not best:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return functools.reduce(DataFrame.union, best).select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= top)


def _search(rows: DataFrame, dim: int, top: int, recall: float, picked: int) -> DataFrame:
    """The best entries of each query and shard, among vectors of one dimension."""
    spark = rows.sparkSession
    index, entries = build(rows.select("vec_id", "v"), dim)
    queries = spill(rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    enough = reach(index, entries, queries, top, recall, picked)
    shared = spark.sparkContext.broadcast(index)
    kind = rows.schema["v"].dataType.simpleString()

    def ask(batches):
        index = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("v"))
            first, second = q[:, : index.half] @ index.codebooks[0].T, q[:, index.half :] @ index.codebooks[1].T
            for r in range(len(q)):
                cells = np.array(walk(first[r], second[r], index.counts, enough), dtype=np.int32)
                # a cell that is split is asked for in all of its shards
                share = index.share[cells]
                flat = np.repeat(cells, share)
                shards = np.repeat(index.first[cells], share) + (np.arange(len(flat)) - np.repeat(np.cumsum(share) - share, share))
                order = np.argsort(shards, kind="stable")
                names, at = np.unique(shards[order], return_index=True)
                n, one = len(names), b.slice(r, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([one.column("vec_id")[0].as_py()] * n, pa.int64()), one.column("v").take(pa.array([0] * n)), pa.array(np.split(flat[order], at[1:]), pa.list_(pa.int32()))],
                    ["shard", "vec_id", "v", "cells"],
                )

    def deal(batches):
        index = shared.value
        for b in batches:
            if b.num_rows:
                cell, salt = b.column("cell").to_numpy(), b.column("salt").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(index.first[cell] + salt % index.share[cell], pa.int32()), *(b.column(c) for c in ("cell", "vec_id", "v"))], ["shard", "cell", "vec_id", "v"])

    tasks = max(1, -(-queries.count() // 128))
    asked = queries.repartition(tasks, "vec_id").mapInArrow(ask, f"shard int, vec_id long, v {kind}, cells array<int>")
    asked = asked.select("shard", F.lit(True).alias("asks"), F.lit(-1).alias("cell"), "vec_id", "v", "cells")
    dealt = entries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)).cast("int")).mapInArrow(deal, f"shard int, cell int, vec_id long, v {kind}")
    dealt = dealt.select("shard", F.lit(False).alias("asks"), "cell", "vec_id", "v", F.lit(None).cast("array<int>").alias("cells"))
    both = asked.union(dealt).repartition("shard").sortWithinPartitions("shard", "asks")
    return both.mapInArrow(_rank(top), "query_id long, vec_id long, score double")
