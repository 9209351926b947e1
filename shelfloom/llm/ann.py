"""Nearest neighbours by inner product with an inverted multi-index.

Both halves of the vectors are quantised on their own; a cell is a pair of centroids. A query visits cells
in the order of summed distance (the negative inner product with both centroids), taken from a heap in
short runs, until they hold enough entries, and the entries are ranked again by the exact measure.

What a query visits is all cells up to one summed distance, so that number goes with the query to the tasks
that hold its cells. Entries are moved once; a task keeps a bounded part of them and streams its queries past.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

#: Most centroids of a half; so a table of cells has at most its square of rows.
MOST_CENTROIDS = 256
#: Cells of one first-half centroid that a query takes from the heap at a time; entries that one task holds; queries it scores at a time.
RUN, ENTRIES, QUERIES = 8, 8_192, 256


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; a centroid that loses all its rows stays where it is."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def reach(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> float:
    """The summed distance up to which cells are visited: taken by increasing d1[i] + d2[j], they hold `enough` entries.

    The heap holds for each first-half centroid its next run of cells; runs come by their nearest cell.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    near, far = d2[o2][::RUN].tolist(), np.append(d2[o2][RUN - 1 :: RUN], d2[o2][-1])[: -(-len(d2) // RUN)].tolist()
    held = np.add.reduceat(counts[o1][:, o2], np.arange(0, len(d2), RUN), axis=1).tolist()
    s1 = d1[o1].tolist()
    heap, opened, total, upto = [(s1[0] + near[0], 0, 0)], 1, 0, -math.inf
    while heap and total < enough:
        _, a, b = heapq.heappop(heap)
        total += held[a][b]
        if held[a][b]:
            upto = max(upto, s1[a] + (near[b] if total < enough else far[b]))
        if b + 1 < len(near):
            heapq.heappush(heap, (s1[a] + near[b + 1], a, b + 1))
        if b == 0 and opened < len(s1):
            heapq.heappush(heap, (s1[opened] + near[0], opened, 0))
            opened += 1
    return math.inf if total < enough else upto


class Part:
    """The entries of one task, sorted by cell."""

    def __init__(self, entries: pa.Table):
        order = np.lexsort((entries["j"].to_numpy(), entries["i"].to_numpy()))
        entries = entries.take(pa.array(order))
        self.rid, self.vec_id, i, j = (entries[c].to_numpy() for c in ("rid", "vec_id", "i", "j"))
        self.x = _vectors(entries["vector"])
        first = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 0) | (np.diff(j) != 0))))
        self.i, self.j, self.sizes = i[first], j[first], np.diff(np.append(first, len(i)))

    def nearest(self, queries: pa.Table, distances: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each query its k nearest among the entries of cells that it visits: query, query_id, vec_id, rid, score."""
        q, own, query_id, upto = _vectors(queries["vector"]), *(queries[c].to_numpy() for c in ("rid", "vec_id", "upto"))
        seen = distances[0][:, self.i] + distances[1][:, self.j] <= (upto + 1e-9 * (1 + np.abs(upto)))[:, None]
        for n, cells in enumerate(seen):
            some = np.flatnonzero(np.repeat(cells, self.sizes))
            some = some[self.rid[some] != own[n]]
            score = (self.x[some] * q[n]).sum(1)  # the same sum for the same vectors, wherever they stand
            if len(some) > k:
                high = score >= np.partition(score, len(score) - k)[len(score) - k]
                some, score = some[high], score[high]
            order = np.lexsort((self.rid[some], self.vec_id[some], -score))[:k]
            best = some[order]
            yield np.full(len(best), own[n]), np.full(len(best), query_id[n]), self.vec_id[best], self.rid[best], score[order]


def search(vectors: DataFrame, is_query: str, k: int = 20, share: float = 0.3, centroids: int = MOST_CENTROIDS, sample: int = 20_000) -> DataFrame:
    """Rows of `vectors` (vec_id, embedding) that is_query selects, against all other rows: query_id, rank, vec_id, score.

    Cells are visited until they hold `share` of all entries and k more than the query itself, at every table
    size. Each half has `centroids` centroids, fewer only if there are not twice as many vectors. They are
    fitted on about `sample` vectors (by hash of vec_id, never over twice as many); every vector is indexed.
    Vectors that are null, all zeros, of another length than most, or with null or non-finite parts take no
    part. Rows may repeat; each is an entry, and a query leaves out its own row only. Ties go to the smaller
    vec_id. Other columns are ignored; an empty table gives an empty one.
    """
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    rows = staged(rows.where(F.col("vector").isNotNull() & fine), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    size, total = sizes[0]
    rows = rows.where(F.size("vector") == size)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // sample))) == 0).select("vec_id", "vector").limit(2 * sample).toArrow()
    if not len(chosen):
        chosen = rows.select("vec_id", "vector").limit(sample).toArrow()
    fitted = _vectors(chosen.sort_by("vec_id")["vector"])
    n_centroids = max(1, min(centroids, len(fitted) // 2))
    half = max(1, size // 2)

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :half], x[:, half:] if size > half else np.zeros((len(x), 1))

    books = tuple(_centroids(x, n_centroids) for x in halves(fitted))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (((c**2).sum(1) - 2 * x @ c.T).argmin(1) for x, c in zip(halves(_vectors(batch.column(3))), books, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["rid", "vec_id", "asks", "vector", "i", "j"])

    index = staged(rows.mapInArrow(assign, "rid long, vec_id long, asks boolean, vector array<double>, i int, j int"), "index")
    counts = np.zeros((n_centroids, n_centroids), np.int64)
    for r in index.groupBy("i", "j").count().collect():
        counts[r["i"], r["j"]] = r["count"]
    enough = max(math.ceil(share * total), k + 1)
    # neighbouring first-half centroids share a block of about ENTRIES entries; one that has more is dealt in parts
    held = counts.sum(1)
    block_of = (np.cumsum(held) - held) // ENTRIES
    blocks, starts = np.unique(block_of, return_index=True)
    parts = np.maximum(1, -(-np.add.reduceat(held, starts) // (2 * ENTRIES)))
    spans = list(pairwise([*starts.tolist(), n_centroids]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = (-x @ c.T for x, c in zip(halves(_vectors(batch.column(2))), books, strict=True))
            upto = np.array([reach(a, b, counts, enough) for a, b in zip(d1, d2, strict=True)])
            nearest = d2.min(1, initial=np.inf)
            for number, (a, z) in enumerate(spans):
                mine = np.flatnonzero(d1[:, a:z].min(1) + nearest <= upto + 1e-9 * (1 + np.abs(upto)))
                for part in range(int(parts[number])):
                    at = [pa.array(np.full(len(mine), v), pa.int32()) for v in (number, part, 1, 0, 0)]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(mine)).columns, pa.array(upto[mine]), *at], kinds)

    kinds = ["rid", "vec_id", "vector", "upto", "block", "part", "role", "i", "j"]
    types = "rid long, vec_id long, vector array<double>, upto double, block int, part int, role int, i int, j int"
    asked = index.where("asks").select("rid", "vec_id", "vector").mapInArrow(walk, types)
    number = F.array(*(F.lit(int(np.searchsorted(blocks, b))) for b in block_of))[F.col("i")]
    part = F.pmod(F.xxhash64("rid"), F.array(*map(F.lit, parts.tolist()))[F.col("block")]).cast("int")
    entries = index.withColumn("block", number.cast("int")).select("rid", "vec_id", "vector", F.lit(None).cast("double").alias("upto"), "block", part.alias("part"), F.lit(0).alias("role"), "i", "j")
    dealt = entries.union(asked).repartition("block", "part").sortWithinPartitions("block", "part", "role")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, task = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (4, 5, 6)], 1)
            edges = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            for a, z in pairwise([0, *edges.tolist(), batch.num_rows]):
                if z == a:
                    continue
                rows_here, (block, part, role) = batch.slice(a, z - a), key[a].tolist()
                if role == 0:
                    if here != (block, part):
                        here, waiting, task = (block, part), [], None
                    waiting.append(rows_here)
                    continue
                if here != (block, part):
                    continue  # no entry of this block fell into this part
                if task is None:
                    task, waiting = Part(pa.Table.from_batches(waiting)), []
                for start in range(0, z - a, QUERIES):
                    queries = pa.Table.from_batches([rows_here.slice(start, QUERIES)])
                    distances = tuple(-x @ c.T for x, c in zip(halves(_vectors(queries["vector"])), books, strict=True))
                    found = [np.concatenate(v) for v in zip(*task.nearest(queries, distances, k), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["query", "query_id", "vec_id", "rid", "score"])

    found = dealt.mapInArrow(score, "query long, query_id long, vec_id long, rid long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
