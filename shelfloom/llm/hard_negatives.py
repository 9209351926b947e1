"""Hard negatives by threshold joins in the manner of L2AP.

Vectors are dealt into blocks, and each task keeps an inverted index of one: dimension by dimension the rows
that hold it. A row's last dimensions are left out while the norm of that suffix, times the largest norm of an
anchor, stays below the smallest threshold asked for: they alone can't make a pair. Anchors stream past,
partial scores are accumulated over the lists, and what even the remaining norms can't lift over the anchor's
threshold is dropped on the way; what is left is scored in full.

A threshold starts where a sample suggests that a window fills; where it doesn't, the threshold is lowered and
that anchor asks again, until the window is full or nothing lies below. What a window holds above the
threshold is complete, so that results don't depend on the sample. Scores are sums of products of integers, exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

#: Least and most rows of a block; anchors that are scored at a time.
BLOCK, ANCHORS = (1_024, 65_536), 64
#: Dimensions between two looks at what can be dropped; share of pairs below which those left are scored one by one.
STRIDE, SPARSE = 8, 0.05
#: Vectors from which first thresholds are estimated; results that a threshold should let through for each one asked for; how much deeper the next one goes.
SAMPLE, SPARE, DEEPER = 2_048, 3, 8
#: From this round on nothing is held back.
LAST = 3
#: Below every score, and above every share of rounding in a bound.
LOWEST, SLACK = -(1 << 62), 1e-9


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding, label) to rid, vec_id, label, v: floor(scale * entry) as longs.

    Rows with a null label or vector, null or non-finite entries, and vectors empty or of another length than
    most (of equally many, the shorter stay) take no part. rid numbers rows, which may repeat.
    """
    entries = F.col("embedding").cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & (F.size(entries) > 0)
    rows = vectors.where(F.col("embedding").isNotNull() & fine).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(entries, lambda c: F.floor(c * scale)).alias("v"))
    rows = staged(rows.where("label is not null"), "quantised")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Index:
    """The inverted index of a block, for thresholds of at least `least` and anchors of at most `norm`.

    Rows stand by the length of their lists, so that the list of a run of dimensions is the first rows' values.
    """

    def __init__(self, entries: pa.Table, least: float, norm: float):
        v = _matrix(entries["v"])
        self.size = v.shape[1]
        self.order = np.argsort(-(v.astype(np.float64) ** 2).sum(0), kind="stable")  # dimensions that weigh most come first
        v = v[:, self.order]
        rest = _suffix_norms(v)
        # a suffix that can't reach the least threshold by itself is in no list; lists end at a multiple of STRIDE
        held = (rest * norm * (1 + SLACK) >= least).sum(1).clip(0, self.size) if least > 0 else np.full(len(v), self.size)
        held = -(-held // STRIDE)
        by = np.argsort(-held, kind="stable")
        self.v, self.rest, held = v[by], rest[by], held[by]
        #: How many rows are in the lists of each run of STRIDE dimensions.
        self.lists = np.searchsorted(-held, -np.arange(-(-self.size // STRIDE) + 1), "left").tolist()
        self.rid, self.label = entries["rid"].to_numpy()[by], entries["label"].to_numpy()[by]
        ids = entries["vec_id"].combine_chunks().take(pa.array(by))
        self.no_id, self.vec_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.most = float(np.abs(v).max(initial=0))

    def above(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of anchor and row with a score of at least the anchor's threshold, and their scores."""
        q = anchors[:, self.order]
        kind = np.float64 if self.size * self.most * float(np.abs(q).max(initial=0)) < 2**52 else np.int64  # exact either way
        after, least = _suffix_norms(q), thresholds.astype(np.float64)[:, None]
        scores = np.zeros((len(q), self.lists[0]), kind)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for number, n in enumerate(self.lists[:-1]):
            end, going = min((number + 1) * STRIDE, self.size), self.lists[number + 1]
            run = slice(number * STRIDE, end)
            scores[:, :n] += q[:, run].astype(kind) @ self.v[:n, run].T.astype(kind)
            part = scores[:, :n]
            alive = part + after[:, end][:, None] * self.rest[:n, end] + SLACK * (np.abs(part) + after[:, :1] * self.rest[:n, 0]) >= least
            if not going or alive[:, :going].mean() < SPARSE:
                found.append(np.nonzero(alive))
                break
            who, row = np.nonzero(alive[:, going:])  # their lists end here
            found.append((who, row + going))
        who, row = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        score = np.concatenate([np.zeros(0, np.int64), *((q[who[k : k + 65_536]] * self.v[row[k : k + 65_536]]).sum(1) for k in range(0, len(who), 65_536))])
        enough = score >= thresholds[who]
        return who[enough], row[enough], score[enough]

    def first(self, row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Where the k highest scores are, ties by smaller vec_id, none last, then by rid."""
        return np.lexsort((self.rid[row], self.vec_id[row], self.no_id[row], -score))[:k]


def _suffix_norms(v: np.ndarray) -> np.ndarray:
    """The norm of each row from each dimension on; 0 after the last."""
    squares = v.astype(np.float64) ** 2
    return np.sqrt(np.concatenate((np.cumsum(squares[:, ::-1], 1)[:, ::-1], np.zeros((len(v), 1))), 1))


Choose = Callable[[Index, dict, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]
FOUND = ["anchor", "window", "rid", "vec_id", "score"]


def _ask(rows: DataFrame, total: int, asked: DataFrame, choose: Choose) -> DataFrame:
    """asked (rid, vec_id, label, v, windows, least, t) against all rows in blocks: anchor, window, rid, vec_id, score.

    What a block gives for an anchor is what `choose` takes of the rows that reach its threshold.
    """
    spark = rows.sparkSession
    bounds = asked.agg(F.min("t").alias("t"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    least, norm = float(bounds["t"]), float(bounds["square"]) ** 0.5
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-total // min(BLOCK[1], max(BLOCK[0], -(-total // (2 * cores))))))
    mine = rows.select(F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "rid", "vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("windows"), F.lit(None).cast("bigint").alias("t"))
    theirs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "rid", "vec_id", "label", "v", "windows", "t")
    tasks = min(blocks, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = mine.union(theirs).repartition(tasks, "block").sortWithinPartitions("block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, waiting, index = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (0, 1)], 1)
            edges = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            for a, z in pairwise([0, *edges.tolist(), batch.num_rows]):
                if z == a:
                    continue
                block, role = key[a].tolist()
                if here != block:
                    here, waiting, index = block, [], None
                if role == 0:
                    waiting.append(batch.slice(a, z - a))
                    continue
                if index is None and waiting:
                    index, waiting = Index(pa.Table.from_batches(waiting), least, norm), []
                for start in range(a, z if index else a, ANCHORS):
                    some = batch.slice(start, min(ANCHORS, z - start))
                    who, row, score = index.above(_matrix(some.column("v")), some.column("t").to_numpy())
                    anchors = some.select(["rid", "label", "windows"]).to_pylist()
                    parts = np.argsort(who, kind="stable")
                    limits = np.searchsorted(who[parts], np.arange(len(anchors) + 1)).tolist()
                    out: list[tuple[np.ndarray, ...]] = []
                    for k, anchor in enumerate(anchors):
                        at = parts[limits[k] : limits[k + 1]]
                        for window, best in choose(index, anchor, row[at], score[at]):
                            r, s = row[at][best], score[at][best]
                            ids = np.ma.array(index.vec_id[r], mask=index.no_id[r])
                            out.append((np.full(len(r), anchor["rid"]), np.full(len(r), window), index.rid[r], ids, s))
                    if out:
                        columns = [pa.array(np.concatenate([o[c] for o in out])) for c in (0, 1, 2)]
                        ids = pa.array(np.concatenate([o[3].data for o in out]), mask=np.concatenate([np.ma.getmaskarray(o[3]) for o in out]))
                        yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(np.concatenate([o[4] for o in out]))], FOUND)

    return dealt.mapInArrow(run, "anchor long, window long, rid long, vec_id long, score long")


def _sampled(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rid, label and v of about SAMPLE rows, never over twice as many."""
    some = rows.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, total // SAMPLE))) == 0).limit(2 * SAMPLE).toArrow()
    return some["rid"].to_numpy(), some["label"].to_numpy(), _matrix(some["v"])


def _thresholds(anchors: DataFrame, sample: tuple[np.ndarray, np.ndarray, np.ndarray], total: int, wanted: int, level: int, same: bool, window: tuple[int, int]) -> DataFrame:
    """anchors with t: the score that about SPARE * DEEPER ** level times the wanted number of rows should reach, by the sample.

    For rows of the same label, or for those of others in each of the anchor's windows, whichever is lowest.
    """
    rid, label, v = sample
    depth = max(1, round(SPARE * DEEPER**level * wanted * len(rid) / total))
    names = ["rid", "vec_id", "label", "v", "windows", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(start, ANCHORS)
                scores = _matrix(batch.column("v")) @ v.T
                out = []
                for k, anchor in enumerate(batch.select(["rid", "label", "windows", "least"]).to_pylist()):
                    if level >= LAST:
                        out.append(anchor["least"])
                        continue
                    mine = scores[k][((label == anchor["label"]) == same) & (rid != anchor["rid"])]
                    within = [mine] if same else [mine[100 * mine <= window[1] * w] for w in anchor["windows"]]
                    depths = [np.partition(x, len(x) - depth)[len(x) - depth] if len(x) >= depth else anchor["least"] for x in within]
                    out.append(max(anchor["least"], int(min(depths))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], [*names, "t"])

    return anchors.select(*names).mapInArrow(run, "rid long, vec_id long, label long, v array<bigint>, windows array<bigint>, least long, t long")


def _filled(rows: DataFrame, total: int, anchors: DataFrame, wanted: int, same: bool, window: tuple[int, int], choose: Choose) -> DataFrame:
    """For each anchor and window the `wanted` first rows: anchor, window, rank, rid, vec_id, score.

    anchors (rid, vec_id, label, v, windows, least): an anchor is done when each of its windows has `wanted`
    rows above its threshold, or when the threshold is the least that a window asks for.
    """
    sample = _sampled(rows, total)
    waiting, results, level = anchors, [], 0
    order = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    while True:
        asked = staged(_thresholds(waiting, sample, total, wanted, level, same, window), "asked")
        if asked.isEmpty():
            break
        found = _ask(rows, total, asked, choose)
        best = staged(found.withColumn("rank", order).where(F.col("rank") <= wanted), "best")
        full = best.where(F.col("rank") == wanted).groupBy("anchor").agg(F.count("*").alias("full"))
        state = asked.join(full.withColumnRenamed("anchor", "rid"), "rid", "left")
        done = (F.col("t") <= F.col("least")) | (F.coalesce("full", F.lit(0)) >= F.size("windows"))
        results.append(best.join(state.where(done).select(F.col("rid").alias("anchor")), "anchor"))
        waiting = state.where(~done).select("rid", "vec_id", "label", "v", "windows", "least")
        level += 1
    out = results[0] if results else rows.sparkSession.createDataFrame([], "anchor long, window long, rid long, vec_id long, score long, rank int")
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """rows (rid, vec_id, label, v) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows that is_anchor selects. An anchor's positives are its first other rows of the same label,
    its negatives for each of them the first rows of other labels with window[0] * positive_score <= 100 *
    score <= window[1] * positive_score: higher scores first, ties by smaller vec_id, none last. Rows may
    repeat; each counts, also as an anchor. A positive without such rows gives none; an empty table gives an
    empty one. Scores must be within a long.
    """
    low, high = window
    rows = staged(rows, "rows")
    total = rows.count()
    every = F.array(F.lit(0).cast("bigint"))
    anchors = rows.where(F.coalesce(F.expr(is_anchor), F.lit(False)))
    first = anchors.select("rid", "vec_id", "label", "v", every.alias("windows"), F.lit(LOWEST).alias("least"))

    def same_label(index: Index, anchor: dict, row: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        fits = np.flatnonzero((index.label[row] == anchor["label"]) & (index.rid[row] != anchor["rid"]))
        yield 0, fits[index.first(row[fits], score[fits], positives)]

    def other_labels(index: Index, anchor: dict, row: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        other = np.flatnonzero(index.label[row] != anchor["label"])
        for w in anchor["windows"]:
            fits = other[(low * w <= 100 * score[other]) & (100 * score[other] <= high * w)]
            yield w, fits[index.first(row[fits], score[fits], negatives)]

    if not total:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    near = staged(_filled(rows, total, first, positives, True, window, same_label).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # a window is [low, high] % of a positive's score: below zero it is empty
    windows = near.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"), F.expr(f"(min(positive_score) * {low} + 99) div 100").alias("least"))
    second = anchors.join(windows.withColumnRenamed("anchor", "rid"), "rid").select("rid", "vec_id", "label", "v", "windows", "least")
    far = _filled(rows, total, second, negatives, False, window, other_labels)
    far = far.select("anchor", F.col("window").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = near.join(far, ["anchor", "positive_score"]).join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
