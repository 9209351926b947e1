"""Whitening of integer vectors by an incremental eigendecomposition.

Each task takes the vectors of its part into a spectrum (spectrum.py), one rank-one change of a secular
equation at a time; spectra are joined in a tree, a bounded number in a task. The joined eigenvectors are a
basis in which a last pass over all vectors gathers the covariance (Rayleigh-Ritz). Where the basis spans all
dimensions one such pass gives the eigenvectors to double precision; where a bounded rank was kept, passes go
on as subspace iteration until the residuals are small.

Through the driver go numbers of the order dimensions x rank only; partial sums meet in Spark's aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import Spectrum
from .storage import discard, staged

#: Vectors that one task takes into a spectrum; spectra that one task joins; entries that are held as doubles at a time.
PART, FAN, ENTRIES = 2_048, 16, 1 << 20
#: Components below this share of the trace have no direction in double precision.
LEAST = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n different vectors with sums per dimension; eigenvectors (columns) and eigenvalues by falling value; trace; identity_error."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        return self.n * x - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.vectors / np.sqrt(self.values)


def quantised(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, a list of longs floor(scale * entry) + offset. Null vectors and ones with null or non-finite entries go, and so do
    empty ones and those of another length than most (of equally many, the shorter stay)."""
    entries = F.col(vector).cast("array<double>")
    fine = F.forall(entries, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & (F.size(entries) > 0)
    rows = vectors.where(F.col(vector).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(entries, lambda v: F.floor(v * scale) + F.lit(offset)).alias("x"))
    rows = staged(rows, "quantised")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch in runs of bounded size with the column's lists as a matrix of longs."""
    if batch.num_rows:
        size = len(batch.column(column)[0])
        step = max(1, ENTRIES // size)
        for start in range(0, batch.num_rows, step):
            some = batch.slice(start, step)
            yield some, some.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows (x) of arrays of one shape that `partial` gives for blocks of them, flat."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _slices(batch, 0):
                total = partial(x) + (0 if total is None else total)
        if total is not None:
            flat = np.asarray(total, dtype).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    parts = rows.mapInArrow(run, f"k long, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).toArrow().sort_by("k")
    return parts["v"].to_numpy()


def _spectra(fit: DataFrame, base: np.ndarray, parts: int, rank: int) -> DataFrame:
    """One row for each of `parts` parts of the vectors: number, count, mean (less base), values, vectors (one after the other)."""
    size = len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(size, rank)
        for batch in batches:
            for _, x in _slices(batch, 0):
                for row in (x - base).astype(np.float64):
                    spectrum.take(row)
        if spectrum.count:
            yield _row(TaskContext.get().partitionId(), spectrum)

    return fit.repartition(parts, F.xxhash64("x")).mapInArrow(run, SPECTRUM)


SPECTRUM = "number long, count long, mean array<double>, values array<double>, vectors array<double>"


def _row(number: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (s.mean, s.values, s.vectors.T.ravel())]
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([s.count]), *lists], ["number", "count", "mean", "values", "vectors"])


def _restored(row: dict, rank: int) -> Spectrum:
    s = Spectrum(len(row["mean"]), rank)
    s.count, s.mean, s.values = row["count"], np.array(row["mean"]), np.array(row["values"])
    s.vectors = np.array(row["vectors"]).reshape(-1, len(s.mean)).T.copy()
    return s


def _joined(spectra: DataFrame, parts: int, rank: int) -> DataFrame:
    """Spectra joined FAN at a time: of `parts` numbers remain parts / FAN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["number"] // FAN != group:
                    if held:
                        yield _row(group, held)
                    group, held = row["number"] // FAN, Spectrum(len(row["mean"]), rank)
                held.join(_restored(row, rank))
        if held:
            yield _row(group, held)

    group = F.floor(F.col("number") / FAN)
    return spectra.repartition(math.ceil(parts / FAN), group).sortWithinPartitions(group, "number").mapInArrow(run, SPECTRUM)


def fit(rows: DataFrame, components: int = 16, rank: int = 128, tolerance: float = 1e-11) -> Whitening | None:
    """The whitening of the different vectors x of rows, each counted once; None if there are none.

    At most `components` eigenvectors, by falling eigenvalue, and only those above LEAST of the trace, so that
    one vector alone or equal entries have none. `rank` bounds what spectra keep. Covariances have divisor n.
    """
    vectors = staged(rows.select("x").distinct(), "fit")
    n = vectors.count()
    if not n:
        return None
    sums = _summed(vectors, lambda x: x.sum(0), "long")
    size = len(sums)
    parts = max(math.ceil(n / PART), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 256)))
    # spectra are of vectors less their mean's whole part, so that no digits go to a common offset
    spectra = staged(_spectra(vectors, sums // n, parts, rank), "spectra")
    parts = max(r["number"] for r in spectra.agg(F.max("number").alias("number")).collect()) + 1
    while parts > 1:
        last, spectra = spectra, staged(_joined(spectra, parts, rank), "spectra")
        discard(last)
        parts = math.ceil(parts / FAN)
    joined = _restored(spectra.first().asDict(), rank)
    basis = np.linalg.qr(joined.vectors[:, ::-1])[0] if joined.vectors.shape[1] else np.zeros((size, 0))

    def gather(x: np.ndarray) -> np.ndarray:
        y = (n * x - sums) / n
        return np.append((y.T @ (y @ basis)).ravel(), (y * y).sum())

    values, ritz, trace = np.zeros(0), basis, 0.0
    for _ in range(200 if basis.shape[1] else 0):
        flat = _summed(vectors, gather, "double") / n
        times, trace = flat[:-1].reshape(size, -1), float(flat[-1])
        small = basis.T @ times
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, times @ turn
        top = min(components, len(values))
        if np.abs(image[:, :top] - ritz[:, :top] * values[:top]).max() <= tolerance * values[0]:
            break
        basis = np.linalg.qr(image)[0]
    top = int((values[:components] > LEAST * trace).sum()) if trace > 0 else 0
    model = Whitening(n, sums, ritz[:, :top], values[:top], trace, 0.0)
    if top:

        def moments(x: np.ndarray) -> np.ndarray:
            w = model.project(x)
            return np.concatenate((w.sum(0), (w.T @ w).ravel()))

        flat = _summed(vectors, moments, "double") / n
        mean, second = flat[:top], flat[top:].reshape(top, top)
        error = np.abs(second - np.outer(mean, mean) - np.eye(top)).max()
        model = Whitening(n, sums, ritz[:, :top], values[:top], trace, float(error))
    discard(vectors, spectra)
    return model


def _squares(away: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null beyond a long."""
    if away.shape[1] * float(np.abs(away.astype(np.float64)).max(initial=0)) ** 2 < 2**62:
        return (away * away).sum(1).tolist()
    exact = [sum(v * v for v in row) for row in away.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """rows (vec_id, x) with their values: one row per vector and component.

    vec_id, component (from 1), n, deviation (the sum over dimensions of (n * x - sums) squared; null beyond
    a long), whitened, explained (the component's share of the trace), identity_error (the largest absolute
    entry of the whitened fit list's covariance less the identity).
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _slices(batch, 1):
                m = len(x)
                at = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    some.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                    pa.array(_squares(model.centred(x)), pa.int64()).take(at), pa.array(model.project(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema_names)

    schema_names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.select("vec_id", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, rank: int = 128) -> DataFrame:
    """Vectors (vec_id, embedding) fitted and whitened, as `quantised`, `fit` and `whitened` say.

    Rows may repeat: each comes out, the fit list has each different vector once. Null vec_ids stay null.
    Other columns are ignored; an empty table gives an empty one.
    """
    rows = quantised(vectors, scale, offset)
    return whitened(rows, fit(rows, components, rank))
