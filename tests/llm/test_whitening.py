"""Spectra and whitening against numpy's eigendecomposition of the whole covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shelfloom.llm import queries, whitening
from shelfloom.llm.spectrum import Spectrum, rank_one

SF = "/root/testdata/sf0.001"


def scatter(x: np.ndarray) -> np.ndarray:
    away = x - x.mean(0)
    return away.T @ away


def restored(s: Spectrum) -> np.ndarray:
    return s.vectors * s.values @ s.vectors.T


@pytest.mark.parametrize("z", [[1.0, 2, 3, 4], [0, 2, 0, 1e-30], [0, 0, 0, 0], [1e-9, 1, 1e-9, 1]])
@pytest.mark.parametrize("values", [[0.0, 1, 2, 3], [1, 1, 1, 1], [0, 0, 1, 1 + 1e-16], [1e-12, 1e-6, 1, 1e6]])
def test_rank_one(values, z):
    """Equal and nearly equal eigenvalues and parts without weight are deflated."""
    values, z = np.array(values, float), np.array(z, float)
    new, turn = rank_one(values, z, 2.5)
    want = np.diag(values) + 2.5 * np.outer(z, z)
    size = np.abs(want).max()
    assert np.abs(turn.T @ turn - np.eye(4)).max() < 1e-13
    assert np.abs(turn * new @ turn.T - want).max() <= 1e-13 * size
    assert (np.diff(new) >= 0).all()


@pytest.mark.parametrize("kind", ["plain", "copies", "dependent", "few", "apart", "constant"])
def test_spectrum_and_join(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.1, 9, 12)
    if kind == "copies":
        x[50:250] = x[0]
    if kind == "dependent":
        x[:, 4], x[:, 5] = x[:, 3], 0
    if kind == "few":
        x = x[:5]
    if kind == "apart":
        x[100:] += 1e6
    if kind == "constant":
        x[:] = 3.0
    whole, parts = Spectrum(12, 99), [Spectrum(12, 99) for _ in range(3)]
    for k, row in enumerate(x):
        whole.take(row)
        parts[k * 3 // len(x)].take(row)
    for other in parts[1:]:
        parts[0].join(other)
    for s in (whole, parts[0]):
        assert s.count == len(x) and np.allclose(s.mean, x.mean(0), rtol=1e-12)
        assert np.abs(restored(s) - scatter(x)).max() <= 1e-11 * max(1.0, np.abs(scatter(x)).max())
        assert np.abs(s.vectors.T @ s.vectors - np.eye(s.vectors.shape[1])).max(initial=0) < 1e-12


def check(got: list, rows: list[tuple[int | None, list | None]], top: int = 16) -> None:
    """Rows of the query against numpy; components up to their sign."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    deviation = ((n * x - sums).astype(object) ** 2).sum(1)
    whitened = ((n * x - sums) / n) @ vectors / np.sqrt(values)
    assert len(got) == len(kept) * top
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    signs = None
    for (i, _), d, w in zip(kept, deviation, whitened, strict=True):
        mine = by_id[i, d]
        assert sorted(mine) == list(range(1, top + 1))
        ours = np.array([mine[c]["whitened"] for c in range(1, top + 1)])
        if signs is None:
            signs = np.sign(ours * w)
        assert np.abs(ours * signs - w).max() < 1e-8
        assert {r["n"] for r in mine.values()} == {n}
        assert np.allclose([mine[c]["explained"] for c in range(1, top + 1)], values / np.trace(y.T @ y / n), rtol=1e-9)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, SF).collect(), rows)


SCHEMA = "vec_id long, embedding array<float>, x string, number long, k long, v double"


def test_rows_that_take_no_part_and_that_repeat(spark, monkeypatch):
    """Small parts and fans, so that spectra join in several rounds."""
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "PART", 20)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(220, 20))
    rows: list[tuple] = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (500, [c + 1e-9 for c in rows[9][1]]), (900, None), (901, [1.0] * 19 + [None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20)]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], SCHEMA)
    got = whitening.whiten(table).collect()
    check(got, rows)
    odd = [(1000, [1.0, 2.0]), (1001, [])]
    again = whitening.whiten(table.union(spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in odd], SCHEMA))).collect()
    assert len(again) == len(got) and {r["vec_id"] for r in again} == {r["vec_id"] for r in got}


def test_tables_without_directions(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    same = [(k, [1.0, 2.0, 3.0], "x", 1, 2, 3.0) for k in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, SCHEMA)).collect() == []
    line = [(k, [float(k), 2.0 * k, 3.0], "x", 1, 2, 3.0) for k in range(5)]
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_bounded_rank_converges(spark):
    """With fewer vectors kept than dimensions, passes of subspace iteration still give the leading components."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 30)) * np.concatenate(([9, 7, 5], np.full(27, 0.5)))
    rows = spark.createDataFrame([(k, [float(np.float32(c)) for c in v], "x", 1, 2, 3.0) for k, v in enumerate(x)], SCHEMA)
    fits = whitening.quantised(rows)
    full, small = whitening.fit(fits, 3), whitening.fit(fits, 3, rank=6)
    assert np.allclose(full.values, small.values, rtol=1e-10)
    assert np.abs(np.abs((full.vectors * small.vectors).sum(0)) - 1).max() < 1e-10


def test_deviation_beyond_a_long():
    away = np.array([[3, 4], [2**40, 0], [2**31, 2**31]])
    assert whitening._squares(away) == [25, None, None]
    assert whitening._squares(away[:1]) == [25]
