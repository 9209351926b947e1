"""Hard negatives against brute force and SQL."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shelfloom.llm import hard_negatives, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, rid long, v string, windows int, t double, block int"


def brute(rows: list[tuple], positives: int = 5, negatives: int = 10) -> Counter:
    kept = []
    for vec_id, vector, label in rows:
        if vector and label is not None and all(c is not None and math.isfinite(c) for c in vector):
            kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * c) for c in vector]))
    out: Counter = Counter()
    v = np.array([k[2] for k in kept], np.int64)
    order = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    for a, (vec_id, label, own) in enumerate(kept):
        if vec_id is None or vec_id % 100:
            continue
        scores = (v @ np.array(own)).tolist()
        same = order((s, k[0]) for n, (s, k) in enumerate(zip(scores, kept, strict=True)) if n != a and k[1] == label)[:positives]
        other = order((s, k[0]) for s, k in zip(scores, kept, strict=True) if k[1] != label)
        for p, positive in same:
            fits = [x for x in other if 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out.update((vec_id, positive, rank, other_id, p, s) for rank, (s, other_id) in enumerate(fits, 1))
    return out


def mined(table) -> Counter:
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(map(tuple, hard_negatives.hard_negatives(hard_negatives.quantised(table, label), "vec_id % 100 = 0").collect()))


def table_rows(seed: int = 6) -> list[tuple]:
    """Clusters across labels, a cluster of equal vectors, a rare label, rows that repeat and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 20))
    x = centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 20)) * 0.5
    x[300:400] = x[300]
    x[700:720] = 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9) * rng.uniform(0.5, 2, (900, 1))
    x[300:400] = x[300]
    rows: list[tuple] = [(k, [float(np.float32(c)) for c in v], int(rng.integers(0, 10)) if rng.random() > 0.4 else 1) for k, v in enumerate(x)]
    rows[500] = (500, rows[500][1], 77)
    rows += [rows[100], rows[101], (None, rows[102][1], 3), (5, rows[103][1], None), (2000, None, 1), (2001, [1.0] * 19 + [None], 1), (2002, [float("nan")] * 20, 1), (2100, [], 2)]
    return rows


@pytest.mark.parametrize("block", [16, 1024])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", (block, 65_536))
    monkeypatch.setattr(hard_negatives, "SAMPLE", 60)  # so that some windows don't fill at once
    rows = table_rows()
    table = spark.createDataFrame([(*r, 1, "v", 2, 3.0, 4) for r in rows], SCHEMA)
    assert mined(table) == brute(rows)


def test_small_tables(spark):
    full = lambda rows: spark.createDataFrame([(*r, 1, "v", 2, 3.0, 4) for r in rows], SCHEMA)
    assert not mined(full([]))
    alone = [(0, [1.0, 0.0], 1), (100, [-1.0, 0.0], 1), (3, [0.5, 0.0], 2)]
    for rows in (alone, alone[:1], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 2), (3, [0.9, 0.0], 2)]):
        assert mined(full(rows)) == brute(rows)


@pytest.mark.parametrize("least", [-1e9, 20_000, 60_000])
def test_index_is_complete_and_leaves_out_suffixes(least):
    """All pairs at or above the thresholds come out; with a high least threshold lists lack most values, and most pairs are dropped on the way."""
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(500, 30)) * np.linspace(40, 3, 30)).astype(np.int64)
    q = (rng.normal(size=(40, 30)) * np.linspace(40, 3, 30)).astype(np.int64)
    entries = pa.table({"rid": np.arange(500), "vec_id": np.arange(500), "label": np.zeros(500, np.int64), "v": v.tolist()})
    t = np.maximum(int(max(least, -(2**40))), rng.integers(-5000, 70_000, 40))
    index = hard_negatives.Index(entries, float(least), float(np.sqrt((q**2).sum(1).max())))
    who, row, score = index.above(q, t)
    want = {(a, int(b)): int(s) for a in range(40) for b, s in enumerate(v @ q[a]) if s >= t[a]}
    assert {(int(a), int(index.rid[b])): int(s) for a, b, s in zip(who, row, score, strict=True)} == want
    held = sum(index.lists)
    assert held == 500 * 4 if least < 0 else held < 500 * 4


def test_large_entries_stay_exact():
    v = np.array([[2**30, 1], [2**30, 2], [0, 0]])
    entries = pa.table({"rid": [0, 1, 2], "vec_id": [0, 1, None], "label": [0, 0, 0], "v": v.tolist()})
    who, row, score = hard_negatives.Index(entries, -1.0, 2.0**31).above(np.array([[2**30, 1]]), np.array([2**60 + 2]))
    assert score.tolist() == [2**60 + 2]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = con.execute(queries.ORACLE_SQL["op12_hard_negatives"])
    columns = [d[0] for d in want.description]
    got = queries.op12_hard_negatives(spark, SF)
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want.fetchall())
