"""Line numbers over splits, counters of a writing pass, and incremental resolution."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfloom.operators import quality, resolution
from shelfloom.sources import files, lines


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_records_carry_the_line_they_start_on(spark, tmp_path, split):
    """Two files, line breaks and quotes inside quotes, empty lines, ragged rows: the same on one task a file and on many."""
    rng = random.Random(3)
    want = set()
    for name in ("a.csv", "b.csv"):
        text, at = "﻿Title,author,ISBN\n", 2
        for k in range(120):
            if rng.random() < 0.1:
                text, at = text + "\n", at + 1
            breaks = rng.choice([0, 0, 0, 1, 3])
            title = f'"say ""{k}""' + f"\n,part {k}" * breaks + '"' if rng.random() < 0.6 or breaks else f"plain {k}"
            ragged = rng.random() < 0.1
            text += f"{title},Someone,{k}" + (",more" if ragged else "") + "\n"
            want.add((name, at, str(k), ragged))
            at += 1 + breaks
        (tmp_path / name).write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= (2 if split == "128m" else 4)
        rows = lines.read_csv_lines(spark, str(tmp_path), ["title", "author", "isbn"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["file"].rsplit("/", 1)[1], r["line"], r["isbn"], r["ragged"]) for r in rows} == want and len(rows) == len(want)
    assert all(f'say "{r["isbn"]}"' in r["title"] or r["title"] == f"plain {r['isbn']}" for r in rows)
    errors = files.catalog_errors(spark.createDataFrame(rows)).where("array_contains(errors, 'ragged_row')")
    assert {r["line"] for r in errors.collect()} == {line for _, line, _, ragged in want if ragged}


def test_a_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title,isbn\nx,1\n")
    with pytest.raises(ValueError, match="header"):
        lines.read_csv_lines(spark, str(tmp_path), ["title", "author", "isbn"])


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    rows = spark.range(100).mapInArrow(seen, "id long").withColumn("reject_reason", F.when(F.col("id") % 10 == 0, "tens").when(F.col("id") % 7 == 0, "sevens"))
    got = {r["reason"]: r["n"] for r in quality.write_counted(rows, str(tmp_path / "out"), ["tens", "sevens", "never"]).collect()}
    assert got == {"tens": 10, "sevens": 13, "never": 0, "accepted": 77} and scans.value == 100
    assert spark.read.parquet(str(tmp_path / "out")).count() == 77
    with pytest.raises(ValueError, match="not the sum"):
        quality.write_counted(rows, str(tmp_path / "again"), ["tens"])


def test_a_second_run_touches_changed_sources_only(spark, monkeypatch):
    sources = [(1, "A tale of one", "Ann Lee"), (2, "Second story", "Bob Ray"), (3, "Third thing", "Cy Dee"), (4, "Nobody's book", "No One")]
    works = spark.createDataFrame([(11, "A tale of one", "Ann Lee", 1999, 1), (12, "Second story", "Bob Ray", None, 0)], "work_id long, title string, author string, year int, cover long")
    more = spark.createDataFrame([(23, "Third thing", "Cy Dee", 2001, 1), (21, "A tale of one", "Ann Lee", 1999, 1)], "work_id long, title string, author string, year int, cover long")
    schema = "key long, title string, author string"
    asked = []
    choose = resolution.choose_works
    monkeypatch.setattr(resolution, "choose_works", lambda s, w, margin: asked.append(sorted(r["key"] for r in s.collect())) or choose(s, w, margin))
    first = resolution.resolve(spark.createDataFrame(sources, schema), spark.createDataFrame([], resolution.RESOLVED), works, more)
    rows = files.cut(first, "first")
    assert {r["key"]: (r["work_id"], r["provider"], r["status"]) for r in rows.collect()} == {1: (11, "primary", "selected"), 2: (12, "primary", "selected"), 3: (23, "secondary", "selected"), 4: (None, None, "no_match")}
    assert asked == [[1, 2, 3, 4], [3, 4]]
    asked.clear()
    changed = [sources[0], (2, "Third thing", "Cy Dee"), sources[2]]
    second = {r["key"]: (r["work_id"], r["how"]) for r in resolution.resolve(spark.createDataFrame(changed, schema), rows.drop("how"), works, more).collect()}
    assert second == {1: (11, "carried"), 2: (23, "matched"), 3: (23, "carried")} and asked == [[2], [2]]
