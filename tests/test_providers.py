from __future__ import annotations

import json

from pyspark.sql import functions as F

from shelfloom.sources import providers


def test_volume_rows(spark):
    volumes = [
        {"id": "a", "volumeInfo": {"title": " T ", "authors": ["X", "X"], "language": "en", "publishedDate": "1999-05", "industryIdentifiers": [{"type": "ISBN_13", "identifier": "978-0306406157"}, {"type": "ISBN_10", "identifier": "x"}],
         "imageLinks": {"large": "http://evil.example/x", "small": "http://books.google.com/blank.png", "thumbnail": "http://books.google.com/t?id=1"}}},
        {"id": "b", "volumeInfo": {}}, {"volumeInfo": {"title": "x"}},
    ]
    df = spark.createDataFrame([(json.dumps(v),) for v in volumes], "j string").select(F.try_parse_json("j").alias("payload"))
    rows = providers.volume_rows(df, 2030).collect()
    first = rows[0]
    assert (first["title"], first["authors"], first["languages"], first["isbns"], first["year"], first["cover_url"]) == ("T", ["X"], ["en"], ["9780306406157"], 1999, "https://books.google.com/t?id=1")
    assert [r["reject_reason"] for r in rows] == [None, "missing_title", "missing_id"]
    assert providers.sample_rows(providers.volume_rows(df, 2030), 5).count() == 1


def test_book_metadata_and_scoring_rows(spark):
    editions = spark.createDataFrame([("1", "w", "T", ["A ", "A", "B"], "circa 1990", [0, 7], ["fantasy"], None), ("2", "v", "U", ["A"], "1990", None, None, "own")], "isbn string, work_key string, title string, authors array<string>, publish_date string, cover_ids array<bigint>, subjects array<string>, description string")
    works = spark.createDataFrame([("w", "from work", ["Poetry"])], "work_key string, description string, subjects array<string>")
    got = {r["isbn"]: r for r in providers.book_metadata(editions, works, 2030, "https://covers/").collect()}
    assert (got["1"]["author"], got["1"]["publication_year"], got["1"]["description"], got["1"]["cover_url"], got["1"]["genres"]) == ("A, B", None, "from work", "https://covers/7", ["Fantasy", "Poetry"])
    assert (got["2"]["publication_year"], got["2"]["description"], got["2"]["cover_url"]) == (1990, "own", None)
    c = spark.createDataFrame([("r", "1", "T", None, ["A"], None, "Hardcover", None, "id:1", None, 1990)], "record_id string, isbn13 string, title string, subtitle string, authors array<string>, language string, format string, cover_url string, cover_reference string, description string, year int")
    row = providers.scoring_rows(c).first()
    assert row["has_cover"] and row["languages"] == [] and row["author"] == "A"
