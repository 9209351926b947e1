from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfloom.functions import dates, editions, isbn, text
from shelfloom.operators import matching


def values(spark, column, rows):
    """What a function of a column gives for each of the rows."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v")).alias("out")).collect()]


def plain_fold(value: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", " ".join(value.split())) if not "̀" <= c <= "ͯ")
    return flat.lower()


def test_fold_equals_unicode_decomposition_where_it_gives_ascii(spark):
    rows = [chr(c) for c in range(0xC0, 0x2500) if (f := plain_fold(chr(c))) and f.isascii() and f.isalnum()]
    assert values(spark, text.fold, rows) == [plain_fold(r) for r in rows]


def test_title_and_author_keys(spark):
    assert values(spark, text.title_key, ["The  Café’s End", "A an b", None, "  ", "ﬁne №5"]) == ["cafes end", "an b", "", "", "fine no5"]
    assert values(spark, text.author_key, ["Müller, Jörg", "J. R. R. Tolkien", "O'Neil"]) == ["jorg muller", "j r r tolkien", "oneil"]
    assert values(spark, text.work_title_key, ["Dune (1st ed.)", "Dune (graphic novel)", "Dune"]) == ["dune", "dune graphic novel", "dune"]
    assert values(spark, text.stable_key, ["Sci-Fi & More!"]) == ["sci-fi-more"]


def test_isbn(spark):
    assert values(spark, isbn.isbn13, ["978-0-306-40615-7", "9780306406158", "123", None]) == ["9780306406157", None, None, None]
    assert values(spark, isbn.isbn10_to_13, ["0-306-40615-2", "080442957X", "0306406153"]) == ["9780306406157", "9780804429573", None]


def test_dates(spark):
    assert [str(x) if x else None for x in values(spark, dates.strict_day, ["2024-02-29", "2023-02-29", "2024-1-1", None])] == ["2024-02-29", None, None, None]
    assert values(spark, lambda v: dates.year_in(v, 2030), ["1999", "1999-05", "May 3, 2001", "3 May 2001", "c. 1990", "0999", "1999-13"]) == [1999, 1999, 2001, 2001, None, None, None]
    assert values(spark, lambda v: dates.single_year(v, 2030), ["1999", "1999-2001", "May 1999, 1999"]) == [1999, None, 1999]
    days = values(spark, lambda v: dates.month_grid(v.cast("date")), ["2024-09-15"])[0]
    assert len(days) == 42 and str(days[0]) == "2024-08-26"


@pytest.mark.parametrize(
    ("format", "title", "kind"),
    [("Audio CD", "x", "audiobook"), ("Kindle", "x", "ebook"), (None, "Big Large Print Book", "large_print"), (None, "3 books set", "boxed_set"), (None, "Calendar Girl", None),
     (None, "2024 wall calendar", "calendar"), (None, "Advent calendar (a novel)", None), ("cards", "x", "cards"), ("paperback", "x", None)],
)
def test_product_kind(spark, format, title, kind):
    df = spark.createDataFrame([(format, title)], "f string, t string")
    assert df.select(editions.product_kind(F.col("f"), F.col("t"), F.lit(None).cast("string"))).first()[0] == kind


def test_category_genres(spark):
    df = spark.createDataFrame([(["Space Opera", "Epic Fantasy"],), (["Historical Fiction"],), (["Fiction"],), ([None],), (["Cooking"],)], "c array<string>")
    got = [r[0] for r in df.select(editions.category_genres(F.col("c"))).collect()]
    assert got == [["space-opera", "science-fiction", "epic-fantasy"], ["historical-fiction"], ["fiction"], [], []]


def test_title_and_author_match(spark):
    df = spark.createDataFrame(
        [("Dune: A Novel", "Dune", "exactly"), ("The Left Hand of Darkness", "Left Hand Darkness", "x"), ("It", "It Ends", "x"), ("One Two Three Four Five", "One Two Three Four", "x"), ("", "x", "x")],
        "a string, b string, c string",
    )
    got = [r[0] for r in df.select(matching.title_match(F.col("a"), F.col("b"))["kind"]).collect()]
    assert got == ["subtitle_omitted", "token_exact", "generic_title", "strong_tokens", "missing"]
    names = spark.createDataFrame([("Jane Doe", "J Doe"), ("Jane Doe", "Doe, Jane"), ("Jane Doe", "Jim Doe"), ("Jane Doe", None)], "a string, b string")
    assert [r[0] for r in names.select(matching.author_match(F.col("a"), F.col("b"))["kind"]).collect()] == ["strong_name", "exact", "mismatch", "missing"]
