"""Payloads of metadata providers, read as tables of JSON, to candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import editions as ed
from ..functions.isbn import isbn13
from ..functions.text import clean
from .dumps import field

#: Image sizes from the best on, hosts that serve them, paths that stand for no image.
IMAGE_SIZES = ("extraLarge", "large", "medium", "small", "thumbnail", "smallThumbnail")
IMAGE_HOSTS = ("books.google.com", "books.googleusercontent.com", "lh3.googleusercontent.com")
NO_IMAGE = r"(?i)placeholder|no[-_ ]?cover|not[-_ ]?found|blank"


def image_url(links: Column) -> Column:
    """The largest usable image of a map of sizes, as https."""
    out = []
    for size in IMAGE_SIZES:
        url = F.try_element_at(links, F.lit(size))
        part = lambda what, url=url: F.try_parse_url(url, F.lit(what))
        good = part("HOST").isin(*IMAGE_HOSTS) & part("PROTOCOL").isin("http", "https") & ~F.regexp_like(F.coalesce(part("PATH"), F.lit("")), F.lit(NO_IMAGE))
        out.append(F.when(good, F.regexp_replace(url, "^http:", "https:")))
    return F.coalesce(*out)


def _texts(name: str) -> Column:
    """A list of texts, or one text as a list, cleaned and distinct."""
    many, one = field(name, "array<string>"), field(name)
    values = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(values, lambda x: clean(x)), lambda x: x.isNotNull()))


def volume_rows(payloads: DataFrame, latest_year: int) -> DataFrame:
    """Volumes (payload variant) as candidates; a row without id or title has a reason."""
    ids = F.filter(F.coalesce(field("volumeInfo.industryIdentifiers", "array<struct<type string, identifier string>>"), F.array().cast("array<struct<type string, identifier string>>")), lambda x: x["type"] == "ISBN_13")
    isbns = F.array_distinct(F.filter(F.transform(ids, lambda x: isbn13(x["identifier"])), lambda x: x.isNotNull()))
    date = clean(field("volumeInfo.publishedDate"))
    rows = payloads.select(
        clean(field("id")).alias("record_id"), clean(field("volumeInfo.title")).alias("title"), clean(field("volumeInfo.subtitle")).alias("subtitle"), _texts("volumeInfo.authors").alias("authors"),
        _texts("volumeInfo.language").alias("languages"), isbns.alias("isbns"), date.alias("publish_date"), dates.single_year(date, latest_year).alias("year"),
        image_url(field("volumeInfo.imageLinks", "map<string, string>")).alias("cover_url"), clean(field("volumeInfo.description")).alias("description"), _texts("volumeInfo.categories").alias("subjects"),
    )
    return rows.withColumn("reject_reason", F.when(F.col("record_id").isNull(), "missing_id").when(F.col("title").isNull(), "missing_title"))


def scoring_rows(candidates: DataFrame) -> DataFrame:
    """Canonical candidates (record_id, isbn13, title, subtitle, authors, language, format, cover_url, cover_reference, description, year) as score_editions reads them."""
    return candidates.select(
        "record_id", F.col("isbn13").alias("isbn"), "title", "subtitle", F.get("authors", F.lit(0)).alias("author"), "format",
        F.filter(F.array("language"), lambda x: x.isNotNull()).alias("languages"), F.coalesce("cover_url", "cover_reference").isNotNull().alias("has_cover"),
        F.col("description").isNotNull().alias("has_description"), "year",
    )


def book_metadata(editions: DataFrame, works: DataFrame, latest_year: int, cover_base: str) -> DataFrame:
    """Editions (isbn, work_key, title, authors, publish_date, cover_ids, subjects, description) with what their work adds.

    A year only where the date names one without doubt.
    """
    w = works.select(F.col("work_key").alias("_w"), F.col("description").alias("_text"), F.col("subjects").alias("_subjects"))
    rows = editions.join(w, editions["work_key"] == w["_w"], "left")
    none = F.array().cast("array<string>")
    sure = ~F.regexp_like("publish_date", F.lit(r"(?i)[?\[\]]|circa|about|before|after|\bc\."))
    out = rows.select(
        "isbn", clean(F.col("title")).alias("title"), F.array_join(F.array_distinct(F.transform("authors", lambda x: F.trim(x))), ", ").alias("author"),
        F.when(sure, dates.single_year(F.col("publish_date"), latest_year)).alias("publication_year"), F.coalesce("description", "_text").alias("description"),
        ed.cover_url(F.col("cover_ids"), cover_base).alias("cover_url"), ed.subject_genres(F.concat(F.coalesce("subjects", none), F.coalesce("_subjects", none))).alias("genres"),
    )
    return out.where(F.col("title").isNotNull() & (F.col("author") != ""))


def sample_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n complete rows of a dump, for trying a job out."""
    return rows.where("reject_reason is null").limit(n)
