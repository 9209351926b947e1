"""Genre taxonomy, and what it plans for a catalogue's books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import work_identity
from ..sources.files import cut
from .catalog import link_changes
from .quality import all_reasons

SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def taxonomy_rows(rows: DataFrame) -> DataFrame:
    """rows (name, slug) with all their errors; names are compared without case."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out = rows.withColumns({"name": F.trim("name"), "slug": F.trim("slug")}).withColumn("low", F.lower("name"))
    slugs = out.groupBy("slug").agg(F.count("*").alias("n_slug"))
    names = out.groupBy("low").agg(F.count("*").alias("n_name"))
    out = out.join(slugs, "slug", "left").join(names, "low", "left")
    return out.select("name", "slug", all_reasons([
        ("missing_name", empty("name")), ("missing_slug", empty("slug")), ("invalid_slug", ~empty("slug") & ~F.regexp_like("slug", F.lit(SLUG))),
        ("duplicate_slug", ~empty("slug") & (F.col("n_slug") > 1)), ("duplicate_name", ~empty("name") & (F.col("n_name") > 1)),
    ]).alias("errors"))


def mapping_rows(rows: DataFrame, taxonomy: DataFrame, catalog: DataFrame, separator: str = ";", most: int = 3) -> DataFrame:
    """rows (isbn, genres) with slugs and all their errors: 1 to `most` different known slugs, each ISBN once and in the catalogue.

    ISBNs of the catalogue that no row maps follow as rows of their own.
    """
    slugs = F.filter(F.transform(F.split(F.coalesce("genres", F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")
    # written once, so that a row has the same number wherever it is read again
    out = cut(rows.select("isbn", slugs.alias("slugs"), F.monotonically_increasing_id().alias("row")), "mapping")
    known = out.select("row", F.explode("slugs").alias("slug")).join(taxonomy.select("slug", F.lit(1).alias("known")).distinct(), "slug", "left")
    unknown = known.where("known is null").select("row").distinct().withColumn("unknown", F.lit(True))
    times = out.groupBy("isbn").agg(F.count("*").alias("times"))
    books = catalog.select("isbn", F.lit(True).alias("in_catalog")).distinct()
    out = out.join(unknown, "row", "left").join(times, "isbn", "left").join(books, "isbn", "left")
    judged = out.select("isbn", "slugs", all_reasons([
        ("genre_count", ~F.size("slugs").between(1, most)), ("repeated_genre", F.size(F.array_distinct("slugs")) < F.size("slugs")), ("unknown_genre", F.col("unknown")),
        ("duplicate_isbn", F.col("times") > 1), ("not_in_catalog", F.col("in_catalog").isNull()),
    ]).alias("errors"))
    unmapped = books.join(rows.select("isbn"), "isbn", "left_anti")
    return judged.unionByName(unmapped.select("isbn", F.array().cast("array<string>").alias("slugs"), F.array(F.lit("unmapped")).alias("errors")))


def match_books(entries: DataFrame, books: DataFrame) -> DataFrame:
    """entries (isbn, title, author) with the book (id, isbn, title, author) each means, by ISBN, else by work.

    match: exact_isbn, work_identity, ambiguous (several books of the work), missing; conflict where more
    than one entry claims the book.
    """
    mine = entries.withColumn("identity", work_identity(F.col("title"), F.col("author")))
    exact = books.where("isbn is not null").select("isbn", F.col("id").alias("exact_id"))
    works = books.select(work_identity(F.col("title"), F.col("author")).alias("identity"), "id").where("identity is not null").groupBy("identity").agg(F.count("*").alias("n"), F.min("id").alias("work_id"))
    rows = mine.join(exact, "isbn", "left").join(works, "identity", "left")
    match = F.when(F.col("exact_id").isNotNull(), "exact_isbn").when(F.col("n") == 1, "work_identity").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    book = F.when(match == "exact_isbn", F.col("exact_id")).when(match == "work_identity", F.col("work_id"))
    rows = rows.select("isbn", match.alias("match"), book.alias("book_id"))
    # entries without a book are dealt by ISBN, not into one task
    claims = F.count("book_id").over(Window.partitionBy("book_id", F.when(F.col("book_id").isNull(), F.col("isbn"))))
    return rows.withColumn("conflict", claims > 1)


def taxonomy_plan(taxonomy: DataFrame, genres: DataFrame) -> DataFrame:
    """taxonomy (name, slug) against genres (name, slug): existing, create, slug_conflict (other name), name_conflict (other slug)."""
    by_slug = genres.select("slug", F.lower("name").alias("its_name"))
    by_name = genres.groupBy(F.lower("name").alias("low")).agg(F.min("slug").alias("other_slug"))
    rows = taxonomy.withColumn("low", F.lower("name")).join(by_slug, "slug", "left").join(by_name, "low", "left")
    action = F.when(F.col("its_name") == F.col("low"), "existing").when(F.col("its_name").isNotNull(), "slug_conflict").when(F.col("other_slug").isNotNull(), "name_conflict").otherwise("create")
    return rows.select("name", "slug", action.alias("action"))


def genre_plan(matches: DataFrame, mapping: DataFrame, present: DataFrame) -> DataFrame:
    """Links to add and to remove (book_id, genre, change) for books that one entry means; mapping: isbn, slugs; present: book_id, genre."""
    meant = matches.where("book_id is not null and not conflict").select("isbn", "book_id")
    wanted = meant.join(mapping.select("isbn", F.explode("slugs").alias("genre")), "isbn").select("book_id", "genre").distinct()
    return link_changes(wanted, present)


def coverage(book_genres: DataFrame, books: DataFrame) -> DataFrame:
    """(what, name, n): books with 0, 1, 2, 3 and more genres, and books of each genre."""
    per_book = books.select(F.col("id").alias("book_id")).join(book_genres.select("book_id", "genre").distinct(), "book_id", "left")
    sizes = per_book.groupBy("book_id").agg(F.count("genre").alias("k")).groupBy(F.when(F.col("k") > 3, "more").otherwise(F.col("k").cast("string")).alias("name")).agg(F.count("*").alias("n"))
    names = book_genres.sparkSession.createDataFrame([(x,) for x in ("0", "1", "2", "3", "more")], "name string")
    sizes = names.join(sizes, "name", "left").select(F.lit("books_with").alias("what"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    genres = per_book.where("genre is not null").groupBy(F.col("genre").alias("name")).agg(F.count("*").alias("n"))
    return sizes.unionByName(genres.select(F.lit("books_of").alias("what"), "name", "n"))
