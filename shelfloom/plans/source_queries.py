"""Queries over files that the tables are written to, and over provider payloads, feeds and snapshots made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, editions, isbn
from ..operators import catalog, consolidate, genres, matching, publisher, quality, readers
from ..sources import dumps, files, lines, providers
from ..sources.index import SnapshotIndex
from ..sources.keyed import KeyedTable
from .reader_queries import FINGERPRINT
from .registry import query
from .views import Tables

def nth() -> Column:
    """The number of a book."""
    return F.col("id")


def by_rest(n: int, cases: dict[int, object], otherwise: object) -> Column:
    """A value by id % n."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rest, value in cases.items():
        out = out.when(nth() % n == rest, value)
    return out.otherwise(otherwise)


def counts(rows: DataFrame, column: str = "errors") -> DataFrame:
    """Rows by their list of errors."""
    return rows.groupBy(F.array_join(column, ",").alias(column)).agg(F.count("*").alias("n"))


def errors_sql(rules: list[tuple[str, str]], rows: str) -> str:
    parts = ", ".join(f"case when {condition} then '{code}' end" for code, condition in rules)
    return f"select errors, count(*) as n from (select array_to_string(list_filter([{parts}], lambda x: x is not null), ',') as errors from {rows}) group by 1"


# --- files -----------------------------------------------------------------------------------------------------------------------


@query(
    "csv_catalog_errors",
    errors_sql([("missing_title", "id % 7 = 1"), ("missing_author", "id % 5 = 2"), ("missing_isbn", "id % 11 = 3"), ("invalid_isbn", "id % 11 <> 3 and id % 3 = 0")], "books"),
)
def csv_catalog_errors(t: Tables) -> DataFrame:
    """Books written as CSV with faults, with hyphens in good ISBNs, and read back."""
    path = files.scratch_dir(t.spark, "csv")
    code = F.when(nth() % 11 == 3, "").when(nth() % 3 == 0, F.concat(F.left("isbn", F.lit(11)), F.lit("xx"))).otherwise(F.concat(F.left("isbn", F.lit(3)), F.lit("-"), F.substring("isbn", 4, 20)))
    rows = t.books.select(F.when(nth() % 7 == 1, " ").otherwise(F.concat("title", F.lit(', "x"'))).alias("title"), F.when(nth() % 5 != 2, F.col("author")).alias("author"), code.alias("isbn"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return counts(files.catalog_errors(files.read_csv(t.spark, path, ["title", "author", "isbn"])))


@query(
    "csv_error_lines",
    """select line, case when id % 7 = 1 then 'missing_title' end as first, id % 5 = 2 as no_author from
       (select id, 1 + sum(1 + (id % 4 = 0)::int + (id % 6 = 0)::int) over (order by id rows unbounded preceding) - (id % 4 = 0)::int as line from books) where id % 7 = 1 or id % 5 = 2""",
)
def csv_error_lines(t: Tables) -> DataFrame:
    """Books as one CSV file with quoted line breaks and empty lines between: the lines of those with errors."""
    path = files.scratch_dir(t.spark, "csv")
    title = F.when(nth() % 7 == 1, F.when(nth() % 4 == 0, F.lit('" \n "')).otherwise("")).otherwise(F.concat(F.lit('"'), "title", F.when(nth() % 4 == 0, F.lit('\n""second"" line"')).otherwise(F.lit('"'))))
    line = F.concat_ws(",", title, F.when(nth() % 5 != 2, F.col("author")).otherwise(""), "isbn")
    rows = t.books.select(nth().alias("id"), F.concat(F.when(nth() % 6 == 0, F.lit("\n")).otherwise(""), line).alias("value"))
    head = t.spark.range(1).select((F.col("id") - 1).alias("id"), F.lit("Title,author,ISBN").alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("id").select("value").write.text(path)
    found = files.catalog_errors(lines.read_csv_lines(t.spark, path, ["title", "author", "isbn"])).where("size(errors) > 0")
    return found.select("line", F.when(F.col("title").isNull(), F.get("errors", F.lit(0))).alias("first"), F.array_contains("errors", F.lit("missing_author")).alias("no_author"))


@query("counts_by_column", "select 'lang' as by, lang as value, count(*) as n from documents group by 2 union all select 'source', source, count(*) from documents group by 2 union all select 'long', (n_chars > 1000)::varchar, count(*) from documents group by 2")
def counts_by_column(t: Tables) -> DataFrame:
    """Three summaries in one pass."""
    rows = t.raw("documents").select("lang", "source", (F.col("n_chars") > 1000).alias("long"))
    return quality.counts_by(rows, ["lang", "source", "long"])


@query(
    "csv_date_errors",
    errors_sql([("invalid_isbn", "id % 3 = 0"), ("invalid_date", "id % 5 = 0"), ("invalid_source_url", "id % 7 = 0")], "books"),
)
def csv_date_errors(t: Tables) -> DataFrame:
    path = files.scratch_dir(t.spark, "csv")
    day = F.when(nth() % 5 == 0, "2025-02-30").otherwise(F.col("publication_date").cast("string"))
    rows = t.books.select(F.when(nth() % 3 == 0, "978").otherwise(F.col("isbn")).alias("isbn"), day.alias("publicationDate"), F.when(nth() % 7 == 0, "http://x.org/a").otherwise(F.concat(F.lit("https://x.org/"), "isbn")).alias("sourceUrl"))
    rows.write.option("header", True).csv(path)
    return counts(files.publication_date_errors(files.read_csv(t.spark, path, ["isbn", "publicationDate", "sourceUrl"])))


RELEASE = ["title", "author", "isbn", "publicationDate", "coverImageUrl", "genres", "sourceUrl"]


@query(
    "csv_release_errors",
    errors_sql(
        [("missing_title", "id % 13 = 0"), ("invalid_date", "id % 5 = 0"), ("date_out_of_range", "id % 5 <> 0 and id % 3 = 0"), ("invalid_cover_url", "id % 7 = 0"), ("genre_count", "id % 11 = 0"), ("repeated_genre", "id % 11 = 1")],
        "books",
    ),
)
def csv_release_errors(t: Tables) -> DataFrame:
    path = files.scratch_dir(t.spark, "csv")
    day = F.when(nth() % 5 == 0, "soon").when(nth() % 3 == 0, "2024-12-31").otherwise("2026-05-01")
    rows = t.books.select(
        F.when(nth() % 13 != 0, F.col("title")).alias("title"), "author", "isbn", day.alias("publicationDate"), F.when(nth() % 7 == 0, "cover.png").otherwise("https://x.org/c.png").alias("coverImageUrl"),
        F.when(nth() % 11 == 0, "a;b;c;d").when(nth() % 11 == 1, "a; a").otherwise("a;b").alias("genres"), F.lit("https://x.org/").alias("sourceUrl"),
    )
    rows.write.option("header", True).csv(path)
    return counts(files.release_errors(files.read_csv(t.spark, path, RELEASE)))


NDJSON = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])


@query("ndjson_strict", "select id, title from books")
def ndjson_strict(t: Tables) -> DataFrame:
    path = files.scratch_dir(t.spark, "ndjson")
    t.books.select("id", "title").write.json(path)
    return files.read_ndjson(t.spark, path, NDJSON, strict=True)


@query("ndjson_permissive", "select case when id % 9 <> 0 then id end as id, case when id % 9 = 0 then '{\"id\": ' || id || ', broken' end as bad from books")
def ndjson_permissive(t: Tables) -> DataFrame:
    """Every ninth line is broken; it comes back as an error row."""
    path = files.scratch_dir(t.spark, "ndjson")
    t.books.select(F.when(nth() % 9 == 0, F.concat(F.lit('{"id": '), nth().cast("string"), F.lit(", broken"))).otherwise(F.to_json(F.struct("id", "title"))).alias("value")).write.text(path)
    return files.read_ndjson(t.spark, path, NDJSON, strict=False).select("id", F.col("_corrupt").alias("bad"))


@query("artifact_rows", "select genre, count(*) as n from book_genres group by 1")
def artifact_rows(t: Tables) -> DataFrame:
    """A report of one row a genre as one JSON document, read with its schema."""
    path = files.scratch_dir(t.spark, "artifact")
    rows = t.book_genres.groupBy("genre").agg(F.count("*").alias("n"))
    rows.agg(F.lit(1).alias("version"), F.collect_list(F.struct("genre", "n")).alias("rows")).coalesce(1).write.json(path)
    return files.read_artifact(t.spark, path, T.StructType.fromDDL("version int, rows array<struct<genre: string, n: bigint>>"), "rows")


@query("exclusion_keys", "select distinct case when id % 10 = 0 then 'OL' || id else work_key end as work_key, case when id % 10 = 0 then 'invalid_key' end as reject_reason from books")
def exclusion_keys(t: Tables) -> DataFrame:
    path = files.scratch_dir(t.spark, "keys")
    line = F.when(nth() % 10 == 0, F.concat(F.lit("OL"), nth().cast("string"))).when(nth() % 7 == 0, F.concat(F.lit("﻿"), "work_key", F.lit(" "))).otherwise(F.col("work_key"))
    t.books.select(F.explode(F.array(line, F.lit(""), line)).alias("value")).write.text(path)
    return dumps.exclusion_keys(dumps.read_lines(t.spark, path))


@query("line_numbers", "select count(*) as lines, count(*) as numbers, 0 as out_of_order from books")
def line_numbers(t: Tables) -> DataFrame:
    """Lines of one sorted file: each has a number of its own, and numbers rise as the lines do."""
    path = files.scratch_dir(t.spark, "lines")
    t.books.select("id", F.lpad(nth().cast("string"), 12, "0").alias("value")).orderBy("id").select("value").write.text(path)
    lines = dumps.read_lines(t.spark, path).withColumn("file", F.col("_metadata.file_name"))
    before = F.lag("value").over(Window.partitionBy("file").orderBy("line_no"))
    return lines.withColumn("wrong", before > F.col("value")).agg(F.count("*").alias("lines"), F.count_distinct("line_no").alias("numbers"), F.count_if("wrong").cast("int").alias("out_of_order"))


@query("sampled_dump", "select least(count(*), 150) as rows, 0 as rejected from works where work_key <> 'bad' and trim(title) <> ''")
def sampled_dump(t: Tables) -> DataFrame:
    rows = t.works.withColumn("reject_reason", quality.first_reason([("invalid_key", F.col("work_key") == "bad"), ("missing_title", F.trim("title") == "")]))
    return providers.sample_rows(rows, 150).agg(F.count("*").alias("rows"), F.count("reject_reason").cast("int").alias("rejected"))


@query("index_without_repeats", "select isbn, title from books")
def index_without_repeats(t: Tables) -> DataFrame:
    """Books written twice into an index that keeps different rows once."""
    path, rows = files.scratch_dir(t.spark, "index"), t.books.select("isbn", "title")
    files.write_index(rows.union(rows), path, "isbn", parts=8)
    return t.spark.read.parquet(path)


@query("published_books", "select id, title from books")
def published_books(t: Tables) -> DataFrame:
    """Two versions, of which the second is current."""
    path = files.scratch_dir(t.spark, "published")
    files.publish(t.books.select("id", F.lit("old").alias("title")), path)
    files.publish(t.books.select("id", "title"), path)
    return files.published(t.spark, path)


@query("report_lines", "select count(*) as lines, count(*) as n from books")
def report_lines(t: Tables) -> DataFrame:
    """A report as JSON lines that is read back and compared."""
    path = files.scratch_dir(t.spark, "report")
    n = files.write_report(t.books.select("id", "title", F.when(nth() % 5 != 0, F.col("isbn")).alias("isbn")), path)
    return t.spark.read.text(path).agg(F.count("*").alias("lines")).withColumn("n", F.lit(n).cast("bigint"))


@query("apply_differences", "select id, case when id % 8 = 0 then 'missing' else 'unexpected' end as side from books where id % 8 = 0 or id % 9 = 0 and id % 8 <> 0 union all select -id, 'missing' from books where id % 9 = 0 and id % 8 <> 0")
def apply_differences(t: Tables) -> DataFrame:
    """A plan against what is found after it: every eighth row is missing, every ninth came out under its own id instead of the negative one."""
    plan = t.books.select(F.when((nth() % 9 == 0) & (nth() % 8 != 0), -nth()).otherwise(nth()).alias("id"))
    return files.differences(plan, t.books.where("id % 8 <> 0").select("id"))


@query("canonical_isbns", "select isbn from books where id % 4 <> 0")
def canonical_isbns(t: Tables) -> DataFrame:
    """The set of valid ISBNs of a file, hyphens or not."""
    given = t.books.select(F.when(nth() % 4 == 0, F.left("isbn", F.lit(12))).otherwise(F.concat(F.left("isbn", F.lit(3)), F.lit("-"), F.substring("isbn", 4, 20))).alias("isbn"))
    return given.union(given).select(isbn.isbn13(F.col("isbn")).alias("isbn")).where("isbn is not null").distinct()


# --- editions and payloads -------------------------------------------------------------------------------------------------------


@query(
    "isbn_lists",
    "select id, case when id % 3 = 0 then isbn when id % 3 = 1 then isbn || ',9780306406157' else '' end as isbns, case when id % 3 = 0 then 1 when id % 3 = 1 then 0 else 1 end as invalid from books",
)
def isbn_lists(t: Tables) -> DataFrame:
    """A repeated and a broken number, a ten-digit one, and none that is valid."""
    thirteen = F.when(nth() % 3 == 0, F.array("isbn", "isbn", F.lit("9780306406158"))).when(nth() % 3 == 1, F.array("isbn")).otherwise(F.array(F.lit("x")))
    ten = F.when(nth() % 3 == 1, F.array(F.lit("0-306-40615-2"))).otherwise(F.array().cast("array<string>"))
    return t.books.select("id", F.array_join(isbn.valid_isbns(thirteen, ten), ",").alias("isbns"), isbn.invalid_isbns(thirteen, ten).alias("invalid"))


WORK_PAYLOAD = """{"title":"%s","authors":[{"author":{"key":"/authors/OL%sA"}},{"author":{"key":"/authors/OL%sA"}},{"author":{}}],"subjects":["b"," a ","b",""],"covers":[0,-1,%s,%s]}"""


@query("unique_lists", "select id, '/authors/OL' || id || 'A' as authors, 'b,a' as subjects, (id + 5)::varchar as covers from books")
def unique_lists(t: Tables) -> DataFrame:
    """Keys, texts and cover ids of a dump's works: each once, in the order of their first place."""
    number = nth().cast("string")
    payload = F.format_string(WORK_PAYLOAD, F.col("title"), number, number, (nth() + 5).cast("string"), (nth() + 5).cast("string"))
    lines = t.books.select(nth().alias("line_no"), F.concat_ws("\t", F.lit("/type/work"), "work_key", F.lit("1"), F.lit("2020"), payload).alias("value"))
    rows = dumps.work_rows(dumps.dump_rows(lines)).where("reject_reason is null")
    return rows.select(F.col("line_no").alias("id"), F.array_join("author_keys", ",").alias("authors"), F.array_join("subjects", ",").alias("subjects"), F.array_join(F.transform("cover_ids", lambda x: x.cast("string")), ",").alias("covers"))


@query("cover_urls", "select id, case when cover_id > 0 then 'https://c.example/' || cover_id end as url from books")
def cover_urls(t: Tables) -> DataFrame:
    return t.books.select("id", editions.cover_url(F.array(F.lit(0), "cover_id", F.lit(-1).cast("bigint")), "https://c.example/").alias("url"))


@query("single_years", "select id, case id % 4 when 0 then publication_year when 1 then null when 2 then publication_year else null end as year from books")
def single_years(t: Tables) -> DataFrame:
    year = F.col("publication_year").cast("string")
    text = F.when(nth() % 4 == 0, F.concat(F.lit("c. "), year)).when(nth() % 4 == 1, F.concat(F.lit("1950, again "), year)).when(nth() % 4 == 2, F.concat_ws(" / ", year, year)).otherwise("1499")
    return t.books.select("id", dates.single_year(text, 2030).alias("year"))


@query("years_agree", "select id, case id % 3 when 0 then false else true end as agrees from books")
def years_agree(t: Tables) -> DataFrame:
    year = F.year("publication_date")
    return t.books.select("id", dates.year_agrees(F.col("publication_date"), F.when(nth() % 3 == 0, year - 1).when(nth() % 3 == 1, year)).alias("agrees"))


@query("subject_labels", "select id, case id % 4 when 0 then 'Fantasy,History' when 1 then 'Mystery,Romance' when 2 then 'Poetry' else '' end as genres from books")
def subject_labels(t: Tables) -> DataFrame:
    lists = {0: ("World History", " FANTASY fiction "), 1: ("love stories", "mystery fiction", "cookery"), 2: ("poetry", "Poetry")}
    subjects = F.when(F.lit(False), F.array(F.lit("")))
    for rest, names in lists.items():
        subjects = subjects.when(nth() % 4 == rest, F.array(*map(F.lit, names)))
    return t.books.select("id", F.array_join(editions.subject_genres(subjects.otherwise(F.array(F.lit("cookery")))), ",").alias("genres"))


CATEGORIES = {
    ("Fiction - Epic Fantasy", "/c/space-opera", None): "space-opera,science-fiction,epic-fantasy", ("Literary", "", "Historical Fiction"): "historical-fiction,literary-fiction", ("Science", None, "Psychological Thriller"): "thriller,science",
    ("Fiction", None, None): "fiction", ("Cookery", None, None): "", ("True Crime", "", "Biography & Memoir"): "true-crime,memoir,biography", ("Action & Adventure", None, "Young Adult Dystopian"): "dystopian,science-fiction,adventure",
}


@query("category_labels", "select p_partkey as id, case p_partkey % 7 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(CATEGORIES.values())) + " end as genres from part")
def category_labels(t: Tables) -> DataFrame:
    """Genres of a publisher's categories, each given by description, address and menu entry."""
    kind = T.StructType.fromDDL("k int, description string, uri string, menu string")
    texts = t.spark.createDataFrame([(k, *c) for k, c in enumerate(CATEGORIES)], kind)
    rows = t.books.select("id", (nth() % 7).cast("int").alias("k")).join(F.broadcast(texts), "k")
    text = editions.category_text(F.replace("description", F.lit("-"), F.lit(" ")), F.replace("uri", F.lit("-"), F.lit(" ")), F.col("menu"))
    return rows.select("id", F.array_join(editions.category_genres(F.array(text)), ",").alias("genres"))


VOLUME_SQL = """select case when id % 13 <> 0 then 'v' || id end as record_id, case when id % 11 <> 0 then title end as title, author as authors, isbn as isbns, publication_year as year,
    case id % 3 when 0 then 'https://books.google.com/big' when 1 then 'https://books.google.com/small' end as cover_url, case when id % 13 = 0 then 'missing_id' when id % 11 = 0 then 'missing_title' end as reject_reason from books"""


def volumes(t: Tables) -> DataFrame:
    links = F.when(nth() % 3 == 0, F.create_map(F.lit("small"), F.lit("http://books.google.com/small"), F.lit("large"), F.lit("http://books.google.com/big"))).when(
        nth() % 3 == 1, F.create_map(F.lit("large"), F.lit("https://evil.example/x"), F.lit("medium"), F.lit("https://books.google.com/no-cover.png"), F.lit("small"), F.lit("http://books.google.com/small"))
    )
    ids = F.array(F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier")), F.struct(F.lit("ISBN_10").alias("type"), F.lit("x").alias("identifier")))
    info = F.struct(F.when(nth() % 11 != 0, F.col("title")).alias("title"), F.array("author", "author").alias("authors"), F.lit("en").alias("language"), F.concat(F.col("publication_year").cast("string"), F.lit("-05")).alias("publishedDate"), ids.alias("industryIdentifiers"), links.alias("imageLinks"))
    payload = F.to_json(F.struct(F.when(nth() % 13 != 0, F.concat(F.lit("v"), nth().cast("string"))).alias("id"), info.alias("volumeInfo")))
    return providers.volume_rows(t.books.select(F.parse_json(payload).alias("payload")), 2030)


@query("provider_volumes", VOLUME_SQL)
def provider_volumes(t: Tables) -> DataFrame:
    """Volumes of a provider as candidate rows, with the image that may be used."""
    return volumes(t).select("record_id", "title", F.array_join("authors", ",").alias("authors"), F.array_join("isbns", ",").alias("isbns"), "year", "cover_url", "reject_reason")


@query("scoring_shape", "select 'v' || id as record_id, isbn, author, 'en' as languages, id % 3 < 2 as has_cover, false as has_description, publication_year as year from books where id % 13 <> 0 and id % 11 <> 0")
def scoring_shape(t: Tables) -> DataFrame:
    """Candidates in the shape that editions are scored in."""
    rows = volumes(t).where("reject_reason is null").select("record_id", F.get("isbns", F.lit(0)).alias("isbn13"), "title", "subtitle", "authors", F.get("languages", F.lit(0)).alias("language"), F.lit(None).cast("string").alias("format"), "cover_url", F.lit(None).cast("string").alias("cover_reference"), "description", "year")
    return providers.scoring_rows(rows).select("record_id", "isbn", "author", F.array_join("languages", ",").alias("languages"), "has_cover", "has_description", "year")


@query(
    "book_metadata",
    "select isbn, title, author, case when publish_date is not null and publish_date not like 'circa%' then cast(right(publish_date, 4) as int) end as publication_year, case when cast(regexp_extract(key, '(\\d+)', 1) as bigint) % 2 = 0 then 'own' else 'of the work' end as description, case when cover > 0 then 'https://c.example/' || cover end as cover_url, 'Fantasy,History' as genres from editions",
)
def book_metadata(t: Tables) -> DataFrame:
    """Editions with what their works add: description and subjects."""
    number = F.regexp_extract("key", r"(\d+)", 1).cast("bigint")
    rows = t.editions.select("isbn", "work_key", "title", F.array(F.concat("author", F.lit(" ")), "author").alias("authors"), "publish_date", F.array("cover").alias("cover_ids"), F.array(F.lit("fantasy")).alias("subjects"), F.when(number % 2 == 0, "own").alias("description"))
    works = t.editions.select("work_key").distinct().select("work_key", F.lit("of the work").alias("description"), F.array(F.lit("history")).alias("subjects"))
    found = providers.book_metadata(rows, works, 2030, "https://c.example/")
    return found.withColumn("genres", F.array_join("genres", ","))


@query("edition_quality", "select key, 1 + (len(languages) > 0)::int + (format <> '')::int + (cover > 0)::int + (publish_date is not null and publish_date not like 'circa%')::int as quality, cover as covers from editions")
def edition_quality(t: Tables) -> DataFrame:
    """Completeness in eight parts, and the covers part of a work's seven."""
    return parts(t).select("key", matching.edition_quality().alias("quality"), matching.work_quality()["covers"].cast("bigint").alias("covers"))


def parts(t: Tables) -> DataFrame:
    """Editions with the lists that make them complete."""
    none = F.array().cast("array<string>")
    some = lambda c, when: F.when(when, F.array(c.cast("string"))).otherwise(none)
    year = dates.year_in(F.col("publish_date"), 2030)
    return t.editions.select(
        "key", "work_key", "title", "author", "languages", F.array("author").alias("authors"), none.alias("publishers"), some(F.col("format"), F.col("format") != "").alias("formats"), F.array_repeat(F.lit("c"), F.col("cover").cast("int")).alias("covers"),
        none.alias("descriptions"), some(year, year.isNotNull()).alias("years"), none.alias("subjects"), F.array("isbn").alias("isbns"), F.col("key").alias("edition_id"),
    )


#: Editions as candidates of two providers; some without an edition id, some of those with another edition's ISBN, some with none.
CANDIDATES = (
    "candidates",
    """select key as id, work_key as work_id, title, author, languages, case when cover = 4 then 'b' else 'a' end as provider, case when cover < 2 then key when cover = 2 then split_part(key, '0', 1) end as edition_id,
       case when cover = 3 then [] else [isbn] end as isbns, format, cover, publish_date is not null and publish_date not like 'circa%' as has_year from editions""",
)
FOREIGN = "len(languages) > 0 and not list_contains(languages, '/languages/eng')"


def candidates(t: Tables) -> DataFrame:
    rows = parts(t).join(t.editions.select("key", "cover"), "key")
    cover = F.col("cover")
    edition = F.when(cover < 2, F.col("key")).when(cover == 2, F.split_part("key", F.lit("0"), F.lit(1)))
    return rows.select(
        F.col("key").alias("id"), F.col("work_key").alias("work_id"), "title", "author", "languages", F.when(cover == 4, "b").otherwise("a").alias("provider"), edition.alias("edition_id"),
        F.when(cover == 3, F.array().cast("array<string>")).otherwise(F.col("isbns")).alias("isbns"), "authors", "publishers", "formats", "covers", "descriptions", "years", "subjects",
    )


@query(
    "consolidated_works",
    f"""select arg_min(id, rank) as id, count(*) as members, array_to_string(list_sort(list(distinct work_id)), ',') as work_ids from
        (select *, case when {FOREIGN} then id end as alone, (case when edition_id is not null then -2 else 0 end, -len(isbns), -len(languages), -cover, -(has_year::int), id) as rank from candidates) group by title, author, alone""",
    CANDIDATES,
)
def consolidated_works(t: Tables) -> DataFrame:
    out = consolidate.consolidate_works(candidates(t), ["title", "author"])
    return out.select("id", "members", F.array_join("work_ids", ",").alias("work_ids"))


@query(
    "work_members",
    f"""select id, row_number() over (partition by title, author, alone order by edition_id is not null desc, len(isbns) desc, len(languages) desc, cover desc, has_year desc, id) as place from
        (select *, case when {FOREIGN} then id end as alone from candidates)""",
    CANDIDATES,
)
def work_members(t: Tables) -> DataFrame:
    return consolidate.work_members(candidates(t), ["title", "author"]).select("id", "place")


@query(
    "consolidated_editions",
    """select identity, arg_min(id, (-(1 + (len(languages) > 0)::int + (format <> '')::int + (cover > 0)::int + has_year::int), id)) as id, count(*) as members from
       (select *, provider || case when edition_id is not null then ':edition:' || edition_id when len(isbns) > 0 then ':isbn:' || isbns[1] else ':candidate:' || id end as identity from candidates) group by 1""",
    CANDIDATES,
)
def consolidated_editions(t: Tables) -> DataFrame:
    return consolidate.consolidate_editions(candidates(t)).select("identity", "id", "members")


@query("edition_completeness", "select id, 2 + (len(languages) > 0)::int + (format <> '')::int + (cover > 0)::int + has_year::int as parts from candidates", CANDIDATES)
def edition_completeness(t: Tables) -> DataFrame:
    years = F.transform("years", lambda y: y.cast("int"))
    return candidates(t).withColumn("years", years).select("id", consolidate.metadata_completeness(2030).alias("parts"))


def _index(t: Tables) -> SnapshotIndex:
    """Books, one in three of them twice, as an index of a name of its own."""
    path = files.scratch_dir(t.spark, "index")
    rows = t.books.select(F.col("isbn").alias("isbn13"), "title", "author")
    return SnapshotIndex(t.spark, path, "index_" + path.rsplit("-", 1)[1], buckets=8).build(rows.unionByName(rows.where("cast(substr(isbn13, 12, 1) as int) % 3 = 0")))


@query(
    "index_links",
    "select b.id as key, 'isbns' as method, b.isbn as value, 1 as n from books b union all select b.id, 'works', lower(b.title) || '|' || lower(regexp_replace(b.author, '[^A-Za-z0-9]+', ' ', 'g')), w.n from books b join (select title, author, count(*) as n from books group by all) w on w.title = b.title and w.author = b.author",
)
def index_links(t: Tables) -> DataFrame:
    """All books as sources against the index of all books."""
    sources = t.books.select(F.col("id").alias("key"), "isbn", "title", "author")
    return _index(t).links(sources).withColumn("value", F.replace("value", F.lit("\u0000"), F.lit("|")))


@query("index_members", "select b.isbn as isbn13, b.title from books b where (b.title, b.author) in (select (title, author) from books where id % 3 = 0)")
def index_members(t: Tables) -> DataFrame:
    """The records of the works and ISBNs of a third of the books."""
    index = _index(t)
    links = index.links(t.books.where("id % 3 = 0").select(F.col("id").alias("key"), "isbn", "title", "author"))
    keys = index.members(links).select("record_key").distinct()
    return index.table("records").join(keys, "record_key").select("isbn13", "title")


@query(
    "upserted_catalog",
    """select b.isbn, case when id % 3 <> 0 then 'kept' when id % 7 = 0 then 'created' when id % 4 = 1 or id % 5 = 2 or id % 11 = 0 then 'updated' else 'unchanged' end as outcome,
              case when id % 3 = 0 and (id % 4 = 1 or id % 7 = 0) then upper(title) else title end as title,
              case when id % 3 = 0 and (id % 5 = 2 or id % 7 = 0 and id % 5 in (1, 3)) then 'https://books.google.com/' || id when id % 7 = 0 and id % 3 = 0 then null when id % 5 = 2 then null when id % 2 = 0 or id % 5 = 1 then 'https://covers.openlibrary.org/' || id else 'https://books.google.com/' || id end as cover_url,
              case when id % 7 <> 0 then 1 else 0 end + case when id % 3 = 0 and (id % 11 = 0 or id % 7 = 0) then 1 else 0 end as genres
       from books b where id % 3 = 0 or id % 7 <> 0""",
)
def upserted_catalog(t: Tables) -> DataFrame:
    """New books, changed titles, covers that may and may not be replaced, genres that are new and known; the rest keeps its files."""
    i, path = F.col("id"), files.scratch_dir(t.spark, "catalog")
    other, own = F.concat(F.lit("https://books.google.com/"), i.cast("string")), F.concat(F.lit("https://covers.openlibrary.org/"), i.cast("string"))
    books = KeyedTable(t.spark, f"{path}/books", "isbn string, title string, cover_url string", ["isbn"], buckets=16)
    links = KeyedTable(t.spark, f"{path}/links", "isbn string, genre string", ["isbn", "genre"], buckets=16)
    old = t.books.where("id % 7 <> 0")
    cover = F.when(i % 5 == 2, F.lit(None)).when((i % 2 == 0) | (i % 5 == 1), own).otherwise(other)
    replace = lambda before, rows: rows
    books.upsert(old.select("isbn", "title", cover.alias("cover_url")), replace)
    links.upsert(old.select("isbn", F.lit("one").alias("genre")), replace)
    updates = t.books.where("id % 3 = 0")
    title = F.when((i % 4 == 1) | (i % 7 == 0), F.upper("title")).when(i % 4 == 2, F.col("title"))
    fresh = F.when((i % 5 == 2) | (i % 5 == 1) | ((i % 7 == 0) & (i % 5 == 3)), other)
    genres = updates.select("isbn", F.when((i % 11 == 0) & (i % 7 != 0), "two").otherwise("one").alias("genre"))
    outcome = catalog.upsert_catalog(books, links, updates.select("isbn", title.alias("title"), fresh.alias("cover_url")), genres)
    n = links.read().groupBy("isbn").agg(F.count("*").alias("genres"))
    return books.read().join(outcome, "isbn", "left").join(n, "isbn", "left").select("isbn", F.coalesce("outcome", F.lit("kept")).alias("outcome"), "title", "cover_url", F.coalesce("genres", F.lit(0)).alias("genres"))


KINDS = {0: ("Audio CD", "audiobook"), 1: ("Kindle Edition", "ebook"), 2: ("Large Print", "large_print"), 3: ("Boxed Set", "boxed_set"), 4: ("Wall calendar", "calendar"), 5: ("Blank book", "journal"), 6: ("Tarot deck", "cards"), 7: ("Jigsaw puzzle", "non_book")}


@query("format_kinds", "select case id % 9 " + " ".join(f"when {k} then '{kind}'" for k, (_, kind) in KINDS.items()) + " else 'book' end as kind, count(*) as n from books group by 1")
def format_kinds(t: Tables) -> DataFrame:
    """All eight kinds of other products, by format."""
    kind = editions.product_kind(by_rest(9, {k: name for k, (name, _) in KINDS.items()}, "Paperback"), F.col("title"), F.lit(None).cast("string"))
    return t.books.groupBy(F.coalesce(kind, F.lit("book")).alias("kind")).agg(F.count("*").alias("n"))


# --- works with many ISBNs -------------------------------------------------------------------------------------------------------


@query(
    "enrich_isbns_by_the_hundred",
    """select work_key, string_agg(isbn, ',' order by isbn) filter (place <= 200) as isbns, count(*) filter (english) as english, count(*) > 200 as truncated from
       (select *, row_number() over (partition by work_key order by english desc, quality desc, isbn) as place from
        (select l_partkey % 20 as work_key, cast(l_orderkey * 10 + l_linenumber as varchar) as isbn, max(l_linestatus = 'F') as english,
                max(case when l_linestatus = 'F' then 3 + case when l_linenumber > 2 then 2 else 0 end + case when l_quantity > 25 then 1 else 0 end else -1 end) as quality from lineitem group by 1, 2)) group by 1""",
)
def enrich_isbns_by_the_hundred(t: Tables) -> DataFrame:
    """Works with thousands of ISBNs, so that the best 200 of each are taken and the rest cut."""
    rows = t.raw("lineitem").select(
        (F.col("l_partkey") % 20).alias("work_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("isbn"), F.lit("A title").alias("title"),
        F.array(F.when(F.col("l_linestatus") == "F", "/languages/eng").otherwise("/languages/fre")).alias("languages"), F.when(F.col("l_quantity") > 25, "1990").alias("publish_date"),
        F.lit("Paperback").alias("format"), F.when(F.col("l_linenumber") > 2, 1).otherwise(0).alias("cover"),
    )
    works = rows.select("work_key").distinct().withColumn("title", F.lit("A title"))
    out = catalog.enrich(works, rows)
    return out.select("work_key", F.array_join("isbns", ",").alias("isbns"), "english", "truncated")


# --- snapshot --------------------------------------------------------------------------------------------------------------------

RECORD = ["isbn13", "title", "authors"]
GROUPS = ("groups", "select cast(l_partkey % 500 as varchar) as isbn13, count(*) as rows, count(distinct l_returnflag || l_linestatus) as records from lineitem group by 1")


def snapshot(t: Tables) -> DataFrame:
    """Candidates in which ISBNs, and whole records, repeat."""
    return t.raw("lineitem").select((F.col("l_partkey") % 500).cast("string").alias("isbn13"), F.col("l_returnflag").alias("title"), F.array("l_linestatus").alias("authors"))


@query("isbn_groups", "select *, rows > 1 as duplicate, records > 1 as conflicting from groups", GROUPS)
def isbn_groups(t: Tables) -> DataFrame:
    return catalog.isbn_groups(snapshot(t), RECORD)


@query("snapshot_counts", "select sum(rows)::bigint as input, sum(records)::bigint as accepted, sum(rows - records)::bigint as duplicate_records, count(*) filter (rows > 1) as duplicate_isbns, count(*) filter (records > 1) as conflicting_isbns from groups", GROUPS)
def snapshot_counts(t: Tables) -> DataFrame:
    return catalog.snapshot_counts(catalog.isbn_groups(snapshot(t), RECORD))


@query(
    "candidate_order",
    """select isbn13, title, author, 'sha256:' || sha256('{"authors":["' || author || '"],"isbn13":"' || isbn13 || '","title":"' || title || '"}') as record_key
       from (select distinct cast(l_partkey % 500 as varchar) as isbn13, l_returnflag as title, l_linestatus as author from lineitem)""",
)
def candidate_order(t: Tables) -> DataFrame:
    return catalog.in_candidate_order(snapshot(t), RECORD).select("isbn13", "title", F.array_join("authors", ",").alias("author"), "record_key")


LANGUAGE_ROWS = (
    "rows",
    """select work_key as key, '{"languages":[' || coalesce(string_agg(distinct '"' || l || '"', ',' order by '"' || l || '"'), '') || '],"work_key":"' || work_key || '"}' as row
       from (select work_key, unnest(case when len(languages) = 0 then [null] else languages end) as l from editions) group by 1""",
)


@query("language_digest", "select sha256('snapshot-1' || chr(10) || fingerprint) as digest from (" + FINGERPRINT + ")", LANGUAGE_ROWS)
def language_digest(t: Tables) -> DataFrame:
    works = t.editions.select("work_key", F.explode_outer("languages").alias("l")).groupBy("work_key").agg(F.collect_set("l").alias("languages"))
    return quality.language_digest(works, "snapshot-1")


# --- import ----------------------------------------------------------------------------------------------------------------------

REPORT_SQL = """select place, work_key, isbn, case when final is null then 'insert' else 'skip' end as action, final as reason from
    (select *, case when reason is null and sum((reason is null)::int) over (order by place rows unbounded preceding) > 300 then 'limit' else reason end as final from
     (select id as place, work_key, isbn, case when id % 10 = 0 then 'existing' when id % 10 = 1 then 'ambiguous' when id % 16 = 2 then 'missing_title' when id % 16 = 3 then 'missing_author' when id % 16 = 4 then 'unsupported_script'
        else case id % 27 """ + " ".join(f"when {k} then '{kind}'" for k, (_, kind) in KINDS.items()) + """ else case when id % 25 = 3 then 'duplicate_work_key' when id % 25 = 8 then 'duplicate_isbn' end end end as reason from books))"""  # fmt: skip


def import_plan(t: Tables) -> DataFrame:
    title = by_rest(16, {2: F.lit(" "), 4: F.lit("книга")}, F.col("title"))
    report = t.books.select(
        nth().alias("place"), "work_key", title.alias("title"), F.when(nth() % 16 != 3, F.col("author")).alias("author"), "isbn", F.when(nth() % 10 == 0, "existing").when(nth() % 10 == 1, "ambiguous").otherwise("new").alias("status"),
        by_rest(27, {k: F.lit(name) for k, (name, _) in KINDS.items()}, "Paperback").alias("format"),
    )
    return catalog.plan_import(report, known_books(t), 300)


def known_books(t: Tables) -> DataFrame:
    """Some of the report's works, and some of its ISBNs under other works."""
    some = t.books.where("id % 25 in (3, 8)")
    key = F.when(nth() % 25 == 3, F.col("work_key")).otherwise("else")
    return some.select(key.alias("work_key"), F.when(nth() % 25 == 8, F.col("isbn")).otherwise(F.concat(F.lit("other"), "isbn")).alias("isbn"), "title", "author")


@query("import_plan_reasons", REPORT_SQL)
def import_plan_reasons(t: Tables) -> DataFrame:
    return import_plan(t)


@query(
    "import_summary",
    "select a as action, r as reason, coalesce(n, 0) as n from (select 'insert' as a, null::varchar as r union all select 'skip', unnest([" + ", ".join(f"'{r}'" for r in catalog.IMPORT_REASONS) + "])) left join (select action, reason, count(*) as n from planned group by 1, 2) p on p.action = a and p.reason is not distinct from r",
    ("planned", REPORT_SQL),
)
def import_summary(t: Tables) -> DataFrame:
    """All 17 reasons, those that no row has with zero."""
    return catalog.import_summary(import_plan(t))


@query(
    "apply_import",
    "select action, reason, count(*) as n from (select case when action = 'insert' and place % 6 = 5 then 'skip' else action end as action, case when action = 'insert' and place % 6 = 5 then 'duplicate_isbn' else reason end as reason from planned) group by 1, 2 union all select 'books', null, (select count(*) from books where id % 25 in (3, 8)) + (select count(*) from books where id % 6 = 5) + (select count(*) from planned where action = 'insert' and place % 6 <> 5)",
    ("planned", REPORT_SQL),
)
def apply_import(t: Tables) -> DataFrame:
    """A plan that is applied after every sixth book came in under another work."""
    plan = files.cut(import_plan(t), "plan")
    late = t.books.where("id % 6 = 5").select(F.concat(F.lit("late"), "work_key").alias("work_key"), "isbn", "title", "author")
    after, done = catalog.apply_import(plan, t.books, known_books(t).unionByName(late))
    return done.groupBy("action", "reason").agg(F.count("*").alias("n")).union(after.agg(F.lit("books"), F.lit(None).cast("string"), F.count("*")))


# --- genres ----------------------------------------------------------------------------------------------------------------------

GENRE_NAMES = ("genre_names", "select distinct genre as g, length(genre) % 4 as k from book_genres")


def genre_names(t: Tables) -> DataFrame:
    return t.book_genres.select(F.col("genre").alias("g"), (F.length("genre") % 4).alias("k")).distinct()


@query(
    "taxonomy_errors",
    "select name, slug, array_to_string(list_filter([case when name = '' then 'missing_name' end, case when slug = '' then 'missing_slug' end, case when slug like '% %' then 'invalid_slug' end, case when slug = 'same' and c > 1 then 'duplicate_slug' end], lambda x: x is not null), ',') as errors from (select *, count(*) over (partition by slug) as c from (select case when k = 0 then '' else g end as name, case k when 1 then g || ' x' when 2 then 'same' when 3 then '' else g end as slug from genre_names))",
    GENRE_NAMES,
)
def taxonomy_errors(t: Tables) -> DataFrame:
    slug = F.when(F.col("k") == 1, F.concat("g", F.lit(" x"))).when(F.col("k") == 2, "same").when(F.col("k") == 0, F.col("g"))
    found = genres.taxonomy_rows(genre_names(t).select(F.when(F.col("k") == 0, " ").otherwise(F.col("g")).alias("name"), F.coalesce(slug, F.lit("")).alias("slug")))
    return found.withColumn("errors", F.array_join("errors", ","))


@query("taxonomy_plan", "select g as name, g as slug, case k when 0 then 'create' when 1 then 'existing' when 2 then 'slug_conflict' else 'name_conflict' end as action from genre_names", GENRE_NAMES)
def taxonomy_plan(t: Tables) -> DataFrame:
    names = genre_names(t)
    present = names.where("k > 0").select(F.when(F.col("k") == 2, F.concat(F.lit("other "), "g")).otherwise(F.upper("g")).alias("name"), F.when(F.col("k") == 3, F.concat("g", F.lit("-x"))).otherwise(F.col("g")).alias("slug"))
    return genres.taxonomy_plan(names.select(F.col("g").alias("name"), F.col("g").alias("slug")), present)


@query(
    "mapping_errors",
    errors_sql(
        [("genre_count", "id % 5 = 0"), ("repeated_genre", "id % 7 = 0 and id % 5 <> 0"), ("unknown_genre", "id % 11 = 0 and id % 5 <> 0 and id % 7 <> 0"), ("duplicate_isbn", "id % 17 = 0"), ("not_in_catalog", "id % 13 = 0")],
        "(select id from books where id % 3 <> 2 union all select id from books where id % 3 <> 2 and id % 17 = 0)",
    ) + " union all select 'unmapped', count(*) from books where id % 3 = 2 and id % 13 <> 0",
)
def mapping_errors(t: Tables) -> DataFrame:
    """An ISBN-to-genres file against taxonomy and catalogue, both ways."""
    names = t.book_genres.select(F.col("genre").alias("slug")).distinct()
    word = F.lower(F.split_part("title", F.lit(" "), F.lit(1)))
    text = F.when(nth() % 5 == 0, "").when(nth() % 7 == 0, F.concat_ws(";", word, word)).when(nth() % 11 == 0, "nope").otherwise(word)
    rows = t.books.where("id % 3 <> 2").select("isbn", text.alias("genres"), "id")
    rows = rows.union(rows.where("id % 17 = 0")).select("isbn", "genres")
    return counts(genres.mapping_rows(rows, names, t.books.where("id % 13 <> 0")))


MATCHES = (
    ("there", "select * from books where id % 3 <> 0"),
    ("entries", "select id, case id % 4 when 0 then isbn else 'x' || isbn end as code, case when id % 4 = 3 then 'nothing like it' else title end as title, author from books"),
    (
        "matches",
        """select code as isbn, match, book_id, match in ('exact_isbn', 'work_identity') and count(book_id) over (partition by book_id) > 1 as conflict from
           (select code, case when b.id is not null then 'exact_isbn' when w.n = 1 then 'work_identity' when w.n > 1 then 'ambiguous' else 'missing' end as match, case when b.id is not null then b.id when w.n = 1 then w.w end as book_id
            from entries e left join there b on b.isbn = e.code left join (select lower(title) as t, lower(author) as a, count(*) as n, min(id) as w from there group by 1, 2) w on w.t = lower(e.title) and w.a = lower(e.author))""",
    ),
)


def matches(t: Tables) -> DataFrame:
    entries = t.books.select(F.when(nth() % 4 == 0, F.col("isbn")).otherwise(F.concat(F.lit("x"), "isbn")).alias("isbn"), F.when(nth() % 4 == 3, "nothing like it").otherwise(F.col("title")).alias("title"), "author")
    return genres.match_books(entries, t.books.where("id % 3 <> 0"))


@query("genre_matches", "select * from matches", *MATCHES)
def genre_matches(t: Tables) -> DataFrame:
    return matches(t)


@query(
    "genre_plan",
    """select book_id, genre, 'add' as change from wanted where not exists (select 1 from own o where o.book_id = wanted.book_id and o.genre = wanted.genre)
       union all select book_id, genre, 'remove' from (select * from book_genres) o where book_id in (select book_id from meant) and not exists (select 1 from wanted w where w.book_id = o.book_id and w.genre = o.genre)""",
    *MATCHES,
    ("own", "select distinct book_id, genre from book_genres"),
    ("meant", "select book_id from matches where book_id is not null and not conflict"),
    ("wanted", "select book_id, genre || case when book_id % 2 = 0 then '' else '-new' end as genre from own join meant using (book_id)"),
)
def genre_plan(t: Tables) -> DataFrame:
    """Links of the books that entries mean: their genres stay, or all change, by book."""
    found = files.cut(matches(t), "matches")
    named = F.concat("genre", F.when(F.col("book_id") % 2 == 0, "").otherwise("-new"))
    mapping = found.where("book_id is not null").select("isbn", "book_id").join(t.book_genres, "book_id").groupBy("isbn").agg(F.collect_set(named).alias("slugs"))
    return genres.genre_plan(found, mapping, t.book_genres)


@query(
    "genre_audit",
    """select 'books_with' as what, k.name, coalesce(n, 0) as n from (select unnest(['0', '1', '2', '3', 'more']) as name) k left join (select case when c > 3 then 'more' else c::varchar end as name, count(*) as n from (select id, (select count(distinct genre) from book_genres g where g.book_id = b.id and g.book_id % 5 <> 0) as c from books b) group by 1) s on s.name = k.name
       union all select 'books_of', genre, count(distinct book_id) from book_genres where book_id % 5 <> 0 group by 2""",
)
def genre_audit(t: Tables) -> DataFrame:
    return genres.coverage(t.book_genres.where("book_id % 5 <> 0"), t.books)


@query("genre_sets_equal", "select id, id % 3 <> 2 as same from books")
def genre_sets_equal(t: Tables) -> DataFrame:
    given = F.when(nth() % 3 == 0, F.array("author", "title")).when(nth() % 3 == 1, F.array("title", "author", "title")).otherwise(F.array("title"))
    return t.books.select("id", readers.genre_sets_equal(given, F.array("title", "author")).alias("same"))


# --- publisher and releases ------------------------------------------------------------------------------------------------------

JUDGED = (
    "judged",
    """select id, isbn, case when id % 11 = 0 then 'non_english' when id % 7 = 0 then 'excluded_format' when id % 13 = 0 then 'invalid_isbn' when id % 17 = 0 then 'missing_title_or_author' when id % 19 = 0 then 'invalid_date'
       when id % 23 = 0 then 'invalid_source_url' when id % 29 = 0 then 'missing_cover' end as reason, case when id % 3 = 0 then 1 else 2 end as rank, title, author, publication_date, case when id % 5 <> 0 then id - id % 2 end as wid from books""",
)


def judged(t: Tables) -> DataFrame:
    titles = t.books.select(
        "id", F.when(nth() % 17 != 0, F.col("title")).alias("title"), "author", F.when(nth() % 13 == 0, "978").otherwise(F.col("isbn")).alias("isbn"), F.when(nth() % 11 == 0, "FR").when(nth() % 2 == 0, "EN").alias("language"), F.lit(None).cast("string").alias("language_description"),
        F.when(nth() % 7 == 0, "EB").when(nth() % 3 == 0, "HC").otherwise("TR").alias("format"), F.lit("").alias("format_description"), F.when(nth() % 19 == 0, "soon").otherwise(F.concat(F.col("publication_date").cast("string"), F.lit("T00:00"))).alias("onsale"),
        F.when(nth() % 23 != 0, F.concat(F.lit("books/"), nth().cast("string"))).alias("path"), F.when(nth() % 29 == 0, "https://p.example/placeholder.png").otherwise("https://p.example/c.png").alias("cover_url"), F.when(nth() % 5 != 0, nth() - nth() % 2).alias("work_id"),
    )
    return publisher.judge_titles(titles, "https://p.example/", "p.example")


@query("publisher_titles", "select coalesce(reason, 'accepted') as reason, count(*) as n from judged group by 1", JUDGED)
def publisher_titles(t: Tables) -> DataFrame:
    return judged(t).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "publisher_discovery",
    """select e.isbn, e.on_sale, d.editions, d.works, case when e.known then 'already_known' when c.id is not null then 'work_collision' else 'new' end as outcome, case when not e.known then c.id end as colliding_book from
       (select arg_min(isbn, (rank, isbn)) as isbn, t, a, sum(n)::bigint as editions, count(*) as works from
        (select arg_min(isbn, (rank, isbn)) as isbn, min(rank) as rank, lower(arg_min(title, (rank, isbn))) as t, lower(arg_min(author, (rank, isbn))) as a, count(*) as n from judged where reason is null group by coalesce('id:' || wid, 'work:' || lower(title) || '|' || lower(author))) group by t, a) d
       join (select isbn, publication_date as on_sale, id % 6 = 1 or id % 8 = 2 as known from judged) e on e.isbn = d.isbn
       left join (select lower(title) as t, lower(author) as a, min(id) as id from books where id % 6 = 1 group by 1, 2) c on c.t = d.t and c.a = d.a""",
    JUDGED,
)
def publisher_discovery(t: Tables) -> DataFrame:
    """The feed against a sixth of the books, and against sources that know some ISBNs more."""
    sources = t.books.where("id % 8 = 2").select(F.lit("feed").alias("provider"), F.col("isbn").alias("source_isbn"))
    out = publisher.discover_titles(judged(t), t.books.where("id % 6 = 1"), sources, "feed")
    return out.select("isbn", "on_sale", "editions", "works", "outcome", "colliding_book")


@query(
    "publisher_sync",
    """select coalesce(j.reason, x.outcome, 'other_edition') as outcome, count(*) as n from dated j left join
       (select isbn, case when known then 'already_known' when hit is not null then 'work_collision' when row_number() over (partition by known or hit is not null order by case when on_sale > date '1998-08-01' then 0 else 1 end, abs(on_sale - date '1998-08-01'), isbn) <= 40 then 'planned' else 'deferred' end as outcome
        from (select d.isbn, e.on_sale, e.known, c.id as hit from
              (select arg_min(isbn, (rank, isbn)) as isbn, t, a from
               (select arg_min(isbn, (rank, isbn)) as isbn, min(rank) as rank, lower(arg_min(title, (rank, isbn))) as t, lower(arg_min(author, (rank, isbn))) as a from dated where reason is null group by coalesce('id:' || wid, 'work:' || lower(title) || '|' || lower(author))) group by t, a) d
              join (select isbn, publication_date as on_sale, id % 6 = 1 or id % 8 = 2 as known from judged) e on e.isbn = d.isbn
              left join (select lower(title) as t, lower(author) as a, min(id) as id from books where id % 6 = 1 group by 1, 2) c on c.t = d.t and c.a = d.a)) x on x.isbn = j.isbn and j.reason is null group by 1""",
    JUDGED,
    ("dated", "select * replace (case when reason is null and publication_date not between date '1998-08-01' - 90 and date '1998-08-01' + 180 then 'outside_window' else reason end as reason) from judged"),
)
def publisher_sync(t: Tables) -> DataFrame:
    """The whole feed of a window around one day, of which 40 titles are planned."""
    sources = t.books.where("id % 8 = 2").select(F.lit("feed").alias("provider"), F.col("isbn").alias("source_isbn"))
    out = publisher.publisher_sync(judged(t), t.books.where("id % 6 = 1"), sources, "feed", "1998-08-01", 40)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("verified_releases", "select id, publication_date, 'feed' as provider from books where publication_date between date '1998-03-01' and date '1998-09-30' and id % 3 <> 0")
def verified_releases(t: Tables) -> DataFrame:
    day = F.when(nth() % 3 == 0, F.date_add("publication_date", 1)).otherwise(F.col("publication_date"))
    sources = t.books.select(nth().alias("book_id"), F.lit("feed").alias("provider"), F.lit("https://p.example/").alias("source_url"), day.alias("verified_publication_date"))
    return readers.verified_releases(t.books, sources, "1998-03-01", "1998-09-30").select("id", "publication_date", "provider")


@query("latest_books", "select id, title, publication_year from books where publication_year is not null order by publication_year desc, title, id limit 30")
def latest_books(t: Tables) -> DataFrame:
    return readers.latest_books(t.books).select("id", "title", "publication_year")
