"""Catalogue queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, editions, isbn, text
from ..operators import catalog, matching, quality
from ..operators.quality import all_reasons, first_reason, reason_counts
from ..sources import dumps
from ..sources.files import scratch_dir
from .registry import query
from .views import Tables

# SQL expressions of the keys, for ASCII text
TITLE_KEY = r"regexp_replace(trim(regexp_replace(replace(lower(trim({0})), '''', ''), '[^a-z0-9]+', ' ', 'g')), '^(the|an|a)\s+', '')"
AUTHOR_KEY = r"trim(regexp_replace(replace(lower(trim({0})), '''', ''), '[^a-z0-9,]+', ' ', 'g'))"
RATINGS = ("ratings", "select work_key, count(*) as ratings_count, sum(value::int) as ratings_sum from ratings_log where value::int between 1 and 5 group by 1")
SHELVES = (
    "shelf_counts",
    "select work_key, count(*) filter (value = 'Want to Read') as want_to_read, count(*) filter (value = 'Currently Reading') as currently_reading, count(*) filter (value = 'Already Read') as already_read from shelf_log where value in ('Want to Read', 'Currently Reading', 'Already Read') group by 1",
)
SIGNALS = (
    "signals",
    "select w.*, coalesce(ratings_count, 0) as ratings_count, coalesce(ratings_sum, 0) as ratings_sum, coalesce(want_to_read, 0) as want_to_read, coalesce(currently_reading, 0) as currently_reading, coalesce(already_read, 0) as already_read from works w left join ratings r on r.work_key = w.work_key left join shelf_counts s on s.work_key = w.work_key",
)
JUDGED = (
    "judged",
    r"""select *, case when not regexp_full_match(work_key, '/works/OL[0-9]+W') then 'invalid_work_key' when trim(title) = '' then 'missing_title' when len(cover_ids) = 0 then 'missing_cover' when id % 41 = 0 then 'excluded'
        when ratings_count + want_to_read + currently_reading + already_read = 0 then 'no_signal' when ratings_count < 5 then 'below_min_ratings' when want_to_read + currently_reading + already_read < 3 then 'below_min_readers' end as reject_reason from signals""",
)
SCORE = "((ratings_sum + 70.0) / (ratings_count + 20) - 1) / 4 * ln(1 + already_read + 0.75 * currently_reading + 0.25 * want_to_read + ratings_count)"


def signals(t: Tables) -> DataFrame:
    return catalog.with_signals(t.works, catalog.rating_totals(t.ratings_log)[0], catalog.shelf_totals(t.shelf_log)[0])


def found(t: Tables) -> tuple[DataFrame, DataFrame]:
    excluded = t.works.where("id % 41 = 0").select("work_key").where("work_key <> 'bad'")
    return catalog.discover(signals(t), excluded, limit=500, min_ratings=5, min_readers=3)


@query("discover", f"select work_key, title, round({SCORE}, 9) as score, ratings_count from judged where reject_reason is null order by round({SCORE}, 12) desc, work_key limit 500", RATINGS, SHELVES, SIGNALS, JUDGED)
def discover(t: Tables) -> DataFrame:
    return found(t)[0].select("work_key", "title", F.round("score", 9).alias("score"), "ratings_count")


@query(
    "discover_reasons",
    "select r.reason, coalesce(n, 0) as n from (select unnest(['invalid_work_key','missing_title','missing_cover','excluded','no_signal','below_min_ratings','below_min_readers','accepted']) as reason) r left join (select coalesce(reject_reason, 'accepted') as reason, count(*) as n from judged group by 1) j on j.reason = r.reason",
    RATINGS, SHELVES, SIGNALS, JUDGED,
)
def discover_reasons(t: Tables) -> DataFrame:
    return reason_counts(found(t)[1], catalog.DISCOVER_REASONS)


@query("rating_totals", "select * from ratings", RATINGS)
def rating_totals(t: Tables) -> DataFrame:
    return catalog.rating_totals(t.ratings_log)[0]


@query("rating_rejects", "select 'out_of_range' as reject_reason, count(*) as n from ratings_log where value::int not between 1 and 5")
def rating_rejects(t: Tables) -> DataFrame:
    return catalog.rating_totals(t.ratings_log)[1]


@query("shelf_totals", "select * from shelf_counts", SHELVES)
def shelf_totals(t: Tables) -> DataFrame:
    return catalog.shelf_totals(t.shelf_log)[0]


@query("shelf_rejects", "select 'unknown_shelf' as reject_reason, count(*) as n from shelf_log where value not in ('Want to Read', 'Currently Reading', 'Already Read')")
def shelf_rejects(t: Tables) -> DataFrame:
    return catalog.shelf_totals(t.shelf_log)[1]


@query("orphan_ratings", "select count(*) as works, sum(ratings_count) as ratings from ratings where work_key not in (select work_key from works)", RATINGS)
def orphan_ratings(t: Tables) -> DataFrame:
    return catalog.orphans(catalog.rating_totals(t.ratings_log)[0], t.works).agg(F.count("*").alias("works"), F.sum("ratings_count").alias("ratings"))


@query("index_totals", "select count(*) as works, sum(ratings_count) as ratings, sum(ratings_sum) as stars, count(*) filter (ratings_sum < ratings_count or ratings_sum > 5 * ratings_count) as broken from signals", RATINGS, SHELVES, SIGNALS)
def index_totals(t: Tables) -> DataFrame:
    return signals(t).agg(
        F.count("*").alias("works"), F.sum("ratings_count").alias("ratings"), F.sum("ratings_sum").alias("stars"),
        F.count_if((F.col("ratings_sum") < F.col("ratings_count")) | (F.col("ratings_sum") > 5 * F.col("ratings_count"))).alias("broken"),
    )


def work_lines(t: Tables) -> DataFrame:
    """Works as dump lines, with rows of every kind that ingestion refuses."""
    i = F.col("id")
    payload = F.when(i % 53 == 0, F.lit("{broken")).when(i % 59 == 0, F.lit("[]")).otherwise(
        F.to_json(F.struct(F.trim("title").alias("title"), "cover_ids", F.struct(F.concat(F.lit("About "), "title").alias("value")).alias("description")))
    )
    kind = F.when(i % 61 == 0, "/type/redirect").otherwise("/type/work")
    twice = F.explode(F.when(i % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("revision")
    rows = t.works.select("*", twice)
    value = F.when(i % 67 == 0, F.concat_ws("\t", kind, "work_key")).otherwise(F.concat_ws("\t", kind, "work_key", F.col("revision").cast("string"), F.lit("2024-01-01"), payload))
    return rows.select(value.alias("value"), (i * 2 + F.col("revision")).alias("line_no"))


LINES = ("lines", "select w.*, r.revision, id * 2 + r.revision as line_no from works w join (select unnest([1, 2]) as revision) r on r.revision = 1 or id % 10 = 0")
WORK_REASON = (
    "line_reasons",
    """select *, case when id % 67 = 0 then 'malformed_dump_row' when id % 53 = 0 then 'invalid_json' when id % 61 = 0 then 'wrong_record_type' when id % 59 = 0 then 'malformed_row'
       when work_key = 'bad' then 'invalid_key' when trim(title) = '' then 'missing_title' end as reject_reason from lines""",
)


@query("ingest_work_rejects", "select coalesce(reject_reason, 'accepted') as reason, count(*) as n from line_reasons group by 1", LINES, WORK_REASON)
def ingest_work_rejects(t: Tables) -> DataFrame:
    rows = dumps.work_rows(dumps.dump_rows(work_lines(t)))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("counted_ingest", "select coalesce(reject_reason, 'accepted') as reason, count(*) as n from line_reasons group by 1", LINES, WORK_REASON)
def counted_ingest(t: Tables) -> DataFrame:
    """The same counts, taken in the pass that writes the accepted works."""
    rows = dumps.work_rows(dumps.dump_rows(work_lines(t)))
    return quality.write_counted(rows, scratch_dir(t.spark, "works"), dumps.WORK_REASONS).where("n > 0")


@query("ingest_works", "select work_key as key, max(revision) as revision, any_value(title) as title, 'About ' || any_value(title) as description from line_reasons where reject_reason is null group by 1", LINES, WORK_REASON)
def ingest_works(t: Tables) -> DataFrame:
    rows = dumps.work_rows(dumps.dump_rows(work_lines(t))).where("reject_reason is null")
    return dumps.latest_revision(rows).select("key", "revision", "title", "description")


@query(
    "signal_rows",
    "select case when event_id % 17 = 0 or event_id % 23 = 0 then 'malformed_row' else 'accepted' end as reason, count(*) as n from events group by 1",
)
def signal_rows(t: Tables) -> DataFrame:
    e = F.col("event_id")
    key = F.concat(F.lit("/works/OL"), (e % 200).cast("string"), F.lit("W"))
    parts = [F.when(e % 17 == 0, F.lit("/bad/1")).otherwise(key), F.lit("\\N"), F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")]
    value = F.concat(F.concat_ws("\t", *parts), F.when(e % 23 == 0, F.lit("\t")).otherwise(F.lit("")))
    rows = dumps.signal_rows(t.raw("events").select(value.alias("value")))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "author_names",
    "select '/authors/OL' || s_nationkey || 'A' as key, case when count(distinct s_nationkey % 5 = 0 and s_suppkey % 2 = 0) = 1 then min(case when s_nationkey % 5 = 0 and s_suppkey % 2 = 0 then 'Other' else 'Nation ' || s_nationkey end) end as name from supplier group by s_nationkey",
)
def author_names(t: Tables) -> DataFrame:
    n = F.col("s_nationkey")
    name = F.when((n % 5 == 0) & (F.col("s_suppkey") % 2 == 0), "Other").otherwise(F.concat(F.lit("Nation "), n.cast("string")))
    line = F.concat_ws("\t", F.lit("/type/author"), F.concat(F.lit("/authors/OL"), n.cast("string"), F.lit("A")), F.lit("1"), F.lit("2024-01-01"), F.to_json(F.struct(name.alias("name"))))
    rows = dumps.author_rows(dumps.dump_rows(t.raw("supplier").select(line.alias("value"), F.col("s_suppkey").alias("line_no"))))
    return dumps.author_names(rows.where("reject_reason is null"))


LANGUAGES = ("candidates", "select work_key, any_value(title) as title from (select work_key, title, row_number() over (partition by work_key order by key) as n from editions) where n = 1 group by 1")


def work_candidates(t: Tables) -> DataFrame:
    return t.editions.groupBy("work_key").agg(F.min_by("title", "key").alias("title"))


@query(
    "work_languages",
    "select work_key, array_to_string(languages, ',') as languages, case when list_contains(languages, 'en') then 'kept' when len(languages) = 0 then 'unknown' else 'non_english' end as status from (select work_key, coalesce(list_sort(list_distinct(list(case when l in ('/languages/eng') then 'en' else replace(l, '/languages/', '') end) filter (l is not null))), []) as languages from (select e.work_key, x.l from editions e left join (select key, unnest(languages) as l from editions) x on x.key = e.key) group by 1)",
)
def work_languages(t: Tables) -> DataFrame:
    out = catalog.work_languages(t.editions, work_candidates(t))
    return out.select("work_key", F.array_join("languages", ",").alias("languages"), "status")


@query("language_summary", "select case when e > 0 then 'kept' when n = 0 then 'unknown' else 'non_english' end as status, count(*) as works from (select work_key, sum(len(languages)) as n, count(*) filter (list_contains(languages, '/languages/eng')) as e from editions group by 1) group by 1")
def language_summary(t: Tables) -> DataFrame:
    return catalog.work_languages(t.editions, work_candidates(t)).groupBy("status").agg(F.count("*").alias("works"))


PLAIN = ("plain", "select *, list_contains(languages, '/languages/eng') and format not in ('Audio CD', 'Wall calendar') as english from editions")


@query(
    "enrich_isbns",
    """select work_key, string_agg(isbn, ',' order by isbn) filter (place <= 2) as isbns, count(*) filter (english) as english, count(*) > 2 as truncated from
       (select *, row_number() over (partition by work_key order by english desc, quality desc, isbn) as place from
        (select p.work_key, isbn, english, case when english then 1 + case when p.title = c.title then 2 else 0 end + case when cover > 0 then 2 else 0 end + case when regexp_matches(coalesce(publish_date, ''), '\\b(1[5-9]\\d\\d|20\\d\\d|2100)\\b') then 1 else 0 end else 0 end as quality
         from plain p join candidates c on c.work_key = p.work_key)) group by 1""",
    PLAIN, LANGUAGES,
)
def enrich_isbns(t: Tables) -> DataFrame:
    out = catalog.enrich(work_candidates(t), t.editions, most=2)
    return out.select("work_key", F.array_join("isbns", ",").alias("isbns"), "english", "truncated")


@query(
    "edition_fields",
    "select key, case when list_contains(languages, '/languages/eng') then 'en' when len(languages) > 0 then replace(languages[1], '/languages/', '') end as language, case when publish_date not like 'circa%' then cast(right(publish_date, 4) as int) end as publication_year, case format when 'Audio CD' then 'audiobook' when 'Mass Market Paperback' then 'paperback' when 'Hardcover' then 'hardcover' else format end as format from editions",
)
def edition_fields(t: Tables) -> DataFrame:
    return t.editions.select("key", editions.edition_language(F.col("languages")).alias("language"), dates.year_in(F.col("publish_date"), 2030).alias("publication_year"), editions.format_bucket(F.col("format")).alias("format"))


@query("product_kinds", "select coalesce(case format when 'Audio CD' then 'audiobook' when 'Wall calendar' then 'calendar' end, 'book') as kind, count(*) as n from editions group by 1")
def product_kinds(t: Tables) -> DataFrame:
    kind = editions.product_kind(F.col("format"), F.col("title"), F.lit(None).cast("string"))
    return t.editions.groupBy(F.coalesce(kind, F.lit("book")).alias("kind")).agg(F.count("*").alias("n"))


@query("date_precision", "select case when publish_date is null then 'unknown' else 'year_or_partial' end as precision, count(*) as n from editions group by 1")
def date_precision(t: Tables) -> DataFrame:
    return t.editions.groupBy(dates.precision(F.col("publish_date"), F.lit(None).cast("int")).alias("precision")).agg(F.count("*").alias("n"))


@query(
    "edition_candidates",
    "select reject_reason, count(*) as n, count(distinct isbn13) as isbns from (select case when cast(regexp_extract(author, '(\\d+)', 1) as int) % 7 = 0 then 'missing_author' when cover = 0 then 'no_usable_isbn' end as reject_reason, case when cover = 0 then null else isbn end as isbn13 from editions) group by 1",
)
def edition_candidates(t: Tables) -> DataFrame:
    number = F.regexp_extract("author", r"(\d+)", 1).cast("int")
    rows = t.editions.select("key", "title", "languages", "publish_date", "format", F.array(F.concat(F.lit("/authors/OL"), number.cast("string"), F.lit("A"))).alias("author_keys"), F.when(F.col("cover") == 0, F.array().cast("array<string>")).otherwise(F.array("isbn")).alias("isbns"))
    authors = t.editions.select(number.alias("n"), F.col("author").alias("name")).distinct().where("n % 7 <> 0").select(F.concat(F.lit("/authors/OL"), F.col("n").cast("string"), F.lit("A")).alias("key"), "name")
    out = catalog.edition_candidates(rows, authors, 2030)
    return out.groupBy("reject_reason").agg(F.count("*").alias("n"), F.count_distinct("isbn13").alias("isbns"))


@query("isbn_check", "select p_partkey as id, isbn, true as valid, false as broken_valid from part join books on p_partkey = id")
def isbn_check(t: Tables) -> DataFrame:
    wrong = F.concat(F.left("isbn", F.lit(12)), ((F.right("isbn", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    spaced = F.concat(F.left("isbn", F.lit(3)), F.lit("-"), F.substring("isbn", 4, 20))
    return t.books.select("id", "isbn", (isbn.isbn13(spaced) == F.col("isbn")).alias("valid"), isbn.isbn13(wrong).isNotNull().alias("broken_valid"))


@query(
    "work_identities",
    f"select t || '|' || a as identity, count(*) as n from (select {TITLE_KEY.format('title')} as t, {AUTHOR_KEY.format('author')} as a from books) group by 1",
)
def work_identities(t: Tables) -> DataFrame:
    key = F.replace(text.work_identity(F.concat(F.lit("The "), F.col("title"), F.lit(" (2nd printing)")), F.col("author")), F.lit("\u0000"), F.lit("|"))
    return t.books.groupBy(key.alias("identity")).agg(F.count("*").alias("n"))


@query("stable_keys", r"select id, regexp_replace(lower(title || ' ' || author), '[^a-z0-9]+', '-', 'g') as key from books")
def stable_keys(t: Tables) -> DataFrame:
    return t.books.select("id", text.stable_key(F.concat_ws(" ", "title", "author")).alias("key"))


HALVES = ("mine", "select * from books where id % 2 = 1"), ("theirs", "select id, case when id % 10 = 0 then '/works/OL' || (id + 1) || 'W' else work_key end as work_key, isbn, title, author from books where id % 2 = 0")


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    theirs = t.books.where("id % 2 = 0").withColumn("work_key", F.when(F.col("id") % 10 == 0, F.concat(F.lit("/works/OL"), (F.col("id") + 1).cast("string"), F.lit("W"))).otherwise(F.col("work_key")))
    return t.books.where("id % 2 = 1"), theirs


MEETINGS = (
    "meetings",
    f"""select m.work_key as key, t.id, 'work_key' as how, m.work_key as value from mine m join theirs t on t.work_key = m.work_key
        union all select m.work_key, t.id, 'isbn', m.isbn from mine m join theirs t on t.isbn = m.isbn
        union all select m.work_key, t.id, 'title_author', {TITLE_KEY.format('m.title')} || '|' || {AUTHOR_KEY.format('m.author')} from mine m join theirs t on {TITLE_KEY.format('m.title')} = {TITLE_KEY.format('t.title')} and lower(m.author) = lower(t.author)""",
)


@query(
    "dedup_check",
    """select m.work_key, title, case when low is null then 'new' when low < high then 'ambiguous' else 'existing' end as status, low as first_id, high as last_id, how as matched_by from mine m left join
        (select key, min(id) as low, max(id) as high, case when count(*) filter (how = 'work_key') > 0 then 'work_key' when count(*) filter (how = 'isbn') > 0 then 'isbn' else 'title_author' end as how
         from meetings group by 1) h on h.key = m.work_key""",
    *HALVES, MEETINGS,
)
def dedup_check(t: Tables) -> DataFrame:
    mine, theirs = halves(t)
    return catalog.dedup_check(mine.withColumn("isbns", F.array("isbn")), theirs)


@query("dedup_links", "select key as work_key, how as matched_by, value, count(distinct id) as n_books from meetings group by all", *HALVES, MEETINGS)
def dedup_links(t: Tables) -> DataFrame:
    mine, theirs = halves(t)
    links = catalog.dedup_links(mine.withColumn("isbns", F.array("isbn")), theirs)
    return links.withColumn("value", F.replace("value", F.lit("\u0000"), F.lit("|")))


@query("dedup_members", "select distinct how as matched_by, value, id from meetings", *HALVES, MEETINGS)
def dedup_members(t: Tables) -> DataFrame:
    mine, theirs = halves(t)
    return catalog.dedup_members(mine.withColumn("isbns", F.array("isbn")), theirs).withColumn("value", F.replace("value", F.lit("\u0000"), F.lit("|")))


MATCHED = (
    "matched",
    f"""select line, isbn, book_id, case when isbn_id is not null and not same then 'identity_conflict' when isbn_id is null and n > 1 then 'ambiguous_work_match' when book_id is not null and row_number() over (partition by book_id order by line) > 1 then 'existing_book_reused'
        when isbn_id is not null then 'matched_isbn' when n = 1 then 'matched_work' else 'new' end as outcome from
        (select e.line, e.isbn, i.id as isbn_id, i.t = e.t and i.a = e.a as same, w.n, case when i.id is not null then case when i.t = e.t and i.a = e.a then i.id end when w.n = 1 then w.id end as book_id from
         (select id as line, case when id % 3 = 0 then isbn else 'x' || isbn end as isbn, {TITLE_KEY.format('title')} as t, lower(author) as a from (select id, isbn, case when id % 21 = 0 then 'other' else title end as title, author from books)) e
         left join cat i on i.isbn = e.isbn left join (select t, a, count(*) as n, min(id) as id from cat group by 1, 2) w on w.t = e.t and w.a = e.a)""",
)
CAT = ("cat", f"select id, isbn, {TITLE_KEY.format('title')} as t, lower(author) as a from books where id % 4 = 0")


def csv_entries(t: Tables) -> DataFrame:
    known = F.when(F.col("id") % 3 == 0, F.col("isbn")).otherwise(F.concat(F.lit("x"), "isbn"))
    return t.books.select(F.col("id").alias("line"), known.alias("isbn"), F.when(F.col("id") % 21 == 0, "other").otherwise(F.col("title")).alias("title"), "author")


@query("csv_plan", "select line, isbn, book_id, outcome from matched", CAT, MATCHED)
def csv_plan(t: Tables) -> DataFrame:
    return matching.match_by_priority(csv_entries(t), t.books.where("id % 4 = 0")).select("line", "isbn", "book_id", "outcome")


@query("csv_summary", "select outcome, count(*) as n from matched group by 1", CAT, MATCHED)
def csv_summary(t: Tables) -> DataFrame:
    return matching.match_by_priority(csv_entries(t), t.books.where("id % 4 = 0")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("unclaimed_books", "select id from cat where id not in (select book_id from matched where book_id is not null)", CAT, MATCHED)
def unclaimed_books(t: Tables) -> DataFrame:
    books = t.books.where("id % 4 = 0")
    return matching.unclaimed(books, matching.match_by_priority(csv_entries(t), books)).select("id")


@query("first_seen", "select id, min(id) over (partition by lower(title), lower(author)) as first_line from books")
def first_seen(t: Tables) -> DataFrame:
    return matching.first_seen(t.books, text.work_identity(F.col("title"), F.col("author")), "id").select("id", "first_line")


@query(
    "plan_import",
    """select place, work_key, isbn, case when reason is null then 'insert' else 'skip' end as action, reason from (select *, case when reason is null and sum((reason is null)::int) over (order by place rows unbounded preceding) > 300 then 'limit' else reason end as final from
        (select place, work_key, isbn, case when reason is null and row_number() over (partition by isbn, reason is null order by place) > 1 then 'duplicate_isbn' else reason end as reason from
         (select r.*, case when status = 'existing' then 'existing' when trim(title) = '' then 'missing_title' when r.work_key in (select work_key from theirs) then 'duplicate_work_key' when r.isbn in (select isbn from theirs) then 'duplicate_isbn' end as reason from report r)))""".replace("reason is null then 'insert' else 'skip' end as action, reason from", "final is null then 'insert' else 'skip' end as action, final as reason from"),
    *HALVES,
    ("report", "select id as place, work_key, case when id % 13 = 0 then ' ' else title end as title, author, case when id % 6 = 0 then isbn when id % 5 = 0 then '9780000000002' else 'n' || isbn end as isbn, case when id % 11 = 0 then 'existing' else 'new' end as status from books"),
)
def plan_import(t: Tables) -> DataFrame:
    i = F.col("id")
    code = F.when(i % 6 == 0, F.col("isbn")).when(i % 5 == 0, "9780000000002").otherwise(F.concat(F.lit("n"), "isbn"))
    report = t.books.select(i.alias("place"), "work_key", F.when(i % 13 == 0, " ").otherwise(F.col("title")).alias("title"), "author", code.alias("isbn"), F.when(i % 11 == 0, "existing").otherwise("new").alias("status"))
    return catalog.plan_import(report, halves(t)[1], 300)


@query(
    "edition_scores",
    """select k, reject_reason, case when reject_reason is null then score else 0 end as score from (select id as k, case when format like '%Audio%' then 'audio_only' when len(languages) > 0 and not list_contains(languages, 'eng') then 'non_english' end as reject_reason,
        35 + 25 + case when list_contains(languages, 'eng') then 10 else 0 end + case when format in ('Mass Market Paperback', 'Hardcover') then 8 else 0 end + case when cover > 0 then 5 else 0 end + case when publish_date is not null and publish_date not like 'circa%' then 3 else 0 end as score
        from (select p_partkey as id, format, list_transform(languages, lambda l: replace(l, '/languages/', '')) as languages, cover, publish_date from editions join part on '/books/OL' || p_partkey || 'M' = key))""",
)
def edition_scores(t: Tables) -> DataFrame:
    return matching.score_editions(scoring_pairs(t)).select("k", "reject_reason", "score")


def scoring_pairs(t: Tables) -> DataFrame:
    e = t.editions
    return e.select(
        F.regexp_extract("key", r"(\d+)", 1).cast("bigint").alias("k"), "work_key", F.col("title").alias("source_title"), F.concat(F.lit("The "), "title").alias("title"), F.lit(None).cast("string").alias("subtitle"),
        F.col("author").alias("source_author"), "author", F.lit(None).cast("string").alias("preferred_isbn"), "isbn", "format",
        F.transform("languages", lambda x: F.replace(x, F.lit("/languages/"), F.lit(""))).alias("languages"), (F.col("cover") > 0).alias("has_cover"), F.lit(False).alias("has_description"),
        dates.year_in(F.col("publish_date"), 2030).alias("year"),
    )


@query(
    "edition_winners",
    """select work_key, k, score, margin, case when score < 55 then 'below_minimum_score' when margin < 8 then 'ambiguous_winner' else 'selected' end as status from (select *, score - lead(score) over w as margin, row_number() over w as place from
        (select work_key, id as k, 35 + 25 + case when list_contains(languages, '/languages/eng') then 10 else 0 end + case when format in ('Mass Market Paperback', 'Hardcover') then 8 else 0 end + case when cover > 0 then 5 else 0 end + case when publish_date is not null and publish_date not like 'circa%' then 3 else 0 end as score
         from (select *, cast(regexp_extract(key, '(\\d+)', 1) as bigint) as id from editions) where format not like '%Audio%' and (len(languages) = 0 or list_contains(languages, '/languages/eng')))
        window w as (partition by work_key order by score desc, k)) where place = 1""",
)
def edition_winners(t: Tables) -> DataFrame:
    return matching.select_winner(matching.score_editions(scoring_pairs(t)), "work_key", [F.asc("k")]).select("work_key", "k", "score", "margin", "status")


@query("work_representatives", "select title, author, id, members from (select *, count(*) over (partition by title, author) as members, row_number() over (partition by title, author order by (case when cover_id > 0 then 1 else 0 end + case when publication_year > 1990 then 1 else 0 end) desc, id) as place from books) where place = 1")
def work_representatives(t: Tables) -> DataFrame:
    quality = matching.completeness([F.col("cover_id") > 0, F.col("publication_year") > 1990])
    return matching.best_of_group(t.books, ["title", "author"], quality, [F.asc("id")]).select("title", "author", "id", "members")


@query(
    "title_matches",
    f"""select a.id, b.id as other, case when a.title = b.title then 'exact' when len(list_intersect(string_split(a.title, ' '), string_split(b.title, ' '))) = 2 then 'token_exact' else 'weak_tokens' end as kind from books a join books b on b.id = a.id + 1""",
)
def title_matches(t: Tables) -> DataFrame:
    b = t.books.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("title").alias("b"))
    pairs = t.books.join(b, "id").select("id", "other", "title", "b")
    return matching.with_title_match(pairs, "title", "b", "match").select("id", "other", F.col("match.kind").alias("kind"))


@query(
    "publication_date_plan",
    """select r.isbn, r.publication_date, case when b.isbn is null then 'missing_book' when b.publication_date = r.publication_date then 'already_correct' when b.publication_date is not null then 'conflicting_date' when b.publication_year <> year(r.publication_date) then 'year_mismatch' else 'needs_update' end as status
       from (select isbn, publication_date + cast(id % 2 as int) as publication_date from books) r left join (select isbn, case when id % 5 <> 0 then publication_date end as publication_date, case when id % 10 = 0 then 1998 else publication_year end as publication_year from books where id % 7 <> 0) b on b.isbn = r.isbn""",
)
def publication_date_plan(t: Tables) -> DataFrame:
    rows = t.books.select("isbn", F.expr("date_add(publication_date, cast(id % 2 as int))").alias("publication_date"))
    books = t.books.where("id % 7 <> 0").select("isbn", F.when(F.col("id") % 5 != 0, F.col("publication_date")).alias("publication_date"), F.when(F.col("id") % 10 == 0, 1998).otherwise(F.col("publication_year")).alias("publication_year"))
    return matching.publication_date_plan(rows, books)


@query("guarded_updates", "select id from books where id % 8 = 0 or id % 3 = 0")
def guarded_updates(t: Tables) -> DataFrame:
    plan = t.books.select("id", F.when(F.col("id") % 8 == 0, F.lit("x")).otherwise(F.col("title")).alias("expected"))
    return matching.guarded_updates(plan, t.books.where("id % 3 <> 0"), "id", "title", "expected").select("id")


@query(
    "release_plan",
    """select r.isbn, 'p' || r.id % 2 as provider, case when b.id is not null and s.book_id is not null and s.book_id <> b.id then 'provenance_conflict' when b.id is not null and b.publication_date <> r.publication_date + cast(r.id % 3 as int) then 'metadata_mismatch'
       when b.id is not null and s.book_id is null then 'missing_provenance' when b.id is not null then 'already_present' when w.title is not null then 'work_collision' else 'new' end as status
       from books r left join (select * from books where id % 4 = 0) b on b.isbn = r.isbn left join (select distinct lower(title) as title, lower(author) as author from books where id % 4 = 0) w on w.title = lower(r.title) and w.author = lower(r.author)
       left join (select 'p0' as provider, isbn, case when id % 16 = 0 then id + 1 else id end as book_id from books where id % 8 = 0) s on s.isbn = r.isbn and s.provider = 'p' || r.id % 2""",
)
def release_plan(t: Tables) -> DataFrame:
    rows = t.books.select("isbn", F.concat(F.lit("p"), (F.col("id") % 2).cast("string")).alias("provider"), "title", "author", F.expr("date_add(publication_date, cast(id % 3 as int))").alias("publication_date"))
    sources = t.books.where("id % 8 = 0").select(F.lit("p0").alias("provider"), "isbn", F.when(F.col("id") % 16 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("book_id"))
    return matching.release_plan(rows, t.books.where("id % 4 = 0"), sources)


TITLES = (
    "titles",
    "select id - id % 3 as work_id, isbn, title, author, case p_type when 'PROMO' then -1 when 'LARGE' then 1 when 'MEDIUM' then 2 when 'SMALL' then 3 else 4 end as rank, publication_date from books join part on p_partkey = id",
)


def feed_titles(t: Tables) -> DataFrame:
    kinds = F.when(F.col("p_type") == "PROMO", "Audio").when(F.col("p_type") == "LARGE", "Hardcover").when(F.col("p_type") == "MEDIUM", "Trade Paperback").when(F.col("p_type") == "SMALL", "Mass Market").otherwise("Other")
    rows = t.books.join(t.raw("part"), F.col("p_partkey") == F.col("id"))
    return rows.select((F.col("id") - F.col("id") % 3).alias("work_id"), "isbn", "title", "author", editions.format_rank(F.lit(None).cast("string"), kinds).alias("rank"), "publication_date")


@query(
    "preferred_editions",
    """select isbn, work_id, editions, works from (select arg_min(isbn, (rank, isbn)) as isbn, arg_min(work_id, (rank, isbn)) as work_id, sum(n) as editions, count(*) as works from
       (select work_id, arg_min(title, (rank, isbn)) as title, arg_min(author, (rank, isbn)) as author, min(rank) as rank, arg_min(isbn, (rank, isbn)) as isbn, count(*) as n
        from (select * replace (case when work_id % 4 = 0 then '***' else title end as title) from titles) where rank > 0 group by 1)
       group by lower(title), lower(author), case when title = '***' then work_id end)""",
    TITLES,
)
def preferred_editions(t: Tables) -> DataFrame:
    """One work in four has a title of which no key is left."""
    titles = feed_titles(t).withColumn("title", F.when(F.col("work_id") % 4 == 0, "***").otherwise(F.col("title")))
    return matching.preferred_editions(titles).select("isbn", "work_id", "editions", "works")


@query(
    "growth_plan",
    "select isbn, publication_date, case when row_number() over (order by case when publication_date > date '1998-08-01' then 0 else 1 end, abs(publication_date - date '1998-08-01'), isbn) <= 100 then 'planned' else 'deferred' end as action from titles",
    TITLES,
)
def growth_plan(t: Tables) -> DataFrame:
    return matching.growth_plan(feed_titles(t), "1998-08-01", 100)


@query("source_status", "select coalesce(s.id, r.id) as key, case when s.id is null then 'orphaned' when r.id is null then 'missing' when s.p <> r.p then 'stale' else r.status end as state from (select id, title as p from books where id % 5 <> 0) s full join (select id, case when id % 4 = 0 then 'x' else title end as p, case when id % 6 = 0 then 'review' else 'resolved' end as status from books where id % 7 <> 0) r on r.id = s.id")
def source_status(t: Tables) -> DataFrame:
    sources = t.books.where("id % 5 <> 0").select(F.col("id").alias("key"), F.col("title").alias("fingerprint"))
    resolved = t.books.where("id % 7 <> 0").select(F.col("id").alias("key"), F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("title")).alias("fingerprint"), F.when(F.col("id") % 6 == 0, "review").otherwise("resolved").alias("status"))
    return matching.source_status(sources, resolved)


@query(
    "refresh_plan",
    "select isbn, case when id % 9 = 0 then 'not_found' when id % 8 = 0 then 'invalid_remote' when id % 7 = 0 then 'identity_mismatch' when id % 5 = 0 then 'local_divergence' when id % 2 = 0 then 'unchanged' else 'date_changed' end as outcome from books",
)
def refresh_plan(t: Tables) -> DataFrame:
    i = F.col("id")
    managed = t.books.select("isbn", "title", F.when(i % 5 == 0, F.date_add("publication_date", 9)).otherwise(F.col("publication_date")).alias("verified_date"), F.col("publication_date").alias("book_date"))
    remote = t.books.where("id % 9 <> 0").select("isbn", F.when(i % 7 == 0, "else").otherwise(F.concat(F.lit("The "), "title")).alias("title"), F.when(i % 8 != 0, F.expr("date_add(publication_date, cast(id % 2 as int))")).alias("on_sale"))
    return matching.refresh_plan(managed, remote)


@query("merged_metadata", "select id, case when id % 3 = 0 then 'B ' || title else title end as title, case when id % 3 = 0 then 'secondary' else 'primary' end as title_from from books where id % 3 <> 0 or id % 5 <> 0")
def merged_metadata(t: Tables) -> DataFrame:
    second = t.books.where("id % 5 <> 0").select("id", F.concat(F.lit("B "), "title").alias("title"))
    return matching.merge_metadata(t.books.where("id % 3 <> 0").select("id", "title"), second, "id", ["title"])


@query(
    "repair_plan",
    """select m.id, case when n.id is not null and o.id is not null and n.id <> o.id then 'isbn_collision' when n.id is not null then 'already_repaired' when o.id is not null then 'replace_isbn' when w.n = 1 then 'alternate_match' when w.n > 1 then 'ambiguous' else 'missing' end as action from
       (select id, isbn as old_isbn, case when id % 2 = 0 then 'new' || isbn else (select min(isbn) from books b2 where b2.id = (b.id * 3) % 1000) end as new_isbn, lower(title) as t, lower(author) as a from books b) m
       left join (select * from books where id % 3 = 0) o on o.isbn = m.old_isbn left join (select * from books where id % 3 = 0) n on n.isbn = m.new_isbn left join (select lower(title) as t, lower(author) as a, count(*) as n from books where id % 3 = 0 group by 1, 2) w on w.t = m.t and w.a = m.a""",
)
def repair_plan(t: Tables) -> DataFrame:
    b2 = t.books.select(F.col("id").alias("i2"), F.col("isbn").alias("other"))
    manifest = t.books.join(b2, (F.col("id") * 3) % 1000 == F.col("i2"), "left").select("id", F.col("isbn").alias("old_isbn"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), "isbn")).otherwise(F.col("other")).alias("new_isbn"), "title", "author")
    out = matching.repair_plan(manifest, t.books.where("id % 3 = 0"))
    return manifest.select("id", "old_isbn").join(out, "old_isbn").select("id", "action")


@query("candidate_lookup", "select a.id as key, b.id as record, a.isbn = b.isbn as exact_isbn from books a join books b on lower(a.title) = lower(b.title) and lower(a.author) = lower(b.author)")
def candidate_lookup(t: Tables) -> DataFrame:
    """Every book as a source."""
    return matching.candidate_lookup(t.books.select(F.col("id").alias("key"), "isbn", "title", "author"), t.books.select(F.col("id").alias("record"), "isbn", "title", "author"))


@query("upsert_books", "select id, case when id % 3 = 0 and id % 4 <> 0 then upper(title) else title end as title, case when id % 7 = 0 then 'create' when id % 3 <> 0 then 'keep' when id % 4 = 0 then 'unchanged' else 'update' end as action from books where id % 7 <> 0 or id % 3 = 0")
def upsert_books(t: Tables) -> DataFrame:
    updates = t.books.where("id % 3 = 0").select("id", F.when(F.col("id") % 4 != 0, F.upper("title")).otherwise(F.when(F.col("id") % 7 == 0, F.col("title"))).alias("title"))
    return catalog.upsert_books(t.books.where("id % 7 <> 0").select("id", "title"), updates, "id", ["title"])


@query("genre_link_changes", "select book_id, genre, 'add' as change from (select book_id, genre || 's' as genre from book_genres where book_id % 3 = 0) union all select book_id, genre, 'remove' from book_genres where book_id % 3 = 0")
def genre_link_changes(t: Tables) -> DataFrame:
    wanted = t.book_genres.where("book_id % 3 = 0").select("book_id", F.concat("genre", F.lit("s")).alias("genre"))
    return catalog.link_changes(wanted, t.book_genres)


@query("genre_coverage", "select n as genres, count(*) as books from (select book_id, count(distinct genre) as n from book_genres group by 1) group by 1")
def genre_coverage(t: Tables) -> DataFrame:
    return t.book_genres.groupBy("book_id").agg(F.count_distinct("genre").alias("genres")).groupBy("genres").agg(F.count("*").alias("books"))


@query("lowest_isbn_per_work", "select work_key, min(isbn) as isbn from editions group by 1")
def lowest_isbn_per_work(t: Tables) -> DataFrame:
    return t.editions.groupBy("work_key").agg(F.min(isbn.isbn13(F.col("isbn"))).alias("isbn"))


@query("url_hosts", "select page_id, case when url like 'https://%' then lower(regexp_extract(url, '^https://([^/?#:]+)', 1)) end as host from pages")
def url_hosts(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", editions.https_host(F.col("url")).alias("host"))


@query("display_texts", r"select doc_id, left(trim(regexp_replace(text, '[\s\x00-\x1f\x7f]+', ' ', 'g')), 500) as shown from documents")
def display_texts(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.display_text(F.col("text"), 500).alias("shown"))


@query("release_rows_errors", "select id, array_to_string(list_filter([case when id % 5 = 0 then 'invalid_isbn' end, case when id % 7 = 0 then 'invalid_date' end], lambda x: x is not null), ',') as errors from books")
def release_rows_errors(t: Tables) -> DataFrame:
    code = F.when(F.col("id") % 5 == 0, F.lit("978000")).otherwise(F.col("isbn"))
    day = F.when(F.col("id") % 7 == 0, F.lit("2025-02-30")).otherwise(F.col("publication_date").cast("string"))
    errors = all_reasons([("invalid_isbn", isbn.isbn13(code).isNull()), ("invalid_date", dates.strict_day(day).isNull())])
    return t.books.select("id", F.array_join(errors, ",").alias("errors"))


@query("import_reasons", "select case when id % 97 = 0 then 'missing_title' else 'eligible' end as reason, count(*) as n from works group by 1")
def import_reasons(t: Tables) -> DataFrame:
    reason = catalog.import_reason(F.col("title"), F.lit("Some One"))
    return t.works.groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query("feed_languages", "select lang, lang = 'en' as accepted, count(*) as n from documents group by 1")
def feed_languages(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("lang", editions.feed_language_ok(F.col("lang"), F.lit(None).cast("string")).alias("accepted")).agg(F.count("*").alias("n"))


@query("edition_languages_by_reason", "select case when len(languages) = 0 then 'unknown' when not list_contains(languages, '/languages/eng') then 'non_english' end as reason, count(*) as n from editions group by 1")
def edition_languages_by_reason(t: Tables) -> DataFrame:
    reason = first_reason([("unknown", F.size("languages") == 0), ("non_english", ~editions.names_english(F.col("languages")))])
    return t.editions.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
