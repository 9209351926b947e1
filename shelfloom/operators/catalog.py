"""Catalogue jobs: popularity, editions of works, languages, import plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import editions as ed
from ..functions.text import display_text, other_script, title_key, work_identity
from ..sources.dumps import SHELVES, WORK_KEY, rating_reason, shelf_reason
from ..sources.files import cut
from ..sources.keyed import KeyedTable
from .quality import first_reason


@dataclass(frozen=True)
class Scoring:
    """A prior of so many ratings of that mean, and what a reader on each shelf weighs."""

    prior_ratings: int = 20
    prior_mean: float = 3.5
    already_read: float = 1.0
    currently_reading: float = 0.75
    want_to_read: float = 0.25


def rating_totals(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log (work_key, value) to (work_key, ratings_count, ratings_sum), and rejected values by reason."""
    rows = log.withColumn("reject_reason", rating_reason(F.col("value")))
    good = rows.where("reject_reason is null").groupBy("work_key").agg(F.count("*").alias("ratings_count"), F.sum(F.col("value").cast("int")).alias("ratings_sum"))
    return good, rows.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


def shelf_totals(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log (work_key, value) to readers on each shelf, and rejected values by reason."""
    rows = log.withColumn("reject_reason", shelf_reason(F.col("value")))
    names = ("want_to_read", "currently_reading", "already_read")
    good = rows.where("reject_reason is null").groupBy("work_key").agg(*(F.count_if(F.col("value") == s).alias(n) for n, s in zip(names, SHELVES, strict=True)))
    return good, rows.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


def with_signals(works: DataFrame, ratings: DataFrame, readers: DataFrame) -> DataFrame:
    """works with rating and reader totals, zero where the logs have none."""
    out = works.join(ratings, "work_key", "left").join(readers, "work_key", "left")
    names = ("ratings_count", "ratings_sum", "want_to_read", "currently_reading", "already_read")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def orphans(totals: DataFrame, works: DataFrame) -> DataFrame:
    """Totals of works that the catalogue doesn't have."""
    return totals.join(works, "work_key", "left_anti")


def popularity(scoring: Scoring = Scoring()) -> Column:
    """((mean rating with the prior - 1) / 4) * ln(1 + weighted readers + ratings)."""
    readers = scoring.already_read * F.col("already_read") + scoring.currently_reading * F.col("currently_reading") + scoring.want_to_read * F.col("want_to_read")
    mean = (F.col("ratings_sum") + scoring.prior_ratings * scoring.prior_mean) / (F.col("ratings_count") + scoring.prior_ratings)
    return ((mean - 1) / 4) * F.ln(1 + readers + F.col("ratings_count"))


DISCOVER_REASONS = ("invalid_work_key", "missing_title", "missing_cover", "excluded", "no_signal", "below_min_ratings", "below_min_readers")


def discover(works: DataFrame, excluded: DataFrame | None = None, *, limit: int, min_ratings: int = 0, min_readers: int = 10, scoring: Scoring = Scoring()) -> tuple[DataFrame, DataFrame]:
    """The most popular eligible works, and works with their first reason for rejection.

    works: work_key, title, author_keys, cover_ids and the totals of with_signals.
    """
    rows = works
    if excluded is not None:
        rows = rows.join(excluded.select("work_key", F.lit(True).alias("excluded")).distinct(), "work_key", "left")
    else:
        rows = rows.withColumn("excluded", F.lit(False))
    readers = F.col("want_to_read") + F.col("currently_reading") + F.col("already_read")
    conditions = (
        ~F.coalesce(F.regexp_like("work_key", F.lit(WORK_KEY)), F.lit(False)), F.coalesce(F.trim("title"), F.lit("")) == "", ~F.exists("cover_ids", lambda x: x > 0),
        F.col("excluded"), F.col("ratings_count") + readers == 0, F.col("ratings_count") < min_ratings, readers < min_readers,
    )
    judged = rows.withColumn("reject_reason", first_reason(list(zip(DISCOVER_REASONS, conditions, strict=True))))
    best = judged.where("reject_reason is null").withColumn("score", popularity(scoring)).orderBy(F.desc("score"), "work_key").limit(limit)
    return best, judged


def work_languages(editions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each candidate work's sorted languages over all its editions, and what they say."""
    wanted = candidates.select("work_key").distinct()
    rows = editions.join(wanted, "work_key").select("work_key", F.explode("languages").alias("language"))
    found = rows.groupBy("work_key").agg(F.array_sort(F.collect_set(ed.language_code(F.col("language")))).alias("languages"))
    out = wanted.join(found, "work_key", "left").withColumn("languages", F.coalesce("languages", F.array().cast("array<string>")))
    return out.withColumn("status", F.when(F.array_contains("languages", "en"), "kept").when(F.size("languages") == 0, "unknown").otherwise("non_english"))


def english_quality(work_title: Column) -> Column:
    """How complete an English edition is: title 1, same title 2, cover 2, year 1."""
    year = F.regexp_like(F.coalesce("publish_date", F.lit("")), F.lit(r"\b(?:1[5-9]\d\d|20\d\d|2100)\b"))
    key = title_key(F.col("title"))
    points = (F.coalesce(F.trim("title"), F.lit("")) != "", 1), ((key != "") & (key == title_key(work_title)), 2), (F.col("cover") > 0, 2), (year, 1)
    return sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points), F.lit(0))


def enrich(candidates: DataFrame, editions: DataFrame, most: int = 200) -> DataFrame:
    """ISBNs of each candidate work (work_key, title): the best of English editions first, filled with the lowest others, sorted.

    editions: work_key, isbn, title, languages, publish_date, format, cover.
    """
    rows = editions.join(candidates.select("work_key", F.col("title").alias("work_title")), "work_key").where("isbn is not null")
    plain = ed.product_kind(ed.format_bucket(F.col("format")), F.col("title"), F.lit(None).cast("string")).isNull() & ed.product_kind(F.col("format"), F.col("title"), F.lit(None).cast("string")).isNull()
    english = ed.names_english(F.col("languages")) & plain
    rank = F.struct(english.alias("english"), F.when(english, english_quality(F.col("work_title"))).otherwise(0).alias("quality"))
    each = rows.groupBy("work_key", "isbn").agg(F.max(rank).alias("rank"))
    order = Window.partitionBy("work_key").orderBy(F.desc("rank.english"), F.desc("rank.quality"), "isbn")
    kept = each.withColumn("place", F.row_number().over(order))
    return kept.groupBy("work_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col("isbn")))).alias("isbns"),
        F.count_if(F.col("rank.english")).alias("english"), (F.count("*") > most).alias("truncated"),
    )


def edition_candidates(editions: DataFrame, authors: DataFrame, latest_year: int) -> DataFrame:
    """Editions as canonical rows with their reason for rejection; author names must all be known and undisputed.

    editions: key, title, author_keys, isbns, languages, publish_date, format. authors: key, name.
    """
    from ..functions.dates import year_in

    wide = editions.select("key", F.size("author_keys").alias("wanted"), F.posexplode_outer("author_keys").alias("pos", "author_key"))
    named = wide.join(authors.select(F.col("key").alias("author_key"), "name"), "author_key", "left")
    lists = named.groupBy("key", "wanted").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name")))).alias("found"))
    lists = lists.select("key", F.when((F.size("found") == F.col("wanted")) & (F.col("wanted") > 0), F.transform("found", lambda x: x["name"])).alias("authors"))
    out = editions.join(lists, "key", "left")
    reason = first_reason([("missing_title", F.coalesce(F.trim("title"), F.lit("")) == ""), ("missing_author", F.col("authors").isNull()), ("no_usable_isbn", F.size("isbns") == 0)])
    out = out.withColumn("reject_reason", reason).withColumns({"language": ed.edition_language(F.col("languages")), "publication_year": year_in(F.col("publish_date"), latest_year), "format": ed.format_bucket(F.col("format"))})
    return out.select("key", "title", "authors", "language", "publication_year", "format", F.explode_outer("isbns").alias("isbn13"), "reject_reason")


#: How a candidate meets a book, in the order in which a match is named.
METHODS = ("work_key", "isbn", "title_author")


def _asked(rows: DataFrame, key: str, isbns: Column) -> DataFrame:
    """rows (key, work_key, title, author and isbns) to (key, method, value): a row for each value that it can be met by."""
    identity = work_identity(F.col("title"), F.col("author"))
    tagged = lambda method: lambda x: F.struct(F.lit(method).alias("method"), x.alias("value"))
    values = (F.array("work_key"), F.coalesce(isbns, F.array().cast("array<string>")), F.array(identity))
    each = F.concat(*(F.transform(v, tagged(k)) for k, v in enumerate(values)))
    return rows.select(F.col(key).alias("key"), F.inline(each)).where("value is not null")


def dedup_check(candidates: DataFrame, books: DataFrame) -> DataFrame:
    """Candidates against the catalogue by work key, ISBN, and title with author: status, first_id and last_id of the books met, matched_by.

    candidates: work_key, title, author, isbns. books: id, work_key, isbn, title, author. The first method
    that matches names the match; it is ambiguous if more than one book is met by any of them. Books of one
    value come as their smallest and largest id, so that a common title makes no pairs; dedup_members has all.
    """
    theirs = _asked(books, "id", F.array("isbn")).groupBy("method", "value").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    hits = _asked(candidates, "work_key", F.col("isbns")).join(theirs, ["method", "value"])
    met = hits.groupBy(F.col("key").alias("work_key")).agg(F.min("method").alias("method"), F.min("low").alias("first_id"), F.max("high").alias("last_id"))
    status = F.when(F.col("method").isNull(), "new").when(F.col("first_id") < F.col("last_id"), "ambiguous").otherwise("existing")
    by = F.get(F.array(*map(F.lit, METHODS)), F.col("method"))
    return candidates.select("work_key", "title").join(met, "work_key", "left").select("work_key", "title", status.alias("status"), "first_id", "last_id", by.alias("matched_by"))


def dedup_links(candidates: DataFrame, books: DataFrame) -> DataFrame:
    """(work_key, matched_by, value, n_books): each value by which a candidate meets books, and how many.

    With dedup_members, which has the books of each value, this is every meeting, at a row a value.
    """
    theirs = _asked(books, "id", F.array("isbn")).distinct().groupBy("method", "value").agg(F.count("*").alias("n_books"))
    links = _asked(candidates, "work_key", F.col("isbns")).distinct().join(theirs, ["method", "value"])
    return links.select(F.col("key").alias("work_key"), F.get(F.array(*map(F.lit, METHODS)), F.col("method")).alias("matched_by"), "value", "n_books")


def dedup_members(candidates: DataFrame, books: DataFrame) -> DataFrame:
    """(matched_by, value, id): the books that candidates meet, a row for each value by which one is met; the values are those of dedup_links."""
    wanted = _asked(candidates, "work_key", F.col("isbns")).select("method", "value").distinct()
    found = _asked(books, "id", F.array("isbn")).join(wanted, ["method", "value"], "left_semi").distinct()
    return found.select(F.get(F.array(*map(F.lit, METHODS)), F.col("method")).alias("matched_by"), "value", F.col("key").alias("id"))


def import_reason(title: Column, author: Column) -> Column:
    """Why a candidate can't become a book: nothing to show, or nothing to compare it by."""
    shown, by = display_text(title, 500), display_text(author, 300)
    from ..functions.text import author_key, work_title_key

    no_key = work_title_key(shown) == ""
    return first_reason([
        ("missing_title", shown == ""), ("missing_author", by == ""), ("unsupported_script", no_key & other_script(shown)),
        ("missing_title", no_key), ("missing_author", author_key(by) == ""),
    ])


def plan_import(report: DataFrame, books: DataFrame, limit: int) -> DataFrame:
    """New candidates of a report (place, work_key, title, author, isbn, status; format where known) with the action on each.

    In the report's order: rows that are not new, can't be shown, or whose work or ISBN the catalogue has
    are skipped; of rows with one ISBN the first is taken; rows after the first `limit` eligible ones wait.
    """
    known_works = books.select("work_key", F.lit(True).alias("has_work")).distinct()
    known_isbns = books.where("isbn is not null").select("isbn", F.lit(True).alias("has_isbn")).distinct()
    rows = report.join(known_works, "work_key", "left").join(known_isbns, "isbn", "left")
    kind = ed.product_kind(F.col("format") if "format" in report.columns else F.lit(None).cast("string"), F.col("title"), F.lit(None).cast("string"))
    # a reason is worked out once a row, not once for each time that it is looked at
    rows = cut(rows.select("place", "work_key", "isbn", "status", "has_work", "has_isbn", F.coalesce(import_reason(F.col("title"), F.col("author")), kind).alias("ineligible")), "judged")
    reason = first_reason([
        ("existing", F.col("status") == "existing"), ("ambiguous", F.col("status") == "ambiguous"), ("ineligible", F.col("ineligible").isNotNull()),
        ("duplicate_work_key", F.col("has_work")), ("duplicate_isbn", F.col("has_isbn")),
    ])
    rows = rows.withColumn("reason", F.when(reason == "ineligible", F.col("ineligible")).otherwise(reason))
    # rows without an ISBN are dealt by place, not into one task
    first = F.row_number().over(Window.partitionBy("isbn", F.col("reason").isNull(), F.when(F.col("isbn").isNull(), F.col("place"))).orderBy("place"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("isbn").isNotNull() & (first > 1), "duplicate_isbn").otherwise(F.col("reason")))
    rows = cut(rows.select("place", "work_key", "isbn", "reason"), "reasons")
    # the limit is on places of eligible rows, so only its last place has to be known
    last = rows.where("reason is null").select("place").orderBy("place").limit(limit).agg(F.max("place"), F.count("*")).first()
    if last[1] == limit:
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("place") > last[0]), "limit").otherwise(F.col("reason")))
    return rows.select("place", "work_key", "isbn", F.when(F.col("reason").isNull(), "insert").otherwise("skip").alias("action"), "reason")


#: Why an import leaves a row out, in the order of its summary.
IMPORT_REASONS = (
    "existing", "ambiguous", "missing_title", "missing_author", "unsupported_script", "audiobook", "ebook", "large_print", "boxed_set",
    "calendar", "journal", "cards", "non_book", "duplicate_work_key", "duplicate_isbn", "limit", "not_attempted",
)


def import_summary(plan: DataFrame) -> DataFrame:
    """(action, reason, n) of a plan: inserted rows, and skipped ones for every reason there is, zeros included."""
    spark = plan.sparkSession
    names = spark.createDataFrame([("insert", None), *(("skip", r) for r in IMPORT_REASONS)], "action string, reason string")
    counts = plan.groupBy("action", "reason").agg(F.count("*").alias("n")).select(F.col("action").alias("a"), F.col("reason").alias("r"), "n")
    out = names.join(counts, (names["action"] == counts["a"]) & names["reason"].eqNullSafe(counts["r"]), "left")
    return out.select("action", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def apply_import(plan: DataFrame, rows: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The books after a plan, and the plan with what became of it.

    rows: work_key, isbn, title, author of the planned rows. A row whose work or ISBN books has by now is not
    inserted and gets the reason it would have had; books are only added, none changes.
    """
    has_work = books.where("work_key is not null").select("work_key", F.lit(True).alias("has_work")).distinct()
    has_isbn = books.where("isbn is not null").select("isbn", F.lit(True).alias("has_isbn")).distinct()
    checked = plan.join(has_work, "work_key", "left").join(has_isbn, "isbn", "left")
    # of planned rows of one work the first is inserted, and then the others' work is there; rows without a work are dealt by place
    open_row = F.col("action") == "insert"
    fresh = open_row & F.col("has_work").isNull() & F.col("has_isbn").isNull()
    turn = F.row_number().over(Window.partitionBy("work_key", F.when(F.col("work_key").isNull() | ~fresh, F.col("place"))).orderBy("place"))
    late = F.when(F.col("has_work"), "duplicate_work_key").when(F.col("has_isbn"), "duplicate_isbn").when(turn > 1, "duplicate_work_key")
    reason = F.when(open_row, late).otherwise(F.col("reason"))
    done = checked.select("place", "work_key", "isbn", F.when(open_row & late.isNull(), "insert").otherwise("skip").alias("action"), reason.alias("reason"))
    taken = done.where("action = 'insert'").select(F.col("work_key").alias("taken_work"), F.col("isbn").alias("taken_isbn"))
    facts = rows.select("work_key", "isbn", "title", "author").dropDuplicates(["work_key", "isbn"])
    new = facts.join(taken, F.col("work_key").eqNullSafe(F.col("taken_work")) & F.col("isbn").eqNullSafe(F.col("taken_isbn")))
    return books.select("work_key", "isbn", "title", "author").unionByName(new.select("work_key", "isbn", "title", "author")), done


def isbn_groups(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """candidates (isbn13 and columns) by ISBN: rows, different records, and whether they are duplicates or conflict."""
    record = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    # rows are counted per record first, so that a common ISBN arrives as few rows
    each = candidates.where("isbn13 is not null").groupBy("isbn13", record.alias("record")).agg(F.count("*").alias("rows"))
    groups = each.groupBy("isbn13").agg(F.sum("rows").alias("rows"), F.count("*").alias("records"))
    return groups.withColumns({"duplicate": F.col("rows") > 1, "conflicting": F.col("records") > 1})


def snapshot_counts(groups: DataFrame) -> DataFrame:
    """Counts over isbn_groups: rows read, records kept, repeated records, duplicate and conflicting ISBNs."""
    return groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("input"), F.coalesce(F.sum("records"), F.lit(0)).alias("accepted"), F.coalesce(F.sum(F.col("rows") - F.col("records")), F.lit(0)).alias("duplicate_records"),
        F.count_if("duplicate").alias("duplicate_isbns"), F.count_if("conflicting").alias("conflicting_isbns"),
    )


def in_candidate_order(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Different candidates by ISBN, title, authors and record digest, as a snapshot lists them."""
    record = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    once = candidates.withColumn("record_key", F.concat(F.lit("sha256:"), record)).dropDuplicates(["record_key"])
    return once.orderBy("isbn13", "title", F.array_join("authors", "\u0001"), "record_key")


def upsert_books(books: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """books after updates by key: non-null fields replace, unknown keys are added; action says which."""
    a, b = books.alias("a"), updates.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    changed = [F.col(f"b.{f}").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields]
    any_change = changed[0]
    for c in changed[1:]:
        any_change = any_change | c
    action = F.when(F.col(f"a.{key}").isNull(), "create").when(F.col(f"b.{key}").isNull(), "keep").when(any_change, "update").otherwise("unchanged")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{f}", f"a.{f}").alias(f) for f in fields), action.alias("action"))


#: Hosts of covers, and those whose covers never take the place of theirs.
COVERS, LESSER_COVERS = ("covers.openlibrary.org",), ("books.google.com", "books.googleusercontent.com", "lh3.googleusercontent.com")


def _host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def upsert_catalog(books: KeyedTable, links: KeyedTable, updates: DataFrame, genres: DataFrame, cover: str = "cover_url") -> DataFrame:
    """Books by ISBN after updates (isbn and fields, one row an ISBN) and their genres (isbn, genre): isbn, outcome.

    A null field leaves what is there, a cover of LESSER_COVERS leaves one of COVERS, and genre links are only
    added. created, updated (a field or a link is new) or unchanged. Only the buckets of created and updated
    books are written, both tables under one version; an update that changes nothing writes nothing.
    """
    fields = [c for c in books.columns if c not in books.key]
    only = books.touched(updates)
    now = books.read(only=only).select(*books.key, F.struct(*fields).alias("now"))
    value = {f: F.col(f) for f in fields}
    if cover in fields:
        keeps = F.coalesce(_host(F.col(cover)).isin(*LESSER_COVERS) & _host(F.col(f"now.{cover}")).isin(*COVERS), F.lit(False))
        value[cover] = F.when(~keeps, F.col(cover))
    rows = updates.join(now, books.key, "left")
    new = cut(genres.join(links.read(only=links.touched(genres)), links.key, "left_anti").join(updates.select(*books.key), books.key, "left_semi").select(*links.columns).distinct(), "links")
    linked = new.select(*books.key, F.lit(True).alias("linked")).distinct()
    differs = F.lit(False)
    for f in fields:
        differs = differs | (value[f].isNotNull() & ~value[f].eqNullSafe(F.col(f"now.{f}")))
    outcome = F.when(F.col("now").isNull(), "created").when(differs | F.coalesce("linked", F.lit(False)), "updated").otherwise("unchanged")
    judged = rows.join(linked, books.key, "left").select(*books.key, *(F.coalesce(value[f], F.col(f"now.{f}")).alias(f) for f in fields), outcome.alias("outcome"))
    judged = cut(judged, "judged")
    changed = judged.where("outcome <> 'unchanged'")
    if not changed.isEmpty():
        over = lambda old, more: old.join(more.select(*books.key), books.key, "left_anti").unionByName(more)
        version = books.upsert(changed.select(*books.columns), over)
        links.upsert(new, lambda old, more: old.unionByName(more), version)
    return judged.select(*books.key, "outcome")


def link_changes(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(book_id, genre, change): links to add, and links to remove from books that `wanted` has."""
    add = wanted.join(present, ["book_id", "genre"], "left_anti").withColumn("change", F.lit("add"))
    stale = present.join(wanted, ["book_id", "genre"], "left_anti").join(wanted, "book_id", "left_semi")
    return add.select("book_id", "genre", "change").unionByName(stale.select("book_id", "genre", F.lit("remove").alias("change")))
