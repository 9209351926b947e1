"""A publisher's feed of titles against the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import editions as ed
from ..functions.dates import strict_day, sync_window
from ..functions.isbn import isbn13
from ..functions.text import work_identity
from ..sources.files import cut
from . import matching
from .quality import first_reason

#: Fixed value: parts of an address that stand for no cover.
NO_COVER = r"(?i)placeholder|no-cover"


def judge_titles(titles: DataFrame, site: str, provider_host: str) -> DataFrame:
    """titles with rank, isbn13, on_sale, source_url and the first reason against each.

    titles: title, author, isbn, language, language_description, format, format_description, onsale, path (of
    the title's page below `site`), cover_url. A format that is no plain print edition is `excluded_format`,
    which is no fault; the other reasons are.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    path = text("path")
    url = F.when(path != "", F.concat(F.lit(site.rstrip("/")), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))))
    rows = titles.withColumns({
        "rank": ed.format_rank(F.col("format"), F.col("format_description")), "isbn13": isbn13(text("isbn")),
        "on_sale": strict_day(F.left(text("onsale"), F.lit(10))), "source_url": url,
    })
    host = ed.https_host(F.col("source_url"))
    cover = text("cover_url")
    reason = first_reason([
        ("non_english", ~ed.feed_language_ok(F.col("language"), F.col("language_description"))), ("excluded_format", F.col("rank") <= 0), ("invalid_isbn", F.col("isbn13").isNull()),
        ("missing_title_or_author", (text("title") == "") | (text("author") == "")), ("invalid_date", F.col("on_sale").isNull()), ("invalid_source_url", host.isNull()),
        ("other_provider", host != provider_host), ("missing_cover", ed.https_host(cover).isNull() | F.regexp_like(cover, F.lit(NO_COVER))),
    ])
    return rows.withColumn("reject_reason", reason)


def discover_titles(judged: DataFrame, books: DataFrame, sources: DataFrame, provider: str) -> DataFrame:
    """One edition of each accepted work with its outcome: already_known (ISBN or source), work_collision, or new.

    judged: as judge_titles gives it, with work_id. books: id, isbn, title, author. sources: provider,
    source_isbn. colliding_book is the smallest id of the books of that work.
    """
    live = judged.where("reject_reason is null")
    identity = work_identity(F.col("title"), F.col("author"))
    work = F.coalesce(F.concat(F.lit("id:"), F.col("work_id").cast("string")), F.concat(F.lit("work:"), identity))
    chosen = matching.preferred_editions(live.select(work.alias("work_id"), F.col("isbn13").alias("isbn"), "title", "author", "rank"))
    facts = live.groupBy(F.col("isbn13").alias("isbn")).agg(F.min("on_sale").alias("on_sale"))
    isbns = books.where("isbn is not null").select("isbn").union(sources.where(F.col("provider") == provider).select("source_isbn")).distinct().withColumn("known", F.lit(True))
    works = books.groupBy(identity.alias("identity")).agg(F.min("id").alias("colliding_book")).where("identity is not null")
    out = chosen.join(facts, "isbn").join(isbns, "isbn", "left").join(works, "identity", "left")
    outcome = F.when(F.col("known"), "already_known").when(F.col("colliding_book").isNotNull(), "work_collision").otherwise("new")
    collision = F.when(outcome == "work_collision", F.col("colliding_book"))
    return out.select("isbn", "title", "author", "on_sale", "editions", "works", outcome.alias("outcome"), collision.alias("colliding_book"))


def publisher_sync(judged: DataFrame, books: DataFrame, sources: DataFrame, provider: str, as_of: str, most: int, past: int = 90, ahead: int = 180) -> DataFrame:
    """Every title of a feed (judged: as judge_titles gives it, with work_id) with what becomes of it: its columns and outcome.

    A reason against it, outside_window (on sale before or after the days that are synchronised), other_edition
    (its work comes in another one), already_known, work_collision; of the new ones the first `most` are
    planned (upcoming soonest first, then recent newest first) and the rest deferred.
    """
    first, last = sync_window(F.lit(as_of).cast("date"), past, ahead)
    outside = F.when(~F.col("on_sale").between(first, last), "outside_window")
    rows = cut(judged.withColumn("reject_reason", F.coalesce("reject_reason", outside)), "titles")
    found = cut(discover_titles(rows, books, sources, provider).select("isbn", "on_sale", "outcome"), "found")
    plan = matching.growth_plan(found.where("outcome = 'new'").select("isbn", F.col("on_sale").alias("publication_date")), as_of, most).select("isbn", "action")
    known = found.join(plan, "isbn", "left").select(F.col("isbn").alias("isbn13"), F.coalesce("action", "outcome").alias("found"))
    out = rows.join(known, "isbn13", "left")
    return out.withColumn("outcome", F.coalesce("reject_reason", "found", F.lit("other_edition"))).drop("reject_reason", "found")
