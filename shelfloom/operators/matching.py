"""Entity resolution: titles, authors, editions, and sources against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import editions as ed
from ..functions.text import author_key, fold, title_key, work_identity
from ..sources.files import cut
from .quality import first_reason

#: Words without weight in a comparison of titles.
SMALL_WORDS = ("a", "an", "and", "of", "or", "the")


def title_tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: (w != "") & ~w.isin(*SMALL_WORDS))


def base_title_key(source: Column) -> Column:
    """Key of a title without its subtitle; empty if it has none."""
    return title_key(F.regexp_extract(source, "^([^:：]+)[:：]", 1))


def title_match(source: Column, candidate: Column) -> Column:
    """struct(kind, score) of two titles; see match_title_keys. For a few rows: tables go through with_title_match."""
    return match_title_keys(title_key(source), title_key(candidate), base_title_key(source))


def with_title_match(pairs: DataFrame, source: str, candidate: str, name: str) -> DataFrame:
    """pairs with the title_match of two of their columns; keys and words are columns, so that each is made once a row."""
    keyed = pairs.withColumns({"_a": title_key(F.col(source)), "_b": title_key(F.col(candidate)), "_base": base_title_key(F.col(source))})
    keyed = keyed.withColumns({"_x": title_tokens(F.col("_a")), "_y": title_tokens(F.col("_b"))})
    return keyed.withColumn(name, _match_titles(*map(F.col, ("_a", "_b", "_base", "_x", "_y")))).drop("_a", "_b", "_base", "_x", "_y")


def match_title_keys(a: Column, b: Column, base: Column) -> Column:
    """struct(kind, score): exact 100, subtitle left out 96, same words 92, strong 80 to 90, else weak.

    The keys are read many times: over more than a few rows they should be columns.
    """
    return _match_titles(a, b, base, title_tokens(a), title_tokens(b))


def _match_titles(a: Column, b: Column, base: Column, x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    nx, ny = F.size(F.array_distinct(x)), F.size(F.array_distinct(y))
    jaccard = F.when(nx + ny - both > 0, both / (nx + ny - both)).otherwise(0.0)
    recall, exact = F.when(nx > 0, both / nx).otherwise(0.0), F.when(ny > 0, both / ny).otherwise(0.0)
    generic = (F.size(x) == 1) | (F.length(a) <= 5)
    strong = ~generic & (both >= 2) & (recall >= 0.8) & (exact >= 0.75) & (jaccard >= 0.65)
    made = lambda kind, score: F.struct(F.lit(kind).alias("kind"), F.round(score).cast("int").alias("score"))
    return (
        F.when((a == "") | (b == ""), made("missing", F.lit(0)))
        .when(a == b, made("exact", F.lit(100)))
        .when((base != "") & (base == b), made("subtitle_omitted", F.lit(96)))
        .when((F.size(x) == F.size(y)) & (both == F.size(x)), made("token_exact", F.lit(92)))
        .when(strong, made("strong_tokens", 80 + jaccard * 10))
        .when(generic, made("generic_title", jaccard * 79))
        .otherwise(made("weak_tokens", jaccard * 79))
    )


def title_agrees(match: Column) -> Column:
    return match["kind"].isin("exact", "subtitle_omitted", "token_exact", "strong_tokens")


def author_match(source: Column, candidate: Column) -> Column:
    """struct(kind, score) of two author names; see match_author_keys."""
    return match_author_keys(author_key(source), author_key(candidate))


def match_author_keys(a: Column, b: Column) -> Column:
    """struct(kind, score): exact 100, same surname with first name or initial 90, else mismatch."""
    x, y = F.split(a, " "), F.split(b, " ")
    p, q = F.element_at(x, 1), F.element_at(y, 1)
    initial = (p == q) | ((F.length(p) == 1) & F.startswith(q, p)) | ((F.length(q) == 1) & F.startswith(p, q))
    made = lambda kind, score: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    strong = (F.element_at(x, -1) == F.element_at(y, -1)) & initial
    return F.when((a == "") | (b == ""), made("missing", 0)).when(a == b, made("exact", 100)).when(strong, made("strong_name", 90)).otherwise(made("mismatch", 0))


def author_agrees(match: Column) -> Column:
    return match["kind"].isin("exact", "strong_name")


#: What an edition's evidence weighs.
WEIGHTS = {
    "preferred_isbn": 40, "title_exact": 35, "title_subtitle_omitted": 32, "title_token_exact": 30, "title_strong_tokens": 25, "title_inherited_work": 20, "author_exact": 25,
    "author_strong_name": 20, "author_inherited": 15, "english": 10, "trade_format": 8, "cover": 5, "description": 4, "publication_year": 3, "library_binding": -12, "large_print": -8,
}
LEAST_SCORE, LEAST_MARGIN = 55, 8


def score_editions(pairs: DataFrame) -> DataFrame:
    """pairs of a source and a candidate edition with reject_reason, evidence and score.

    Columns read: source_title, source_author, preferred_isbn, isbn, title, subtitle, author, format,
    languages, has_cover, has_description, year; and work_matches where given: whether the edition's work
    is known to be the source's, so that an edition without title or authors inherits them.
    """
    inherits = F.coalesce(F.col("work_matches"), F.lit(False)) if "work_matches" in pairs.columns else F.lit(False)
    no_title, no_author = (F.coalesce(F.trim(c), F.lit("")) == "" for c in ("title", "author"))
    full = F.concat_ws(" ", "title", "subtitle")
    rows = pairs.withColumns({
        "_a": title_key(F.col("source_title")), "_b": title_key(F.col("title")), "_base": base_title_key(F.col("source_title")), "_x": author_key(F.col("source_author")),
        "_y": author_key(F.col("author")), "_asked": fold(F.col("source_title")), "_named": fold(full),
    })
    rows = rows.withColumns({"_p": title_tokens(F.col("_a")), "_q": title_tokens(F.col("_b"))})
    rows = rows.withColumns({"t": _match_titles(*map(F.col, ("_a", "_b", "_base", "_p", "_q"))), "a": match_author_keys(F.col("_x"), F.col("_y"))})
    english = F.exists(F.coalesce("languages", F.array().cast("array<string>")), ed.is_english)
    reason = F.coalesce(
        first_reason([("missing_valid_isbn", F.col("isbn").isNull())]), ed.other_variant(F.col("_asked"), F.col("_named")),
        first_reason([
            ("audio_only", ed.audio_only(F.col("format"), full)), ("non_english", (F.size("languages") > 0) & ~english), ("title_mismatch", ~title_agrees(F.col("t")) & ~(inherits & no_title)),
            ("author_mismatch", ~no_author & ~author_agrees(F.col("a"))), ("missing_author_evidence", no_author & ~inherits),
        ]),
    )
    evidence = {
        "preferred_isbn": F.col("isbn") == F.col("preferred_isbn"), **{f"title_{k}": F.col("t.kind") == k for k in ("exact", "subtitle_omitted", "token_exact", "strong_tokens")},
        "title_inherited_work": inherits & no_title & ~title_agrees(F.col("t")), **{f"author_{k}": F.col("a.kind") == k for k in ("exact", "strong_name")}, "author_inherited": inherits & no_author, "english": english, "trade_format": ed.trade_format(F.col("format")), "cover": F.col("has_cover"),
        "description": F.col("has_description"), "publication_year": F.col("year").isNotNull(), "library_binding": ed.library_binding(F.col("format")), "large_print": ed.large_print(F.col("format")),
    }
    holds = {k: F.coalesce(c, F.lit(False)) for k, c in evidence.items()}
    score = sum((F.when(c, WEIGHTS[k]).otherwise(0) for k, c in holds.items()), F.lit(0))
    reasons = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in holds.items())), lambda x: x.isNotNull())
    rows = rows.withColumn("reject_reason", reason).drop("_a", "_b", "_base", "_p", "_q", "_x", "_y", "_asked", "_named")
    return rows.withColumns({"score": F.when(F.col("reject_reason").isNull(), score).otherwise(0), "reasons": F.array_join(reasons, ",")})


def select_winner(scored: DataFrame, key: str, tie: list[Column], least_score: int = LEAST_SCORE, least_margin: int = LEAST_MARGIN) -> DataFrame:
    """The best eligible row of each key, with the margin to the next and whether it is clear enough."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), *tie)
    ranked = scored.where("reject_reason is null").withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order)})
    top = ranked.where("place = 1").withColumn("margin", F.col("score") - F.col("next"))
    status = F.when(F.col("score") < least_score, "below_minimum_score").when(F.col("margin") < least_margin, "ambiguous_winner").otherwise("selected")
    return top.withColumn("status", status).drop("place", "next")


def completeness(columns: list[Column]) -> Column:
    """How many of the columns hold something."""
    return sum((F.when(c, 1).otherwise(0) for c in columns), F.lit(0))


#: List columns that make an edition complete, one point each; and those of a work, compared one after another.
EDITION_PARTS = ("authors", "languages", "publishers", "formats", "covers", "descriptions", "years", "subjects")
WORK_PARTS = ("isbns", "languages", "covers", "subjects", "years", "descriptions")


def edition_quality() -> Column:
    """How many of an edition's eight lists (EDITION_PARTS) hold something: 0 to 8."""
    return completeness([F.coalesce(F.size(c), F.lit(0)) > 0 for c in EDITION_PARTS])


def work_quality() -> Column:
    """A work's quality in seven parts: 2 for an edition id (column edition_id), then the sizes of WORK_PARTS; compared in that order."""
    sizes = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias(c) for c in WORK_PARTS)
    return F.struct(F.when(F.col("edition_id").isNotNull(), 2).otherwise(0).alias("edition"), *sizes)


def best_of_group(rows: DataFrame, key: list[str], quality: Column, tie: list[Column]) -> DataFrame:
    """One row a group: the most complete, ties by `tie`; members counts the group."""
    order = Window.partitionBy(*key).orderBy(quality.desc(), *tie)
    out = rows.withColumns({"_place": F.row_number().over(order), "members": F.count("*").over(Window.partitionBy(*key))})
    return out.where("_place = 1").drop("_place")


def first_seen(rows: DataFrame, key: Column, line: str = "line") -> DataFrame:
    """rows with first_line, the first line that has the same key; null keys have none."""
    window = Window.partitionBy("_key", F.when(F.col("_key").isNull(), F.col(line)))
    out = rows.withColumn("_key", key).withColumn("first_line", F.min(line).over(window))
    return out.withColumn("first_line", F.when(F.col("_key").isNotNull(), F.col("first_line"))).drop("_key")


def match_by_priority(entries: DataFrame, books: DataFrame) -> DataFrame:
    """entries (line, isbn, title, author) against books (id, isbn, title, author): by ISBN, else by work.

    An ISBN of another work is a conflict, several books of a work are ambiguous, and of entries that
    match one book the first line has it.
    """
    mine = entries.withColumn("identity", work_identity(F.col("title"), F.col("author")))
    theirs = books.withColumn("identity", work_identity(F.col("title"), F.col("author")))
    by_isbn = theirs.where("isbn is not null").select("isbn", F.col("id").alias("isbn_id"), F.col("identity").alias("isbn_identity"))
    by_work = theirs.where("identity is not null").groupBy("identity").agg(F.count("*").alias("n"), F.min("id").alias("work_id"))
    rows = mine.join(by_isbn, "isbn", "left").join(by_work, "identity", "left")
    book = F.when(F.col("isbn_id").isNotNull(), F.when(F.col("isbn_identity").eqNullSafe(F.col("identity")), F.col("isbn_id"))).when(F.col("n") == 1, F.col("work_id"))
    rows = rows.withColumn("book_id", book)
    # entries without a book are dealt by line, not into one task
    claim = F.row_number().over(Window.partitionBy("book_id", F.when(F.col("book_id").isNull(), F.col("line"))).orderBy("line"))
    outcome = (
        F.when(F.col("isbn_id").isNotNull() & F.col("book_id").isNull(), "identity_conflict")
        .when(F.col("isbn_id").isNull() & (F.col("n") > 1), "ambiguous_work_match")
        .when(F.col("book_id").isNotNull() & (claim > 1), "existing_book_reused")
        .when(F.col("isbn_id").isNotNull(), "matched_isbn")
        .when(F.col("n") == 1, "matched_work")
        .otherwise("new")
    )
    return rows.select("line", "isbn", "title", "author", "book_id", outcome.alias("outcome"))


def unclaimed(books: DataFrame, matched: DataFrame) -> DataFrame:
    """Books that no entry matched."""
    return books.join(matched.where("book_id is not null").select(F.col("book_id").alias("id")), "id", "left_anti")


def publication_date_plan(rows: DataFrame, books: DataFrame) -> DataFrame:
    """rows (isbn, publication_date) against books (isbn, publication_date, publication_year)."""
    b = books.select("isbn", F.col("publication_date").alias("current"), F.col("publication_year").alias("year"), F.lit(True).alias("known"))
    out = rows.join(b, "isbn", "left")
    day = F.col("publication_date")
    status = (
        F.when(F.col("known").isNull(), "missing_book")
        .when(F.col("current") == day, "already_correct")
        .when(F.col("current").isNotNull(), "conflicting_date")
        .when(F.col("year").isNotNull() & (F.col("year") != F.year(day)), "year_mismatch")
        .otherwise("needs_update")
    )
    return out.select("isbn", "publication_date", status.alias("status"))


def guarded_updates(plan: DataFrame, table: DataFrame, key: str, column: str, expected: str) -> DataFrame:
    """Plan rows whose expected value is no longer in the table; a plan is applied only if there are none."""
    now = table.select(F.col(key).alias("_k"), F.col(column).alias("_now"), F.lit(True).alias("_known"))
    joined = plan.join(now, plan[key] == now["_k"], "left")
    return joined.where(F.col("_known").isNull() | ~F.col("_now").eqNullSafe(F.col(expected))).drop("_k", "_now", "_known")


def release_plan(rows: DataFrame, books: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (isbn, provider, title, author, publication_date) against books and sources (provider, isbn, book_id)."""
    identity = work_identity(F.col("title"), F.col("author"))
    b = books.select("isbn", F.col("id").alias("book_id"), F.col("publication_date").alias("current"))
    s = sources.select("provider", F.col("isbn").alias("source_isbn"), F.col("book_id").alias("source_book"))
    works = books.select(identity.alias("identity"), F.col("isbn").alias("other_isbn")).groupBy("identity").agg(F.min("other_isbn").alias("work_isbn"))
    out = rows.withColumn("identity", identity).join(b, "isbn", "left").join(works, "identity", "left")
    out = out.join(s, (out["isbn"] == s["source_isbn"]) & (out["provider"] == s["provider"]), "left").select(out["*"], "source_book")
    status = (
        F.when(F.col("book_id").isNotNull() & F.col("source_book").isNotNull() & (F.col("source_book") != F.col("book_id")), "provenance_conflict")
        .when(F.col("book_id").isNotNull() & ~F.col("current").eqNullSafe(F.col("publication_date")), "metadata_mismatch")
        .when(F.col("book_id").isNotNull() & F.col("source_book").isNull(), "missing_provenance")
        .when(F.col("book_id").isNotNull(), "already_present")
        .when(F.col("work_isbn").isNotNull(), "work_collision")
        .otherwise("new")
    )
    return out.select("isbn", "provider", status.alias("status"))


def preferred_editions(titles: DataFrame) -> DataFrame:
    """titles (work_id, isbn, title, author, rank) to one edition a work, then one a work identity; lowest rank, then ISBN.

    Works whose title or author leaves no key have no identity; each of them stays on its own.
    """
    live = titles.where("rank > 0")
    per_work = live.groupBy("work_id").agg(F.min(F.struct("rank", "isbn", "title", "author")).alias("e"), F.count("*").alias("editions")).select("work_id", "e.*", "editions")
    identity = work_identity(F.col("title"), F.col("author"))
    return per_work.groupBy(identity.alias("identity"), F.when(identity.isNull(), F.col("work_id")).alias("alone")).agg(
        F.min(F.struct("rank", "isbn", "work_id", "title", "author")).alias("e"), F.sum("editions").alias("editions"), F.count("*").alias("works")
    ).select("identity", "e.*", "editions", "works")


def growth_plan(titles: DataFrame, as_of: str, most: int) -> DataFrame:
    """titles (isbn, publication_date): upcoming soonest first, then recent newest first; the first `most` are planned, the rest wait.

    Only the last planned place is needed of the whole order, so no window runs over all titles.
    """
    day = F.lit(as_of).cast("date")
    away = F.datediff("publication_date", day)
    rows = titles.withColumns({"bucket": F.when(away > 0, 0).otherwise(1), "distance": F.abs(away)})
    planned = rows.orderBy("bucket", "distance", "isbn").limit(most).select("isbn", F.lit(True).alias("planned"))
    return rows.join(planned, "isbn", "left").select("isbn", "publication_date", F.when(F.col("planned"), "planned").otherwise("deferred").alias("action"))


def source_status(sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """sources (key, fingerprint) against resolved (key, fingerprint, status): current status, stale, missing or orphaned."""
    r = resolved.select(F.col("key").alias("rkey"), F.col("fingerprint").alias("rprint"), "status")
    joined = sources.join(r, F.col("key") == F.col("rkey"), "full")
    state = (
        F.when(F.col("key").isNull(), "orphaned").when(F.col("rkey").isNull(), "missing")
        .when(F.col("fingerprint") != F.col("rprint"), "stale").otherwise(F.col("status"))
    )
    return joined.select(F.coalesce("key", "rkey").alias("key"), state.alias("state"))


def refresh_plan(managed: DataFrame, remote: DataFrame) -> DataFrame:
    """managed (isbn, title, verified_date, book_date) against remote (isbn, title, on_sale): six outcomes; local changes are kept."""
    r = remote.select(F.col("isbn").alias("risbn"), F.col("title").alias("rtitle"), "on_sale")
    out = managed.join(r, managed["isbn"] == r["risbn"], "left")
    outcome = (
        F.when(F.col("risbn").isNull(), "not_found")
        .when(F.col("on_sale").isNull(), "invalid_remote")
        .when(title_key(F.col("title")) != title_key(F.col("rtitle")), "identity_mismatch")
        .when(~F.col("verified_date").eqNullSafe(F.col("book_date")), "local_divergence")
        .when(F.col("on_sale") == F.col("book_date"), "unchanged")
        .otherwise("date_changed")
    )
    return out.select("isbn", outcome.alias("outcome"))


def merge_metadata(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of the primary source, else of the secondary, with the source of each."""
    a, b = primary.alias("a"), secondary.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    columns = []
    for f in fields:
        columns += [F.coalesce(f"a.{f}", f"b.{f}").alias(f), F.when(F.col(f"a.{f}").isNotNull(), "primary").when(F.col(f"b.{f}").isNotNull(), "secondary").alias(f"{f}_from")]
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *columns)


def repair_plan(manifest: DataFrame, books: DataFrame) -> DataFrame:
    """manifest (old_isbn, new_isbn, title, author) against books: which book gets the new ISBN, or why none does."""
    old = books.select(F.col("isbn").alias("old_isbn"), F.col("id").alias("old_id"))
    new = books.select(F.col("isbn").alias("new_isbn"), F.col("id").alias("new_id"))
    identity = work_identity(F.col("title"), F.col("author"))
    works = books.groupBy(identity.alias("identity")).agg(F.count("*").alias("n"), F.min("id").alias("work_id"))
    out = manifest.withColumn("identity", identity).join(old, "old_isbn", "left").join(new, "new_isbn", "left").join(works, "identity", "left")
    action = (
        F.when(F.col("new_id").isNotNull() & F.col("old_id").isNotNull() & (F.col("new_id") != F.col("old_id")), "isbn_collision")
        .when(F.col("new_id").isNotNull(), "already_repaired").when(F.col("old_id").isNotNull(), "replace_isbn")
        .when(F.col("n") == 1, "alternate_match").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    )
    book = F.when(action == "replace_isbn", F.col("old_id")).when(action == "alternate_match", F.col("work_id")).when(action == "already_repaired", F.col("new_id"))
    return out.select("old_isbn", "new_isbn", action.alias("action"), book.alias("book_id"))


def candidate_lookup(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """sources (key, isbn, title, author) to candidates (record, isbn, title, author) by ISBN or by work, the former first."""
    s = sources.select("key", "isbn", work_identity(F.col("title"), F.col("author")).alias("identity"))
    return links_of(s, candidates.select("record", "isbn", work_identity(F.col("title"), F.col("author")).alias("identity")))


def links_of(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of sources (key, isbn, identity) and candidates (record, isbn, identity) of one ISBN or identity, with exact_isbn.

    There are as many rows as books of an identity squared, so none is shuffled: a pair is found once, by identity,
    or by ISBN where the identities differ. Only of keys and records that have several rows are pairs brought together.
    """
    several = lambda name: (F.count("*").over(Window.partitionBy(name)) > 1).alias(f"{name}_again")
    s = cut(sources.distinct().select("*", several("key")), "asked")
    c = cut(candidates.select("record", F.col("isbn").alias("code"), F.col("identity").alias("work")).distinct().select("*", several("record")), "records")

    def meet(s: DataFrame, c: DataFrame) -> DataFrame:
        same = F.coalesce(F.col("isbn") == F.col("code"), F.lit(False))
        by_work = s.join(c, F.col("identity") == F.col("work")).select("key", "record", same.alias("exact_isbn"))
        other_work = ~F.coalesce(F.col("identity") == F.col("work"), F.lit(False))
        return by_work.union(s.join(c, (F.col("isbn") == F.col("code")) & other_work).select("key", "record", F.lit(True).alias("exact_isbn")))

    once = meet(s.where("not key_again"), c.where("not record_again"))
    again = meet(s.where("key_again"), c).union(meet(s.where("not key_again"), c.where("record_again")))
    return once.union(again.groupBy("key", "record").agg(F.max("exact_isbn").alias("exact_isbn")))
