"""Contracts of catalogue records, and the jobs that resolve sources to works and editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import editions as ed
from ..functions.isbn import isbn13
from ..functions.text import author_key, stable_key, title_key, work_identity
from ..sources.files import canonical_json, cut
from . import matching
from .catalog import import_reason
from .quality import first_reason


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def source_reason() -> Column:
    """Why a curated source (key, title, author, preferred_isbn, pinned_isbn, alternates) breaks its contract."""
    bad = lambda c: F.col(c).isNotNull() & F.coalesce(isbn13(F.col(c)) != F.col(c), F.lit(True))
    return first_reason([
        ("invalid_key", _blank(F.col("key")) | (stable_key(F.col("key")) != F.col("key"))), ("missing_title", _blank(F.col("title"))), ("missing_author", _blank(F.col("author"))),
        ("invalid_preferred_isbn", bad("preferred_isbn")), ("invalid_pinned_isbn", bad("pinned_isbn")), ("pinned_not_preferred", F.col("pinned_isbn").isNotNull() & ~F.col("pinned_isbn").eqNullSafe(F.col("preferred_isbn"))),
        ("pinned_with_alternates", F.col("pinned_isbn").isNotNull() & F.col("alternates")),
    ])


def candidate_reason(latest_year: int) -> Column:
    """Why a canonical candidate (record_id, isbn, title, authors, year, cover_url) breaks its contract."""
    return first_reason([
        ("missing_record_id", _blank(F.col("record_id"))), ("invalid_isbn", F.coalesce(isbn13(F.col("isbn")) != F.col("isbn"), F.lit(True))), ("missing_title", _blank(F.col("title"))),
        ("missing_author", F.coalesce(F.size("authors"), F.lit(0)) < 1), ("invalid_year", F.col("year").isNotNull() & ~F.col("year").between(1000, latest_year)),
        ("invalid_cover_url", F.col("cover_url").isNotNull() & ed.https_host(F.col("cover_url")).isNull()),
    ])


def resolved_reason() -> Column:
    """Why a resolved entry (status, isbn, title, author, diagnostic, genres) breaks its contract."""
    done = F.col("status") == "resolved"
    return first_reason([
        ("invalid_status", ~F.col("status").isin("resolved", "needs_review", "failed")), ("resolved_without_isbn", done & F.coalesce(isbn13(F.col("isbn")).isNull(), F.lit(True))),
        ("resolved_without_title", done & _blank(F.col("title"))), ("resolved_without_author", done & _blank(F.col("author"))), ("no_diagnostic", ~done & _blank(F.col("diagnostic"))),
        ("unknown_genre", F.exists(F.coalesce("genres", F.array().cast("array<string>")), lambda g: ~g.isin(*ed.GENRES))),
    ])


def isbn_policy() -> Column:
    """What a candidate's isbn means to its source (pinned_isbn, preferred_isbn, alternates)."""
    return (
        F.when(F.col("pinned_isbn").isNotNull(), F.when(F.col("isbn") == F.col("pinned_isbn"), "pinned").otherwise("violates_pin"))
        .when(F.col("isbn") == F.col("preferred_isbn"), "preferred")
        .when(F.col("preferred_isbn").isNull() | F.col("alternates"), "alternate")
        .otherwise("alternate_not_allowed")
    )


def report_faults(report: DataFrame) -> DataFrame:
    """Report rows whose matches (none, one, or more books from first_id to last_id) don't fit their status, or whose method is unknown."""
    low, high = F.col("first_id"), F.col("last_id")
    fits = (
        F.when(F.col("status") == "new", low.isNull() & high.isNull() & F.col("matched_by").isNull())
        .when(F.col("status") == "existing", low == high).when(F.col("status") == "ambiguous", low < high)
    )
    known = F.col("matched_by").isNull() | F.col("matched_by").isin("work_key", "isbn", "title_author")
    return report.where(~F.coalesce(fits & known, F.lit(False)))


def report_mismatches(report: DataFrame, artifact: DataFrame) -> DataFrame:
    """Keys that only one of both has, or that have different titles; empty if they belong together."""
    a = artifact.select(F.col("work_key").alias("other_key"), F.col("title").alias("other_title"))
    both = report.join(a, report["work_key"] == a["other_key"], "full")
    fault = F.when(F.col("work_key").isNull(), "not_in_report").when(F.col("other_key").isNull(), "not_in_artifact").when(F.col("title") != F.col("other_title"), "title_differs")
    return both.select(F.coalesce("work_key", "other_key").alias("work_key"), fault.alias("fault")).where("fault is not null")


def bridge(report: DataFrame, kept: DataFrame, editions: DataFrame, *, limit: int | None) -> DataFrame:
    """Every work of a report with the edition that stands for it, or the reason why it has none.

    report: place, work_key, status. kept: work_key, title, author, isbns, cover, and format and languages
    where known. editions: key, work_key, isbn, title, author, languages, format, cover, publish_date, year.
    Rows that are not new or not eligible carry their reason; eligible ones after the first `limit` carry
    'limit'. An edition competes with its lowest ISBN that the work lists; works that resolve to one
    identity all go to review.
    """
    has = lambda c: c in kept.columns
    kind = ed.product_kind(F.col("format") if has("format") else F.lit(None).cast("string"), F.col("title"), F.lit(None).cast("string"))
    why = first_reason([
        ("no_candidate", F.col("known").isNull()), ("ineligible", import_reason(F.col("title"), F.col("author")).isNotNull()), ("not_a_book", kind.isNotNull()),
        ("unknown_language", ~ed.names_english(F.col("languages")) if has("languages") else F.lit(False)), ("missing_isbn", F.coalesce(F.size("isbns"), F.lit(0)) < 1),
    ])
    known = kept.withColumn("known", F.lit(True))
    rows = report.select("place", "work_key", "status").join(known, "work_key", "left")
    rows = rows.select("place", "work_key", F.when(F.col("status") != "new", F.col("status")).otherwise(why).alias("reason"))
    if limit is not None:
        # the limit is on places of eligible rows, so only its last place has to be known
        last = rows.where("reason is null").select("place").orderBy("place").limit(limit).agg(F.max("place"), F.count("*")).first()
        if last[1] == limit:
            after = F.col("place") > last[0] if limit else F.lit(True)
            rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & after, "limit").otherwise(F.col("reason")))
    new = rows.where("reason is null").select("place", "work_key")
    works = new.join(kept.select("work_key", F.col("title").alias("source_title"), F.col("author").alias("source_author"), "isbns", F.col("cover").alias("work_cover")), "work_key")
    plain = ed.product_kind(F.col("format"), F.col("title"), F.lit(None).cast("string")).isNull() & ed.product_kind(ed.format_bucket(F.col("format")), F.col("title"), F.lit(None).cast("string")).isNull()
    live = editions.where(ed.names_english(F.col("languages")) & plain)
    pairs = works.join(live, "work_key").where(F.array_contains("isbns", F.col("isbn")))
    lowest = pairs.groupBy("work_key", "key").agg(F.min_by(F.struct(*[c for c in pairs.columns if c not in ("work_key", "key")]), "isbn").alias("e")).select("work_key", "key", "e.*")
    shaped = lowest.withColumns({
        "preferred_isbn": F.lit(None).cast("string"), "subtitle": F.lit(None).cast("string"), "has_cover": F.col("cover") > 0, "has_description": F.lit(False),
        "languages": F.transform("languages", lambda x: F.regexp_replace(x, "^/languages/", "")),
    })
    # the optimizer takes minutes over one plan of the match, the score and the choice
    scored = cut(matching.score_editions(cut(shaped, "contenders")), "scored")
    best = matching.select_winner(scored, "work_key", [F.asc("isbn")])
    best = best.withColumn("identity", work_identity(F.col("source_title"), F.col("source_author")))
    # works without an identity are dealt by key, not into one task
    twice = F.count("*").over(Window.partitionBy("identity", F.when(F.col("identity").isNull(), F.col("work_key")))) > 1
    best = best.withColumn("status", F.when((F.col("status") == "selected") & F.col("identity").isNotNull() & twice, "duplicate_identity").otherwise(F.col("status")))
    cover = F.when(F.col("cover") > 0, F.col("cover")).otherwise(F.col("work_cover"))
    out = rows.join(best.select("work_key", "isbn", "score", "status", cover.alias("cover")), "work_key", "left")
    return out.select("place", "work_key", "isbn", "score", F.coalesce("reason", "status", F.lit("no_eligible_editions")).alias("status"), "cover")


def choose_works(sources: DataFrame, works: DataFrame, margin: int = 8) -> DataFrame:
    """sources (key, title, author) to one of works (work_id, title, author, year, cover): the best match, if clear.

    Works are met by title and surname, or by author and one of the title's rarest words, of which a title
    that agrees has at least one. Works with the same title and author are one group, for which the most
    complete of them stands; the best group must lead by the margin. Sources of equal keys are matched once.
    """
    shape = F.struct("s_ak", "s_tk", "s_base")
    keyed = sources.select("key", author_key(F.col("author")).alias("s_ak"), title_key(F.col("title")).alias("s_tk"), matching.base_title_key(F.col("title")).alias("s_base"))
    # one plan of the keys and all joins takes the driver more memory than the tables
    keyed = cut(keyed, "sources")
    s = keyed.select(shape.alias("shape"), "s_ak", "s_tk", "s_base").distinct()
    w = works.withColumns({"ak": author_key(F.col("author")), "tk": title_key(F.col("title")), "group": work_identity(F.col("title"), F.col("author"))})
    # works of equal keys have equal scores: the best of them and their number stand for all
    quality = matching.completeness([F.col("year").isNotNull(), F.col("cover") > 0])
    stands = F.min(F.struct((-quality).alias("rank"), "work_id", "year", "cover")).alias("x")
    w = w.groupBy("ak", "tk", "group").agg(stands, F.count("*").alias("n")).select("ak", "tk", "group", "x.work_id", "x.year", "x.cover", "n")
    w = cut(w, "works")
    surname = lambda c: F.element_at(F.split(c, " "), -1)
    words = lambda c: F.array_distinct(F.when(F.size(matching.title_tokens(c)) > 0, matching.title_tokens(c)).otherwise(F.array(F.lit(""))))
    word_of = w.select("ak", "tk", F.explode(words(F.col("tk"))).alias("word")).distinct()
    common = word_of.groupBy("ak", "word").agg(F.count("*").alias("common"))
    asked = s.select("*", F.size(words(F.col("s_tk"))).alias("size"), F.explode(words(F.col("s_tk"))).alias("word"))
    asked = asked.join(common.withColumnRenamed("ak", "s_ak"), ["s_ak", "word"], "left")
    rarest = F.row_number().over(Window.partitionBy("shape").orderBy(F.coalesce("common", F.lit(0)), "word"))
    # four fifths of the words have to agree, so that one more than a fifth can't all be missing
    asked = asked.withColumn("n_th", rarest).where(F.col("n_th") <= F.col("size") - F.ceil(F.col("size") * 0.8 - 1e-9) + 1)
    by_word = asked.join(word_of, (F.col("s_ak") == F.col("ak")) & (asked["word"] == word_of["word"])).select("shape", "s_ak", "s_tk", "s_base", "ak", "tk")
    by_base = s.where("s_base <> ''").join(w, (F.col("s_ak") == F.col("ak")) & (F.col("s_base") == F.col("tk"))).select("shape", "s_ak", "s_tk", "s_base", "ak", "tk")
    by_title = s.join(w, (F.col("s_tk") == F.col("tk")) & (surname(F.col("s_ak")) == surname(F.col("ak")))).select("shape", "s_ak", "s_tk", "s_base", "ak", "tk")
    pairs = cut(by_title.union(by_base).union(by_word).distinct(), "pairs")
    t, a = matching.match_title_keys(F.col("s_tk"), F.col("tk"), F.col("s_base")), matching.match_author_keys(F.col("s_ak"), F.col("ak"))
    pairs = pairs.withColumns({"t": t, "a": a}).where(matching.title_agrees(F.col("t")) & matching.author_agrees(F.col("a")))
    pairs = pairs.withColumns({"score": F.round(F.col("t.score") * 0.7 + F.col("a.score") * 0.3).cast("int"), "reject_reason": F.lit(None).cast("string")})
    pairs = pairs.join(w, ["ak", "tk"])
    pairs = pairs.withColumn("all", F.sum("n").over(Window.partitionBy("shape", "group")))
    groups = matching.best_of_group(pairs, ["shape", "group"], quality, [F.asc("work_id")]).withColumn("members", F.col("all"))
    best = matching.select_winner(groups, "shape", [F.asc("work_id")], least_score=0, least_margin=margin).select("shape", "work_id", "score", "members", F.when(F.col("status") == "selected", "selected").otherwise("ambiguous").alias("status"))
    best = best.select("shape.*", "work_id", "score", "members", "status")
    return keyed.join(best, ["s_ak", "s_tk", "s_base"]).select("key", "work_id", "score", "members", "status")


RESOLVED = "key bigint, fingerprint string, work_id bigint, score int, members bigint, status string, provider string"


def resolve(sources: DataFrame, resolved: DataFrame, primary: DataFrame, secondary: DataFrame, margin: int = 8) -> DataFrame:
    """sources (key, title, author) resolved anew where they have to be: RESOLVED and how (carried or matched).

    An entry of `resolved` whose fingerprint is still the source's is carried over as it is. Only missing and
    changed sources are matched with the primary provider's works, and only those of them without a clear
    winner with the secondary's. Entries without a source are left out.
    """
    asked = cut(sources.withColumn("fingerprint", F.sha2(canonical_json(["title", "author"]), 256)), "asked")
    states = matching.source_status(asked.select("key", "fingerprint"), resolved.select("key", "fingerprint", "status"))
    open_keys = cut(states.where("state in ('missing', 'stale')").select("key"), "open")
    todo = asked.join(open_keys, "key", "left_semi")
    columns = ["key", "fingerprint", "work_id", "score", "members", "status", "provider"]
    kept = resolved.join(asked.select("key"), "key", "left_semi").join(open_keys, "key", "left_anti").select(*columns, F.lit("carried").alias("how"))

    def matched(rows: DataFrame, works: DataFrame, provider: str) -> DataFrame:
        found = choose_works(rows.select("key", "title", "author"), works, margin)
        return rows.select("key", "fingerprint").join(found, "key").select("key", "fingerprint", "work_id", "score", F.col("members").cast("bigint").alias("members"), "status", F.lit(provider).alias("provider"))

    first = cut(matched(todo, primary, "primary"), "first")
    won = first.where("status = 'selected'")
    rest = cut(todo.join(won.select("key"), "key", "left_anti"), "rest")
    second = first.limit(0) if rest.isEmpty() else cut(matched(rest, secondary, "secondary"), "second")
    # without a clear winner of either, the second's answer stands, then the first's
    left = rest.select("key", "fingerprint").join(second.drop("fingerprint"), "key", "left_anti").join(first.drop("fingerprint"), "key", "left")
    left = left.select("key", "fingerprint", "work_id", "score", "members", F.coalesce("status", F.lit("no_match")).alias("status"), "provider")
    new = won.select(columns).unionByName(second.select(columns)).unionByName(left.select(columns))
    return kept.unionByName(new.withColumn("how", F.lit("matched")))


def _targeted(sources: DataFrame, editions: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources and the editions that some source may ask for, with their keys; and the latter's first authors."""
    s = sources.select("key", "isbn", title_key(F.col("title")).alias("tk"), author_key(F.col("author")).alias("ak"))
    near = editions.withColumn("tk", title_key(F.col("title")))
    wanted = near.join(s.select("tk").distinct(), "tk", "left_semi").select("key").union(near.join(s.select("isbn").distinct(), "isbn", "left_semi").select("key")).distinct()
    picked = near.join(wanted, "key")
    first = picked.select("key", F.get("author_keys", F.lit(0)).alias("author_key"))
    named = first.join(authors.select(F.col("key").alias("author_key"), "name", F.lit(True).alias("known")), "author_key", "left")
    return s, picked.join(named.select("key", author_key(F.col("name")).alias("ak")), "key"), named


def targeted_extract(sources: DataFrame, editions: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Editions that a source asks for by ISBN, or by title and first author; and how author keys resolve.

    sources: key, isbn, title, author. editions: key, isbn, title, author_keys. authors: key, name (null if disputed).
    Pairs are found as in candidate_lookup, without a shuffle of them.
    """
    s, picked, _ = _targeted(sources, editions, authors)
    identity = F.concat_ws("\u0000", "tk", "ak").alias("identity")
    links = matching.links_of(s.select("key", "isbn", identity), picked.select(F.col("key").alias("record"), "isbn", identity))
    return links.select(F.col("key").alias("source_key"), F.col("record").alias("key"), "exact_isbn"), author_key_states(sources, editions, authors)


def author_key_states(sources: DataFrame, editions: DataFrame, authors: DataFrame) -> DataFrame:
    """How the author keys of targeted_extract resolve: counts by state."""
    named = _targeted(sources, editions, authors)[2]
    state = F.when(F.col("known").isNull(), "missing").when(F.col("name").isNull(), "conflicted").otherwise("resolved")
    return named.where("author_key is not null").select("author_key", state.alias("state")).distinct().groupBy("state").agg(F.count("*").alias("n"))


def pilot_plan(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """sources (key, isbn, title, author) with the clear winner among candidates (record, work_id, isbn, title, author, format, languages, year, has_cover).

    Products that are no books are out; candidates of different works that no work id unites go to review.
    A score depends on what a source and a candidate look like, and on whether their ISBN is the same. So looks
    meet looks, not sources their candidates, of which there are as many as books of a title squared. The two
    best of a source are those of its ISBN and the best with another one, so of each look the first two records of
    the first three ISBNs are enough.
    """
    shape = F.struct(F.col("title").alias("source_title"), F.col("author").alias("source_author")).alias("shape")
    looks = F.struct("title", "author", "format", "languages", "has_cover", F.col("year").isNotNull().alias("dated")).alias("looks")
    identity = work_identity(F.col("title"), F.col("author")).alias("identity")
    spans = [F.min("low").alias("low"), F.max("high").alias("high")]
    s = cut(sources.select("key", F.col("isbn").alias("preferred_isbn"), shape, identity), "sources")
    # what has no ISBN can't win; sources without title or author have no match
    records = candidates.where("isbn is not null").select(looks, identity, "isbn", "record", F.col("work_id").alias("low"), F.col("work_id").alias("high"))
    records = cut(records.groupBy("looks", "identity", "isbn").agg(F.slice(F.array_sort(F.collect_list("record")), 1, 2).alias("records"), *spans), "records")
    classes = cut(s.select("shape", "identity").distinct().join(records.groupBy("looks", "identity").agg(*spans), "identity"), "classes")
    asked = cut(s.join(records.withColumnRenamed("isbn", "preferred_isbn").drop("identity"), "preferred_isbn"), "asked")
    none = F.lit(None).cast("string")
    pairs = classes.select("shape", "looks").union(asked.select("shape", "looks")).distinct().select("shape", "looks", "shape.*", "looks.*").withColumns({
        "preferred_isbn": none, "isbn": F.lit("one"), "subtitle": none, "has_description": F.lit(False), "year": F.when(F.col("dated"), 1),
    })
    # cut, as in bridge: the plan of match and score is too deep to be optimized with the choice
    scored = matching.score_editions(cut(pairs, "pairs"))
    kind = ed.product_kind(F.col("format"), F.col("title"), none)
    live = cut(scored.where(kind.isNull() & F.col("reject_reason").isNull()).select("shape", "looks", "score"), "live")
    classes = classes.join(live, ["shape", "looks"])
    leading = records.withColumn("n", F.row_number().over(Window.partitionBy("looks").orderBy("isbn"))).where("n <= 3").select("looks", "isbn", "records")
    tops = classes.join(leading, "looks").select("shape", "score", "isbn", F.explode("records").alias("record"))
    of_isbn = Window.partitionBy("shape", "isbn")
    tops = tops.withColumns({"n": F.row_number().over(of_isbn.orderBy(F.desc("score"), "record")), "best": F.max("score").over(of_isbn)}).where("n <= 2")
    tops = tops.withColumn("n", F.dense_rank().over(Window.partitionBy("shape").orderBy(F.desc("best"), "isbn"))).where("n <= 3")
    tops = tops.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "isbn", "record"))).alias("tops"))
    others = F.filter("tops", lambda x: F.col("preferred_isbn").isNull() | (x["isbn"] != F.col("preferred_isbn")))
    by_work = s.join(tops, "shape").select("key", F.explode(F.slice(others, 1, 2)).alias("x")).select("key", (-F.col("x.less")).alias("score"), "x.isbn", "x.record")
    by_isbn = asked.join(live, ["shape", "looks"])
    rows = by_isbn.select("key", (F.col("score") + matching.WEIGHTS["preferred_isbn"]).alias("score"), F.col("preferred_isbn").alias("isbn"), F.explode("records").alias("record")).unionByName(by_work)
    best = matching.select_winner(rows.withColumn("reject_reason", none), "key", [F.asc("isbn"), F.asc("record")]).select("key", "record", "score", "status")
    works = s.join(classes.groupBy("shape").agg(*spans), "shape").select("key", "low", "high").union(by_isbn.select("key", "low", "high")).groupBy("key").agg(*spans)
    out = s.select("key").join(best, "key", "left").join(works, "key", "left")
    status = F.when(F.col("record").isNull(), "no_match").when(F.col("low") != F.col("high"), "conflicting_works").otherwise(F.col("status"))
    return out.select("key", "record", "score", status.alias("status"))


def pilot_summary(plan: DataFrame, low: int = 65) -> DataFrame:
    """Counts by status and the spread of scores."""
    return plan.agg(
        F.count("*").alias("sources"), F.count_if(F.col("status") == "selected").alias("selected"), F.count_if(F.col("status") == "no_match").alias("no_match"),
        F.count_if(~F.col("status").isin("selected", "no_match")).alias("review"), F.min("score").alias("lowest"), F.median("score").alias("median"), F.max("score").alias("highest"),
        F.count_if(F.col("score") < low).alias("low_confidence"),
    )
