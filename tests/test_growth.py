"""Jobs whose work must not grow faster than their tables, and what they give on odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfloom.functions import editions
from shelfloom.functions.text import work_identity
from shelfloom.operators import matching, readers, resolution
from shelfloom.plans import catalog_queries, reader_queries  # noqa: F401  they register their queries
from shelfloom.plans.registry import QUERIES
from shelfloom.sources.files import cut

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_title_matches_make_each_key_once(spark):
    """A plan that repeats the keys wherever they are read takes half a millisecond a row."""
    assert plan_of(QUERIES["title_matches"](spark, SF)).count("translate(") <= 10


def test_with_title_match_equals_title_match(spark):
    titles = ["The Red Ring", "red ring", "Red Ring: a story of gold", "gold ring red", "Café of the Red Gold Ring", "", None, "a", "ﬁne  book", "Blue", "the blue"]
    rows = spark.createDataFrame([(a, b) for a in titles for b in titles], "a string, b string")
    got = matching.with_title_match(rows.withColumn("want", matching.title_match(F.col("a"), F.col("b"))), "a", "b", "got")
    assert got.columns == ["a", "b", "want", "got"] and got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_few_pairs_of_alike_readers_are_written(spark):
    """Readers of the same books all meet; what is written are the best of each block, ties cut by username and id."""
    shelf = spark.range(300).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("book_id")).withColumns({"status": F.lit("read"), "user_rating": (F.col("book_id") % 5 + 1).cast("int")})
    genres = spark.range(20).select(F.col("id").alias("book_id"), F.when(F.col("id") > 0, F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("genre"))
    entries, weights, _ = readers.genre_vectors(shelf, genres)
    none = spark.createDataFrame([], "reader long, other long")
    pairs = readers.suggestion_candidates(entries, weights, readers._vectors(weights), none, entries.select("user_id").distinct(), 5)
    assert sum(p.count() for p in pairs) <= 300 * 299 / 10
    users = spark.range(300).select("id", F.format_string("u%03d", 299 - F.col("id")).alias("username"))
    friends = spark.createDataFrame([(0, 299), (298, 0)], "user_a long, user_b long")
    got = readers.reader_suggestions(shelf, genres, friends, users, readers=users.where("id = 0").select(F.col("id").alias("user_id")), limit=3).collect()
    norm = 7 * 7 + 6 * 6 + 6 * 6 + 1  # the book without a genre counts in the norm, but isn't shared
    assert [(r["place"], r["other"], r["genres"], r["both_rated"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 297, "g1,g0", 20), (2, 296, "g1,g0", 20), (3, 295, "g1,g0", 20)]
    assert {r["score"] for r in got} == {round(0.6 * (norm - 1) / norm + 0.25 + 0.15, 7)}


def test_a_few_askers_meet_all_blocks(spark):
    """A stated set gets what it gets among all readers, whatever the blocks."""
    shelf = spark.range(200).select(F.col("id").alias("user_id"), F.explode(F.expr("transform(sequence(0L, 9L), k -> (id * 7 + k * k * 3) % 90)")).alias("book_id")).distinct().withColumns({"status": F.lit("read"), "user_rating": (F.col("book_id") % 5 + 1).cast("int")})
    genres = spark.range(90).select(F.col("id").alias("book_id"), F.concat(F.lit("g"), (F.col("id") % 80).cast("string")).alias("genre"))
    users = spark.range(200).select("id", F.format_string("u%03d", "id").alias("username"))
    friends = spark.createDataFrame([(0, 1)], "user_a long, user_b long")
    ask = lambda who: {tuple(r) for r in readers.reader_suggestions(shelf, genres, friends, users, readers=who.select(F.col("id").alias("user_id")), limit=4).where("reader % 50 = 0").collect()}
    few = ask(users.where("id % 50 = 0"))
    assert len(few) == 16 and few == ask(users)


def plain_pilot(sources, candidates):
    """Every source against each of its candidates."""
    links = matching.candidate_lookup(sources, candidates)
    s = sources.select("key", F.col("isbn").alias("preferred_isbn"), F.col("title").alias("source_title"), F.col("author").alias("source_author"))
    pairs = links.select("key", "record").join(s, "key").join(candidates, "record").withColumns({"subtitle": F.lit(None).cast("string"), "has_description": F.lit(False)})
    scored = cut(matching.score_editions(cut(pairs, "pairs")), "scored")
    kind = editions.product_kind(F.col("format"), F.col("title"), F.lit(None).cast("string"))
    scored = scored.withColumn("reject_reason", F.coalesce(kind, "reject_reason"))
    live = scored.where("reject_reason is null").groupBy("key").agg(F.count_distinct("work_id").alias("works"))
    best = matching.select_winner(scored, "key", [F.asc("isbn"), F.asc("record")]).select("key", "record", "score", "status")
    status = F.when(F.col("record").isNull(), "no_match").when(F.col("works") > 1, "conflicting_works").otherwise(F.col("status"))
    return s.select("key").join(best, "key", "left").join(live, "key", "left").select("key", "record", "score", status.alias("status"))


@pytest.mark.parametrize("n_works", [1, 60])
def test_pilot_plan_equals_every_pair(spark, n_works):
    rng = random.Random(3)
    title = lambda: rng.choice(["Red Ring", "red  ring", "The Red Ring", "Red Ring (2nd printing)", "Red Ring: a story", "Blue Gold Bolt", "Gold Blue Bolt", None, "", "Study Guide to Red Ring"])
    author = lambda: rng.choice(["Ann Lee", "A. Lee", "Lee, Ann", "Bob Ray", None])
    code = lambda: rng.choice([None, *(f"i{k:02d}" for k in range(30))])
    sources = spark.createDataFrame([(k, code(), title(), author()) for k in range(150)], "key long, isbn string, title string, author string")
    rows = [(f"r{k:03d}", f"w{rng.randrange(n_works)}", code(), title(), author(), rng.choice(["Hardcover", "Audio CD", "Wall calendar", None]), rng.choice([["eng"], ["fre"], ["ger", "eng"], []]), rng.choice([None, 1990, 2001]), rng.choice([True, False])) for k in range(250)]
    candidates = spark.createDataFrame(rows, "record string, work_id string, isbn string, title string, author string, format string, languages array<string>, year int, has_cover boolean")
    got, want = ({tuple(r) for r in plan(sources, candidates).collect()} for plan in (resolution.pilot_plan, plain_pilot))
    assert len(want) == 150 and got == want


def test_pilot_plan_scores_looks_not_pairs(spark, monkeypatch):
    """Of 300 sources and 300 candidates of one title and author, two looks are scored."""
    seen = []
    monkeypatch.setattr(matching, "score_editions", lambda pairs, plain=matching.score_editions: seen.append(pairs.count()) or plain(pairs))
    books = spark.range(300).select(F.col("id").alias("key"), F.col("id").cast("string").alias("isbn"), F.lit("Red Ring").alias("title"), F.lit("Ann Lee").alias("author"))
    candidates = books.select(F.col("isbn").alias("record"), F.lit("w").alias("work_id"), "isbn", "title", "author", F.lit("Hardcover").alias("format"), F.array(F.lit("eng")).alias("languages"), F.when(F.col("key") % 2 == 0, 1990).alias("year"), F.lit(True).alias("has_cover"))
    plan = resolution.pilot_plan(books, candidates)
    assert seen == [2]
    assert plan.where("status = 'selected' and record = cast(key as string)").count() == 300


def test_pilot_summary_of_a_common_title(spark):
    """400 books of one title: a plan of every pair has 160,000 rows, this one has none that large."""
    books = spark.range(400).select(F.col("id").alias("key"), F.col("id").cast("string").alias("isbn"), F.lit("Red Ring").alias("title"), F.lit("Ann Lee").alias("author"))
    candidates = books.select(F.col("isbn").alias("record"), F.lit("w").alias("work_id"), "isbn", "title", "author", F.lit("Hardcover").alias("format"), F.array(F.lit("eng")).alias("languages"), F.lit(1990).alias("year"), F.lit(True).alias("has_cover"))
    written = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(resolution, "cut", lambda rows, name: written.append(rows.count()) or cut(rows, name))
        summary = resolution.pilot_summary(resolution.pilot_plan(books, candidates)).first()
    assert max(written) == 400
    assert tuple(summary) == (400, 400, 0, 0, 126, 126.0, 126, 0)


def test_candidate_lookup_of_odd_rows(spark):
    """Repeated keys and records, and ISBNs of other works, give each pair once, by ISBN where any of its rows has it."""
    rng = random.Random(4)
    some = lambda k: [(rng.choice([None, *range(k)]), rng.choice([None, "1", "2", "3"]), rng.choice(["Red Ring", "the red ring", "Bolt", None]), rng.choice(["Ann Lee", "Lee, Ann"])) for _ in range(60)]
    sources = spark.createDataFrame(some(200), "key long, isbn string, title string, author string")
    candidates = spark.createDataFrame(some(40), "record long, isbn string, title string, author string")
    s, c = (df.withColumn("identity", work_identity(F.col("title"), F.col("author"))).collect() for df in (sources, candidates))
    want = {}
    for a in s:
        for b in c:
            exact = a["isbn"] is not None and a["isbn"] == b["isbn"]
            if exact or a["identity"] is not None and a["identity"] == b["identity"]:
                want[a["key"], b["record"]] = exact or want.get((a["key"], b["record"]), False)
    got = [tuple(r) for r in matching.candidate_lookup(sources, candidates).collect()]
    assert len(got) == len(set(got)) and {g[:2]: g[2] for g in got} == want


def test_candidate_lookup_shuffles_no_pairs(spark):
    """Of 500 books of one work each meets all: 250,000 pairs, of which none goes through a shuffle."""
    books = spark.range(500).select(F.col("id").alias("key"), F.col("id").cast("string").alias("isbn"), F.lit("Red Ring").alias("title"), F.lit("Ann Lee").alias("author"))
    pairs = matching.candidate_lookup(books, books.withColumnRenamed("key", "record"))
    assert pairs.agg(F.count("*"), F.count_if("exact_isbn")).first() == (250_000, 500)
    text = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in text.split("Aggregate")[0]


def test_targeted_extract_shuffles_no_pairs(spark):
    """300 editions of one title and author are asked for by 300 sources: each pair once, none through a shuffle."""
    sources = spark.range(300).select(F.col("id").alias("key"), F.col("id").cast("string").alias("isbn"), F.lit("Red Ring").alias("title"), F.lit("Ann Lee").alias("author"))
    others = F.when(F.col("key") == 7, F.lit("Bolt")).otherwise(F.col("title")).alias("title")
    found = sources.select(F.col("isbn").alias("key"), "isbn", others, F.array(F.lit("a1")).alias("author_keys"))
    links = resolution.targeted_extract(sources, found, spark.createDataFrame([("a1", "Lee, Ann")], "key string, name string"))[0]
    assert links.agg(F.count("*"), F.count_if("exact_isbn")).first() == (300 * 299 + 1, 300)
    assert "Union" in links._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_top_picks_read_the_sales_once(spark):
    """The shelf is made once, and what stands between classes and picks carries neither genres nor names."""
    picks = QUERIES["top_picks"](spark, SF)
    assert not [f for f in picks.inputFiles() if "lineitem" in f or "orders" in f]
    windows = [line for line in plan_of(picks).splitlines() if "Window [row_number" in line and "of_author" in line]
    assert windows and not any("genres" in line for line in windows)
