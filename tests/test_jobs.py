from __future__ import annotations

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.functions.text import author_key, title_key, work_identity
from shelfloom.operators import catalog, matching, quality, readers, resolution
from shelfloom.sources import dumps, files
from shelfloom.streaming import commands as cmd


def test_dump_rows_and_latest_revision(spark):
    lines = [
        '/type/work\t/works/OL1W\t2\t2024\t{"title":" A  b ","covers":[-1,7,7],"description":{"value":"d"}}', '/type/work\t/works/OL1W\t2\t2024\t{"title":"Later"}',
        '/type/work\t/works/OL1W\t1\t2024\t{"title":"Older"}', "", "/type/work\t/works/OL2W\t1\t2024\t{bad", "/type/work\t/works/OL3W\t1\t2024\t[]", "/type/work\tshort",
        '/type/author\t/authors/OL1A\t1\t2024\t{"name":"N"}', '/type/work\t/works/OL4W\t1\t2024\t{"title":"tab\\tx","title":"Last"}', '/type/work\t/works/OL5W\t1\t2024\t{}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    rows = dumps.work_rows(dumps.dump_rows(df))
    reasons = {r["line_no"]: r["reject_reason"] for r in rows.collect()}
    assert reasons == {0: None, 1: None, 2: None, 4: "invalid_json", 5: "malformed_row", 6: "malformed_dump_row", 7: "wrong_record_type", 8: None, 9: "missing_title"}
    good = {r["key"]: r for r in dumps.latest_revision(rows.where("reject_reason is null")).collect()}
    assert good["/works/OL1W"]["title"] == "Later" and good["/works/OL4W"]["title"] == "Last"


def test_read_lines_keeps_order(spark, tmp_path):
    path = tmp_path / "dump.txt"
    path.write_text("\n".join(f"{k}\tx" for k in range(5000)))
    rows = dumps.read_lines(spark, str(path), 3).orderBy("line_no").collect()
    assert [int(r["value"].split("\t")[0]) for r in rows] == list(range(5000))


def test_csv_header_and_errors(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿Title,author,ISBN\n"A, b",X,978-0-306-40615-7\nB,,123\nC,Y,9780306406157,extra\n', encoding="utf-8")
    rows = files.catalog_errors(files.read_csv(spark, str(path), ["title", "author", "isbn"])).collect()
    assert [(r["title"], r["errors"]) for r in rows] == [("A, b", []), ("B", ["missing_author", "invalid_isbn"]), ("C", ["ragged_row"])]
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, str(path), ["title", "isbn"])


def test_ndjson_strict_and_permissive(spark, tmp_path):
    path = tmp_path / "x.ndjson"
    path.write_text('{"a":1}\nbad\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert [r["a"] for r in files.read_ndjson(spark, str(path), schema, strict=False).collect()] == [1, None]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_ndjson(spark, str(path), schema, strict=True).collect()


def test_publish_keeps_the_old_version_if_counts_differ(spark, tmp_path):
    path = str(tmp_path / "out")
    files.publish(spark.range(3), path, 3)
    with pytest.raises(ValueError, match="stays"):
        files.publish(spark.range(5), path, 4)
    assert files.differences(spark.range(3), files.published(spark, path)).isEmpty()
    files.publish(spark.range(7), path, 7)
    assert files.published(spark, path).count() == 7
    # a job that dies before the last commit leaves the version before it
    spark.range(9).write.parquet(f"{path}/versions/half")
    assert files.published(spark, path).count() == 7


def test_corrections_rewrite_the_latest_finish_before_them(spark):
    day = lambda n: datetime.date(2024, 1, n)
    at = lambda n: datetime.datetime(2024, 2, n)
    finishes = [("a", 1, 1, day(1), at(5)), ("b", 1, 1, day(2), at(10)), ("c", 1, 2, day(3), at(5)), ("d", 1, 3, day(4), at(20))]
    fixes = [
        (1, 1, 1, at(7), day(11)), (2, 1, 1, at(8), day(12)),  # both of a: the later holds
        (3, 1, 1, at(12), day(13)),  # of b
        (4, 1, 2, at(6), day(14)), (5, 1, 2, at(6), day(15)),  # at one time: the later command holds
        (6, 1, 3, at(1), day(16)), (7, 1, 3, at(2), day(17)),  # before any finish: one historical row, rewritten
        (8, 2, 9, at(1), day(18)),
    ]
    df = spark.createDataFrame(finishes, "id string, user_id long, book_id long, finished_on date, created_at timestamp")
    log = spark.createDataFrame(fixes, "command_id long, user_id long, book_id long, ts timestamp, finished_on date")
    got = sorted((r["user_id"], r["book_id"], r["finished_on"].day, r["historical"]) for r in cmd.corrected_finishes(df, log).collect())
    assert got == [(1, 1, 12, False), (1, 1, 13, False), (1, 2, 15, False), (1, 3, 4, False), (1, 3, 17, True), (2, 9, 18, True)]


def test_a_lost_version_stops_the_upserts(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long").coalesce(1)
    run = lambda: cmd.upsert_batches(spark.readStream.schema("k long, v long").parquet(source), table, state, "k")
    # an update-mode aggregate is what such a table takes; a plain stream gives its new rows
    rows((1, 1), (2, 2)).write.parquet(source)
    run()[0].awaitTermination()
    rows((2, 5), (3, 3)).write.mode("append").parquet(source)
    running, found = run()
    running.awaitTermination()
    assert {(r["k"], r["v"]) for r in found.read().collect()} == {(1, 1), (2, 5), (3, 3)}
    assert {(r["k"], r["v"]) for r in found.read(0).collect()} == {(1, 1), (2, 2)}
    shutil.rmtree(table)
    rows((4, 4)).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="has no version before batch"):
        run()[0].awaitTermination()


def test_editions_inherit_from_a_work_that_matches(spark):
    schema = "source_title string, source_author string, preferred_isbn string, isbn string, title string, subtitle string, author string, format string, languages array<string>, has_cover boolean, has_description boolean, year int, work_matches boolean"
    base = ("A Tale", "Ann Lee", None, "9780306406157")
    rows = [
        (*base, None, None, "Ann Lee", None, ["en"], False, False, None, True), (*base, "A Tale", None, None, None, ["en"], False, False, None, True), (*base, None, None, "Ann Lee", None, ["en"], False, False, None, False),
        (*base, "A Tale", None, " ", None, ["en"], False, False, None, None), (*base, "Else", None, None, None, ["en"], False, False, None, True), (*base, "A Tale", None, "Bob Ray", None, ["en"], False, False, None, True),
    ]
    got = [(r["reject_reason"], r["score"], r["reasons"]) for r in matching.score_editions(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == (None, 55, "title_inherited_work,author_exact,english") and got[1] == (None, 60, "title_exact,author_inherited,english")
    assert [g[0] for g in got[2:]] == ["title_mismatch", "missing_author_evidence", "title_mismatch", "author_mismatch"]


def test_fingerprint_ignores_order(spark):
    rows = [(k, f"t{k}") for k in range(50)]
    prints = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        prints.add(quality.fingerprint(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", ["id", "t"]).first()[0])
    assert len(prints) == 1


def test_request_state_equals_a_fold(spark):
    rng = random.Random(4)
    log = [(k, rng.randint(0, 4), rng.randint(0, 4), rng.choice(["request", "accept", "decline", "remove", "wave"])) for k in range(800)]
    state: dict = {}
    for _, actor, target, action in log:
        pair = (min(actor, target), max(actor, target))
        now, by = state.get(pair, ("none", None))
        if actor == target:
            state[pair] = ("none", None)
        elif action == "request" and now == "none":
            state[pair] = ("pending", actor)
        elif action == "accept" and now == "pending" and by != actor:
            state[pair] = ("accepted", by)
        elif (action, now) in (("decline", "pending"), ("remove", "accepted")):
            state[pair] = ("none", None)
        else:
            state.setdefault(pair, (now, by))
    df = spark.createDataFrame(log, "command_id long, actor long, target long, action string").withColumn("ts", F.col("command_id"))
    got = cmd.request_state(df)
    assert {(r["a"], r["b"]): (r["state"], r["requested_by"]) for r in got.collect()} == state
    assert got.select("state").distinct().count() == 3
    empty = cmd.request_state(df.where("false")).collect()
    assert empty == []


def test_shelf_events_equal_a_fold(spark):
    rng = random.Random(5)
    log = [(k, rng.randint(0, 2), rng.randint(0, 2), rng.choice([None, "read", "currently_reading"]), rng.choice([None, 1, 2])) for k in range(300)]
    want, held = [], {}
    for k, u, b, status, rating in log:
        old = held.setdefault((u, b), [None, None])
        if status and status != old[0]:
            want.append((k, "finished_reading" if status == "read" else "started_reading"))
        elif rating and rating != old[1]:
            want.append((k, "rated_book"))
        held[u, b] = [status or old[0], rating or old[1]]
    df = spark.createDataFrame(log, "command_id long, user_id long, book_id long, status string, rating int")
    df = df.withColumns({"ts": F.timestamp_seconds("command_id"), "finished_on": F.lit(None).cast("date")})
    assert sorted((r["command_id"], r["type"]) for r in cmd.shelf_events(df).collect()) == want


def test_monthly_finishes_stream(spark, tmp_path):
    rows = [(1, b, f"2024-05-0{d} 10:00:00") for b, d in [(1, 1), (1, 1), (2, 2), (3, 3)]]
    spark.createDataFrame(rows, "user_id long, book_id long, ts string").select("user_id", "book_id", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, book_id long, ts timestamp").parquet(str(tmp_path / "in"))
    out = cmd.monthly_finishes(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("finishes").option("checkpointLocation", str(tmp_path / "cp"))
    out.trigger(availableNow=True).start().awaitTermination()
    assert sum(r["books"] for r in spark.table("finishes").collect()) == 3


def test_choose_works_equals_all_pairs_without_making_them(spark):
    rng, names = random.Random(3), ["blue", "river", "stone", "house", "night", "storm", "garden", "of", "the"]
    title = lambda: " ".join(rng.choices(names, k=rng.randint(1, 6))) + rng.choice(["", "", ": a novel", ": the night"])
    authors = ["Ann Lee", "A Lee", "Bob Ray", "Lee, Ann"]
    works = [(k, title(), rng.choice(authors), rng.choice([None, 2000]), rng.choice([0, 5])) for k in range(150)]
    sources = [(k, rng.choice(works)[1] if k % 2 else title(), rng.choice(authors)) for k in range(80)]
    w = spark.createDataFrame(works, "work_id long, title string, author string, year int, cover int")
    s = spark.createDataFrame(sources, "key long, title string, author string")
    got = {r["key"]: (r["work_id"], r["score"], r["members"], r["status"]) for r in resolution.choose_works(s, w).collect()}
    pairs = s.select("key", F.col("title").alias("st"), F.col("author").alias("sa")).crossJoin(w.withColumn("group", work_identity(F.col("title"), F.col("author"))))
    same = (author_key(F.col("sa")) == author_key(F.col("author"))) | (title_key(F.col("st")) == title_key(F.col("title")))
    t, a = matching.title_match(F.col("st"), F.col("title")), matching.author_match(F.col("sa"), F.col("author"))
    rows = pairs.where(same).withColumns({"t": t, "a": a}).where(matching.title_agrees(F.col("t")) & matching.author_agrees(F.col("a"))).collect()
    want = {}
    for key in {r["key"] for r in rows}:
        groups = {}
        for r in rows:
            if r["key"] == key:
                groups.setdefault(r["group"], []).append((-(r["year"] is not None) - (r["cover"] > 0), r["work_id"], int(r["t"]["score"] * 0.7 + r["a"]["score"] * 0.3 + 0.5)))
        best = sorted((-min(g)[2], min(g)[1], len(g)) for g in groups.values())
        clear = len(best) == 1 or best[1][0] - best[0][0] >= 8
        want[key] = (best[0][1], -best[0][0], best[0][2], "selected" if clear else "ambiguous")
    assert len(want) > 30 and got == want


def test_bridge_counts_eligible_works_and_returns_the_rest(spark):
    report = [(1, "w1", "existing"), (2, "w2", "new"), (3, "w3", "new"), (4, "w4", "new"), (5, "w5", "new"), (6, "w6", "new"), (7, "w7", "ambiguous")]
    lists = {"w2": [], "w3": ["i3"], "w4": ["i4"], "w5": ["i5"], "w6": ["i6"]}
    kept = [(k, f"Story {k}", "Ann Lee", v, 1, "Paperback", ["/languages/fre" if k == "w3" else "/languages/eng"]) for k, v in lists.items()]
    kept += [(k, "Story", "Ann Lee", ["x"], 1, "Paperback", ["/languages/eng"]) for k in ("w1", "w7")]
    editions = [(f"/books/{k}", k, f"i{k[1]}", f"Story {k}", "Ann Lee", ["/languages/eng"], "Paperback", 1, "2001", 2001) for k in lists]
    out = resolution.bridge(
        spark.createDataFrame(report, "place long, work_key string, status string"),
        spark.createDataFrame(kept, "work_key string, title string, author string, isbns array<string>, cover long, format string, languages array<string>"),
        spark.createDataFrame(editions, "key string, work_key string, isbn string, title string, author string, languages array<string>, format string, cover long, publish_date string, year int"),
        limit=2,
    )
    got = {r["place"]: (r["status"], r["isbn"]) for r in out.collect()}
    assert got == {1: ("existing", None), 2: ("missing_isbn", None), 3: ("unknown_language", None), 4: ("selected", "i4"), 5: ("selected", "i5"), 6: ("limit", None), 7: ("ambiguous", None)}


def test_monthly_finishes_over_weeks_and_batches(spark, tmp_path):
    schema = "user_id long, book_id long, ts timestamp"
    batches = [[(1, 1, "2024-05-01"), (1, 2, "2024-05-02"), (2, 1, "2024-05-03")], [(1, 1, "2024-05-20"), (1, 1, "2024-06-02"), (1, 2, "2024-06-02")], [(1, 1, "2024-05-31"), (1, 3, "2024-05-30"), (1, 1, "2024-06-29")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "user_id long, book_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        running, table = cmd.upsert_batches(cmd.monthly_finishes(stream), str(tmp_path / "table"), str(tmp_path / "state"), ["user_id", "month"])
        running.awaitTermination()
    got = {(r["user_id"], r["month"]): r["books"] for r in table.read().collect()}
    assert got == {(1, "2024-05"): 3, (2, "2024-05"): 1, (1, "2024-06"): 2}


def test_release_calendar_takes_three_a_day_before_the_shuffle(spark):
    rows = [(k, "1998-06-15") for k in range(50, 0, -1)] + [(100, "1998-06-16"), (None, "1998-06-17"), (None, "1998-06-16"), (7, None)]
    books = spark.createDataFrame(rows, "id long, day string").select("id", F.col("day").cast("date").alias("publication_date"))
    out = readers.release_calendar(books, "1998-06-15")
    got = {str(r["day"]): (r["n"], r["first_ids"]) for r in out.collect()}
    assert len(got) == 42 and (got["1998-06-15"], got["1998-06-16"], got["1998-06-17"]) == ((50, "1,2,3"), (2, "100"), (1, ""))
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_dedup_check_makes_no_pairs_of_a_common_title(spark):
    mine = spark.createDataFrame(
        [("w1", "One", "A B", ["i1"]), ("w2", "Same", "A B", None), ("w3", "Other", "C D", ["i9", "i8"]), ("w4", "New", "C D", []), (None, "Same", "A B", ["i1"])],
        "work_key string, title string, author string, isbns array<string>",
    )
    books = spark.createDataFrame(
        [(1, "w1", "i1", "One", "A B"), (2, None, None, "Same", "A B"), (3, "w9", "i7", "Same", "A B"), (4, None, "i8", "Else", "C D"), (5, "w1", None, "Two", "C D")],
        "id long, work_key string, isbn string, title string, author string",
    )
    got = {r["work_key"]: tuple(r)[2:] for r in catalog.dedup_check(mine, books).collect() if r["work_key"]}
    assert got == {"w1": ("ambiguous", 1, 5, "work_key"), "w2": ("ambiguous", 2, 3, "title_author"), "w3": ("existing", 4, 4, "isbn"), "w4": ("new", None, None, None)}
    members = {(r["matched_by"], r["id"]) for r in catalog.dedup_members(mine, books).collect()}
    assert members == {("work_key", 1), ("work_key", 5), ("isbn", 1), ("isbn", 4), ("title_author", 1), ("title_author", 2), ("title_author", 3)}
    assert catalog.dedup_check(mine.where("false"), books).collect() == []
    assert {r["status"] for r in catalog.dedup_check(mine, books.where("false")).collect()} == {"new"}


def test_a_plan_inserts_a_work_once(spark):
    """Two planned rows of one work are one book; rows without a work or an ISBN stand for themselves."""
    plan = [(1, "w1", "i1", "insert", None), (2, "w1", "i2", "insert", None), (3, None, "i3", "insert", None), (4, None, "i4", "insert", None), (5, "w5", None, "insert", None), (6, "w6", "i6", "skip", "limit"), (7, "w0", "i7", "insert", None)]
    rows = [(w, i, f"t{p}", "a") for p, w, i, _, _ in plan] + [("w1", "i1", "t1", "a")]
    books = spark.createDataFrame([("w0", "i0", "t", "a")], "work_key string, isbn string, title string, author string")
    after, done = catalog.apply_import(spark.createDataFrame(plan, "place long, work_key string, isbn string, action string, reason string"), spark.createDataFrame(rows, books.schema), books)
    assert {r["place"]: (r["action"], r["reason"]) for r in done.collect()} == {
        1: ("insert", None), 2: ("skip", "duplicate_work_key"), 3: ("insert", None), 4: ("insert", None), 5: ("insert", None), 6: ("skip", "limit"), 7: ("skip", "duplicate_work_key"),
    }
    assert sorted((r["work_key"] or "", r["isbn"] or "") for r in after.collect()) == [("", "i3"), ("", "i4"), ("w0", "i0"), ("w1", "i1"), ("w5", "")]


def test_works_without_a_key_stay_apart(spark):
    titles = [(1, "i1", "***", "Ann Lee", 1), (2, "i2", "???", "Bob Ray", 1), (3, "i3", "Same", "Cy Dee", 2), (4, "i4", "The Same", "Cy Dee", 1)]
    got = matching.preferred_editions(spark.createDataFrame(titles, "work_id long, isbn string, title string, author string, rank int")).collect()
    assert sorted((r["work_id"], r["works"]) for r in got) == [(1, 1), (2, 1), (4, 2)]
