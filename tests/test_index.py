"""The snapshot index, incremental upserts, feed pages and consolidation: results, and what they read and write."""

from __future__ import annotations

import datetime
import re
import uuid

import pytest
from pyspark.sql import functions as F

from shelfloom.operators import catalog, consolidate, readers
from shelfloom.sources.index import SnapshotIndex
from shelfloom.sources.keyed import KeyedTable


def isbn(n: int) -> str:
    body = f"978{n:09d}"
    return body + str((10 - sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(body)) % 10) % 10)


@pytest.fixture
def index(spark, tmp_path):
    rows = [(isbn(k % 5000), f"Title {k % 700}", f"Author {k % 7}") for k in range(6000)]  # a thousand records twice
    made = SnapshotIndex(spark, str(tmp_path / "index"), "t" + uuid.uuid4().hex, buckets=4).build(spark.createDataFrame(rows, "isbn13 string, title string, author string"), rows_a_group=200)
    yield made
    made.drop()


def test_records_are_kept_once_and_pointers_lead_to_them(index):
    assert index.table("records").count() == 6000 - sum(1 for k in range(1000) if (f"Title {k % 700}", k % 7) == (f"Title {(k + 5000) % 700}", (k + 5000) % 7))
    assert {r["isbn13"] for r in index.by_isbn(isbn(123)).collect()} == {isbn(123)} and index.by_isbn(isbn(9_999)).count() == 0


def test_a_join_leaves_the_indexed_side_where_it_is(spark, index):
    """One exchange: of the sources."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sources = spark.createDataFrame([(isbn(k), k) for k in range(0, 5000, 10)], "isbn13 string, key long")
        joined = sources.join(index.table("isbns"), "isbn13")
        joined.collect()
        plan = joined._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ran = plan[plan.find("Final Plan") : plan.find("Initial Plan")]
    assert len(re.findall(r"\bExchange \(", ran)) == 1 and "SortMergeJoin" in ran
    assert "SelectedBucketsCount: 4 out of 4" in plan


def test_a_lookup_reads_one_bucket_and_few_row_groups(spark, index):
    found = index.table("isbns").where(F.col("isbn13") == isbn(2222))
    assert found.collect()
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    read = metrics.apply("numOutputRows").value()
    assert 0 < read <= 200  # rows of the one row group that statistics leave, of some 1,500 in the bucket


def test_an_index_opens_in_another_session(spark, index):
    other = SnapshotIndex(spark.newSession(), index.path, index.prefix + "again", index.buckets).opened()
    assert other.table("works").count() == index.table("works").count()
    plan = other.table("isbns").groupBy("isbn13").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    other.drop()


def test_links_count_what_members_list(spark, index):
    sources = spark.createDataFrame([(1, isbn(3), "The Title 3", "author 3"), (2, None, "title 9", "Author 2"), (3, "x", None, None)], "key long, isbn string, title string, author string")
    links = index.links(sources).collect()
    assert {(r["key"], r["method"]) for r in links} == {(1, "isbns"), (1, "works"), (2, "works")}
    members = index.members(index.links(sources)).collect()
    for r in links:
        assert r["n"] == sum(m["method"] == r["method"] and m["value"] == r["value"] for m in members)


def test_only_touched_buckets_of_the_catalogue_are_written(spark, tmp_path):
    books = KeyedTable(spark, str(tmp_path / "books"), "isbn string, title string, cover_url string", ["isbn"], buckets=8)
    links = KeyedTable(spark, str(tmp_path / "links"), "isbn string, genre string", ["isbn", "genre"], buckets=8)
    own, other = "https://covers.openlibrary.org/1", "https://books.google.com/1"
    update = lambda rows, genres: {r["isbn"]: r["outcome"] for r in catalog.upsert_catalog(books, links, spark.createDataFrame(rows, books.schema), spark.createDataFrame(genres, links.schema)).collect()}
    assert set(update([(str(k), f"t{k}", own) for k in range(60)], [(str(k), "g") for k in range(60)]).values()) == {"created"}
    first = books.folders(0)
    # neither nulls, nor a lesser cover, nor known genres change anything, so nothing is written
    assert update([("1", None, other), ("2", "t2", None)], [("1", "g")]) == {"1": "unchanged", "2": "unchanged"}
    assert books.last_version() == 0
    assert update([("1", "new", other), ("2", "t2", None), ("3", None, None)], [("3", "h"), ("3", "h"), ("77", "g")]) == {"1": "updated", "2": "unchanged", "3": "updated"}
    now = {r["isbn"]: (r["title"], r["cover_url"]) for r in books.read().collect()}
    assert now["1"] == ("new", own) and now["3"] == ("t3", own) and len(now) == 60
    assert sorted(r["genre"] for r in links.read().where("isbn in ('3', '77')").collect()) == ["g", "h"]
    second = books.folders(1)
    touched = books.touched(spark.createDataFrame([("1",), ("3",)], "isbn string"))
    assert {b for b in second if second[b] != first[b]} == touched
    assert update([("3", None, "http://else.example/x")], [("3", "g")]) == {"3": "updated"}  # a third provider's cover does replace


def test_a_feed_meets_the_newest_of_each_friend_only(spark):
    at = datetime.datetime(2024, 1, 1)
    acts = [(f"{u:02d}-{k:03d}", u, k % 5, "finished_reading", k % 17 == 0, at + datetime.timedelta(minutes=(k * 37 + u * 11) % 900)) for u in range(8) for k in range(100)]
    edges = [(a, b, "accepted", at + datetime.timedelta(minutes=300 * ((a + b) % 3))) for a in range(8) for b in range(a + 1, 8)]
    a = spark.createDataFrame(acts, "id string, user_id long, book_id long, type string, historical boolean, created_at timestamp")
    f = spark.createDataFrame(edges, "user_a long, user_b long, status string, accepted_at timestamp")
    before = (at + datetime.timedelta(minutes=700), "03")
    got = readers.feed_page(a, f, before=(F.lit(before[0]), F.lit(before[1])), limit=5)
    since = {(x, y): s for p, q, _, s in edges for x, y in ((p, q), (q, p))}
    for reader in range(8):
        items = sorted(((c, i) for i, u, _, _, h, c in acts if not h and (reader, u) in since and c >= since[reader, u] and (c, i) < before), reverse=True)
        mine = sorted((r["place"], r["id"], r["more"]) for r in got.where(F.col("reader") == reader).collect())
        assert mine == [(k + 1, i, len(items) > 5) for k, (_, i) in enumerate(items[:5])]


def test_consolidation_compares_parts_in_their_order(spark):
    schema = "id string, work_id string, edition_id string, provider string, title string, isbns array<string>, languages array<string>, covers array<string>, subjects array<string>, years array<int>, descriptions array<string>, authors array<string>, publishers array<string>, formats array<string>"
    row = lambda i, work, edition, isbns=(), languages=(), covers=(), **more: (i, work, edition, "p", "t", list(isbns), list(languages), list(covers), more.get("subjects", []), more.get("years", []), [], ["a"], [], [])
    rows = [
        row("c", "w1", None, [isbn(1), isbn(2)], covers=["x"] * 9), row("b", "w2", "e1", [isbn(1)]), row("a", "w2", "e1", [isbn(1)]),  # an edition id outweighs everything, then the smaller id
        row("d", "w3", "e9", [], ["/languages/fre"]), row("e", None, None, [isbn(7)], ["/languages/eng"], years=[1999, 2400]),
    ]
    table = spark.createDataFrame(rows, schema)
    works = {r["group_key"]: (r["id"], r["members"], r["work_ids"]) for r in consolidate.consolidate_works(table, ["title"]).collect()}
    assert works == {"t": ("a", 4, ["w1", "w2"]), "non_english|d": ("d", 1, ["w3"])}
    members = [(r["id"], r["place"]) for r in consolidate.work_members(table, ["title"]).orderBy("group_key", "place").collect()]
    assert members == [("d", 1), ("a", 1), ("b", 2), ("c", 3), ("e", 4)]
    editions = {r["identity"]: (r["id"], r["members"]) for r in consolidate.consolidate_editions(table).collect()}
    assert editions == {"p:edition:e1": ("a", 2), "p:edition:e9": ("d", 1), f"p:isbn:{isbn(1)}": ("c", 1), f"p:isbn:{isbn(7)}": ("e", 1)}
    parts = {r["id"]: r["n"] for r in table.select("id", consolidate.metadata_completeness(2025).alias("n")).collect()}
    assert parts == {"a": 2, "b": 2, "c": 3, "d": 3, "e": 4}
