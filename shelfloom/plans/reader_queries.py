"""Reader queries over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality, readers
from ..sources.files import cut
from .registry import query
from .views import Tables

CACHE = (
    "cache",
    "select b.*, cast(r.a as decimal(3,2)) as average_rating, coalesce(r.n, 0) as ratings_count from books b left join (select book_id, avg(user_rating) as a, count(*) as n from user_books where user_rating is not null group by 1) r on b.id = r.book_id",
)


def cached(t: Tables) -> DataFrame:
    return readers.rating_cache(t.books, t.user_books)


@query("rating_cache", "select id, cast(average_rating as double) as average_rating, ratings_count from cache", CACHE)
def rating_cache(t: Tables) -> DataFrame:
    return cached(t).select("id", F.col("average_rating").cast("double").alias("average_rating"), "ratings_count")


@query("like_counts", "select review_id, count(*) as likes from review_likes group by 1")
def like_counts(t: Tables) -> DataFrame:
    return t.review_likes.groupBy("review_id").agg(F.count("*").alias("likes"))


@query("book_genres_array", "select b.id, array_to_string(list_sort(list_distinct(list(g.genre))), ',') as genres from books b left join book_genres g on g.book_id = b.id group by 1")
def book_genres_array(t: Tables) -> DataFrame:
    return readers.with_genres(t.books, t.book_genres).select("id", F.array_join("genres", ",").alias("genres"))


@query(
    "search_books",
    "select id, title, author from books where (contains(lower(title), 'bolt') or contains(lower(author), 'bolt')) and contains(lower(author), 'brand#1') and id in (select book_id from book_genres where genre = 'promo')",
)
def search_books(t: Tables) -> DataFrame:
    return readers.search_books(t.books, t.book_genres, text="BOLT", genre="promo", author="brand#1").select("id", "title", "author")


@query("search_books_literal", "select id, title from books where contains(lower(author), '#1%') or contains(lower(title), 'd_b') or contains(lower(author), 'd#2')")
def search_books_literal(t: Tables) -> DataFrame:
    parts = [readers.search_books(t.books, t.book_genres, text=x) for x in ("#1%", "d_b", "d#2")]
    return parts[0].union(parts[1]).union(parts[2]).distinct().select("id", "title")


@query("books_by_rating", "select id, cast(average_rating as double) as average_rating from cache order by average_rating desc nulls last, id limit 25 offset 25", CACHE)
def books_by_rating(t: Tables) -> DataFrame:
    return readers.book_page(cached(t), "rating", True, 2, 25).select("id", F.col("average_rating").cast("double").alias("average_rating"))


@query("books_by_year", "select id, publication_year from books order by publication_year asc nulls last, id limit 40")
def books_by_year(t: Tables) -> DataFrame:
    return readers.book_page(t.books, "year", False, 1, 40).select("id", "publication_year")


@query("page_info", "select count(*) as total, greatest(cast(ceil(count(*) / 24.0) as bigint), 1) as pages from books where contains(lower(title), 'red')")
def page_info(t: Tables) -> DataFrame:
    return readers.page_info(t.books.where(F.contains(F.lower("title"), F.lit("red"))), 24)


@query(
    "review_pages",
    """select book_id, r.id, cast(floor((row_number() over (partition by book_id order by created_at desc, r.id) - 1) / 5) as bigint) + 1 as page,
       coalesce(l.n, 0) as likes, m.review_id is not null as liked_by_me from reviews r left join (select review_id, count(*) as n from review_likes group by 1) l on l.review_id = r.id
       left join (select review_id from review_likes where user_id = 7) m on m.review_id = r.id""",
)
def review_pages(t: Tables) -> DataFrame:
    return readers.review_pages(t.reviews, t.review_likes, 5, 7)


LATEST = ("latest", "select user_id, book_id, arg_max(finished_on, (created_at, id)) as finished_on from activities where type = 'finished_reading' group by all")


@query("latest_finish", "select * from latest", LATEST)
def latest_finish(t: Tables) -> DataFrame:
    return readers.latest_finish(t.activities)


@query(
    "shelves",
    "select u.user_id, u.book_id, u.status, title, case when u.status = 'read' then finished_on end as finished_on from user_books u join books b on b.id = u.book_id left join latest l on l.user_id = u.user_id and l.book_id = u.book_id where u.status is not null",
    LATEST,
)
def shelves(t: Tables) -> DataFrame:
    return readers.shelves(t.user_books, t.books, t.activities).select("user_id", "book_id", "status", "title", "finished_on")


@query("shelf_search", "select user_id, book_id from user_books join books on id = book_id where status = 'read' and (contains(lower(title), 'blue') or contains(lower(author), 'blue'))")
def shelf_search(t: Tables) -> DataFrame:
    return readers.shelves(t.user_books, t.books, t.activities, status="read", text="Blue").select("user_id", "book_id")


EDGES = (
    "edges",
    "select user_a as reader, user_b as friend, accepted_at as since from friendships where status = 'accepted' union all select user_b, user_a, accepted_at from friendships where status = 'accepted'",
)
FEED = ("feed", "select e.reader, a.id, a.type, a.user_id, a.book_id, a.created_at from activities a join edges e on a.user_id = e.friend and a.created_at >= e.since where not historical")
FEED_SQL = """select reader, place, f.id, type, username, title, f.created_at, more from (select *, max(place) over (partition by reader) > 20 as more from
    (select *, row_number() over (partition by reader order by created_at desc, id desc) as place from feed {where}) where place <= 21) f
    join users u on u.id = f.user_id join books b on b.id = f.book_id where place <= 20"""


@query("friend_edges", "select * from edges", EDGES)
def friend_edges(t: Tables) -> DataFrame:
    return readers.both_ways(t.friendships)


@query("feed_size", "select reader, count(*) as items from feed group by 1", EDGES, FEED)
def feed_size(t: Tables) -> DataFrame:
    return readers.feed_items(t.activities, t.friendships).groupBy("reader").agg(F.count("*").alias("items"))


@query("friend_feed", FEED_SQL.format(where=""), EDGES, FEED)
def friend_feed(t: Tables) -> DataFrame:
    return readers.friend_feed(t.activities, t.friendships, t.users, t.books)


@query("friend_feed_page", FEED_SQL.format(where="where (created_at, id) < (timestamp '1998-06-01', '5') and reader = 12"), EDGES, FEED)
def friend_feed_page(t: Tables) -> DataFrame:
    return readers.friend_feed(t.activities, t.friendships, t.users, t.books, reader=12, before=(F.lit("1998-06-01").cast("timestamp"), F.lit("5")))


@query(
    "friend_feed_details",
    """select f.reader, f.place, f.id, f.type, u.id as actor_id, u.username as actor, b.id as book_id, b.isbn, f.rating, case when f.type = 'reviewed_book' and f.review_id % 10 <> 3 then f.review_id end as review_id, case when f.type = 'reviewed_book' and f.review_id % 10 <> 3 then f.snapshot end as review_text, f.more
       from (select *, max(place) over (partition by reader) > 20 as more from (select a.*, e.reader, row_number() over (partition by e.reader order by a.created_at desc, a.id desc) as place
             from acts a join edges e on e.friend = a.user_id and a.created_at >= e.since where not a.historical) where place <= 21) f join users u on u.id = f.user_id join books b on b.id = f.book_id where place <= 20""",
    EDGES,
    ("acts", """select id, user_id, book_id, type, historical, created_at, null::int as rating, null::bigint as review_id, null::varchar as snapshot from activities
        union all select 'r' || id, user_id, book_id, 'reviewed_book', id % 7 = 0, created_at, rating, id, 'text of ' || id from reviews"""),
)
def friend_feed_details(t: Tables) -> DataFrame:
    """Activities and reviews, of which one in ten was taken back since, as nested items."""
    none = {"rating": F.lit(None).cast("int"), "review_id": F.lit(None).cast("bigint"), "snapshot": F.lit(None).cast("string")}
    plain = t.activities.withColumns(none).withColumn("created_at", F.col("created_at").cast("timestamp"))
    key = F.col("id")
    of_reviews = t.reviews.select(
        F.concat(F.lit("r"), key.cast("string")).alias("id"), "user_id", "book_id", F.lit("reviewed_book").alias("type"), (key % 7 == 0).alias("historical"), F.col("created_at").cast("timestamp").alias("created_at"),
        "rating", key.alias("review_id"), F.concat(F.lit("text of "), key.cast("string")).alias("snapshot"),
    )
    page = readers.feed_page(plain.select(of_reviews.columns).unionByName(of_reviews), t.friendships)
    shown = readers.feed_details(page, t.users, t.books, t.reviews.where("id % 10 <> 3"))
    return shown.select("reader", "place", "id", "type", F.col("actor.id").alias("actor_id"), F.col("actor.username").alias("actor"), F.col("book.id").alias("book_id"), "book.isbn", "rating", F.col("review.id").alias("review_id"), F.col("review.text").alias("review_text"), "more")


@query(
    "top_picks",
    """select user_id, place, book_id, score, reason, label from (select *, row_number() over (partition by user_id order by score desc, ratings_count desc, average_rating desc nulls last, publication_year desc nulls last, book_id) as place from
        (select *, row_number() over (partition by user_id, author_key order by score desc, ratings_count desc, average_rating desc nulls last, publication_year desc nulls last, book_id) as of_author from
         (select p.user_id, p.book_id, coalesce(p.gs, 0) + coalesce(k.points, 0) as score, c.ratings_count, c.average_rating, c.publication_year, lower(trim(c.author)) as author_key,
                 case when coalesce(k.points, 0) > 0 then 'author' else 'genre' end as reason, case when coalesce(k.points, 0) > 0 then c.author else p.best end as label
          from (select user_id, book_id, max(gs) as gs, max(best) as best from (
                  select l.user_id, g.book_id, sum(l.points) as gs, arg_min(l.genre, (-l.points, l.genre)) as best from likes l join book_genres g on g.genre = l.genre group by 1, 2
                  union all select k.user_id, c.id, null, null from knows k join cache c on lower(trim(c.author)) = k.author_key where k.points > 0) group by 1, 2) p
          join cache c on c.id = p.book_id left join knows k on k.user_id = p.user_id and k.author_key = lower(trim(c.author))
          where not exists (select 1 from user_books u where u.user_id = p.user_id and u.book_id = p.book_id)) where score > 0) where of_author <= 2) where place <= 6""",
    CACHE,
    ("rated", "select * from user_books where user_rating is not null and user_id in (select user_id from user_books where user_rating is not null group by 1 having count(*) >= 3)"),
    ("likes", "select user_id, genre, sum(case user_rating when 5 then 2 else 1 end) as points from rated join book_genres using (book_id) where user_rating >= 4 group by 1, 2"),
    ("knows", "select user_id, lower(trim(author)) as author_key, sum(case user_rating when 5 then 3 when 4 then 2 when 3 then 0 when 2 then -2 else -3 end) as points from rated join books on id = book_id group by 1, 2"),
)
def top_picks(t: Tables) -> DataFrame:
    # ratings, profiles and shelves read the sales once; in as many files as tasks, since the rows are short and their profiles long
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    shelf = cut(t.user_books.select("user_id", "book_id", "user_rating").repartition(parts, "user_id"), "shelf")
    return readers.top_picks(shelf, readers.rating_cache(t.books, shelf), t.book_genres)


SUGGESTIONS = """select reader, place, other, score, reason, case when reason = 'genres' then genres else '' end as genres, both_rated, shared_books from
       (select *, row_number() over (partition by reader order by score desc, round(similarity, 7) desc, shared_books desc, username, other) as place,
               case when similarity > 0 then 'genres' when ratings > 0 then 'ratings' else 'shared_books' end as reason from
        (select p.*, username, round(0.60 * similarity + 0.25 * ratings + 0.15 * shared_books / (b1.books + b2.books - shared_books), 7) as score from
         (select coalesce(d.reader, o.reader) as reader, coalesce(d.other, o.other) as other, coalesce(dot / (n1.norm * n2.norm), 0) as similarity, coalesce(genres, '') as genres,
                 coalesce(shared_books, 0) as shared_books, coalesce(both_rated, 0) as both_rated, coalesce(agreement, 0) * least(coalesce(both_rated, 0) / 5.0, 1) as ratings
          from dots d full join overlap o on o.reader = d.reader and o.other = d.other
          left join norms n1 on n1.user_id = coalesce(d.reader, o.reader) left join norms n2 on n2.user_id = coalesce(d.other, o.other)) p
         join (select distinct user_id, books from eligible) b1 on b1.user_id = p.reader join (select distinct user_id, books from eligible) b2 on b2.user_id = p.other join users on users.id = p.other
         where not exists (select 1 from friendships f where (f.user_a = p.reader and f.user_b = p.other) or (f.user_b = p.reader and f.user_a = p.other)))
        where score > 0) where place <= 12"""


def _suggestion_views(asking: str) -> tuple[tuple[str, str], ...]:
    return (
        ("eligible", "select *, count(*) over (partition by user_id) as books from (select *, case when status = 'read' or user_rating is not null then 1.0 when status = 'currently_reading' then 0.5 end as weight from user_books) where weight > 0 qualify count(*) over (partition by user_id) >= 5"),
        ("weights", "select user_id, genre, sum(weight) as weight from eligible join book_genres using (book_id) group by 1, 2"),
        ("norms", "select user_id, sqrt(sum(weight * weight)) as norm from weights group by 1"),
        ("dots", f"select a.user_id as reader, b.user_id as other, sum(a.weight * b.weight) as dot, array_to_string(list_slice(list(a.genre order by -(a.weight + b.weight), a.genre), 1, 2), ',') as genres from weights a join weights b on a.genre = b.genre and a.user_id <> b.user_id where {asking} group by 1, 2"),
        ("overlap", f"select a.user_id as reader, b.user_id as other, count(*) as shared_books, count(1 - abs(a.user_rating - b.user_rating) / 4.0) as both_rated, avg(1 - abs(a.user_rating - b.user_rating) / 4.0) as agreement from eligible a join eligible b on a.book_id = b.book_id and a.user_id <> b.user_id where {asking} group by 1, 2"),
    )


@query("reader_suggestions", SUGGESTIONS, *_suggestion_views("a.user_id % 50 = 0"))
def reader_suggestions(t: Tables) -> DataFrame:
    """A search: for the readers whose id is divisible by 50, against all others."""
    asking = t.users.where("id % 50 = 0").select(F.col("id").alias("user_id"))
    return readers.reader_suggestions(t.user_books, t.book_genres, t.friendships, t.users, readers=asking)


@query("reader_suggestions_all", SUGGESTIONS, *_suggestion_views("true"))
def reader_suggestions_all(t: Tables) -> DataFrame:
    """For every reader."""
    return readers.reader_suggestions(t.user_books, t.book_genres, t.friendships, t.users, readers=t.users.select(F.col("id").alias("user_id")))


FIRST = ("firsts", "select user_id, date_trunc('month', finished_on) as month, book_id, min((finished_on, created_at, id)) as f, arg_min(finished_on, (finished_on, created_at, id)) as day from activities where type = 'finished_reading' and finished_on is not null group by all")


@query(
    "trophies",
    "select user_id, strftime(month, '%Y-%m') as key, strftime(month, '%B %Y') || ' Reading Challenge' as title, count(*) as books_read, max(day) filter (n = 3) as completed_on from (select *, row_number() over (partition by user_id, month order by f) as n from firsts) group by user_id, month having count(*) >= 3",
    FIRST,
)
def trophies(t: Tables) -> DataFrame:
    return readers.trophies(t.activities)


@query(
    "challenge_progress",
    "select user_id, count(*) as progress, count(*) >= 3 as completed, string_agg(book_id::varchar, ',' order by f desc, book_id desc) as books from firsts where month = date '1998-05-01' group by 1",
    FIRST,
)
def challenge_progress(t: Tables) -> DataFrame:
    return readers.challenge_progress(t.activities, "1998-05-01")


@query("friends", "select reader, friend, username, since, row_number() over (partition by reader order by since desc, friend) as place from edges join users on id = friend", EDGES)
def friends(t: Tables) -> DataFrame:
    return readers.friends(t.friendships, t.users)


@query(
    "friend_requests",
    "select me, other, case when requested_by = me then 'sent' else 'incoming' end as direction, username from (select user_a as me, user_b as other, requested_by from friendships where status = 'pending' union all select user_b, user_a, requested_by from friendships where status = 'pending') join users on id = other",
)
def friend_requests(t: Tables) -> DataFrame:
    return readers.requests(t.friendships, t.users)


def _search_sql(text: str) -> str:
    return f"""select * from (select '{text}' as text, u.id, username, case when f.status is null then 'none' when f.status = 'accepted' then 'accepted' when f.requested_by = 12 then 'pending_outgoing' else 'pending_incoming' end as relationship,
       case when username = '{text}' then 0 when starts_with(username, '{text}') then 1 else 2 end as rank from users u
       left join (select case when user_a = 12 then user_b else user_a end as id, status, requested_by from friendships where user_a = 12 or user_b = 12) f on f.id = u.id
       where contains(username, '{text}') and u.id <> 12 order by rank, username, id limit 20)"""


SEARCHES = ("customer_000000014", "customer_00000001", "00001")


@query("search_readers", " union all ".join(map(_search_sql, SEARCHES)))
def search_readers(t: Tables) -> DataFrame:
    """A whole name, a prefix and a part, as reader 12 finds them."""
    found = [readers.search_readers(t.users, t.friendships, text, 12, 20).select(F.lit(text).alias("text"), "*") for text in SEARCHES]
    return found[0].union(found[1]).union(found[2])


@query(
    "notifications",
    """select recipient_id, place, n.id, u.username as actor, title, unread from (select *, row_number() over (partition by recipient_id order by created_at desc, id desc) as place, count(*) filter (read_at is null) over (partition by recipient_id) as unread from notifications) n
       join users u on u.id = n.actor_id left join reviews r on r.id = n.review_id left join books b on b.id = r.book_id where place <= 10""",
)
def notifications(t: Tables) -> DataFrame:
    return readers.notifications(t.notifications, t.users, t.reviews, t.books)


@query("unread_counts", "select recipient_id, count(*) filter (read_at is null) as unread from notifications group by 1")
def unread_counts(t: Tables) -> DataFrame:
    return t.notifications.groupBy("recipient_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


@query("used_genres", "select distinct genre from book_genres where book_id in (select id from books where publication_year < 1975)")
def used_genres(t: Tables) -> DataFrame:
    return readers.used_genres(t.book_genres, t.books.where("publication_year < 1975"))


@query(
    "releases",
    """select * from (select 'new' as kind, id, title, publication_date from books where publication_date between date '1998-08-01' - 90 and date '1998-08-01' order by publication_date desc, id limit 24)
       union all select * from (select 'upcoming', id, title, publication_date from books where publication_date > date '1998-08-01' and publication_date <= date '1998-08-01' + 180 order by publication_date, id limit 24)""",
)
def releases(t: Tables) -> DataFrame:
    return readers.releases(t.books, "1998-08-01", 24)


@query(
    "release_calendar",
    """select cast(d.day as date) as day, coalesce(n, 0) as n, coalesce(first_ids, '') as first_ids from (select unnest(generate_series(date '1998-06-01', date '1998-06-01' + 41, interval 1 day)) as day) d
       left join (select publication_date as day, count(*) as n, array_to_string(list_slice(list(id order by id), 1, 3), ',') as first_ids from books group by 1) b on b.day = d.day""",
)
def release_calendar(t: Tables) -> DataFrame:
    return readers.release_calendar(t.books, "1998-06-15")


@query(
    "release_readiness",
    """select count(*) as total, count(*) filter (publication_year is null) as without_year, max(publication_year) as latest_year, count(publication_date) as dated,
       count(*) filter (publication_date between date '1998-08-01' - 90 and date '1998-08-01') as recent, count(*) filter (publication_date > date '1998-08-01' and publication_date <= date '1998-08-01' + 180) as upcoming from books""",
)
def release_readiness(t: Tables) -> DataFrame:
    return readers.release_readiness(t.books, "1998-08-01")


@query("books_per_year", "select publication_year, count(*) as n from books group by 1")
def books_per_year(t: Tables) -> DataFrame:
    return t.books.groupBy("publication_year").agg(F.count("*").alias("n"))


@query(
    "constraint_report",
    """select 'rating_range' as rule, count(*) filter (user_rating not between 1 and 5) as n from user_books union all select 'cache_shape', count(*) filter ((ratings_count = 0) <> (average_rating is null)) from cache
       union all select 'isbn_format', count(*) filter (not regexp_full_match(isbn, '[0-9]{13}')) from books union all select 'year_range', count(*) filter (publication_year not between 1 and 2005) from books""",
    CACHE,
)
def constraint_report(t: Tables) -> DataFrame:
    books = quality.broken_rules(cached(t), [
        ("cache_shape", (F.col("ratings_count") == 0) != F.col("average_rating").isNull()), ("isbn_format", ~F.regexp_like("isbn", F.lit("^[0-9]{13}$"))),
        ("year_range", ~F.col("publication_year").between(1, 2005)),
    ])
    return quality.broken_rules(t.user_books, [("rating_range", ~F.col("user_rating").between(1, 5))]).union(books)


@query("duplicate_works", "select * from (select lower(title) || '|' || lower(author) as value, id as member, count(*) over (partition by lower(title) || '|' || lower(author)) as n from books) where n > 1")
def duplicate_works(t: Tables) -> DataFrame:
    return quality.duplicate_groups(t.books, F.concat(F.lower("title"), F.lit("|"), F.lower("author")), "id")


@query("sorted_extract", "select id, title, author, isbn from books")
def sorted_extract(t: Tables) -> DataFrame:
    return t.books.select("id", "title", "author", "isbn").orderBy("isbn", "title", "author", "id")


FINGERPRINT = """select sha256(string_agg(digest, chr(10) order by block)) as fingerprint from
       (select substr(part, 1, 4) as block, sha256(string_agg(digest, chr(10) order by part)) as digest from
        (select substr(sha256(key::varchar), 1, 8) as part, sha256(string_agg(sha256(row), chr(10) order by key)) as digest from rows group by 1) group by 1)"""


@query("users_fingerprint", FINGERPRINT, ("rows", """select id as key, '{"bio":"' || bio || '","id":' || id || ',"username":"' || username || '"}' as row from users"""))
def users_fingerprint(t: Tables) -> DataFrame:
    return quality.fingerprint(t.users, "id", ["id", "username", "bio"])
