"""Catalogue and reader tables derived from the star-schema tables, in Spark and as SQL with the same rows."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return value.cast("string")


class Tables:
    """Derived tables of one folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        name = F.lower(F.replace("c_name", F.lit("#"), F.lit("_")))
        return self.raw("customer").select(F.col("c_custkey").alias("id"), name.alias("username"), F.col("c_mktsegment").alias("bio"))

    @cached_property
    def books(self) -> DataFrame:
        key = F.col("p_partkey")
        body = F.concat(F.lit("978"), F.lpad(_text(key), 9, "0"))
        total = sum((F.substring(body, i, 1).cast("int") * (3 if i % 2 == 0 else 1) for i in range(1, 13)), F.lit(0))
        return self.raw("part").select(
            key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
            F.concat(body, _text((10 - total % 10) % 10)).alias("isbn"), F.concat(F.lit("/works/OL"), _text(key), F.lit("W")).alias("work_key"),
            (F.col("p_size") + 1970).alias("publication_year"), F.expr("date_add(date'1998-01-01', cast(p_partkey % 400 as int))").alias("publication_date"),
            (key % 7).alias("cover_id"),
        )

    @cached_property
    def book_genres(self) -> DataFrame:
        part = self.raw("part")
        kind = part.select(F.col("p_partkey").alias("book_id"), F.lower("p_type").alias("genre"))
        return kind.union(part.select("p_partkey", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))))

    @cached_property
    def _sales(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def user_books(self) -> DataFrame:
        grouped = self._sales.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("book_id")).agg(
            F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line"), F.max("l_quantity").alias("quantity"), F.max("o_orderdate").alias("updated_at")
        )
        status = F.when(F.col("flag") == "R", "read").when(F.col("flag") == "A", "currently_reading").when(F.col("line") == "F", "want_to_read")
        rating = F.when(F.col("flag") != "N", F.col("quantity").cast("int") % 5 + 1)
        return grouped.select("user_id", "book_id", status.alias("status"), rating.alias("user_rating"), "updated_at")

    @cached_property
    def activities(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        grouped = self._sales.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("book_id"), day.alias("day")).agg(
            F.max("l_returnflag").alias("flag"), F.min("o_orderdate").alias("created_at")
        )
        kind = F.when(F.col("flag") == "R", "finished_reading").when(F.col("flag") == "A", "started_reading").otherwise("rated_book")
        return grouped.select(
            F.concat_ws("-", _text(F.col("user_id")), _text(F.col("book_id")), F.date_format("day", "yyyyMMdd")).alias("id"), "user_id", "book_id",
            kind.alias("type"), F.when(F.col("flag") == "R", F.col("day")).alias("finished_on"), (F.dayofmonth("day") % 10 == 0).alias("historical"), "created_at",
        )

    @cached_property
    def friendships(self) -> DataFrame:
        """Readers with the six next ones; one in five pairs is pending."""
        ids = self.raw("customer").select(F.col("c_custkey").alias("a"))
        pairs = ids.withColumn("b", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.col("a") + k)))
        pairs = pairs.join(ids.select(F.col("a").alias("b")), "b")
        total = F.col("a") + F.col("b")
        return pairs.select(
            F.col("a").alias("user_a"), F.col("b").alias("user_b"), F.when(total % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("requested_by"),
            F.when(total % 5 == 0, "pending").otherwise("accepted").alias("status"),
            F.when(total % 5 != 0, F.expr("cast(date_add(date'1996-01-01', cast((a + b) % 1500 as int)) as timestamp)")).alias("accepted_at"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        d = F.col("doc_id")
        at = F.expr("cast(date_add(date'2024-01-01', cast(doc_id % 360 as int)) as timestamp)")
        return self.raw("documents").select(d.alias("id"), (d * 7 % 150).alias("user_id"), (d * 13 % 200).alias("book_id"), (d % 5 + 1).cast("int").alias("rating"), F.col("n_chars"), at.alias("created_at"))

    @cached_property
    def review_likes(self) -> DataFrame:
        return self.raw("events").where("event_type = 'click'").select("user_id", (F.col("event_id") % 200).alias("review_id")).distinct()

    @cached_property
    def notifications(self) -> DataFrame:
        e = F.col("event_id")
        read_at = F.when(F.col("value") > 50, F.col("ts"))
        kept = self.raw("events").where("event_type in ('view', 'purchase')")
        return kept.select(e.alias("id"), F.col("user_id").alias("recipient_id"), (e % 150).alias("actor_id"), F.when(e % 3 != 0, e % 200).alias("review_id"), read_at.alias("read_at"), F.col("ts").alias("created_at"))

    @cached_property
    def works(self) -> DataFrame:
        blank = F.when(F.col("id") % 97 == 0, F.lit(" ")).otherwise(F.col("title"))
        key = F.when(F.col("id") % 89 == 0, F.lit("bad")).otherwise(F.col("work_key"))
        covers = F.when(F.col("cover_id") > 0, F.array("cover_id")).otherwise(F.array().cast("array<bigint>"))
        author = F.concat(F.lit("/authors/OL"), F.regexp_extract("author", r"(\d+)", 1), F.lit("A"))
        return self.books.select(key.alias("work_key"), blank.alias("title"), F.array(author).alias("author_keys"), covers.alias("cover_ids"), "id")

    @cached_property
    def ratings_log(self) -> DataFrame:
        """Ratings of 0 to 6, of which 0 and 6 are out of range; some of works that don't exist."""
        part = F.col("l_partkey")
        key = F.concat(F.lit("/works/OL"), _text(F.when(part % 50 == 0, part + 100_000_000).otherwise(part)), F.lit("W"))
        return self.raw("lineitem").select(key.alias("work_key"), _text(F.col("l_quantity").cast("int") % 7).alias("value"))

    @cached_property
    def shelf_log(self) -> DataFrame:
        shelf = F.when(F.col("event_type") == "view", "Want to Read").when(F.col("event_type") == "click", "Currently Reading").when(F.col("event_type") == "purchase", "Already Read").otherwise(F.col("event_type"))
        return self.raw("events").select(F.concat(F.lit("/works/OL"), _text(F.col("event_id") % 200), F.lit("W")).alias("work_key"), shelf.alias("value"))

    @cached_property
    def editions(self) -> DataFrame:
        """Three editions a work; languages, formats and dates of several shapes."""
        k, size = F.col("p_partkey"), F.col("p_size") % 4
        b = self.books.select(F.col("id").alias("k"), "isbn", "title")
        rows = self.raw("part").join(b, k == F.col("k"))
        languages = F.when(size == 0, F.array(F.lit("/languages/eng"))).when(size == 1, F.array(F.lit("/languages/fre"))).when(size == 2, F.array(F.lit("/languages/ger"), F.lit("/languages/eng"))).otherwise(F.array().cast("array<string>"))
        date = F.when(size == 0, _text(F.col("p_size") + 1970)).when(size == 1, F.concat(F.lit("March 3, "), _text(F.col("p_size") + 1970))).when(size == 2, F.concat(F.lit("circa "), _text(F.col("p_size") + 1970)))
        fmt = F.when(F.col("p_type") == "PROMO", "Audio CD").when(F.col("p_type") == "SMALL", "Mass Market Paperback").when(F.col("p_type") == "LARGE", "Hardcover").when(F.col("p_type") == "MEDIUM", "Wall calendar").otherwise(F.lower("p_type"))
        return rows.select(
            F.concat(F.lit("/books/OL"), _text(k), F.lit("M")).alias("key"), F.concat(F.lit("/works/OL"), _text(k - k % 3), F.lit("W")).alias("work_key"), "isbn", "title",
            languages.alias("languages"), date.alias("publish_date"), fmt.alias("format"), (k % 5).alias("cover"), F.col("p_brand").alias("author"),
        )


def _digits(text: str) -> str:
    return "(" + " + ".join(f"cast(substr({text}, {i}, 1) as int)" + (" * 3" if i % 2 == 0 else "") for i in range(1, 13)) + ")"


#: The same tables as common table expressions.
VIEWS = {
    "users": "select c_custkey as id, lower(replace(c_name, '#', '_')) as username, c_mktsegment as bio from customer",
    "books": f"""select id, title, author, body || cast((10 - {_digits("body")} % 10) % 10 as varchar) as isbn, '/works/OL' || id || 'W' as work_key,
        publication_year, date '1998-01-01' + cast(id % 400 as int) as publication_date, id % 7 as cover_id
        from (select p_partkey as id, p_name as title, p_brand as author, '978' || lpad(cast(p_partkey as varchar), 9, '0') as body, p_size + 1970 as publication_year from part)""",
    "book_genres": "select p_partkey as book_id, lower(p_type) as genre from part union all select p_partkey, lower(split_part(p_name, ' ', 1)) from part",
    "user_books": """select user_id, book_id, case when flag = 'R' then 'read' when flag = 'A' then 'currently_reading' when line = 'F' then 'want_to_read' end as status,
        case when flag <> 'N' then cast(quantity as int) % 5 + 1 end as user_rating, updated_at
        from (select o_custkey as user_id, l_partkey as book_id, max(l_returnflag) as flag, min(l_linestatus) as line, max(l_quantity) as quantity, max(o_orderdate) as updated_at
              from lineitem join orders on l_orderkey = o_orderkey group by all)""",
    "activities": """select user_id || '-' || book_id || '-' || strftime(day, '%Y%m%d') as id, user_id, book_id,
        case flag when 'R' then 'finished_reading' when 'A' then 'started_reading' else 'rated_book' end as type,
        case when flag = 'R' then day end as finished_on, dayofmonth(day) % 10 = 0 as historical, created_at
        from (select o_custkey as user_id, l_partkey as book_id, cast(l_shipdate as date) as day, max(l_returnflag) as flag, min(o_orderdate) as created_at
              from lineitem join orders on l_orderkey = o_orderkey group by all)""",
    "friendships": """select a as user_a, b as user_b, case when (a + b) % 2 = 0 then a else b end as requested_by,
        case when (a + b) % 5 = 0 then 'pending' else 'accepted' end as status,
        case when (a + b) % 5 <> 0 then cast(date '1996-01-01' + cast((a + b) % 1500 as int) as timestamp) end as accepted_at
        from (select c_custkey as a, c_custkey + unnest([1, 2, 3, 4, 5, 6]) as b from customer) where b in (select c_custkey from customer)""",
    "reviews": """select doc_id as id, doc_id * 7 % 150 as user_id, doc_id * 13 % 200 as book_id, cast(doc_id % 5 + 1 as int) as rating, n_chars,
        cast(date '2024-01-01' + cast(doc_id % 360 as int) as timestamp) as created_at from documents""",
    "review_likes": "select distinct user_id, event_id % 200 as review_id from events where event_type = 'click'",
    "notifications": """select event_id as id, user_id as recipient_id, event_id % 150 as actor_id, case when event_id % 3 <> 0 then event_id % 200 end as review_id,
        case when value > 50 then ts end as read_at, ts as created_at from events where event_type in ('view', 'purchase')""",
    "works": """select case when id % 89 = 0 then 'bad' else work_key end as work_key, case when id % 97 = 0 then ' ' else title end as title,
        ['/authors/OL' || regexp_extract(author, '(\\d+)', 1) || 'A'] as author_keys, case when cover_id > 0 then [cover_id] else [] end as cover_ids, id from books""",
    "ratings_log": """select '/works/OL' || (case when l_partkey % 50 = 0 then l_partkey + 100000000 else l_partkey end) || 'W' as work_key,
        cast(cast(l_quantity as int) % 7 as varchar) as value from lineitem""",
    "shelf_log": """select '/works/OL' || event_id % 200 || 'W' as work_key, case event_type when 'view' then 'Want to Read' when 'click' then 'Currently Reading'
        when 'purchase' then 'Already Read' else event_type end as value from events""",
    "editions": """select '/books/OL' || p_partkey || 'M' as key, '/works/OL' || (p_partkey - p_partkey % 3) || 'W' as work_key, isbn, title,
        case p_size % 4 when 0 then ['/languages/eng'] when 1 then ['/languages/fre'] when 2 then ['/languages/ger', '/languages/eng'] else [] end as languages,
        case p_size % 4 when 0 then '' || (p_size + 1970) when 1 then 'March 3, ' || (p_size + 1970) when 2 then 'circa ' || (p_size + 1970) end as publish_date,
        case p_type when 'PROMO' then 'Audio CD' when 'SMALL' then 'Mass Market Paperback' when 'LARGE' then 'Hardcover' when 'MEDIUM' then 'Wall calendar' else lower(p_type) end as format,
        p_partkey % 5 as cover, p_brand as author from part join books on p_partkey = id""",
}


def with_views(sql: str, *more: tuple[str, str]) -> str:
    """The SQL with the derived tables, and further ones, that it needs before it."""
    tables = VIEWS | dict(more)
    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        todo += [tables[n] for n in words & tables.keys() - needed]
        needed |= words & tables.keys()
    ctes = ", ".join(f"{name} as ({text})" for name, text in tables.items() if name in needed)
    return f"with {ctes} {sql}" if ctes else sql
