"""Queries over command logs made of the event table, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_dir
from ..streaming import commands as cmd
from ..streaming import ordered, shelves
from .registry import query
from .views import Tables

COMMANDS = (
    "commands",
    """select event_id as command_id, ts, user_id, event_id % 7 as book_id, case event_type when 'view' then 'currently_reading' when 'purchase' then 'read' when 'signup' then 'want_to_read' end as status,
       case when event_type = 'click' then cast(floor(value) as int) % 5 + 1 end as rating, event_type = 'error' as removes from events""",
)


def commands(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "currently_reading").when(kind == "purchase", "read").when(kind == "signup", "want_to_read")
    return t.raw("events").select(
        F.col("event_id").alias("command_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_id") % 7).alias("book_id"), status.alias("status"),
        F.when(kind == "click", F.floor("value").cast("int") % 5 + 1).alias("rating"), (kind == "error").alias("removes"), F.lit(None).cast("date").alias("finished_on"),
    )


@query(
    "shelf_events",
    """select command_id, type, case when type = 'finished_reading' then cast(ts as date) end as finished_on, case when type = 'rated_book' then rating end as rating from
       (select *, case when status is not null and status is distinct from old_status and status = 'currently_reading' then 'started_reading' when status is not null and status is distinct from old_status and status = 'read' then 'finished_reading'
                       when rating is not null and rating is distinct from old_rating then 'rated_book' end as type from
        (select *, last_value(status ignore nulls) over w as old_status, last_value(rating ignore nulls) over w as old_rating from commands where not removes
         window w as (partition by user_id, book_id order by ts, command_id rows between unbounded preceding and 1 preceding))) where type is not null""",
    COMMANDS,
)
def shelf_events(t: Tables) -> DataFrame:
    return cmd.shelf_events(commands(t).where("not removes")).select("command_id", "type", "finished_on", "rating")


#: One log of shelf, removal, review and review-removal commands, made of all events.
READER_LOG = (
    "reader_log",
    """select event_id as command_id, ts, user_id, event_id % 7 as book_id,
       case when event_type = 'error' and event_id % 3 = 0 then 'unreview' when event_type = 'error' then 'remove' when event_type = 'click' and event_id % 4 < 2 then 'review' else 'shelf' end as kind,
       case event_type when 'view' then 'currently_reading' when 'purchase' then 'read' when 'signup' then 'want_to_read' end as status,
       case when event_type = 'click' and event_id % 8 <> 3 or event_type = 'signup' and event_id % 2 = 0 then cast(floor(value) as int) % 5 + 1 end as rating,
       event_type = 'click' and event_id % 8 = 3 as clears_rating,
       case when event_id % 11 = 0 and event_type in ('purchase', 'view', 'click') then cast(ts as date) - 3 end as finished_on, case when event_id % 8 in (0, 5) then 'text ' || event_id end as text from events""",
)
#: The log folded one command at a time.
READER_WALK = (
    "reader_walk",
    """with recursive numbered as (select *, row_number() over (partition by user_id, book_id order by ts, command_id) as n from reader_log),
       w as (select distinct user_id, book_id, 0::bigint as n, null::bigint as command_id, null::timestamp as ts, null::varchar as outcome, null::varchar as type, null::date as finished_on, null::int as activity_rating, null::varchar as snapshot,
                    null::varchar as status, null::int as rating, false as on_shelf, false as reviewed, null::varchar as review_text, null::timestamp as reviewed_at from numbered
         union all
         select user_id, book_id, n, command_id, ts, outcome, type, case when type = 'finished_reading' then coalesce(c_day, cast(ts as date)) end, case when type in ('rated_book', 'reviewed_book') then c_rating end, case when type = 'reviewed_book' then c_text end,
                case when kind = 'remove' then null when kind = 'shelf' and outcome is null then coalesce(c_status, p_status) else p_status end,
                case when kind = 'review' and outcome is null then c_rating when kind = 'shelf' and outcome is null then case when clears_rating then null else coalesce(c_rating, p_rating) end else p_rating end,
                case when kind in ('shelf', 'review') and outcome is null then true when kind = 'remove' then p_rating is not null or p_reviewed else p_on_shelf end,
                case when kind = 'review' and outcome is null then true when kind = 'unreview' then false else p_reviewed end,
                case when kind = 'review' and outcome is null then case when p_reviewed then coalesce(c_text, p_text) else c_text end when kind = 'unreview' then null else p_text end,
                case when kind = 'review' and outcome is null and not p_reviewed then ts when kind = 'unreview' then null else p_at end
         from (select *, case when outcome is not null then null when kind = 'shelf' and c_status is not null and c_status is distinct from p_status and c_status = 'currently_reading' then 'started_reading'
                              when kind = 'shelf' and c_status is not null and c_status is distinct from p_status and c_status = 'read' then 'finished_reading' when kind = 'shelf' and c_rating is not null and c_rating is distinct from p_rating then 'rated_book'
                              when kind = 'review' and not p_reviewed then 'reviewed_book' end as type from
           (select *, case when kind = 'shelf' and clears_rating and p_reviewed then 'review_requires_rating' when kind = 'shelf' and c_day is not null and coalesce(c_status, p_status, '') <> 'read' then 'invalid_shelf_status' when kind = 'review' and c_rating is null then 'missing_rating'
                           when kind = 'remove' and not p_on_shelf then 'shelf_not_found' when kind = 'unreview' and not p_reviewed then 'review_not_found' end as outcome from
             (select s.user_id, s.book_id, s.n, s.command_id, s.ts, s.kind, s.status as c_status, s.rating as c_rating, s.clears_rating, s.finished_on as c_day, s.text as c_text, p.status as p_status, p.rating as p_rating, p.on_shelf as p_on_shelf, p.reviewed as p_reviewed, p.review_text as p_text, p.reviewed_at as p_at
              from w p join numbered s on s.user_id = p.user_id and s.book_id = p.book_id and s.n = p.n + 1))))
       select * from w""",
)
READER_LAST = ("reader_last", "select * from reader_walk where n > 0 qualify row_number() over (partition by user_id, book_id order by n desc) = 1")
DECIDED = ["command_id", "user_id", "book_id", "outcome", "type", "finished_on", "activity_rating", "snapshot", "status", "rating", "on_shelf", "reviewed"]


def reader_log(t: Tables) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "view", "currently_reading").when(kind == "purchase", "read").when(kind == "signup", "want_to_read")
    clears = (kind == "click") & (e % 8 == 3)
    rates = ((kind == "click") & (e % 8 != 3)) | ((kind == "signup") & (e % 2 == 0))
    what = F.when((kind == "error") & (e % 3 == 0), "unreview").when(kind == "error", "remove").when((kind == "click") & (e % 4 < 2), "review").otherwise("shelf")
    return t.raw("events").select(
        e.alias("command_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("user_id"), (e % 7).alias("book_id"), what.alias("kind"), status.alias("status"),
        F.when(rates, F.floor("value").cast("int") % 5 + 1).alias("rating"), clears.alias("clears_rating"),
        F.when((e % 11 == 0) & kind.isin("purchase", "view", "click"), F.date_sub("ts", 3)).alias("finished_on"), F.when((e % 8).isin(0, 5), F.concat(F.lit("text "), e.cast("string"))).alias("text"),
    )


@query("reader_log", f"select {', '.join(DECIDED)} from reader_walk where n > 0", READER_LOG, READER_WALK)
def decided_log(t: Tables) -> DataFrame:
    """What each command of the log came to, and the shelf after it."""
    return shelves.decide(reader_log(t)).select(*DECIDED)


@query("shelf_state", "select user_id, book_id, status, rating from reader_last where on_shelf", READER_LOG, READER_WALK, READER_LAST)
def shelf_state(t: Tables) -> DataFrame:
    return shelves.shelf_rows(shelves.decide(reader_log(t)))


@query("current_reviews", "select user_id, book_id, rating, review_text as text, reviewed_at as created_at from reader_last where reviewed", READER_LOG, READER_WALK, READER_LAST)
def current_reviews(t: Tables) -> DataFrame:
    return shelves.review_rows(shelves.decide(reader_log(t)))


@query("review_events", "select command_id, user_id, book_id, type, activity_rating as rating, snapshot from reader_walk where type = 'reviewed_book'", READER_LOG, READER_WALK)
def review_events(t: Tables) -> DataFrame:
    made = shelves.activities(shelves.decide(reader_log(t))).where("type = 'reviewed_book'")
    return made.select("command_id", "user_id", "book_id", "type", "rating", "snapshot")


@query("log_ratings", "select book_id, round(avg(rating), 9) as average_rating, count(rating) as ratings_count from reader_last group by 1", READER_LOG, READER_WALK, READER_LAST)
def log_ratings(t: Tables) -> DataFrame:
    """The rating cache of the shelf that the whole log leads to."""
    decided = shelves.decide(reader_log(t))
    books = decided.select("book_id").distinct()
    return books.join(shelves.shelf_rows(decided), "book_id", "left").groupBy("book_id").agg(F.round(F.avg("rating"), 9).alias("average_rating"), F.count("rating").alias("ratings_count"))


@query(
    "like_state",
    "select review_id, count(*) as likes, count(*) filter (owner <> user_id) as notified from (select user_id, event_id % 200 as review_id, arg_max(event_type = 'click', (ts, event_id)) as liked from events where event_type in ('click', 'error') group by 1, 2) join (select id, user_id as owner from reviews) r on r.id = review_id where liked group by 1",
)
def like_state(t: Tables) -> DataFrame:
    e = t.raw("events").where("event_type in ('click', 'error')")
    log = e.select("ts", F.col("event_id").alias("command_id"), "user_id", (F.col("event_id") % 200).alias("review_id"), (F.col("event_type") == "click").alias("liked"))
    return cmd.like_state(log, t.reviews)


REQUESTS = (
    (
        "steps",
        """select least(actor, target) as a, greatest(actor, target) as b, actor, action, row_number() over (partition by least(actor, target), greatest(actor, target) order by ts, command_id) as n from
           (select ts, event_id as command_id, user_id as actor, user_id + 1 + event_id % 2 as target, case when event_type in ('view', 'click') then 'request' when event_type = 'error' and event_id % 3 = 0 then 'decline' when event_type = 'error' then 'remove' else 'accept' end as action from events)""",
    ),
    (
        "walk",
        """with recursive w as (select distinct a, b, 0::bigint as n, 'none' as state, null::bigint as asker from steps
           union all select s.a, s.b, s.n, case when action = 'request' and state = 'none' then 'pending' when action = 'accept' and state = 'pending' and actor <> asker then 'accepted' when action = 'decline' and state = 'pending' or action = 'remove' and state = 'accepted' then 'none' else state end,
                  case when action = 'request' and state = 'none' then actor when action = 'decline' and state = 'pending' or action = 'remove' and state = 'accepted' then null else asker end
           from w join steps s on s.a = w.a and s.b = w.b and s.n = w.n + 1) select * from w""",
    ),
)


def request_log(t: Tables) -> DataFrame:
    e = t.raw("events")
    ends = F.when(F.col("event_id") % 3 == 0, "decline").otherwise("remove")
    action = F.when(F.col("event_type").isin("view", "click"), "request").when(F.col("event_type") == "error", ends).otherwise("accept")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("command_id"), F.col("user_id").alias("actor"), (F.col("user_id") + 1 + F.col("event_id") % 2).alias("target"), action.alias("action"))


@query("request_state", """select a, b, arg_max(state, n) as state, nullif(arg_max(coalesce(asker, -1), n), -1) as requested_by from walk group by a, b""", *REQUESTS)
def request_state(t: Tables) -> DataFrame:
    return cmd.request_state(request_log(t))


@query(
    "corrected_finishes",
    """select a.user_id, a.book_id, coalesce(c.new_day, a.finished_on) as finished_on, false as historical from finishes a left join corrected c on c.user_id = a.user_id and c.book_id = a.book_id and c.target = a.id
       union all select user_id, book_id, new_day, true from corrected where target is null""",
    ("finishes", "select * from activities where type = 'finished_reading'"),
    ("fixes", "select event_id as command_id, user_id, event_id % 20 as book_id, cast(ts as date) as day, case when event_id % 2 = 0 then ts else ts - interval 26 year end as moment from events where event_type = 'error'"),
    (
        "aimed",
        """select f.command_id, f.user_id, f.book_id, f.day, f.moment, arg_max(a.id, (a.created_at, a.id)) filter (a.id is not null) as target from fixes f
           left join finishes a on a.user_id = f.user_id and a.book_id = f.book_id and a.created_at <= f.moment group by all""",
    ),
    ("corrected", "select user_id, book_id, target, arg_max(day, (moment, command_id)) as new_day from aimed group by all"),
)
def corrected_finishes(t: Tables) -> DataFrame:
    """Half of the corrections are moved among the finishes, so that some come before a finish and some after."""
    at = F.when(F.col("event_id") % 2 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("interval 26 year"))
    fixes = t.raw("events").where("event_type = 'error'").select(F.col("event_id").alias("command_id"), "user_id", (F.col("event_id") % 20).alias("book_id"), F.to_date("ts").alias("finished_on"), at.cast("timestamp").alias("ts"))
    return cmd.corrected_finishes(t.activities.where("type = 'finished_reading'"), fixes)


MARKS = ("marks", "select ts, user_id, case when event_type = 'click' then null else event_id - 5 end as notification_id from events where event_type in ('error', 'signup') or event_type = 'click' and event_id % 5 = 0")


@query(
    "first_reads",
    """select n.id, n.recipient_id, coalesce(n.read_at, least((select min(m.ts) from marks m where m.notification_id = n.id and m.user_id = n.recipient_id), (select min(m.ts) from marks m where m.notification_id is null and m.user_id = n.recipient_id and m.ts >= n.created_at))) as read_at
       from notifications n""",
    MARKS,
)
def first_reads(t: Tables) -> DataFrame:
    """Commands that mark one notification read, and ones that mark all."""
    e, kind = F.col("event_id"), F.col("event_type")
    marks = t.raw("events").where("event_type in ('error', 'signup') or event_type = 'click' and event_id % 5 = 0")
    marks = marks.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(kind != "click", e - 5).alias("notification_id"))
    notes = t.notifications.select("id", "recipient_id", F.col("created_at").cast("timestamp").alias("created_at"), F.col("read_at").cast("timestamp").alias("read_at"))
    return cmd.first_reads(notes, marks)


@query("backfilled_finishes", "select id, case when type = 'finished_reading' and (finished_on is null or finished_on = cast(created_at as date) - 1) then cast(created_at as date) else finished_on end as finished_on from activities")
def backfilled_finishes(t: Tables) -> DataFrame:
    return cmd.backfilled(t.activities.withColumn("created_at", F.col("created_at").cast("timestamp")), "America/New_York").select("id", "finished_on")


def _stream(t: Tables, name: str) -> DataFrame:
    """A table's file as a stream; as a pattern, since a stream's plain path has to be a folder."""
    return t.spark.readStream.schema(t.raw(name).schema).parquet(f"{t.sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _parts(t: Tables, rows: DataFrame, schema: str, name: str, parts: int = 3) -> tuple[str, DataFrame]:
    """rows as a stream of `parts` batches in the order of ts, each with some that belong to the next one; a folder and the stream."""
    out = scratch_dir(t.spark, name)
    edges = rows.approxQuantile("at", [k / parts for k in range(1, parts)], 0.001) if not rows.isEmpty() else []
    batch = sum(((F.col("at") + F.when(F.col("command_id") % 5 == 0, -3600).otherwise(0) >= edge).cast("int") for edge in edges), F.lit(0))
    for k in range(parts):
        rows.where(batch == k).drop("at").coalesce(1).write.mode("append").parquet(f"{out}/in")
    return out, t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")


def _with_end(rows: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """rows with a last event of a key of its own, far behind all others, that lets the watermark pass them; `at` is ts in seconds."""
    last = rows.agg(F.max("ts").alias("ts")).where("ts is not null").select((F.col("ts") + F.expr("interval 9 days")).alias("ts"), *(F.lit(-1).cast("long").alias(k) for k in keys))
    return rows.unionByName(last, allowMissingColumns=True).to(rows.sparkSession.createDataFrame([], schema).schema).withColumn("at", F.col("ts").cast("double"))


def _folded(t: Tables, stream: DataFrame, out: str) -> DataFrame:
    """A stream's rows after it has run, in a session with the settings of ordered folds.

    Each partition of state has a store of its own, opened in every batch: two a core are enough.
    """
    partitions = min(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 2 * t.spark.sparkContext.defaultParallelism)
    settings = ordered.SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: t.spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        t.spark.conf.set(k, v)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/table").awaitTermination()
    finally:
        for k, v in before.items():
            t.spark.conf.set(k, v) if v is not None else t.spark.conf.unset(k)
    return t.spark.read.schema(stream.schema).parquet(f"{out}/table")


@query("stream_reader_log", f"select {', '.join(DECIDED)} from reader_walk where n > 0", READER_LOG, READER_WALK)
def stream_reader_log(t: Tables) -> DataFrame:
    """The reader log as a stream of several batches, some events late, folded in order of time."""
    out, stream = _parts(t, _with_end(reader_log(t), shelves.LOG, shelves.KEYS), shelves.LOG, "shelves")
    return _folded(t, ordered.fold_in_order(stream, shelves.KEYS, shelves.step, shelves.DECIDED), out).select(*DECIDED)


@query("stream_requests", "select a, b, arg_max(state, n) as state, nullif(arg_max(coalesce(asker, -1), n), -1) as requested_by, case arg_max(state, n) when 'pending' then a + b - arg_max(asker, n) end as notified from walk where n > 0 group by a, b", *REQUESTS)
def stream_requests(t: Tables) -> DataFrame:
    """The request log as a stream; the notification that stands is the last that was made and isn't gone."""
    schema = "command_id long, ts timestamp, a long, b long, actor long, target long, action string"
    log = request_log(t).withColumns({"a": F.least("actor", "target"), "b": F.greatest("actor", "target")})
    out, stream = _parts(t, _with_end(log, schema, ["a", "b"]), schema, "requests")
    rows = _folded(t, ordered.fold_in_order(stream, ["a", "b"], cmd.request_step, cmd.ANSWERED), out)
    at = F.struct("ts", "command_id")
    pairs = rows.groupBy("a", "b").agg(F.max_by(F.struct("state", "requested_by"), at).alias("s"), F.max_by(F.struct("note", "requested_by"), F.when(F.col("note").isNotNull(), at)).alias("note"))
    stands = F.when(F.col("note.note") == "made", F.col("a") + F.col("b") - F.col("note.requested_by"))
    return pairs.select("a", "b", "s.state", "s.requested_by", stands.alias("notified"))


@query("request_notifications", "select a + b - asker as recipient_id, asker as actor_id from walk where n > 0 qualify row_number() over (partition by a, b order by n desc) = 1 and state = 'pending'", *REQUESTS)
def request_notifications(t: Tables) -> DataFrame:
    return cmd.request_notifications(cmd.request_state(request_log(t)))


@query("stream_running_ratings", "select book_id, round(avg(rating), 9) as average_rating, count(rating) as ratings_count from (select event_id % 50 as book_id, user_id % 40 as reader, case when event_type <> 'error' then cast(floor(value) as int) % 5 + 1 end as rating from events qualify row_number() over (partition by event_id % 50, user_id % 40 order by ts desc, event_id desc) = 1) group by 1")
def stream_running_ratings(t: Tables) -> DataFrame:
    """Ratings, changed ratings and cleared ones as a stream of several batches, some out of order, kept as a running cache."""
    e = F.col("event_id")
    rows = t.raw("events").select((e % 50).alias("book_id"), (F.col("user_id") % 40).alias("user_id"), F.when(F.col("event_type") != "error", F.floor("value").cast("int") % 5 + 1).alias("rating"), F.col("ts").cast("timestamp").alias("ts"), e.alias("command_id"))
    out, stream = _parts(t, rows.withColumn("at", F.col("ts").cast("double")), cmd.RATED, "ratings")
    running, cache = cmd.running_ratings(stream, f"{out}/table", f"{out}/state")
    running.awaitTermination()
    return cmd.cached_ratings(cache.read()).select("book_id", F.round("average_rating", 9).alias("average_rating"), "ratings_count")


@query(
    "stream_monthly_finishes",
    "select user_id, strftime(finished_on, '%Y-%m') as month, count(distinct book_id) as books from activities where type = 'finished_reading' and finished_on is not null group by 1, 2",
)
def stream_monthly_finishes(t: Tables) -> DataFrame:
    """The finishes of the activities as a stream, each reader's months upserted into a table."""
    out = scratch_dir(t.spark, "finishes")
    done = t.activities.where("type = 'finished_reading' and finished_on is not null").select("user_id", "book_id", F.col("finished_on").cast("timestamp").alias("ts"))
    done.write.parquet(f"{out}/in")
    stream = t.spark.readStream.schema(done.schema).parquet(f"{out}/in")
    running, table = cmd.upsert_batches(cmd.monthly_finishes(stream), f"{out}/table", f"{out}/state", ["user_id", "month"])
    running.awaitTermination()
    return table.read().select("user_id", "month", "books")


@query("stream_live_feed", "select reader, count(*) as items from (select e.user_id, e.ts from events e where event_type = 'purchase') a join (select user_a as reader, user_b as friend, accepted_at as since from friendships where status = 'accepted' union all select user_b, user_a, accepted_at from friendships where status = 'accepted') f on a.user_id = f.friend and a.ts >= f.since group by 1")
def stream_live_feed(t: Tables) -> DataFrame:
    """A stream of purchases joined with the accepted friendships as they stand."""
    from ..operators.readers import both_ways

    acts = _stream(t, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    out = scratch_dir(t.spark, "feed")
    feed = cmd.live_feed(acts, both_ways(t.friendships)).select("reader", "created_at")
    feed.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/table").awaitTermination()
    return t.spark.read.schema("reader long, created_at timestamp").parquet(f"{out}/table").groupBy("reader").agg(F.count("*").alias("items"))
