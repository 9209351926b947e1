"""Shelf, review, like and friendship commands: the events and the state that a log of them leads to.

The batch functions fold whole logs with windows; the streaming ones use the same rules on streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import KeyedTable


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts", "command_id")


def shelf_events(commands: DataFrame) -> DataFrame:
    """commands (command_id, ts, user_id, book_id, status, rating, finished_on) to activity events.

    A field that a command leaves null keeps its value. Going to currently_reading starts, going to read
    finishes (on the day given, else on the command's day), else a changed rating rates.
    """
    order = _by("user_id", "book_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = commands.withColumns({"old_status": F.last("status", ignorenulls=True).over(past), "old_rating": F.last("rating", ignorenulls=True).over(past)})
    changed = F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.col("old_status"))
    kind = (
        F.when(changed & (F.col("status") == "currently_reading"), "started_reading")
        .when(changed & (F.col("status") == "read"), "finished_reading")
        .when(F.col("rating").isNotNull() & ~F.col("rating").eqNullSafe(F.col("old_rating")), "rated_book")
    )
    finished = F.when(kind == "finished_reading", F.coalesce("finished_on", F.to_date("ts")))
    return rows.withColumns({"type": kind, "finished_on": finished}).where("type is not null").select("command_id", "ts", "user_id", "book_id", "type", "finished_on", F.when(F.col("type") == "rated_book", F.col("rating")).alias("rating"))


def corrected_finishes(finishes: DataFrame, corrections: DataFrame) -> DataFrame:
    """finishes (id, user_id, book_id, finished_on, created_at) after corrections (command_id, user_id, book_id, ts, finished_on).

    A correction rewrites the latest finish before it, by created_at and id, or where there is none a
    historical one, which the first such correction adds. Of corrections of one finish the last holds, by
    ts and command_id.
    """
    key = ["user_id", "book_id"]
    facts = finishes.select(*key, "id", F.lit(None).cast("date").alias("day"), F.col("created_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("command_id"))
    fixes = corrections.select(*key, F.lit(None).cast("string").alias("id"), F.col("finished_on").alias("day"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("command_id").cast("bigint").alias("command_id"))
    upto = Window.partitionBy(*key).orderBy("at", "kind", "id", "command_id").rowsBetween(Window.unboundedPreceding, 0)
    aimed = facts.unionByName(fixes).withColumn("target", F.last("id", ignorenulls=True).over(upto)).where("kind = 1")
    last = aimed.groupBy(*key, "target").agg(F.max_by("day", F.struct("at", "command_id")).alias("new_day"))
    own = last.select(*key, F.col("target").alias("id"), "new_day")
    kept = finishes.join(own, [*key, "id"], "left").select(*key, F.coalesce("new_day", "finished_on").alias("finished_on"), F.lit(False).alias("historical"))
    added = last.where("target is null").select(*key, F.col("new_day").alias("finished_on"), F.lit(True).alias("historical"))
    return kept.unionByName(added)


def like_state(commands: DataFrame, reviews: DataFrame) -> DataFrame:
    """commands (ts, command_id, user_id, review_id, liked) to likes per review and how many notify another owner."""
    last = commands.groupBy("user_id", "review_id").agg(F.max_by("liked", F.struct("ts", "command_id")).alias("liked")).where("liked")
    owned = last.join(reviews.select(F.col("id").alias("review_id"), F.col("user_id").alias("owner")), "review_id")
    return owned.groupBy("review_id").agg(F.count("*").alias("likes"), F.count_if(F.col("owner") != F.col("user_id")).alias("notified"))


#: What a step makes of a pair's states: 0 none, 1 and 2 pending, 3 and 4 friends, asked by a and by b. A step that isn't legal leaves a state as it is.
REQUEST_STATES = ("none", "pending", "pending", "accepted", "accepted")
REQUEST_STEPS = {
    "none": (0, 1, 2, 3, 4), "request_a": (1, 1, 2, 3, 4), "request_b": (2, 1, 2, 3, 4), "accept_a": (0, 1, 4, 3, 4), "accept_b": (0, 3, 2, 3, 4),
    "decline": (0, 0, 0, 3, 4), "remove": (0, 1, 2, 0, 0),
}


def request_state(commands: DataFrame) -> DataFrame:
    """commands (ts, command_id, actor, target, action) to each pair's state by legal steps only.

    request makes a pending pair of nothing, accept by the other side makes friends of it; decline takes back
    what is pending, remove ends a friendship. Any other step, or one of a reader with itself, changes nothing.
    Steps are dealt by range of pair and time, so that a long log is many runs; a run becomes a map from the
    state before it to the state after it, and a pair's few maps are applied in order.
    """
    table = lambda values: F.array(*map(F.lit, values))
    a, b, side = F.least("actor", "target"), F.greatest("actor", "target"), F.when(F.col("actor") == F.least("actor", "target"), "_a").otherwise("_b")
    name = F.when(~F.coalesce(a < b, F.lit(False)), "none").when(F.col("action").isin("request", "accept"), F.concat("action", side)).when(F.col("action").isin("decline", "remove"), F.col("action"))
    step = F.array_position(table(REQUEST_STEPS), F.coalesce(name, F.lit("none"))).cast("int")
    log = commands.select(a.alias("a"), b.alias("b"), "ts", "command_id", step.alias("step")).repartitionByRange("a", "b", "ts", "command_id")
    moves = F.array(*map(table, REQUEST_STEPS.values()))
    after = lambda states, move: F.transform(states, lambda s: F.get(move, s))
    start = table(REQUEST_STEPS["none"])
    runs = log.withColumn("run", F.spark_partition_id()).groupBy("a", "b", "run").agg(F.array_sort(F.collect_list(F.struct("ts", "command_id", "step"))).alias("steps"))
    runs = runs.select("a", "b", "run", F.aggregate("steps", start, lambda states, x: after(states, F.element_at(moves, x["step"]))).alias("move"))
    pairs = runs.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("run", "move"))).alias("runs"))
    pairs = pairs.select("a", "b", F.get(F.aggregate("runs", start, lambda states, x: after(states, x["move"])), F.lit(0)).alias("s"))
    asked = F.when(F.col("s").isin(1, 3), F.col("a")).when(F.col("s").isin(2, 4), F.col("b"))
    return pairs.select("a", "b", F.get(table(REQUEST_STATES), F.col("s")).alias("state"), asked.alias("requested_by"))


#: What each command of a pair came to.
ANSWERED = "command_id long, ts timestamp, a long, b long, outcome string, state string, requested_by long, note string"


def request_step(state: tuple | None, c: dict) -> tuple[tuple | None, tuple]:
    """The rules of request_state for one command of a pair (a, b): its state after it (None: nothing) and its ANSWERED row.

    note says what becomes of the request's notification: made by a request, gone once it is accepted or taken back.
    """
    now, by = state or ("none", None)
    actor, action, outcome, note = c["actor"], c["action"], None, None
    if actor == c["target"]:
        outcome = "cannot_friend_self"
    elif action == "request":
        outcome = {"accepted": "already_friends", "pending": "request_pending"}.get(now)
        if outcome is None:
            now, by, note = "pending", actor, "made"
    elif action == "accept":
        outcome = {"none": "request_not_found", "accepted": "invalid_request_status"}.get(now) or ("forbidden" if actor == by else None)
        if outcome is None:
            now, note = "accepted", "gone"
    elif action == "decline":
        outcome = {"none": "request_not_found", "accepted": "invalid_request_status"}.get(now)
        if outcome is None:
            now, by, note = "none", None, "gone"
    elif action == "remove":
        outcome = {"none": "friendship_not_found", "pending": "invalid_friendship_status"}.get(now)
        if outcome is None:
            now, by = "none", None
    else:
        outcome = "unknown_command"
    return (None if now == "none" else (now, by)), (c["command_id"], c["ts"], c["a"], c["b"], outcome, now, by, note)


def request_notifications(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, state, requested_by) to the notifications that stand: those of pending requests, to whom was asked."""
    other = F.when(F.col("requested_by") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return pairs.where("state = 'pending'").select(other.alias("recipient_id"), F.col("requested_by").alias("actor_id"))


#: Parts that one recipient's notifications are dealt into.
READ_PARTS = 16


def first_reads(notifications: DataFrame, commands: DataFrame, parts: int = READ_PARTS) -> DataFrame:
    """notifications (id, recipient_id, created_at, read_at) with the time at which each was first read, or null.

    commands (ts, user_id, notification_id): one notification of the user's own, or with a null id all that
    the user has by then. A command at the time of a notification comes after it; who has read stays read.
    The first mark-all after a notification is found by one ordered pass over both; a recipient's
    notifications are dealt into parts, each of which gets all of the recipient's (far fewer) mark-alls.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    notes = notifications.select("id", "recipient_id", F.col("created_at").alias("at"), "read_at", F.lit(0).alias("mark"), part.alias("part"))
    marks = commands.where("notification_id is null").select(F.col("user_id").alias("recipient_id"), F.col("ts").alias("at")).distinct()
    marks = marks.withColumns({"id": F.lit(None).cast(notifications.schema["id"].dataType), "read_at": F.lit(None).cast("timestamp"), "mark": F.lit(1), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    later = Window.partitionBy("recipient_id", "part").orderBy(F.desc("at"), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    next_all = F.last(F.when(F.col("mark") == 1, F.col("at")), ignorenulls=True).over(later)
    found = notes.unionByName(marks).withColumn("by_all", next_all).where("mark = 0")
    single = commands.where("notification_id is not null").groupBy(F.col("notification_id").alias("id"), F.col("user_id").alias("recipient_id"))
    single = single.agg(F.min("ts").alias("by_one"))
    out = found.join(single, ["id", "recipient_id"], "left")
    return out.select("id", "recipient_id", F.coalesce("read_at", F.least("by_all", "by_one")).alias("read_at"))


def backfilled(activities: DataFrame, zone: str) -> DataFrame:
    """Finish days from the UTC day of creation where they are missing or were the day in another zone."""
    other = F.to_date(F.from_utc_timestamp("created_at", zone))
    fix = (F.col("type") == "finished_reading") & (F.col("finished_on").isNull() | (F.col("finished_on") == other))
    return activities.withColumn("finished_on", F.when(fix, F.to_date("created_at")).otherwise(F.col("finished_on")))


RATED = "book_id long, user_id long, rating int, ts timestamp, command_id long"
CACHE = "book_id long, rating_sum long, ratings_count long"


def running_ratings(changes: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> tuple[StreamingQuery, KeyedTable]:
    """A stream of rating changes (command_id, ts, user_id, book_id, rating; null: cleared) to each book's running sum and count.

    The last rating of every reader and book is kept in a keyed table, so that a changed or cleared rating
    becomes a difference to the book's sum and count, and a change older than the one kept becomes none.
    Both tables rewrite only the buckets of a batch; a batch that runs again gives the same versions.
    """
    spark = changes.sparkSession
    rated = KeyedTable(spark, f"{path}/rated", RATED, ["book_id", "user_id"], buckets)
    cache = KeyedTable(spark, f"{path}/cache", CACHE, ["book_id"], buckets)
    at = F.struct("ts", "command_id")

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("book_id", "user_id").agg(F.max_by(F.struct("rating", "ts", "command_id"), at).alias("r")).select("book_id", "user_id", "r.*")

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("book_id").agg(F.sum("rating_sum").alias("rating_sum"), F.sum("ratings_count").alias("ratings_count"))

    def fold(batch: DataFrame, number: int) -> None:
        before = rated.last_version(number)
        if number and before is None:
            raise ValueError(f"{path} has no version before batch {number}")
        rated.upsert(batch.select(*rated.columns), lambda old, new: newest(old.unionByName(new)), number)
        # what the touched readers' ratings were and are
        gone = batch.select("book_id", "user_id").distinct()
        only = rated.touched(gone)
        sides = [(rated.read(number, only), 1)] + ([(rated.read(before, only), -1)] if before is not None else [])
        parts = [t.join(gone, ["book_id", "user_id"], "left_semi").select("book_id", (F.coalesce("rating", F.lit(0)) * sign).cast("long").alias("rating_sum"), (F.col("rating").isNotNull().cast("long") * sign).alias("ratings_count")) for t, sign in sides]
        moved = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        cache.upsert(moved.groupBy("book_id").agg(F.sum("rating_sum").alias("rating_sum"), F.sum("ratings_count").alias("ratings_count")), add, number)

    query = changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, cache


def cached_ratings(cache: DataFrame) -> DataFrame:
    """book_id, average_rating (null without ratings), ratings_count of a running sum and count."""
    return cache.select("book_id", F.when(F.col("ratings_count") > 0, F.col("rating_sum") / F.col("ratings_count")).alias("average_rating"), "ratings_count")


def monthly_finishes(finishes: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of finishes (user_id, book_id, ts) to different books per reader and month, late events up to `late`.

    A month's state goes when a month starts that is 31 days and `late` after its own start, so that
    a book counts once however far apart its finishes in the month are.
    """
    months = finishes.select("user_id", "book_id", F.date_trunc("month", "ts").alias("starts"))
    once = months.withWatermark("starts", f"31 days {late}").dropDuplicates(["user_id", "book_id", "starts"])
    return once.groupBy("starts", "user_id").agg(F.count("*").alias("books")).select("user_id", F.date_format("starts", "yyyy-MM").alias("month"), "books")


def live_feed(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """A stream of activities joined with the accepted friendships of both directions (reader, friend, since)."""
    return activities.join(edges, (activities["user_id"] == edges["friend"]) & (activities["created_at"] >= edges["since"]))


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str | list[str], buckets: int = 64) -> tuple[StreamingQuery, KeyedTable]:
    """Write every batch's rows over those of the same key in a keyed table; returns the running query and the table.

    A batch rewrites the buckets of its own keys. It starts from the last version before it, so that a batch
    that is run again gives the same version; if there is none although there were batches before, it fails
    rather than begin anew.
    """
    keys = [key] if isinstance(key, str) else key
    table = KeyedTable(stream.sparkSession, path, stream.schema, keys, buckets)

    def merge(batch: DataFrame, number: int) -> None:
        if number and table.last_version(number) is None:
            raise ValueError(f"{path} has no version before batch {number}")
        table.upsert(batch, lambda old, new: old.join(new, keys, "left_anti").unionByName(new), number)

    query = stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, table
