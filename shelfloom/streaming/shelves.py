"""One log of all that a reader does to a book: shelf, removal, review and its removal, folded together.

Fields that a command leaves out keep their value, and commands reach over: a review rates the book on the
shelf, a rating on the shelf is the review's rating, a rating can't be cleared while a review stands, and a
removed book stays, without status, while it is rated or reviewed. The batch fold is windows of one
partitioning; `step` is the same rule for one command, for streams.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["user_id", "book_id"]
#: command_id, ts, reader and book; kind: shelf, remove, review or unreview; fields left null keep their value, clears_rating takes the rating away.
LOG = "command_id long, ts timestamp, user_id long, book_id long, kind string, status string, rating int, clears_rating boolean, finished_on date, text string"
#: What each command came to: outcome (null if accepted, else why not), the activity that it makes, and the shelf after it.
DECIDED = "command_id long, ts timestamp, user_id long, book_id long, outcome string, type string, finished_on date, activity_rating int, snapshot string, status string, rating int, on_shelf boolean, reviewed boolean"


def decide(log: DataFrame) -> DataFrame:
    """LOG to DECIDED and, for the review itself, `kind`, `text` and `era` (how many reviews were taken back before).

    Commands of one reader and book count by ts and command_id. A review without a rating is refused.
    """
    at = Window.partitionBy(*KEYS).orderBy("ts", "command_id")
    past = at.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column: F.last(column, ignorenulls=True).over(past)
    boxed = lambda column: F.struct(column.alias("value"))  # noqa: E731  a struct, so that a null can be the last value too
    kind, status, rating = F.col("kind"), F.col("status"), F.col("rating")
    shelf, review = kind == "shelf", (kind == "review") & rating.isNotNull()
    clears, day = F.coalesce("clears_rating", F.lit(False)) & rating.isNull(), F.col("finished_on").isNotNull()

    rows = log.withColumn("had_review", F.coalesce(before(F.when(review, True).when(kind == "unreview", False)), F.lit(False)))
    keeps_rating = shelf & clears & F.col("had_review")
    set_status = F.when(kind == "remove", boxed(F.lit(None).cast("string"))).when(shelf & status.isNotNull() & ~keeps_rating & ~(day & (status != "read")), boxed(status))
    rows = rows.withColumns({"set_status": set_status, "old_status": before(set_status)["value"]})
    now = F.coalesce(status, F.col("old_status"))
    misplaced = shelf & day & ~F.coalesce(now == "read", F.lit(False))
    fine = shelf & ~keeps_rating & ~misplaced
    set_rating = F.when(review | (fine & rating.isNotNull()), boxed(rating)).when(fine & clears, boxed(F.lit(None).cast("int")))
    rows = rows.withColumns({"fine": fine, "misplaced": misplaced, "keeps_rating": keeps_rating, "set_rating": set_rating, "old_rating": before(set_rating)["value"]})
    stays = F.when(review | F.col("fine"), True).when(kind == "remove", F.col("old_rating").isNotNull() | F.col("had_review"))
    rows = rows.withColumns({"stays": stays, "existed": F.coalesce(before(stays), F.lit(False)), "era": F.coalesce(F.sum(F.when((kind == "unreview") & F.col("had_review"), 1)).over(past), F.lit(0))})

    outcome = (
        F.when(F.col("keeps_rating"), "review_requires_rating").when(F.col("misplaced"), "invalid_shelf_status").when((kind == "review") & ~review, "missing_rating")
        .when((kind == "remove") & ~F.col("existed"), "shelf_not_found").when((kind == "unreview") & ~F.col("had_review"), "review_not_found").when(~F.coalesce(kind, F.lit("")).isin("shelf", "remove", "review", "unreview"), "unknown_command")
    )
    moved = F.col("fine") & status.isNotNull() & ~status.eqNullSafe(F.col("old_status"))
    made = (
        F.when(moved & (status == "currently_reading"), "started_reading").when(moved & (status == "read"), "finished_reading")
        .when(F.col("fine") & rating.isNotNull() & ~rating.eqNullSafe(F.col("old_rating")), "rated_book").when(review & ~F.col("had_review"), "reviewed_book")
    )
    after = lambda new, old: F.when(F.col(new).isNotNull(), F.col(new)["value"]).otherwise(F.col(old))
    return rows.select(
        "command_id", "ts", *KEYS, outcome.alias("outcome"), made.alias("type"),
        F.when(made == "finished_reading", F.coalesce("finished_on", F.to_date("ts"))).alias("finished_on"),
        F.when(made.isin("rated_book", "reviewed_book"), rating).alias("activity_rating"), F.when(made == "reviewed_book", F.col("text")).alias("snapshot"),
        after("set_status", "old_status").alias("status"), after("set_rating", "old_rating").alias("rating"),
        F.coalesce("stays", "existed").alias("on_shelf"), F.when(review, True).when(kind == "unreview", False).otherwise(F.col("had_review")).alias("reviewed"),
        F.when(outcome.isNull(), kind).alias("kind"), "text", "era", "old_rating",
    )


def activities(decided: DataFrame) -> DataFrame:
    """The activities that commands made."""
    return decided.where("type is not null").select("command_id", "ts", *KEYS, "type", "finished_on", F.col("activity_rating").alias("rating"), "snapshot")


def shelf_rows(decided: DataFrame) -> DataFrame:
    """The shelf after all commands: user_id, book_id, status, rating."""
    last = decided.groupBy(*KEYS).agg(F.max_by(F.struct("status", "rating", "on_shelf"), F.struct("ts", "command_id")).alias("s"))
    return last.where("s.on_shelf").select(*KEYS, "s.status", "s.rating")


def review_rows(decided: DataFrame) -> DataFrame:
    """The reviews after all commands: user_id, book_id, rating, text (the last that was given), created_at."""
    at = F.struct("ts", "command_id")
    last = decided.groupBy(*KEYS).agg(F.max_by(F.struct("rating", "reviewed"), at).alias("s")).where("s.reviewed").select(*KEYS, F.col("s.rating").alias("rating"))
    eras = decided.where("kind = 'review'").groupBy(*KEYS, "era").agg(F.max_by("text", F.when(F.col("text").isNotNull(), at)).alias("text"), F.min("ts").alias("created_at"))
    newest = eras.groupBy(*KEYS).agg(F.max_by(F.struct("text", "created_at"), "era").alias("r"))
    return last.join(newest, KEYS).select(*KEYS, "rating", "r.text", "r.created_at")


def rating_changes(decided: DataFrame) -> DataFrame:
    """Commands that changed a rating, with the rating after them (null: none any more)."""
    return decided.where("outcome is null and not (rating <=> old_rating)").select("command_id", "ts", *KEYS, "rating")


def step(state: tuple | None, c: dict) -> tuple[tuple | None, tuple]:
    """The rules of `decide` for one command: the state after it (status, rating, on shelf, reviewed; None once nothing is left) and its DECIDED row."""
    status, rating, on_shelf, reviewed = state or (None, None, False, False)
    outcome = made = day = snapshot = None
    clears = bool(c["clears_rating"]) and c["rating"] is None
    if c["kind"] == "shelf":
        now = c["status"] if c["status"] is not None else status
        if clears and reviewed:
            outcome = "review_requires_rating"
        elif c["finished_on"] is not None and now != "read":
            outcome = "invalid_shelf_status"
        else:
            moved = c["status"] is not None and c["status"] != status
            if moved and now == "currently_reading":
                made = "started_reading"
            elif moved and now == "read":
                made, day = "finished_reading", c["finished_on"] or c["ts"].date()
            elif c["rating"] is not None and c["rating"] != rating:
                made = "rated_book"
            status, on_shelf = now, True
            rating = None if clears else c["rating"] if c["rating"] is not None else rating
    elif c["kind"] == "remove":
        outcome = None if on_shelf else "shelf_not_found"
        status, on_shelf = None, rating is not None or reviewed
    elif c["kind"] == "review":
        if c["rating"] is None:
            outcome = "missing_rating"
        else:
            if not reviewed:
                made, snapshot = "reviewed_book", c["text"]
            rating, on_shelf, reviewed = c["rating"], True, True
    elif c["kind"] == "unreview":
        outcome = None if reviewed else "review_not_found"
        reviewed = False
    else:
        outcome = "unknown_command"
    rated = c["rating"] if made in ("rated_book", "reviewed_book") else None
    row = (c["command_id"], c["ts"], c["user_id"], c["book_id"], outcome, made, day if day is None or type(day) is datetime.date else day.date(), rated, snapshot, status, rating, on_shelf, reviewed)
    return ((status, rating, on_shelf, reviewed) if on_shelf else None), row

