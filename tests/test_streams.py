"""The reader log, running ratings, read marks and keyed tables against plain folds."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from shelfloom.sources.keyed import KeyedTable
from shelfloom.streaming import commands as cmd
from shelfloom.streaming import shelves

START = datetime.datetime(2024, 3, 1)


def random_log(n: int, seed: int) -> list[tuple]:
    """Commands of few readers and books, with equal times, cleared ratings, misplaced finish days, unknown kinds and reviews without a rating."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choice(["shelf"] * 5 + ["remove", "review", "review", "unreview", "dance", None])
        status = rng.choice([None, None, "read", "currently_reading", "want_to_read"]) if kind == "shelf" else None
        rating = rng.choice([None, 1, 2, 3]) if kind in ("shelf", "review") else None
        clears = rating is None and kind == "shelf" and rng.random() < 0.3
        day = datetime.date(2024, 2, rng.randint(1, 28)) if kind == "shelf" and rng.random() < 0.3 else None
        text = rng.choice([None, f"t{k}"]) if kind == "review" else None
        rows.append((k, START + datetime.timedelta(hours=rng.randint(0, 200)), rng.randint(0, 3), rng.randint(0, 2), kind, status, rating, clears, day, text))
    return rows


def folded(rows: list[tuple]) -> tuple[list[tuple], dict]:
    names = [c.split(" ")[0] for c in shelves.LOG.split(", ")]
    states: dict = {}
    out = []
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        c = dict(zip(names, row, strict=True))
        key = (c["user_id"], c["book_id"])
        states[key], decided = shelves.step(states.get(key), c)
        out.append(decided)
    return out, states


def test_batch_fold_equals_one_command_at_a_time(spark):
    rows = random_log(3000, 2)
    decided = shelves.decide(spark.createDataFrame(rows, shelves.LOG))
    names = [c.split(" ")[0] for c in shelves.DECIDED.split(", ")]
    want, states = folded(rows)
    assert sorted(map(tuple, decided.select(names).collect())) == sorted(want)
    assert {r[4] for r in want} == {None, "review_requires_rating", "invalid_shelf_status", "missing_rating", "shelf_not_found", "review_not_found", "unknown_command"}
    shelf = {(r["user_id"], r["book_id"]): (r["status"], r["rating"]) for r in shelves.shelf_rows(decided).collect()}
    assert shelf == {k: s[:2] for k, s in states.items() if s}


def test_reviews_keep_their_text_and_reviewed_books_stay(spark):
    at = lambda n: START + datetime.timedelta(hours=n)
    rows = [
        (1, at(1), 1, 1, "review", None, 4, False, None, "good book"), (2, at(2), 1, 1, "review", None, 5, False, None, None),  # keeps the text
        (3, at(3), 1, 1, "remove", None, None, False, None, None),  # reviewed, so it stays without status
        (4, at(4), 1, 1, "shelf", None, 2, False, None, None),  # is the review's rating too
        (5, at(1), 1, 2, "review", None, 3, False, None, "first"), (6, at(2), 1, 2, "unreview", None, None, False, None, None), (7, at(3), 1, 2, "review", None, 1, False, None, None),  # a new review
        (8, at(1), 2, 1, "shelf", "read", None, False, None, None), (9, at(2), 2, 1, "remove", None, None, False, None, None),  # neither rated nor reviewed: gone
    ]
    decided = shelves.decide(spark.createDataFrame(rows, shelves.LOG))
    reviews = {(r["user_id"], r["book_id"]): (r["rating"], r["text"], r["created_at"]) for r in shelves.review_rows(decided).collect()}
    assert reviews == {(1, 1): (2, "good book", at(1)), (1, 2): (1, None, at(3))}
    shelf = {(r["user_id"], r["book_id"]): (r["status"], r["rating"]) for r in shelves.shelf_rows(decided).collect()}
    assert shelf == {(1, 1): (None, 2), (1, 2): (None, 1)}
    made = [(r["command_id"], r["type"], r["snapshot"]) for r in shelves.activities(decided).orderBy("command_id").collect()]
    assert made == [(1, "reviewed_book", "good book"), (4, "rated_book", None), (5, "reviewed_book", "first"), (7, "reviewed_book", None), (8, "finished_reading", None)]
    changes = [(r["command_id"], r["rating"]) for r in shelves.rating_changes(decided).orderBy("command_id").collect()]
    assert changes == [(1, 4), (2, 5), (4, 2), (5, 3), (7, 1)]


def test_running_ratings_equal_the_last_ratings(spark, tmp_path):
    """Ratings change and are cleared over several batches, some arrive late; a batch that is folded twice changes nothing."""
    rng = random.Random(7)
    rows = [(rng.randint(0, 5), rng.randint(0, 8), rng.choice([None, 1, 2, 3, 4, 5]), START + datetime.timedelta(hours=k // 3), k) for k in range(400)]
    arrive = sorted(rows, key=lambda r: r[4] + rng.randint(0, 60))
    source, path, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    for k in range(3):
        spark.createDataFrame(arrive[k * 134 : (k + 1) * 134], cmd.RATED).coalesce(1).write.mode("append").parquet(source)
        running, cache = cmd.running_ratings(spark.readStream.schema(cmd.RATED).parquet(source), path, state, buckets=4)
        running.awaitTermination()
        seen = arrive[: (k + 1) * 134]
        last = {(r[0], r[1]): r[2] for r in sorted(seen, key=lambda r: (r[3], r[4]))}
        want = {}
        for book in {b for b, _ in last}:
            values = [v for (b, _), v in last.items() if b == book and v is not None]
            want[book] = (sum(values) / len(values) if values else None, len(values))
        assert {r["book_id"]: (r["average_rating"], r["ratings_count"]) for r in cmd.cached_ratings(cache.read()).collect()} == want
    # the last batch again, as after a lost driver: it starts from the versions before it
    shown = sorted(map(tuple, cache.read().collect()))
    rated = KeyedTable(spark, f"{path}/rated", cmd.RATED, ["book_id", "user_id"], 4)
    newest = lambda old, new: old.unionByName(new).groupBy("book_id", "user_id").agg(F.max_by(F.struct("rating", "ts", "command_id"), F.struct("ts", "command_id")).alias("r")).select("book_id", "user_id", "r.*")
    before = sorted(map(tuple, rated.read().collect()))
    rated.upsert(spark.createDataFrame(arrive[268:402], cmd.RATED), newest, rated.last_version())
    assert sorted(map(tuple, rated.read().collect())) == before and sorted(map(tuple, cache.read().collect())) == shown


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=16)
    assert table.read().collect() == [] and table.last_version() is None
    over = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)
    table.upsert(spark.createDataFrame([(k, "a") for k in range(200)], table.schema), over)
    first = table.folders(0)
    table.upsert(spark.createDataFrame([(3, "b"), (500, "b")], table.schema), over)
    second = table.folders(1)
    touched = table.touched(spark.createDataFrame([(3,), (500,)], "k long"))
    assert {b for b in second if second[b] != first.get(b)} == touched and len(touched) < len(second)
    assert {r["k"]: r["v"] for r in table.read().collect()} == {k: "a" for k in range(200)} | {3: "b", 500: "b"}
    assert {r["k"]: r["v"] for r in table.read(0).collect()} == {k: "a" for k in range(200)}
    # a version that is written again starts from the one before it; old versions and what only they name go
    table.upsert(spark.createDataFrame([(3, "c")], table.schema), over, 1)
    assert {r["k"]: r["v"] for r in table.read().where("k in (3, 500)").collect()} == {3: "c"}
    for v in range(2, 5):
        table.upsert(spark.createDataFrame([(k, "z") for k in range(200)], table.schema), over, v)
    assert not (tmp_path / "t" / "manifests" / "version=1").exists() and table.read(3).count() == 200
    assert len(list((tmp_path / "t" / "data").glob("*/*/*.parquet"))) == 2 * len(table.folders(4))
    # a bucket can become empty
    table.upsert(spark.createDataFrame([(k, "z") for k in range(200)], table.schema), lambda old, new: old.limit(0))
    assert table.read().count() == 0


def test_first_reads(spark):
    """Marking all reaches what was there by then, also at the same time; one's own mark counts, another's doesn't; read stays read."""
    at = lambda n: START + datetime.timedelta(hours=n)
    notes = [(1, 7, at(1), None), (2, 7, at(5), None), (3, 7, at(9), None), (4, 7, at(2), at(3)), (5, 8, at(1), None), (6, 8, at(4), None)]
    marks = [(at(5), 7, None), (at(7), 7, None), (at(2), 7, 1), (at(3), 7, 1), (at(10), 8, 3), (at(1), 8, 6), (at(3), 8, None)]
    got = cmd.first_reads(spark.createDataFrame(notes, "id long, recipient_id long, created_at timestamp, read_at timestamp"), spark.createDataFrame(marks, "ts timestamp, user_id long, notification_id long"))
    assert {r["id"]: r["read_at"] for r in got.collect()} == {1: at(2), 2: at(5), 3: None, 4: at(3), 5: at(3), 6: at(1)}


def test_requests_one_at_a_time_equal_the_maps(spark):
    rng = random.Random(4)
    log = [(k, START + datetime.timedelta(seconds=rng.randint(0, 90)), rng.randint(0, 4), rng.randint(0, 4), rng.choice(["request", "accept", "decline", "remove", "wave"])) for k in range(600)]
    states: dict = {}
    for command_id, ts, actor, target, action in sorted(log, key=lambda r: (r[1], r[0])):
        pair = (min(actor, target), max(actor, target))
        event = {"command_id": command_id, "ts": ts, "actor": actor, "target": target, "action": action, "a": pair[0], "b": pair[1]}
        states[pair], _ = cmd.request_step(states.get(pair), event)
    pairs = cmd.request_state(spark.createDataFrame(log, "command_id long, ts timestamp, actor long, target long, action string"))
    assert {(r["a"], r["b"]): (r["state"], r["requested_by"]) for r in pairs.collect()} == {p: s or ("none", None) for p, s in states.items()}
    pending = {(b if by == a else a, by) for (a, b), s in states.items() if s and s[0] == "pending" for by in [s[1]]}
    assert {tuple(r) for r in cmd.request_notifications(pairs).collect()} == pending


class Held:
    """A group's state between batches."""

    def __init__(self):
        self.get, self.at, self.watermark, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.get is not None)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get = value

    def remove(self):
        self.get = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.at = at


def test_keys_of_a_group_are_folded_together():
    """One call folds all keys of a group in the order of time, holds back what may still be preceded, and leaves nothing behind."""
    import pandas as pd
    from pyspark.sql import types as T

    from shelfloom.streaming import ordered

    events = T.StructType.fromDDL("command_id long, ts timestamp, k long, ends boolean")
    step = lambda n, e: (None if e["ends"] else (n or 0) + 1, (e["k"], e["command_id"], n or 0))
    run, held = ordered._fold(step, ["k"], events, ["k", "command_id", "n"]), Held()
    frame = lambda *rows: pd.DataFrame([(c, pd.Timestamp(f"1970-01-01 00:00:0{s}"), k, e) for c, s, k, e in rows], columns=events.fieldNames())
    call = lambda *frames: [tuple(r) for out in run((0,), iter(frames), held) for r in out.itertuples(index=False)]
    assert call(frame((5, 3, 1, True), (2, 2, 1, False)), frame((1, 2, 1, False), (4, 2, 2, False))) == [] and held.at == 2000
    held.watermark = 2000
    assert call(frame((9, 4, 2, True))) == [(1, 1, 0), (1, 2, 1), (2, 4, 0)] and held.at == 3000
    held.watermark, held.hasTimedOut = 9000, True
    assert call() == [(1, 5, 2), (2, 9, 1)] and not held.exists
