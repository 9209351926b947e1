"""A fold of each key's events in the order of their time, on Structured Streaming."""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Takes a key's state (None at first) and an event; gives the new state (None: nothing to remember) and the row that the event leads to.
Step = Callable[[tuple | None, dict], tuple[tuple | None, tuple]]
#: A store that keeps state on disk, not on the heap.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Groups of keys whose state is kept together: a call for each key costs far more than to write the few bytes of those that rest.
GROUPS = 1024
_EPOCH = datetime.datetime(1970, 1, 1)


def _micros(moment: datetime.datetime | pd.Timestamp) -> int:
    return (pd.Timestamp(moment).tz_localize(None) - _EPOCH) // datetime.timedelta(microseconds=1)


def _plain(column: pd.Series, kind: T.DataType) -> list:
    """A column's values as the state store takes them: whole numbers that pandas made doubles for their nulls are whole again."""
    if isinstance(kind, T.IntegralType):
        return [None if pd.isna(x) else int(x) for x in column]
    if isinstance(kind, T.TimestampType):
        return [None if pd.isna(x) else x.to_pydatetime() for x in column]
    return [None if pd.isna(x) else x for x in column]


def _fold(step: Step, keys: list[str], events: T.StructType, output: list[str]) -> Callable:
    """Holds the events of a group of keys back until the watermark has passed them, then folds each key's by ts and command_id.

    What is held is a dict from key to its state and a list of the events to come; a key whose state is None
    isn't among the former. Events later than the watermark are dropped by Spark before they come here.
    """
    names = events.fieldNames()
    at, number = names.index("ts"), names.index("command_id")
    places = [names.index(k) for k in keys]

    def run(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states, waiting = pickle.loads(held.get[0]) if held.exists else ({}, [])
        if not held.hasTimedOut:
            for frame in frames:
                waiting += zip(*(_plain(frame[f.name], f.dataType) for f in events.fields), strict=True)
        watermark = held.getCurrentWatermarkMs()
        passed = _EPOCH + datetime.timedelta(milliseconds=watermark)
        later, due = [e for e in waiting if e[at] > passed], sorted((e for e in waiting if e[at] <= passed), key=lambda e: (e[at], e[number]))
        out = []
        for event in due:
            key = tuple(event[k] for k in places)
            state, row = step(states.get(key), dict(zip(names, event, strict=True)))
            out.append(row)
            if state is not None:
                states[key] = state
            else:
                states.pop(key, None)
        if states or later:
            held.update((pickle.dumps((states, later)),))
            if later:
                held.setTimeoutTimestamp(max(-(-_micros(min(e[at] for e in later)) // 1000), watermark + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=output, dtype=object)

    return run


def fold_in_order(events: DataFrame, keys: list[str], step: Step, output: str, late: str = "1 day") -> DataFrame:
    """A stream of events (ts, command_id, keys and what `step` reads) to one row per event, in a key's order of time.

    `output` is a schema. An event comes out once the watermark, `late` behind the newest event, has passed it;
    start the stream in append mode. Events with a null among their keys or without ts take no part.
    """
    parsed = T.StructType.fromDDL(output)
    kept = events.where(" and ".join(f"{k} is not null" for k in [*keys, "ts"])).withWatermark("ts", late)
    grouped = kept.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(GROUPS))).groupBy("_group")
    return grouped.applyInPandasWithState(_fold(step, keys, events.schema, parsed.fieldNames()), parsed, T.StructType.fromDDL("held binary"), "append", GroupStateTimeout.EventTimeTimeout)
