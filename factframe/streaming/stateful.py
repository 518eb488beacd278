"""Answers about each key kept up to date as rows arrive in any order.

The state of a key is a fold over its rows in event time. Rows that the
watermark has not passed wait in a list; when it passes them, a timer folds them
into one value and the list forgets them. Keys are dealt into groups that share a
list and a timer, as a call of the state costs much more than a row. Each batch
gives the present answer of the keys that it touched, with the number of rows
seen as its version, and these replace the keys' rows in a table; other keys'
files stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factframe.operators.keyed import KeyedTable
from factframe.streaming.ledger import read_events

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONG = ("n", "transitions", "rises", "falls", "streak", "longest")
#: Rows in one entry of a state's list.
CHUNK = 1_000
ANSWER = T.StructType([T.StructField("user_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in _LONG)])


def folded(state: tuple | None, rows: list[tuple]) -> tuple | None:
    """The state after rows (ts, event_id, type, value) in that order: last type, last value, direction, n, transitions, rises, falls, streak, longest.

    A streak is a number of steps in a row in one direction; a step to an equal
    or missing value, or from one, ends it.
    """
    for _, _, kind, value in sorted(rows, key=lambda r: r[:2]):
        if state is None:
            state = (kind, value, 0, 1, 0, 0, 0, 0, 0)
            continue
        before, last, way, n, transitions, rises, falls, streak, longest = state
        step = 0 if value is None or last is None else (value > last) - (value < last)
        streak = 0 if step == 0 else streak + 1 if step == way else 1
        state = (kind, value, step, n + 1, transitions + (kind != before), rises + (step > 0), falls + (step < 0), streak, max(longest, streak))
    return state


def by_user(rows: list[tuple]) -> dict[int, list[tuple]]:
    """Rows (user, ts, event_id, type, value) as rows for folded(), by user."""
    mine: dict[int, list[tuple]] = {}
    for user, *row in rows:
        mine.setdefault(user, []).append(tuple(row))
    return mine


def chunks(rows: list[tuple]) -> list[tuple]:
    """Rows as columns of CHUNK rows each: a list of the state costs by its entries."""
    return [tuple([*column] for column in zip(*rows[i : i + CHUNK], strict=True)) for i in range(0, len(rows), CHUNK)]


class Streaks(StatefulProcessor):
    """Transitions between types and streaks of values by user; a key of the state is a group of users."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        user = T.StructType([T.StructField("user_id", T.LongType())])
        self.done = handle.getMapState("done", user, T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("way", T.LongType()), *(T.StructField(c, T.LongType()) for c in _LONG)]))
        columns = {"user_id": T.LongType(), "us": T.LongType(), "event_id": T.LongType(), "kind": T.StringType(), "value": T.DoubleType()}
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(c, T.ArrayType(kind)) for c, kind in columns.items()]))

    def _states(self) -> dict[int, tuple]:
        return {user[0]: tuple(state) for user, state in self.done.iterator()} if self.done.exists() else {}

    def _rows(self) -> list[tuple]:
        return [row for chunk in self.waiting.get() for row in zip(*chunk, strict=True)] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._rows()
        known = {(r[0], r[2]) for r in held}
        new = {}
        for part in rows:
            for user, us, event_id, kind, value in zip(*(part[c].tolist() for c in ("user_id", "us", "event_id", "event_type", "value")), strict=True):
                user = None if pd.isna(user) else int(user)
                if (user, event_id) not in known:
                    new[user, event_id] = (user, int(us), int(event_id), kind, None if pd.isna(value) else float(value))
        if new:
            self.waiting.appendList(chunks([*new.values()]))
            self.handle.registerTimer(min(r[1] for r in new.values()) // 1000)
        touched, states = by_user([*new.values()]), self._states()
        waited = by_user([r for r in held if r[0] in touched])
        answers = [(user, *folded(states.get(user), waited.get(user, []) + mine)[3:]) for user, mine in touched.items()]
        if answers:
            yield pd.DataFrame(answers, columns=ANSWER.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = self._rows()
        old, young = [r for r in held if r[1] // 1000 <= passed], [r for r in held if r[1] // 1000 > passed]
        if old:
            states = self._states()
            for user, mine in by_user(old).items():
                self.done.updateValue((user,), folded(states.get(user), mine))
            self.waiting.clear()
            if young:
                self.waiting.put(chunks(young))
                self.handle.registerTimer(min(r[1] for r in young) // 1000)
        yield pd.DataFrame(columns=ANSWER.names).astype({c: "int64" for c in ANSWER.names})

    def close(self) -> None:
        pass


def streaks(events: DataFrame, late: str, groups: int) -> DataFrame:
    """The present answer of every user that a batch touches; rows may come as late as `late`."""
    group = F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("_group")
    rows = events.withWatermark("ts", late).select("ts", group, "user_id", F.unix_micros("ts").alias("us"), "event_id", "event_type", "value")
    return rows.groupBy("_group").transformWithStateInPandas(statefulProcessor=Streaks(), outputStructType=ANSWER, outputMode="Update", timeMode="EventTime")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that a stream is started under, by the last part of their names; the session has its own again afterwards."""
    names = {"providerClass": "spark.sql.streaming.stateStore.providerClass", "partitions": "spark.sql.shuffle.partitions"}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def keep_streaks(source: str, table: KeyedTable, checkpoint: str, late: str, files_a_batch: int = 1, partitions: int = 200, groups: int = 800) -> list[int]:
    """Read what is in the folder `source`, some files a batch, and keep the answers in `table`; returns the buckets written by each batch.

    `partitions` is how many parts the state has, `groups` how many groups users are
    dealt into, both as long as the checkpoint lives.
    """
    spark, written = table.spark, []
    with settings(spark, providerClass=_PROVIDER, partitions=str(partitions)):
        answers = streaks(read_events(spark, source, files_a_batch), late, groups)
        query = answers.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.foreachBatch(lambda batch, number: written.append(table.replace(batch))).start().awaitTermination()
    return written


def attributed(left: DataFrame, right: DataFrame, late: str, within: str) -> DataFrame:
    """Pairs of a left and a right event of one user, the left one at most `within` earlier; both sides are kept until the watermark shows that no partner can come."""
    a = left.withWatermark("ts", late).select(F.col("user_id"), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("_user"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    near = (F.col("user_id") == F.col("_user")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select("user_id", "left_id", "right_id", "left_ts", "right_ts")
