"""Answers of a stream do not depend on the order in which rows arrive."""

import random

import pytest
from pyspark.sql import functions as F

from factframe.operators.keyed import KeyedTable
from factframe.plans.streams import attributed
from factframe.streaming import stateful
from factframe.streaming.ledger import EVENTS, read_events


def answers(rows):
    by_user = {}
    for event_id, ts, user, kind, value, _ in rows:
        by_user.setdefault(user, []).append((ts, event_id, kind, value))
    return sorted((u, *stateful.folded(None, mine)[3:]) for u, mine in by_user.items())


def plain_fold(rows):
    """n, transitions, rises, falls, streak, longest of one user's rows in order."""
    steps = [(b > a) - (b < a) if None not in (a, b) else 0 for (_, _, _, a), (_, _, _, b) in zip(rows, rows[1:])]
    runs, i = [], 0
    while i < len(steps):
        j = i
        while j < len(steps) and steps[j] == steps[i]:
            j += 1
        runs.append((steps[i], j - i))
        i = j
    lengths = [n for s, n in runs if s]
    return (len(rows), sum(a[2] != b[2] for a, b in zip(rows, rows[1:])), steps.count(1), steps.count(-1), runs[-1][1] if runs and runs[-1][0] else 0, max(lengths, default=0))


def test_fold_in_parts_equals_a_plain_scan():
    draw = random.Random(1)
    for _ in range(300):
        rows = [(i, i, draw.choice("ab"), draw.choice([None, 1.0, 2.0, 3.0])) for i in range(draw.randint(1, 30))]
        cut = draw.randint(0, len(rows))
        assert stateful.folded(stateful.folded(None, rows[:cut]), rows[cut:])[3:] == plain_fold(rows)


@pytest.mark.parametrize("late, shuffled", [("60 days", True), ("2 hours", False)])
def test_any_order_of_arrival(spark, sf_dir, tmp_path, late, shuffled):
    """With events of all times in each file, and with files in order of time, where timers fold what the watermark has passed."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENTS.names).where("user_id < 40").collect()]
    rows = [(*r[:4], None if r[0] % 17 == 0 else r[4], r[5]) for r in rows]
    rows.sort(key=lambda r: hash(r[0]) % 7 if shuffled else r[1])
    source, n = tmp_path / "in", -(-len(rows) // 4)
    for i in range(4):
        part = rows[i * n : (i + 1) * n] + rows[i * n : i * n + 3]  # some rows come twice
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{source}")
    store = KeyedTable(spark, f"file://{tmp_path}/out", stateful.ANSWER, ["user_id"], version="n", buckets=32)
    written = stateful.keep_streaks(str(source), store, f"file://{tmp_path}/state", late, partitions=4)
    assert len(written) >= 4
    assert sorted(map(tuple, store.read().collect())) == answers(rows)


def test_only_touched_keys_are_written(spark, tmp_path):
    source = tmp_path / "in"
    event = lambda i, user, day: (i, __import__("datetime").datetime(2024, 1, day), user, "a", float(i), None)
    spark.createDataFrame([event(i, i, 1) for i in range(60)], EVENTS).coalesce(1).write.parquet(str(source))
    store = KeyedTable(spark, f"file://{tmp_path}/out", stateful.ANSWER, ["user_id"], version="n", buckets=32)
    first = stateful.keep_streaks(str(source), store, f"file://{tmp_path}/state", "1 day", partitions=4)
    spark.createDataFrame([event(99, 5, 2)], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    second = stateful.keep_streaks(str(source), store, f"file://{tmp_path}/state", "1 day", partitions=4)
    assert max(first) > 10 and sum(second) == 1
    assert [tuple(r) for r in store.lookup(5).collect()] == [(5, 2, 0, 1, 0, 1, 1)]


@pytest.mark.parametrize("groups", [1, 7])
def test_users_share_calls_of_the_state(spark, sf_dir, tmp_path, monkeypatch, groups):
    """No more calls a batch than groups, and lists of few entries, with the answers of each user's rows alone."""
    monkeypatch.setattr(stateful, "CHUNK", 64)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENTS.names).collect()]
    rows.sort(key=lambda r: r[1])
    source, n = tmp_path / "in", -(-len(rows) // 3)
    for i in range(3):
        spark.createDataFrame(rows[i * n : (i + 1) * n], EVENTS).coalesce(1).write.mode("append").parquet(f"{source}")
    store = KeyedTable(spark, f"file://{tmp_path}/out", stateful.ANSWER, ["user_id"], version="n", buckets=4)
    stateful.keep_streaks(str(source), store, f"file://{tmp_path}/state", "3 days", partitions=4, groups=groups)
    assert sorted(map(tuple, store.read().collect())) == answers(rows)
    keys = spark.read.format("statestore").option("path", f"file://{tmp_path}/state").option("stateVarName", "waiting").load()
    assert keys.select("key").distinct().count() <= groups < len({r[2] for r in rows})


def test_entries_of_a_list_hold_many_rows():
    rows = [(u, u * 10, u, "a" if u % 2 else None, None if u % 3 else 1.5) for u in range(2_500)]
    packed = stateful.chunks(rows)
    assert len(packed) == 3 and [row for chunk in packed for row in zip(*chunk)] == rows


def test_joined_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENTS.names)
    for kind in ("view", "error"):
        events.where(F.col("event_type") == kind).repartition(3).write.parquet(f"{tmp_path}/{kind}")
    streams = [read_events(spark, f"{tmp_path}/{kind}", 1) for kind in ("view", "error")]
    attributed(*streams, "60 days", "2 days").writeStream.format("parquet").option("path", f"{tmp_path}/pairs").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["left_id"], r["right_id"]) for r in spark.read.parquet(f"{tmp_path}/pairs").collect()}
    rows = events.collect()
    day = __import__("datetime").timedelta(days=2)
    want = {(a["event_id"], b["event_id"]) for a in rows if a["event_type"] == "view" for b in rows if b["event_type"] == "error" and a["user_id"] == b["user_id"] and a["ts"] <= b["ts"] <= a["ts"] + day}
    assert got == want and want
