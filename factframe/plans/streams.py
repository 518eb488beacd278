"""Streams of events in several batches, whose answers equal those of one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factframe.operators.keyed import KeyedTable
from factframe.operators.storage import fresh_folder
from factframe.registry import query
from factframe.sources.tables import table
from factframe.streaming.ledger import EVENTS, read_events
from factframe.streaming.stateful import ANSWER, attributed, keep_streaks, settings

#: Batches that the events arrive in, and how late an event may be: the data span about a month.
BATCHES, LATE = 4, "60 days"
#: Parts of the state for so many events each, at least LEAST_PARTS.
PART_EVENTS, LEAST_PARTS = 1_000_000, 8
#: Users are dealt into groups of so many events, whose state is read and written at once.
GROUP_EVENTS = 5_000


def parts_of(events: DataFrame) -> int:
    return max(LEAST_PARTS, -(-events.count() // PART_EVENTS))


def groups_of(events: DataFrame, parts: int) -> int:
    return max(4 * parts, -(-events.count() // GROUP_EVENTS))


def arriving(events: DataFrame, name: str) -> str:
    """A folder of files, one a batch, with events of all times in each."""
    folder = fresh_folder(events.sparkSession, name)
    parts = events.select(*EVENTS.names).withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)))
    parts.repartitionByRange(BATCHES, "_part").drop("_part").write.parquet(folder)
    return folder


@query("""
WITH e AS (SELECT user_id, event_type, value, row_number() OVER w AS i, lag(event_type) OVER w AS before, coalesce(sign(value - lag(value) OVER w), 0) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, step ORDER BY i) AS island FROM e),
s AS (SELECT user_id, step, island, count(*) AS length, max(i) AS last FROM g WHERE step <> 0 GROUP BY ALL),
m AS (SELECT user_id, max(length) AS longest, max(last) AS last, max_by(length, last) AS streak FROM s GROUP BY user_id),
t AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> before) AS transitions, count(*) FILTER (step > 0) AS rises, count(*) FILTER (step < 0) AS falls FROM e GROUP BY user_id)
SELECT user_id, n, transitions, rises, falls, CASE WHEN last = n THEN streak ELSE 0 END AS streak, coalesce(longest, 0) AS longest FROM t LEFT JOIN m USING (user_id)""")
def streamed_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of types and streaks of values by user, from a stream whose batches hold events of all times."""
    events = table(spark, sf_dir, "events")
    source = arriving(events, "arriving")
    store = KeyedTable(spark, fresh_folder(spark, "streaks"), ANSWER, ["user_id"], version="n", buckets=16)
    parts = parts_of(events)
    keep_streaks(source, store, fresh_folder(spark, "stream-state"), LATE, partitions=parts, groups=groups_of(events, parts))
    return store.read()


@query("""
SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, a.ts AS left_ts, b.ts AS right_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def streamed_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within six hours of a click of the same user, from two streams joined under watermarks."""
    events = table(spark, sf_dir, "events")
    clicks, purchases = (arriving(events.where(F.col("event_type") == kind), kind) for kind in ("click", "purchase"))
    pairs = attributed(read_events(spark, clicks, 1), read_events(spark, purchases, 1), LATE, "6 hours")
    folder = fresh_folder(spark, "attributed")
    with settings(spark, partitions=str(parts_of(events))):
        pairs.writeStream.format("parquet").option("path", folder).option("checkpointLocation", fresh_folder(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("user_id", "left_id", "right_id")] + [T.StructField(c, T.TimestampType()) for c in ("left_ts", "right_ts")])
    return spark.read.schema(shape).parquet(folder)
