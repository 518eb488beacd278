"""Nested documents of users, built from their events: differences of two versions and canonical text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.operators.trees import canonical, rebuilt, tree_diff, tree_nodes
from factframe.registry import query
from factframe.sources.tables import table


def user_documents(events: DataFrame) -> DataFrame:
    """One JSON document a user: counts and the last event by type, the three newest events, times of the clock at two depths."""
    last = F.max_by(F.struct("event_id", "props", "ts"), F.struct("ts", "event_id"))
    by_type = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), last.alias("e"), F.sort_array(F.collect_list("event_id"), asc=False).alias("ids"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    entry = F.struct(F.col("n"), F.struct(F.col("e.event_id").alias("id"), F.parse_json("e.props").alias("props"), stamp("e.ts").alias("analyzed_at")).alias("last"))
    users = by_type.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("event_type"), entry))).alias("by type"),
        F.slice(F.sort_array(F.flatten(F.collect_list(F.slice("ids", 1, 3))), asc=False), 1, 3).alias("recent"),
        stamp(F.max("e.ts")).alias("built_at"),
    )
    return users.select("user_id", F.to_json(F.struct("user_id", "recent", "built_at", "by type")).alias("document"))


_LAST = """l AS (SELECT side, user_id, event_type AS t, count(*) AS n, first({'id': event_id, 'k': CAST(json_extract(props, '$.k') AS BIGINT), 'ts': ts} ORDER BY ts DESC, event_id DESC) AS e FROM v GROUP BY ALL),
r AS (SELECT side, user_id, event_id, row_number() OVER (PARTITION BY side, user_id ORDER BY event_id DESC) AS i FROM v QUALIFY i <= 3)"""
_STAMP = "'%Y-%m-%d %H:%M:%S'"


@query(f"""
WITH v AS (SELECT 'old' AS side, * FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT 'new', * FROM events WHERE event_id % 10 <> 4), {_LAST},
f AS (SELECT side, user_id, 'user_id' AS path, CAST(user_id AS VARCHAR) AS leaf FROM v GROUP BY ALL
  UNION ALL SELECT side, user_id, 'built_at', '"' || strftime(max(ts), {_STAMP}) || '"' FROM v GROUP BY side, user_id
  UNION ALL SELECT side, user_id, 'recent[' || (i - 1) || ']', CAST(event_id AS VARCHAR) FROM r
  UNION ALL SELECT side, user_id, '["by type"].' || t || '.n', CAST(n AS VARCHAR) FROM l
  UNION ALL SELECT side, user_id, '["by type"].' || t || '.last.id', CAST(e.id AS VARCHAR) FROM l
  UNION ALL SELECT side, user_id, '["by type"].' || t || '.last.props.k', CAST(e.k AS VARCHAR) FROM l
  UNION ALL SELECT side, user_id, '["by type"].' || t || '.last.analyzed_at', '"' || strftime(e.ts, {_STAMP}) || '"' FROM l)
SELECT user_id, path, CASE WHEN n.leaf IS NULL THEN '-' WHEN o.leaf IS NULL THEN '+' ELSE '~' END AS change, o.leaf AS old, n.leaf AS new
FROM (SELECT * FROM f WHERE side = 'old') o FULL JOIN (SELECT * FROM f WHERE side = 'new') n USING (user_id, path) WHERE o.leaf IS DISTINCT FROM n.leaf""")
def nested_document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in each user's document between two readings, each of which missed a tenth of the events."""
    events = table(spark, sf_dir, "events")
    return tree_diff(user_documents(events.where("event_id % 10 <> 3")), user_documents(events.where("event_id % 10 <> 4")), ["user_id"])


_ENTRY = """'"' || t || '":{"last":{"id":' || e.id || ',"props":{"k":' || e.k || '}},"n":' || n || '}'"""
_CANONICAL = f"""
WITH v AS (SELECT 'all' AS side, * FROM events), {_LAST},
t AS (SELECT user_id, string_agg({_ENTRY}, ',' ORDER BY t) AS types FROM l GROUP BY user_id),
q AS (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS recent FROM r GROUP BY user_id),
c AS (SELECT user_id, '{{"by type":{{' || types || '}},"recent":[' || recent || '],"user_id":' || user_id || '}}' AS canonical FROM t JOIN q USING (user_id))
SELECT user_id, canonical, sha256(canonical) AS digest FROM c"""


@query(_CANONICAL)
def nested_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical text of each user's document and its digest: sorted keys, no volatile ones at any depth."""
    return canonical(user_documents(table(spark, sf_dir, "events")), ["user_id"])


@query(_CANONICAL.replace("SELECT user_id, canonical, sha256(canonical) AS digest FROM c", "SELECT user_id, canonical AS document, true AS same FROM c"))
def nested_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made again of their paths and leaves, and whether they say the same as the ones they came from."""
    docs = user_documents(table(spark, sf_dir, "events"))
    kept = rebuilt(tree_nodes(docs, ["user_id"], without=("analyzed_at", "built_at")), ["user_id"])
    whole = rebuilt(tree_nodes(docs, ["user_id"]), ["user_id"], "_again")
    # a variant's text has its keys sorted
    same = F.to_json(F.parse_json("_given")) == F.col("_again")
    given = docs.select("user_id", F.col("document").alias("_given"))
    return kept.join(whole, "user_id").join(given, "user_id").select("user_id", "document", same.alias("same"))
