"""Results saved and replaced by key: runs of analyses, with failures kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.operators.keyed import KeyedTable
from factframe.operators.storage import fresh_folder
from factframe.registry import query
from factframe.sources.filings import KIND_SQL, document_kind
from factframe.sources.tables import money, table


def runs(orders: DataFrame, version: int) -> DataFrame:
    """A run for each order: its version, status and total; a failed run has no total."""
    failed = F.col("o_orderstatus") == "P"
    return orders.select(
        F.col("o_orderkey").alias("evidence_id"),
        F.lit(version).alias("version"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(~failed, (money("o_totalprice") * version).cast("double")).alias("total"),
    )


_RUNS_SQL = """
SELECT o_orderkey AS evidence_id, CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END AS DOUBLE) END AS total FROM orders"""


@query(_RUNS_SQL)
def runs_replaced_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs are saved, a tenth of them is written again with a newer version, late old versions change nothing, and the table is read back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = runs(orders, 1)
    store = KeyedTable(spark, fresh_folder(spark, "runs"), first.schema, ["evidence_id"])
    store.replace(first)
    again = runs(orders.where("o_orderkey % 10 = 3"), 2)
    store.replace(again)
    store.replace(again)
    store.replace(runs(orders.where("o_orderkey % 20 = 3"), 1))
    return store.read()


@query("""
SELECT CAST(o_orderdate AS DATE) AS run, count(*) AS n, max(o_orderkey) AS newest, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL""")
def profiles_saved_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile a day, saved from half of the orders and then replaced from all of them, days in three writes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("run"), money("o_totalprice").alias("price"))
    profile = lambda rows, v: rows.groupBy("run").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"), F.sum("price").cast("double").alias("total")).withColumn("version", F.lit(v))
    before = profile(orders.where("o_orderkey % 2 = 0"), 1)
    store = KeyedTable(spark, fresh_folder(spark, "profiles"), before.schema, ["run"], buckets=16)
    store.replace(before)
    for part in range(3):
        store.replace(profile(orders.where(F.pmod(F.datediff("run", F.lit("1970-01-01")), F.lit(3)) == part), 2))
    return store.read().drop("version")


@query(f"""WITH e AS (SELECT o_orderkey AS evidence_id, {KIND_SQL} AS kind, CAST(o_orderdate AS DATE) AS source_date FROM orders)
SELECT evidence_id, CASE WHEN evidence_id % 7 = 0 THEN 'corrected' ELSE kind END AS kind, source_date FROM e WHERE evidence_id IN (5, 7, 14, 777)""")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's entries of a few ids, after some were added again: each lookup reads one bucket, and an unknown id has no entry."""
    orders = table(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_orderkey").alias("evidence_id"), document_kind(F.col("o_orderpriority")).alias("kind"), F.to_date("o_orderdate").alias("source_date"), F.lit(1).alias("version"))
    catalog = KeyedTable(spark, fresh_folder(spark, "catalog"), entries.schema, ["evidence_id"])
    catalog.replace(entries)
    catalog.replace(entries.where("evidence_id % 7 = 0").withColumn("kind", F.lit("corrected")).withColumn("version", F.lit(2)))
    return reduce(DataFrame.unionByName, [catalog.lookup(i) for i in (5, 7, 14, 777, -1)]).drop("version")


@query("SELECT doc_id AS evidence_id FROM documents WHERE doc_id % 17 <> 0 AND coalesce(n_chars, 0) > 0 AND text IS NOT NULL AND doc_id % 3 = 2")
def usable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were parsed without error, hold text, and were parsed by the present version."""
    parsed = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("evidence_id"),
        F.when((F.col("doc_id") % 17 != 0) & F.col("text").isNotNull(), "ok").otherwise("failed").alias("status"),
        F.coalesce("n_chars", F.lit(0)).alias("char_count"),
        (F.col("doc_id") % 3).alias("parser_version"),
    )
    return parsed.where("status = 'ok' and char_count > 0 and parser_version = 2").select("evidence_id")


@query("SELECT doc_id AS evidence_id, n_chars, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id IN (SELECT event_id // 3 FROM events WHERE event_type = 'click')")
def documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a list of ids, which repeats some and names some that are not there."""
    asked = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.floor(F.col("event_id") / 3).alias("evidence_id"))
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    return held.join(asked, "evidence_id", "left_semi")
