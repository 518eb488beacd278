"""Queries of what filings are written in: shares or percent, local times, a bank's form of accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factframe.functions import dates as D
from factframe.registry import query
from factframe.sources.tables import table


@query("""WITH p AS (SELECT l_orderkey AS evidence_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 2 = 0 THEN l_discount * 100 ELSE l_discount END AS v FROM lineitem)
SELECT evidence_id, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN max(v) OVER (PARTITION BY evidence_id) > 1.5 THEN v ELSE v * 100 END, 4) AS pct FROM p""")
def percent_scale(spark, sf_dir):
    """Shares to percent, by document: values above 1.5 show that a document is in percent already."""
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(key.alias("evidence_id"), "l_linenumber", "l_partkey", "l_suppkey", F.when(key % 2 == 0, F.col("l_discount") * 100).otherwise(F.col("l_discount")).alias("v"))
    most = rows.groupBy("evidence_id").agg(F.max("v").alias("_most"))
    return rows.join(most, "evidence_id").select("evidence_id", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.when(F.col("_most") > 1.5, F.col("v")).otherwise(F.col("v") * 100), 4).alias("pct"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '.123' ELSE '' END AS raw, ts FROM events)
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE date_trunc('second', ts) - INTERVAL 330 MINUTE END AS at, CASE WHEN CAST(ts AS DATE) < make_date(year(ts), 3, 31) THEN make_date(year(ts) - 1, 3, 31) ELSE make_date(year(ts), 3, 31) END AS year_end FROM t""")
def utc_times(spark, sf_dir):
    """Exchange time without its fraction to UTC; text that is no time is null."""
    n = F.col("event_id")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 3 == 0, ".123").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", D.utc_time(F.when(n % 7 == 0, "soon").otherwise(raw)).alias("at"), D.fiscal_year_end(F.to_date("ts")).alias("year_end"))


_BANK = (r"(?i)Interest\s+Earned|Net\s+Interest\s+Income", r"\b(?:Bank|BANK|Banking|BANKING)\b")


@query(f"""SELECT doc_id, NOT contains(lower(substr(text, 1, 15000)), 'revenue from operations') AND (regexp_matches(substr(text, 1, 15000), '{_BANK[0]}') OR regexp_matches(substr(text, 1, 2000), '{_BANK[1]}')) AS banking
FROM (SELECT doc_id, list_extract(['', 'Bank of the Vale. ', 'Interest earned 5. ', 'Bank. Revenue from Operations 7. '], CAST(doc_id % 4 AS INTEGER) + 1) || text AS text FROM documents WHERE text IS NOT NULL)""")
def banking_filings(spark, sf_dir):
    """A bank's form of accounts: no revenue line in the head of the document, and a bank's own lines there or its name on the cover. The heads are the rule's definition."""
    cover = F.get(F.array(*[F.lit(x) for x in ("", "Bank of the Vale. ", "Interest earned 5. ", "Bank. Revenue from Operations 7. ")]), (F.col("doc_id") % 4).cast("int"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(cover, "text").alias("text"))
    head = F.substring("text", 1, 15000)
    return docs.select("doc_id", (~F.lower(head).contains("revenue from operations") & (head.rlike(_BANK[0]) | F.substring("text", 1, 2000).rlike(_BANK[1]))).alias("banking"))
