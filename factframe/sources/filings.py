"""Facts as documents state them: one row for each, with its document, section and place in the order of emission.

A document is an order, its company the customer, a fact one line of it. The
kind of a fact is dealt from a list by the part's number, so that every query
over facts runs at the size of the line items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.sources.tables import quarter_end, table

KINDS = {"1-URGENT": "financial_results", "2-HIGH": "annual_report", "3-MEDIUM": "investor_presentation", "4-NOT SPECIFIED": "call_transcript"}
SECTIONS = ("consolidated_results", "standalone_results", "balance_sheet", "notes")


def document_kind(priority: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[priority], F.lit("other"))


def _document() -> list[Column]:
    day = F.col("o_orderdate")
    return [F.col("o_custkey").alias("company_id"), document_kind(F.col("o_orderpriority")).alias("doc_kind"), day.cast("date").alias("source_date"), quarter_end(day).alias("quarter")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence_id, company_id, doc_kind, source_date, quarter."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), *_document())


def facts(spark: SparkSession, sf_dir: str, kinds: Sequence[str], filed: DataFrame | None = None) -> DataFrame:
    """evidence_id, company_id, doc_kind, source_date, seq, kind, value (null if the fact is text), text, unit, section, period, scope, char_offset.

    Where filed_lines() have been made, they are read from there.
    """
    pick = lambda names, by: F.get(F.array(*[F.lit(n) for n in names]), by)
    lines = (table(spark, sf_dir, "lineitem") if filed is None else filed).select(
        F.col("l_orderkey").alias("evidence_id"),
        (F.col("l_linenumber") * F.lit(10**17) + F.col("l_partkey") * F.lit(10**9) + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("seq"),
        pick(kinds, (F.col("l_partkey") % len(kinds)).cast("int")).alias("kind"),
        F.when((F.col("l_linestatus") == "F") | (F.col("l_discount") < 0.05), F.col("l_extendedprice")).alias("value"),
        F.concat(F.lit("text "), (F.col("l_suppkey") % 20).cast("string")).alias("text"),
        F.when(F.col("l_returnflag") == "R", "USD_BILLION").otherwise("CRORE_INR").alias("unit"),
        pick(SECTIONS, (F.col("l_suppkey") % 4).cast("int")).alias("section"),
        (F.col("l_tax") < 0.075).alias("_dated"),
        F.when(F.col("l_quantity") > 25, "annual").otherwise("quarterly").alias("scope"),
        (F.col("l_quantity").cast("long") % 4).alias("char_offset"),
        *([] if filed is None else _document()),
    )
    joined = lines.join(documents(spark, sf_dir), "evidence_id") if filed is None else lines
    return joined.withColumn("period", F.when(F.col("_dated"), F.col("quarter"))).drop("_dated", "quarter")


KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " ELSE 'other' END"


def facts_sql(kinds: Sequence[str]) -> str:
    """The same projection for DuckDB."""
    return f"""facts AS (
  SELECT o_orderkey AS evidence_id, o_custkey AS company_id, {KIND_SQL} AS doc_kind, CAST(o_orderdate AS DATE) AS source_date,
    l_linenumber * 100000000000000000 + l_partkey * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq, list_extract({list(kinds)}, CAST(l_partkey % {len(kinds)} AS INTEGER) + 1) AS kind,
    CASE WHEN l_linestatus = 'F' OR l_discount < 0.05 THEN l_extendedprice END AS value, 'text ' || CAST(l_suppkey % 20 AS VARCHAR) AS text,
    CASE l_returnflag WHEN 'R' THEN 'USD_BILLION' ELSE 'CRORE_INR' END AS unit, list_extract({list(SECTIONS)}, CAST(l_suppkey % 4 AS INTEGER) + 1) AS section,
    CASE WHEN l_tax < 0.075 THEN last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) END AS period,
    CASE WHEN l_quantity > 25 THEN 'annual' ELSE 'quarterly' END AS scope, CAST(l_quantity AS BIGINT) % 4 AS char_offset
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
