"""Extraction held against expectations with wildcards, and pairs of similar sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.functions.text import keywords
from factframe.operators.matching import match_quality
from factframe.operators.similarity import similar_sets
from factframe.plans.text import _KEYWORDS_SQL
from factframe.registry import query
from factframe.sources.tables import table

FIELDS = ("quarter", "flag", "status")
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def _rounds_sql() -> str:
    """The rounds of the greedy match, one after another."""
    masks = sorted(range(1 << len(FIELDS)), key=lambda m: (-m.bit_count(), m))
    parts, order = [], ", ".join(ORDER)
    for i, mask in enumerate(masks):
        fixed = ", ".join(["company_id", *(c for k, c in enumerate(FIELDS) if mask >> k & 1)])
        parts.append(
            f"""a{i} AS (SELECT *, row_number() OVER (PARTITION BY {fixed} ORDER BY {order}) AS k FROM e WHERE fixed = {mask}),
o{i} AS (SELECT *, row_number() OVER (PARTITION BY {fixed} ORDER BY {order}) AS k FROM l{i}),
c{i} AS (SELECT a{i}.company_id, o{i}.id FROM a{i} JOIN o{i} USING ({fixed}, k)),
l{i + 1} AS (SELECT * FROM l{i} WHERE id NOT IN (SELECT id FROM c{i}))"""
        )
    return ",\n".join(parts), " UNION ALL ".join(f"SELECT company_id FROM c{i}" for i in range(len(masks)))


_ROUNDS, _CLAIMS = _rounds_sql()
_QUARTER = "CAST(date_trunc('quarter', l_shipdate) AS DATE)"


@query(f"""
WITH b AS (SELECT l_suppkey AS company_id, {_QUARTER} AS quarter, l_returnflag AS flag, l_linestatus AS status, {", ".join(ORDER)}, l_quantity FROM lineitem),
l0 AS (SELECT * EXCLUDE (l_quantity), row_number() OVER () AS id FROM b WHERE l_quantity > 10),
w AS (SELECT company_id, CASE WHEN l_orderkey % 5 <> 0 THEN quarter END AS quarter, CASE WHEN l_linenumber % 3 <> 0 THEN flag END AS flag,
  CASE WHEN l_partkey % 7 <> 0 THEN status END AS status, {", ".join(ORDER)} FROM b WHERE l_quantity > 5),
e AS (SELECT *, CASE WHEN quarter IS NULL THEN 0 ELSE 1 END + CASE WHEN flag IS NULL THEN 0 ELSE 2 END + CASE WHEN status IS NULL THEN 0 ELSE 4 END AS fixed FROM w),
{_ROUNDS},
m AS (SELECT company_id, count(*) AS matched FROM ({_CLAIMS}) GROUP BY company_id),
x AS (SELECT company_id, count(*) FILTER (l_quantity > 5) AS expected, count(*) FILTER (l_quantity > 10) AS found FROM b GROUP BY company_id HAVING expected > 0)
SELECT company_id, coalesce(matched, 0) AS matched, expected, found, CASE WHEN found > 0 THEN coalesce(matched, 0) / found ELSE 0 END AS precision,
  coalesce(matched, 0) / expected AS recall, 2 * coalesce(matched, 0) / (found + expected) AS f1
FROM x LEFT JOIN m USING (company_id)""")
def wildcard_match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines above a quantity as extracted facts, held against expectations that leave some fields open."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("company_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("quarter"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), *ORDER, "l_quantity"
    )
    found = lines.where("l_quantity > 10")
    open_ = {"quarter": F.col("l_orderkey") % 5, "flag": F.col("l_linenumber") % 3, "status": F.col("l_partkey") % 7}
    expected = lines.where("l_quantity > 5").withColumns({c: F.when(rest != 0, F.col(c)) for c, rest in open_.items()})
    return match_quality(expected, found, ["company_id"], FIELDS, ORDER)


_SIMILAR_SQL = """o AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM t x JOIN t y ON x.w = y.w AND x.k < y.k GROUP BY ALL),
n AS (SELECT k, count(*) AS n FROM t GROUP BY k)
SELECT a, b, shared, shared / (x.n + y.n - shared) AS jaccard FROM o JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE shared / (x.n + y.n - shared) > {}"""


@query(f"WITH t AS (SELECT item_id AS k, unnest(list_distinct({_KEYWORDS_SQL.format('text')})) AS w FROM benchmark), {_SIMILAR_SQL.format(0.1)}")
def similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of similar wording, by the rarest words of each."""
    return similar_sets(table(spark, sf_dir, "benchmark").select("item_id", keywords(F.col("text")).alias("ws")), "item_id", "ws", 0.1)


@query(f"WITH t AS (SELECT DISTINCT l_orderkey AS k, l_partkey // 5 AS w FROM lineitem), {_SIMILAR_SQL.format(0.3)}")
def similar_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of similar groups of parts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.floor(F.col("l_partkey") / 5).alias("part"))
    return similar_sets(lines.groupBy("order").agg(F.collect_set("part").alias("parts")), "order", "parts", 0.3)
