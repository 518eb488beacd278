"""Scans: the driver's tables, and the fact model that is read from them.

A company is a supplier, a piece of evidence an order, a period the quarter of
the order's date. Only the columns that a query uses reach the scan.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.operators.storage import bounded, bucketed, written

METRICS = ("revenue", "total_income", "finance_cost", "total_tax", "total_debt", "cash", "capex")

#: Segment of a customer -> kind of holder, and the least move that counts as a signal.
HOLDERS = {"AUTOMOBILE": "promoter", "BUILDING": "fpi", "FURNITURE": "dii", "HOUSEHOLD": "mutual_fund", "MACHINERY": "insurance"}
THRESHOLDS = {"promoter": 0.05, "fpi": 0.5, "dii": 0.5, "mutual_fund": 0.3, "insurance": 0.3}


#: Bytes of files, and of a shuffle, that one task reads; a part of a shuffle stands for so many bytes of a table's files.
TASK_BYTES, PART_BYTES = 8 << 20, 2 << 20


@cache
def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a path; their contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def bound_tasks(spark: SparkSession, path: str) -> None:
    """Larger tables make more tasks, not larger ones: what a task sorts, groups and buffers does not grow with the input.

    By default a scan's splits and the parts of a shuffle grow with the input up
    to 128 and 64 MB, and shuffles have 200 parts however large they are.
    """
    for name, unset in (("spark.sql.files.maxPartitionBytes", "128m"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")):
        text = spark.conf.get(name, unset).lower().removesuffix("b")
        held = int(text[:-1]) << {"k": 10, "m": 20, "g": 30}[text[-1]] if text[-1] in "kmg" else int(text)
        if held > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))
    parts = -(-file_bytes(spark, path) // PART_BYTES)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if parts > int(spark.conf.get(initial, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(initial, str(parts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    bound_tasks(spark, path)
    return spark.read.parquet(path)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "QUARTER"), 2))


def money(column: str, scale: int = 2) -> Column:
    """Doubles with two decimals as exact decimals, so that sums don't depend on their order."""
    return F.col(column).cast(f"decimal(18,{scale})")


LINE = ("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def filed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items beside their orders, joined once and written in buckets by order, for queries that read facts or lines several times."""
    buckets = max(1, -(-file_bytes(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES))
    lines = table(spark, sf_dir, "lineitem").select(*LINE).repartition(buckets, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").repartition(buckets, "o_orderkey")
    return bucketed(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"), "l_orderkey", buckets, "filed")


def fact_lines(spark: SparkSession, sf_dir: str, filed: DataFrame | None = None) -> DataFrame:
    """One row per line item with company, evidence, date, period and exact amounts; of filed_lines() where they have been made."""
    if filed is None:
        lines = table(spark, sf_dir, "lineitem").select(*LINE)
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        filed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price, kept = money("l_extendedprice"), 1 - F.col("l_discount").cast("decimal(4,2)")
    return filed.select(
        F.col("l_suppkey").alias("company_id"),
        F.col("l_orderkey").alias("evidence_id"),
        F.col("o_orderdate").cast("date").alias("source_date"),
        quarter_end(F.col("o_orderdate")).alias("period"),
        F.col("o_orderpriority").alias("kind"),
        "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
        price.alias("price"),
        (price * kept).alias("net"),
        (price * F.col("l_discount").cast("decimal(4,2)")).alias("discount"),
        (price * kept * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
    )


def metric_sums() -> list[Column]:
    """The metrics of a group of fact lines as exact sums; a metric without any line is null."""
    flag = lambda f: F.when(F.col("l_returnflag") == f, F.col("price"))
    return [
        F.sum("net").alias("revenue"),
        F.sum("price").alias("total_income"),
        F.sum("discount").alias("finance_cost"),
        F.sum("tax").alias("total_tax"),
        F.sum(flag("R")).alias("total_debt"),
        F.sum(flag("A")).alias("cash"),
        F.sum(F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40), F.col("price"))).alias("capex"),
    ]


def metric_columns() -> list[Column]:
    """The metrics of a group of fact lines."""
    return [c.cast("double").alias(m) for m, c in zip(METRICS, metric_sums(), strict=True)]


def quarter_totals(spark: SparkSession, sf_dir: str, filed: DataFrame | None = None) -> DataFrame:
    """Exact sums by company and period, written once for reports that ask for them several times.

    Filed lines lie by order, so a task holds few lines of a company's quarter:
    the lines are dealt by it as they are, which are narrower than partial sums.
    """
    lines = fact_lines(spark, sf_dir, filed)
    if filed is not None:
        lines = fact_lines(spark, sf_dir, filed.repartition("l_suppkey", quarter_end(F.col("o_orderdate"))))
    return written(lines.groupBy("company_id", "period").agg(*metric_sums()), "totals")


def newest_lines(spark: SparkSession, sf_dir: str, totals: DataFrame, filed: DataFrame) -> DataFrame:
    """The fact lines of each company's newest period; companies are few beside their lines, and are broadcast up to a bound."""
    newest = totals.groupBy(F.col("company_id").alias("_company")).agg(F.max("period").alias("_newest"))
    return fact_lines(spark, sf_dir, filed).join(bounded(newest, 1_000_000), F.col("company_id").eqNullSafe(F.col("_company")) & (F.col("period") == F.col("_newest")), "left_semi")


def snapshots(spark: SparkSession, sf_dir: str, basis: str = "consolidated", by: tuple[str, ...] = ("company_id", "period"), totals: DataFrame | None = None) -> DataFrame:
    """Wide quarterly snapshots: one row per company and period. Standalone has the lines of status F only.

    Where quarter_totals() has been made, the consolidated ones are read from it.
    """
    if totals is not None:
        return totals.select(*by, *[F.col(m).cast("double").alias(m) for m in METRICS])
    lines = fact_lines(spark, sf_dir)
    if basis == "standalone":
        lines = lines.where("l_linestatus = 'F'")
    return lines.groupBy(*by).agg(*metric_columns())


def long_facts(wide: DataFrame, keys: tuple[str, ...] = ("company_id", "period")) -> DataFrame:
    """Snapshots as (keys, metric, value), nulls kept."""
    return wide.unpivot(list(keys), list(METRICS), "metric", "value")


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, period, kind, share: percent of a nation's quarterly order value by kind of holder."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    kinds = F.create_map(*[F.lit(x) for pair in HOLDERS.items() for x in pair])
    value = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), quarter_end(F.col("o_orderdate")).alias("period"), kinds[F.col("c_mktsegment")].alias("kind")).agg(F.sum(money("o_totalprice")).cast("double").alias("value"))
    from pyspark.sql import Window

    return value.select("nation", "period", "kind", (F.col("value") / F.sum(F.col("value").cast("decimal(28,2)")).over(Window.partitionBy("nation", "period")).cast("double") * 100).alias("share"))


# The same projections for DuckDB.
LINES_SQL = """lines AS (
  SELECT l_suppkey AS company_id, o_orderkey AS evidence_id, CAST(o_orderdate AS DATE) AS source_date,
    last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period, o_orderpriority AS kind,
    l_partkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net,
    CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS discount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(24,4)) * CAST(l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
METRICS_SQL = """CAST(sum(net) AS DOUBLE) AS revenue, CAST(sum(price) AS DOUBLE) AS total_income, CAST(sum(discount) AS DOUBLE) AS finance_cost,
    CAST(sum(tax) AS DOUBLE) AS total_tax, CAST(sum(price) FILTER (l_returnflag = 'R') AS DOUBLE) AS total_debt,
    CAST(sum(price) FILTER (l_returnflag = 'A') AS DOUBLE) AS cash,
    CAST(sum(price) FILTER (l_returnflag = 'N' AND l_quantity > 40) AS DOUBLE) AS capex"""
FACTS_SQL = f"""{LINES_SQL},
f AS (SELECT company_id, period, {METRICS_SQL} FROM lines GROUP BY company_id, period)"""
LONG_SQL = f"""{FACTS_SQL},
m AS (SELECT company_id, period, metric, value FROM (
  {' UNION ALL '.join(f"SELECT company_id, period, '{m}' AS metric, {m} AS value FROM f" for m in METRICS)}))"""
HOLDINGS_SQL = f"""v AS (
  SELECT c_nationkey AS nation, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period,
    CASE c_mktsegment {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in HOLDERS.items())} END AS kind,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
h AS (SELECT nation, period, kind, value / CAST(sum(CAST(value AS DECIMAL(28,2))) OVER (PARTITION BY nation, period) AS DOUBLE) * 100 AS share FROM v)"""
