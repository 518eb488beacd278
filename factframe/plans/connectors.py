"""Queries over connectors and folders that may hold unreadable files."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factframe.operators.storage import fresh_folder
from factframe.registry import query
from factframe.sources.discovery import readable_rows, skipped_files
from factframe.sources.tables import table
from factframe.sources.windows import read_dated


@query("""SELECT o_orderkey AS evidence_id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS total, o_orderpriority AS kind FROM orders""")
def connector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, fetched in windows of 90 days."""
    orders = read_dated(spark, f"{sf_dir}/orders.parquet", "o_orderdate", 90)
    return orders.select(F.col("o_orderkey").alias("evidence_id"), "day", F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("kind"))


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS status, count(*) AS n, max(o_orderkey) AS newest FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-15' AND CAST(o_orderdate AS DATE) < DATE '1997-02-10' GROUP BY ALL""")
def connector_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of some months: only the windows that reach into them are fetched."""
    days = (F.col("day") >= F.to_date(F.lit("1996-03-15"))) & (F.col("day") < F.to_date(F.lit("1997-02-10")))
    some = read_dated(spark, f"{sf_dir}/orders.parquet", "o_orderdate", 30, where=days)
    return some.groupBy(F.to_date(F.date_trunc("month", "day")).alias("month"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


def split_customers(spark: SparkSession, sf_dir: str) -> str:
    """A folder of customers in files by nation, schema versions 1 to 3, with half of a file beside them."""
    folder = fresh_folder(spark, "customers")
    rows = table(spark, sf_dir, "customer").withColumn("schema_version", F.when(F.col("c_nationkey") < 3, 1).otherwise(2 + F.col("c_nationkey") % 2))
    rows.repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(folder)
    system, place = fs.FileSystem.from_uri(folder)
    whole = next(f for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.path.endswith(".parquet"))
    with system.open_input_file(whole.path) as source, system.open_output_stream(f"{place}/c_nationkey=0/cut.parquet") as out:
        out.write(source.read(whole.size // 2))
    return folder


@query("""
SELECT 'read' AS outcome, CAST(2 + c_nationkey % 2 AS VARCHAR) AS detail, count(*) AS n, count(DISTINCT c_nationkey) AS files FROM customer WHERE c_nationkey >= 3 GROUP BY ALL
UNION ALL SELECT 'skipped', 'stale', 0, count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey < 3 UNION ALL SELECT 'skipped', 'unreadable', 0, 1""")
def discovery_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read of a folder of many companies' files, by version of their schema, and what is skipped, with the reason."""
    folder = split_customers(spark, sf_dir)
    shape = spark.read.parquet(f"{sf_dir}/customer.parquet").drop("c_nationkey").schema.add("schema_version", T.IntegerType())
    current = ("schema_version", 2)
    rows = readable_rows(spark, folder, shape, current)
    read = rows.groupBy(F.lit("read").alias("outcome"), F.col("schema_version").cast("string").alias("detail")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    gone = skipped_files(spark, folder, shape, current)
    return read.unionByName(gone.groupBy(F.lit("skipped").alias("outcome"), F.col("reason").alias("detail")).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("files")))
