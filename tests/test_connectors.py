"""The dated connector reads what a plain scan reads, and only the windows that a query reaches."""

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringContains

from factframe.sources.windows import DatedReader, read_dated

DAY = datetime.date


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dated") / "rows")
    rows = [(i, datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=31 * i) if i % 50 else None) for i in range(400)]
    spark.createDataFrame(rows, "id long, at timestamp_ntz").repartition(3).write.parquet(path)
    return path


def test_rows_equal_a_plain_scan(spark, folder):
    plain = spark.read.parquet(folder).withColumn("day", F.to_date("at"))
    for days in (1, 7, 1000):
        got = read_dated(spark, folder, "at", days)
        assert got.columns == ["id", "at", "day"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def read_windows(frame):
    """What a window of rows came in: one partition each."""
    return frame.rdd.getNumPartitions(), frame.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pruned_windows_are_no_partitions(spark, folder):
    first, last = DAY(2020, 6, 3), DAY(2020, 6, 30)
    dated = lambda where=None: read_dated(spark, folder, "at", 10, "2021-12-31", where)
    some = dated((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last)))
    plain = spark.read.parquet(folder).where((F.to_date("at") >= F.lit(first)) & (F.to_date("at") <= F.lit(last)))
    assert sorted(r["id"] for r in some.collect()) == sorted(r["id"] for r in plain.collect())
    windows, with_rows = read_windows(some)
    assert 3 <= windows == with_rows <= 4
    assert read_windows(dated())[0] > 40
    assert read_windows(dated(F.col("day") == F.lit(DAY(2020, 6, 3))))[0] == 1
    assert dated(F.col("day").isNull()).count() == 8


def test_two_queries_over_one_load_get_all_their_rows(spark, folder):
    dated = read_dated(spark, folder, "at", 10)
    early = dated.where(F.col("day") < F.lit(DAY(2020, 6, 1)))
    n = spark.read.parquet(folder).where("at < '2020-06-01'").count()
    assert (early.count(), dated.count(), early.count()) == (n, 400, n)
    assert dated.join(early.withColumnRenamed("id", "x"), F.col("id") == F.col("x"), "left_anti").count() == 400 - n


def test_windows_go_backwards_and_follow_the_filters(folder):
    reader = DatedReader({"path": folder, "date": "at", "days": "30", "newest": "2020-12-31"})
    filters = [GreaterThan(("day",), DAY(2020, 3, 1)), LessThan(("day",), DAY(2020, 9, 1)), StringContains(("id",), "x"), GreaterThanOrEqual(("day",), DAY(2020, 2, 1)), LessThanOrEqual(("other",), DAY(2019, 1, 1))]
    assert list(reader.pushFilters(filters)) == filters
    windows = reader.partitions()
    assert all(a.first > b.last for a, b in zip(windows, windows[1:])) and windows[0].last >= DAY(2020, 8, 31) and windows[-1].first <= DAY(2020, 3, 2)
    assert all((w.last - w.first).days == 29 and w.last >= DAY(2020, 3, 2) and w.first <= DAY(2020, 8, 31) for w in windows)
    none = DatedReader({"path": folder, "date": "at"})
    list(none.pushFilters([EqualTo(("day",), DAY(2020, 3, 1)), EqualTo(("day",), DAY(2020, 3, 2))]))
    assert none.partitions() == [] or len(none.partitions()) == 1


def test_tables_without_dates(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(1, None), (2, None)])):
        spark.createDataFrame(rows, "id long, at date").write.parquet(f"{tmp_path}/{name}")
        assert read_dated(spark, f"{tmp_path}/{name}", "at").count() == len(rows)


def test_a_window_is_read_a_batch_at_a_time(tmp_path):
    """One row group of 2,000,000 rows: what is held at once is some batches, not the group."""
    n = 2_000_000
    at = pa.array(np.datetime64("2020-01-01", "us") + np.arange(n) % 1000 * np.timedelta64(1, "D"))
    pq.write_table(pa.table({"id": np.arange(n), "at": at, "note": np.random.default_rng(1).random(n), "more": np.random.default_rng(2).random(n)}), tmp_path / "one.parquet", row_group_size=n)
    reader = DatedReader({"path": str(tmp_path / "one.parquet"), "date": "at", "days": "500"})
    windows = reader.partitions()
    rows, before, most = 0, pa.total_allocated_bytes(), 0
    for window in windows:
        for batch in reader.read(window):
            rows, most = rows + len(batch), max(most, pa.total_allocated_bytes() - before)
    assert rows == n and len(windows) == 3
    assert most < 30_000_000  # the group is 64 MB
