"""Tables whose rows are replaced by key."""

import glob
import os

import pytest
from pyspark.sql import types as T

from factframe.operators.keyed import KeyedTable

SHAPE = T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("note", T.StringType())])


@pytest.fixture
def store(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/runs", SHAPE, ["id", "part"], buckets=8)


def files(tmp_path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/runs/_bucket=*/*.parquet")}


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_the_newest_version_of_a_key_stays(spark, store, tmp_path):
    assert rows_of(store.read()) == []
    first = [(i, "a", 1, "ok") for i in range(200)]
    assert store.replace(spark.createDataFrame(first, SHAPE)) == 8
    before = files(tmp_path)
    assert store.replace(spark.createDataFrame([(7, "a", 2, "failed"), (7, "b", 1, "new")], SHAPE)) <= 2
    after = files(tmp_path)
    untouched = before.keys() & after.keys()
    assert len({os.path.dirname(p) for p in untouched}) >= 6 and all(before[p] == after[p] for p in untouched)
    want = sorted([r for r in first if r[0] != 7] + [(7, "a", 2, "failed"), (7, "b", 1, "new")])
    assert rows_of(store.read()) == want
    # an older version that comes late, and the same write once more
    store.replace(spark.createDataFrame([(7, "a", 1, "late")], SHAPE))
    store.replace(spark.createDataFrame([(7, "a", 2, "failed"), (7, "b", 1, "new")], SHAPE))
    assert rows_of(store.read()) == want
    assert rows_of(store.lookup(7, "a")) == [(7, "a", 2, "failed")] and rows_of(store.lookup(7, "c")) == []
    assert store.replace(spark.createDataFrame([], SHAPE)) == 0


def test_writes_that_are_refused_change_nothing(spark, store):
    store.replace(spark.createDataFrame([(1, "a", 1, "ok")], SHAPE))
    for bad in ([(2, "a", 1, "x"), (2, "a", 2, "y")], [(None, "a", 1, "x")]):
        with pytest.raises(ValueError):
            store.replace(spark.createDataFrame(bad, SHAPE))
    assert rows_of(store.read()) == [(1, "a", 1, "ok")]


def test_a_lookup_reads_one_bucket(spark, store):
    store.replace(spark.createDataFrame([(i, "a", 1, "ok") for i in range(100)], SHAPE))
    plan = store.lookup(5, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan
