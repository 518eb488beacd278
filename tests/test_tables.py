"""Tasks of larger tables are more, not larger."""

import pytest

from factframe.sources import tables

NAMES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")


@pytest.fixture
def settings(spark):
    held = {name: spark.conf.get(name, None) for name in NAMES}
    for name in NAMES:
        spark.conf.unset(name)
    yield
    for name, value in held.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_parts_of_a_shuffle_follow_the_bytes_of_a_table(spark, sf_dir, settings, monkeypatch):
    orders = tables.table(spark, sf_dir, "orders")
    assert spark.conf.get(NAMES[2], None) is None and orders.count() == 1500
    assert [int(spark.conf.get(name)) for name in NAMES[:2]] == [tables.TASK_BYTES] * 2
    monkeypatch.setattr(tables, "file_bytes", lambda *_: 1_000 * tables.PART_BYTES)
    tables.table(spark, sf_dir, "orders")
    assert spark.conf.get(NAMES[2]) == "1000"


def test_smaller_settings_are_kept(spark, sf_dir, settings):
    spark.conf.set(NAMES[0], "1m")
    spark.conf.set(NAMES[1], "512KB")
    tables.table(spark, sf_dir, "orders")
    assert [spark.conf.get(name) for name in NAMES[:2]] == ["1m", "512KB"]
