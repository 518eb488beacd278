"""Lines are joined with their documents once; what follows by document is not shuffled again."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factframe.catalogue import ORACLE_SQL, QUERIES
from factframe.operators.events import trailing
from factframe.plans.claims import hydrated_claims, section_credibility
from factframe.plans.events import event_merge_by_day
from factframe.plans.report import assembled_report, report_markdown
from factframe.plans.series import segment_concentration
from factframe.sources import tables


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 20_000)


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filed_lines_are_the_join_in_buckets(spark, sf_dir, small_buckets):
    filed = tables.filed_lines(spark, sf_dir)
    lines, orders = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*filed.columns)
    assert filed.exceptAll(joined).count() == joined.exceptAll(filed).count() == 0
    by_order = filed.groupBy("l_orderkey").agg(F.sum("l_quantity"))
    assert by_order.rdd.getNumPartitions() > 1 and "Exchange" not in physical(by_order)


def test_spans_of_claims_are_not_shuffled(spark, sf_dir, small_buckets):
    """Only values by snapshot and the excerpts of documents move; lines are not joined again."""
    plan = physical(hydrated_claims(spark, sf_dir))
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "lineitem.parquet" not in plan
    assert sum("hashpartitioning(company_id" in line for line in shuffles) == 1
    assert not any("claim" in line for line in shuffles)


def test_a_report_joins_lines_once(spark, sf_dir, small_buckets):
    """No section scans the line items for itself, but for the companies that they name; a section's rows are not sorted before they are placed."""
    plan = assembled_report(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan) == 2
    assert not any("Sort [" in line for line in plan)


def test_a_company_is_dealt_once_for_its_text(spark, sf_dir, small_buckets):
    plan = physical(report_markdown(spark, sf_dir))
    above = plan[: plan.index("Union")]
    assert above.count("Exchange") == 1 and "hashpartitioning(company_id" in above


def test_parts_of_a_report_say_the_same_of_filed_lines(spark, sf_dir, small_buckets):
    filed = tables.filed_lines(spark, sf_dir)
    totals = tables.quarter_totals(spark, sf_dir, filed)
    same = lambda a, b: a.select(*b.columns).exceptAll(b).count() == b.exceptAll(a.select(*b.columns)).count() == 0
    assert same(totals, tables.quarter_totals(spark, sf_dir))
    assert same(segment_concentration(spark, sf_dir, tables.newest_lines(spark, sf_dir, totals, filed)), segment_concentration(spark, sf_dir))
    assert same(section_credibility(spark, sf_dir, filed), section_credibility(spark, sf_dir))
    assert same(event_merge_by_day(spark, sf_dir, days=10), trailing(event_merge_by_day(spark, sf_dir), "day", 10))


def test_totals_deal_lines_once(spark, sf_dir, small_buckets, monkeypatch):
    made = []
    monkeypatch.setattr(tables, "written", lambda frame, _: made.append(frame) or frame)
    tables.quarter_totals(spark, sf_dir, tables.filed_lines(spark, sf_dir))
    assert physical(made[0]).count("Exchange") == 1


@pytest.fixture
def odd_dir(spark, sf_dir, tmp_path):
    """Some orders have no customer, some lines no supplier."""
    for name in os.listdir(sf_dir):
        if name not in ("orders.parquet", "lineitem.parquet"):
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    unless = lambda column, by: F.when(F.col(by) % 3 != 0, F.col(column))
    spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_custkey", unless("o_custkey", "o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_suppkey", unless("l_suppkey", "l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_segments_of_lines_without_a_company(spark, odd_dir, small_buckets):
    filed = tables.filed_lines(spark, odd_dir)
    got = segment_concentration(spark, odd_dir, tables.newest_lines(spark, odd_dir, tables.quarter_totals(spark, odd_dir, filed), filed))
    want = segment_concentration(spark, odd_dir)
    assert want.where("company_id is null").count() == 1
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_snapshots_without_a_company_are_left_out(spark, odd_dir, sf_dir, small_buckets):
    """As the SQL does, which joins snapshots by company; lines keep their suppliers here."""
    os.rename(f"{odd_dir}/lineitem.parquet", f"{odd_dir}/lines_without_suppliers")
    os.symlink(f"{sf_dir}/lineitem.parquet", f"{odd_dir}/lineitem.parquet")
    duck = duckdb.connect()
    for name, files in (("orders", "orders.parquet/*.parquet"), ("lineitem", "lineitem.parquet"), ("documents", "documents.parquet")):
        duck.execute(f"create view {name} as select * from '{odd_dir}/{files}'")
    names = ["company_id", "claim", "evidence_id", "excerpt"]
    want = duck.execute(f"select {', '.join(names)} from ({ORACLE_SQL['hydrated_claims']})").fetchall()
    got = [tuple(r) for r in QUERIES["hydrated_claims"](spark, odd_dir).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[0] is None for r in got)
