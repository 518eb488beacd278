"""Extractors of letters on odd texts: what is missing is null or an empty list, and nothing fails."""

import datetime

import pytest
from pyspark.sql import functions as F

from factframe.functions import letters as L
from factframe.sources.letters import KINDS, letters


def one(spark, function, text):
    return spark.createDataFrame([(text,)], "t string").select(function(F.col("t")).alias("v")).first()["v"]


def rows(found):
    return [tuple(r) for r in found]


@pytest.mark.parametrize("text", ["", "nothing to read here", "Annexure A", "Rs. crore % FY | | |", None])
def test_texts_without_facts(spark, text):
    for function in (L.dividends, L.ratings, L.resolutions, L.board, L.chart, L.bullets):
        assert not one(spark, function, text)
    assert not one(spark, L.holdings, text)
    assert set(tuple(one(spark, L.buyback, text))) == set(tuple(one(spark, L.acquisition, text))) == {None}
    assert one(spark, L.results, text)["period"] is None and not one(spark, L.results, text)["rows"]


def test_dividends_and_dates(spark):
    text = "An Interim dividend of Rs 3 and a SPECIAL dividend of Rs. 0.75. The record date is fixed for May 5, 2021. Paid later."
    assert rows(one(spark, L.dividends, text)) == [("interim", 3.0), ("special", 0.75)]
    assert one(spark, lambda t: L.day_after(t, "record date"), text) == datetime.date(2021, 5, 5)
    assert one(spark, lambda t: L.day_after(t, "paid on"), text) is None


def test_sections_in_either_order_and_absent(spark):
    assert tuple(one(spark, L.sections, "x\nAnnexure B\nb\nAnnexure A\na")) == ("x\n", "a", "b\n")
    assert tuple(one(spark, L.sections, "no heading: Annexure A within a line")) == ("no heading: Annexure A within a line", None, None)


def test_votes_that_make_a_hundred(spark):
    assert tuple(one(spark, L.complements, "12.5000 71.0000 60.0001 39.9999 100.0000")) == (60.0001, 39.9999)
    assert tuple(one(spark, L.complements, "12.5000 71.0000")) == (None, None)
    (r,) = one(spark, L.resolutions, "Item 3. A thing\nSpecial resolution\n74.9999 25.0001\n")
    assert tuple(r) == (3, "A thing", "special", 74.9999, 25.0001, "not_passed")


def test_holdings_by_scale(spark):
    tag = "<share context='{}'>{}</share>"
    assert one(spark, L.holdings, tag.format("A", "0.5") + tag.format("B", "0.25") + tag.format("A", "0.6")) == {"B": 25.0, "A": 60.0}
    assert one(spark, L.holdings, tag.format("A", "1.6") + tag.format("B", "0.25")) == {"A": 1.6, "B": 0.25}


def test_values_of_rows(spark):
    text = "Revenue from operations\n 2,37,983 (340) -\nOther income - 5\nTrade receivables (4) 9.5"
    assert one(spark, lambda t: L.values_after(t, "Revenue from operations"), text) == [237983.0, -340.0, 0.0]
    assert rows(one(spark, L.results, text)["rows"]) == [("revenue", 237983.0), ("other_income", 0.0), ("receivables", 9.5)]


def test_charts_pair_first_to_first(spark):
    assert rows(one(spark, L.chart, "FY2020 FY2021 FY2022 then 5% and 6.5%")) == [(2020, 5.0), (2021, 6.5)]


def test_every_order_has_a_letter(spark, sf_dir):
    found = letters(spark, sf_dir)
    assert {r["kind"]: r["n"] for r in found.groupBy("kind").agg(F.count("text").alias("n")).collect()} == {k: found.count() // 10 for k in KINDS}
