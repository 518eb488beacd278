"""Bounded retrieval and the terms of a total, against plain scoring."""

import datetime

from pyspark.sql import functions as F

from factframe.operators import retrieval as R
from factframe.sources.tables import table


def test_bounds_leave_the_chosen_passages_and_few_others(spark):
    sf_dir = "/root/testdata/sf0.01"
    terms = R.question_terms(table(spark, sf_dir, "benchmark"), "item_id")
    passages = R.windows(table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id"))
    every = R.candidates(passages, terms, "item_id").cache()
    for k in (1, 3, 10):
        some = R.bounded_candidates(passages, terms, "item_id", k).cache()
        assert some.exceptAll(every.select(*some.columns)).isEmpty()
        chosen = [sorted(map(tuple, R.overlap_free(frame, "item_id", k).collect())) for frame in (every, some)]
        assert chosen[0] == chosen[1] and chosen[0]
        assert some.count() <= every.count() / 2
        some.unpersist()
    every.unpersist()


def test_each_term_of_a_total(spark):
    day = datetime.date
    found = spark.createDataFrame([(1, d, 0, 2, 1 if d == 3 else 0, 4) for d in range(14)] + [(2, 3, 0, 2, 1, 4)], "q long, doc_id long, start long, n_words long, n_numbers long, score long")
    docs = spark.createDataFrame([(d, "brsr" if d == 1 else "other", None if d == 5 else day(2020, 1, 1 + d)) for d in range(14)], "doc_id long, kind string, date date")
    periods = spark.createDataFrame([(2, 0, ["q3fy2024"])], "doc_id long, start long, periods array<string>")
    plan = spark.createDataFrame(
        [(1, "esg", ["FY2024"], True, True, day(2020, 1, 4), day(2020, 1, 7)), (2, "general", [], False, False, None, None)],
        "q long, intent string, periods array<string>, prefer_recent boolean, prefer_numeric boolean, window_start date, window_end date",
    )
    got = {(r["q"], r["doc_id"]): r for r in R.boosted(found, plan, docs, periods, "q").collect()}
    newest = [d for d in range(13, -1, -1) if d != 5] + [5]
    for d in range(14):
        r, place = got[1, d], newest.index(d)
        want = (70 if d == 1 else 0, 25 if 3 <= d <= 6 and d != 5 else 0, 40 if d == 2 else 0, max(0, 30 - 3 * place), 20 if d == 3 else 0)
        assert (r["doc_type"], r["window"], r["period"], r["recency"], r["numeric"]) == want
        assert r["total"] == 400 + sum(want)
    assert got[2, 3]["total"] == 400


def test_a_half_open_window_and_plans_without_wishes(spark):
    found = spark.createDataFrame([(1, d, 0, 2, 0, 2) for d in range(3)], "q long, doc_id long, start long, n_words long, n_numbers long, score long")
    docs = spark.createDataFrame([(d, "other", None if d == 2 else datetime.date(2020, 1, 1 + d)) for d in range(3)], "doc_id long, kind string, date date")
    none = spark.createDataFrame([], "doc_id long, start long, periods array<string>")
    plan = spark.createDataFrame([(1, "general", [])], "q long, intent string, periods array<string>")
    assert {r["total"] for r in R.boosted(found, plan, docs, none, "q").collect()} == {200}
    later = plan.withColumn("window_start", F.lit("2020-01-02").cast("date"))
    assert {r["doc_id"]: r["window"] for r in R.boosted(found, later, docs, none, "q").collect()} == {0: 0, 1: 25, 2: 0}
