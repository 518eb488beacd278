"""Literal fixtures: expected answers written out by hand."""

import datetime as dt
import hashlib
import random
import re

from pyspark.sql import functions as F

from factframe.functions import text as X
from factframe.operators import entities, provenance, retrieval, series


def day(s):
    return dt.date.fromisoformat(s)


def test_change_policies(spark):
    rows = [("a", day("2023-03-31"), 100.0), ("a", day("2024-03-31"), None), ("a", day("2025-03-31"), 110.0)]
    df = spark.createDataFrame(rows, "company string, period date, v double")
    keep = {r.period: r.change for r in series.change_keeping_nulls(df, "v", ["company"]).collect()}
    assert keep == {day("2023-03-31"): None, day("2024-03-31"): None, day("2025-03-31"): None}
    skip = {r.period: r.change for r in series.change_skipping_nulls(df, "v", ["company"]).collect()}
    assert skip[day("2023-03-31")] is None and abs(skip[day("2025-03-31")] - 10.0) < 1e-9


def test_zero_prior_has_no_change(spark):
    df = spark.createDataFrame([("a", day("2023-03-31"), 0.0), ("a", day("2024-03-31"), 5.0)], "company string, period date, v double")
    assert [r.change for r in series.change_keeping_nulls(df, "v", ["company"]).collect()] == [None, None]


def test_streaks_and_nearest_year(spark):
    fpi = [31.5, 29.0, 27.75, 26.5, 22.0]
    quarters = [day(d) for d in ("2018-06-30", "2018-09-30", "2018-12-31", "2019-03-31", "2019-06-30")]
    df = spark.createDataFrame([("fpi", q, v) for q, v in zip(quarters, fpi)], "kind string, period date, v double")
    found = series.streaks(df, "v", ["kind"]).collect()
    assert [(r.direction, r.first_period) for r in found] == [("falling", day("2019-03-31"))]
    near = series.yoy_nearest(df, "v", ["kind"]).collect()
    assert [(r.period, r.prior_period) for r in near] == [(day("2019-06-30"), day("2018-06-30"))]


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 10, "x"), (1, 15, "y")], "k int, rat int, label string")
    got = {(r.k, r["at"]): r.label for r in series.asof_before(left, right, ["k"], "at", "rat", ["label"]).collect()}
    assert got == {(1, 10): None, (1, 20): "y", (2, 5): None}


def test_names(spark):
    names = ["T B Lund", "Tora B Lund", "Dr. T. B. Lund", "Tora B Lund", "M Olsen"]
    df = spark.createDataFrame(list(enumerate(names)), "mention_id long, name string")
    got = {r.mention_id: (r.entity_id, r.canonical) for r in entities.resolve_persons(df).collect()}
    assert got[0][0] == got[1][0] == got[2][0] == got[3][0] == 0 and got[1][1] == "Tora B Lund" and got[4][0] == 4


def test_blocks_of_names_share_a_task(spark):
    """Blocks that span batches resolve as in one, and no block is a Python group of its own."""
    names = [f"{given} Name{i}" for given in ("Tora", "T", "Max", "M") for i in range(40)]
    df = spark.createDataFrame(list(enumerate(names)), "mention_id long, name string")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "3")
    try:
        found = entities.resolve_persons(df)
        got = {r.mention_id: (r.entity_id, r.canonical) for r in found.collect()}
    finally:
        spark.conf.set(batch, before)
    assert got == {i: (i // 80 * 80 + i % 40, names[i // 80 * 80 + i % 40]) for i in range(160)}
    assert "MapInArrow" in (plan := found._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan


def test_two_full_names_stay_apart(spark):
    df = spark.createDataFrame(list(enumerate(["Tora B Lund", "Tim B Lund", "T B Lund"])), "mention_id long, name string")
    assert spark_set(entities.resolve_persons(df), "entity_id") == {0, 1, 2}


def spark_set(df, column):
    return {r[column] for r in df.collect()}


def test_windows_keep_offsets(spark):
    text = "first paragraph\n\n" + "x" * 1000 + "\n\nlast"
    got = sorted((r.start, r.passage) for r in retrieval.windows(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert all(text[s : s + len(p)] == p for s, p in got)
    assert [s for s, _ in got] == [0, 17, 17 + 450, 17 + 900, 1019]


def test_overlap_free_top_k(spark):
    rows = [(1, 1, 0, 5), (1, 1, 450, 9), (1, 1, 900, 4), (1, 2, 0, 5)]
    got = retrieval.overlap_free(spark.createDataFrame(rows, "item_id long, doc_id long, start long, score long"), "item_id", 3).collect()
    assert [(r.place, r.doc_id, r.start) for r in sorted(got, key=lambda r: r.place)] == [(1, 1, 450), (2, 2, 0)]


def test_overlap_free_top_k_of_many_documents_is_limited_before_the_shuffle(spark):
    rows = [(i % 3, i, 0, i * 7919 % 101) for i in range(3000)]
    top = retrieval.overlap_free(spark.createDataFrame(rows, "item_id long, doc_id long, start long, score long"), "item_id", 5)
    want = [(q, n + 1, r[1], r[3]) for q in range(3) for n, r in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))[:5])]
    assert sorted((r.item_id, r.place, r.doc_id, r.score) for r in top.collect()) == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_every_number_of_a_document_is_repaired_and_parsed(spark, tmp_path):
    """The whole text is repaired, then its numbers are read, in plain Python."""
    from factframe.plans.text import ocr_number_fix

    rng = random.Random(5)
    texts = ["".join(rng.choices(["1", "27", "903", "L", ",", ".", " ", " ", "of", "(", ")", "-", "x", "\n", "12.345.67", "5.123 45"], k=rng.randint(0, 40))) for _ in range(400)]
    texts += ["paid 2.21.071.22 of 69.327.15, then (45.339 45) and 79.66L.92.", None]
    spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in sorted(ocr_number_fix(spark, str(tmp_path)).where("doc_id >= 100").collect(), key=lambda r: (r.doc_id, r.position)):
        assert r.position == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.token, r.value))
    repairs = ((r"(?<=\d)L(?=[.\d])", "1"), (r"(?<!\d)(\d{1,2})\.(\d{2}),(\d{3})\.(\d{2})(?!\d)", r"\1,\2,\3.\4"), (r"(?<!\d)(\d{1,2})\.(\d{2})\.(\d{3})\.(\d{2})(?!\d)", r"\1,\2,\3.\4"), (r"(?<!\d)(\d+)\.(\d{3})\.(\d{2})(?!\d)", r"\1,\2.\3"), (r"(?<!\d)(\d+)\.(\d{3}) (\d{2})(?!\d)", r"\1,\2.\3"))
    for i, text in enumerate(texts, 100):
        for pattern, to in repairs:
            text = re.sub(pattern, to, text or "")
        assert [t for t, _ in got.get(i, [])] == re.findall(r"\([\d,]+(?:\.\d+)?\)|(?<!\w)-(?!\w)|[\d,]+(?:\.\d+)?", text), texts[i - 100]
    assert [v for _, v in got[500]] == [221071.22, 69327.15, None, -45339.45, 79661.92]


def test_normalised_keeps_accents(spark):
    df = spark.createDataFrame([("Étion,  RISK—of\tfire",)], "t string")
    assert df.select(X.normalised(F.col("t"))).first()[0] == "étion risk of fire"


def test_digest_ignores_order_and_sees_changes(spark):
    rows = [(1, "a"), (2, "b"), (2, "b")]
    make = lambda r: provenance.digest(spark.createDataFrame(r, "k int, v string")).first()
    assert make(rows) == make(rows[::-1]) != make(rows[:2])


def test_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(2, 3.0), (3, None), (4, 4.0)], "k int, v double")
    assert {(r.k, r.change) for r in provenance.diff(a, b, ["k"], "v").collect()} == {(1, "-"), (2, "~"), (4, "+")}


def test_versions(spark):
    df = spark.createDataFrame([("1.10",), ("1.9.rc",), ("1.9",)], "v string").orderBy(provenance.version_key(F.col("v")))
    assert [r.v for r in df.collect()] == ["1.9", "1.9.rc", "1.10"]


def test_digest_of_more_rows_than_a_long_can_sum(spark):
    n = 100_000
    got = provenance.digest(spark.range(n).select(F.col("id").alias("k"))).first()
    hashes = [hashlib.md5(str(k).encode()).hexdigest() for k in range(n)]
    sums = [sum(int(h[at : at + 12], 16) for h in hashes) for at in (0, 12)]
    assert min(sums) >= 2**63 and tuple(got) == (n, *(x % 2**63 for x in sums))


def test_parts_of_a_report_share_their_totals(spark, sf_dir):
    """Lines are read for the totals, which are written, and once more for segments."""
    from factframe.plans.evaluation import report_sections

    plan = report_sections(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
