"""Text rules and retrieval against plain Python and answers worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factframe.functions import filings as L
from factframe.functions import scalars as S
from factframe.functions import text as X
from factframe.operators import retrieval as R
from factframe.plans import passages, text


def one(spark, column, *values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("c")).alias("out")).collect()]


def test_ocr_repairs(spark):
    given = ("3.27,951.46", "2.21.071.22", "69.327.15", "45.339 45", "79.66L.92", "3,38.407.31", "5.6", "L5", None)
    assert one(spark, X.fix_ocr_numbers, *given) == ["3,27,951.46", "2,21,071.22", "69,327.15", "45,339.45", "79,661.92", "3,38,407.31", "5.6", "L5", None]


def test_numbers(spark):
    assert one(spark, X.parse_number, "2,37,983.50", "(1,234.5)", "-", " ", "abc", "( 5 )", ",", None) == [237983.5, -1234.5, 0.0, 0.0, None, -5.0, None, None]
    found = one(spark, X.number_tokens, "Profit (340) of 2,37,983.5 - and x-1 2-3", "")
    assert found == [["(340)", "2,37,983.5", "-", "1", "2", "3"], []]


def test_number_tokens_equal_plain_code(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("12,.() -aL|\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = [re.findall(r"\([\d,]+(?:\.\d+)?\)|(?<!\w)-(?!\w)|[\d,]+(?:\.\d+)?", t) for t in texts]
    assert one(spark, X.number_tokens, *texts) == want


def test_garbled_words(spark):
    fine = "Sales Q3FY27 ₹31,270 60–70 Level4 AB12 SqlServer a€ 'quoted' (l) …"
    bad = "pr€fitS lNcome sTa4emenT été"
    got = one(spark, X.garbled_words, fine, bad, "", None)
    assert [(r["words"], r["garbled"]) for r in got[:3]] == [(11, 1), (4, 4), (0, 0)]  # a€ is the one


def test_risk_rules(spark):
    long = "the impact of a new store layout on opening hours is shown on this page"
    rows = [(long, 1, False), (long, 2, True), (long + " and it may disrupt trade", 1, True), ("Litigation", 1, True), (long + " impact impact", 1, False)]
    frame = spark.createDataFrame(rows, "t string, n int, want boolean")
    assert all(r.got == r.want for r in frame.select("want", X.high_confidence_risk(F.col("t"), F.col("n")).alias("got")).collect())
    assert one(spark, X.plausible_risk, long, "short", long + " http://x", long.replace("impact", "person appointed as head"), "***" + " " * 60 + "1.5") == [True, False, False, False, False]


def test_targets_and_guidance(spark):
    assert one(spark, X.target_tokens, "31-33%, 31-33% and 50 - 60 MTPA, <3 tCO2e, 12 pages, 6x") == [["31-33%", "50 - 60 mtpa", "<3 tco2e", "6x"]]
    assert one(spark, X.guidance_statements, "Target of 5 now. TARGET of 5 now. guidance\nis 7. aspires to 8. targeting 9", "none") == [["Target of 5 now", "guidance is 7", "aspires to 8"], []]


def test_classifier_rules(spark):
    rows = [
        ("annual_report", "Sub: Related Party Transactions", 90, ("regulatory_filing", True, "reclassified")),
        ("regulatory_filing", "Sub: Reg 23(9)", None, ("regulatory_filing", True, "passed")),
        ("earnings_transcript", "Sub: Schedule of the call", 9, ("earnings_transcript", False, "notice")),
        ("earnings_transcript", "Sub: Schedule of the transcript", 9, ("earnings_transcript", True, "passed")),
        ("brsr", "no line", 2, ("brsr", False, "too_short")),
        ("brsr", "x" * 3000 + "Sub: Schedule of", 5, ("brsr", True, "passed")),
        ("other", "Sub: Schedule of", 1, ("other", True, "passed")),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "kind string, text string, pages int")
    got = frame.select(L.classified(F.col("kind"), F.col("text"), F.col("pages")).alias("v")).collect()
    assert [tuple(r.v) for r in got] == [r[3] for r in rows]


def test_scalars(spark):
    assert one(spark, S.lenient_json, '```json\n{"a": {"b": 1}}\n```', 'x {"a": 2} y', "{bad}", "") [:2] == ['{"a": {"b": 1}}', '{"a": 2}']
    assert one(spark, S.clean_role, "Chairman of the Company, subject to law", "Head, ") == ["Chairman", "Head"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = ["", "\n\n", "a\n \nb", "one paragraph", " \n\n x", "word " * 400, "y" * 900 + "\n\n\n" + "z " * 1000]
    for _ in range(40):
        out.append("".join(rng.choice(["word ", "nine 9 ", "\n", "\n\n", "\n \n", "long " * 250, "  "]) for _ in range(rng.randint(1, 12))))
    return out


def plain_windows(content):
    out, at = [], 0
    for match in [*re.finditer(r"\n\s*\n", content), None]:
        end = match.start() if match else len(content)
        part = content[at:end]
        cuts = range(0, len(part), 450) if len(part) > 900 else [0]
        out += [(at + c, part[c : c + 900]) for c in cuts if re.search(r"\S", part[c : c + 900])]
        at = match.end() if match else end
    return out


def test_windows_equal_plain_code(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in R.windows(docs).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.passage))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain_windows(t), i
        assert all(t[s : s + len(p)] == p for s, p in got.get(i, []))


def test_overlap_free_equals_a_greedy_choice(spark):
    rng = random.Random(5)
    rows = [(q, d, s * 450, rng.randint(1, 6)) for q in range(4) for d in range(5) for s in range(12) if rng.random() < 0.7]
    frame = spark.createDataFrame(rows, "q long, doc_id long, start long, score long")
    for per in (None, 2):
        got = {}
        for r in R.overlap_free(frame, "q", 7, per_document=per).orderBy("q", "place").collect():
            got.setdefault(r.q, []).append((r.doc_id, r.start))
        for q in range(4):
            chosen = []
            for _, d, s, score in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1], r[2])):
                same = [x for x in chosen if x[0] == d]
                if len(chosen) < 7 and all(abs(s - x[1]) >= 900 for x in same) and len(same) < (per or 7):
                    chosen.append((d, s))
            assert got[q] == chosen


def test_plan_without_preferences_is_unplanned_retrieval(spark, sf_dir):
    shape = lambda df: sorted((r.item_id, r.place, r.doc_id, r.start) for r in df.collect())
    assert shape(passages.passage_topk_baseline(spark, sf_dir)) == shape(passages.passage_topk(spark, sf_dir))


def test_boosts(spark):
    docs = spark.createDataFrame([(1, "annual_report", "2024-05-01"), (2, "brsr", None)], "doc_id long, kind string, date string").withColumn("date", F.col("date").cast("date"))
    body = spark.createDataFrame([(1, "risk factor litigation in Q3 FY2024"), (2, "risk and litigation 24.2 in q4 fy 2024")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "What litigation risk was in Q3 FY24?")], "item_id long, text string")
    plan = R.plans(asked, "item_id")
    assert plan.first().asDict() == {"item_id": 7, "intent": "risk", "periods": ["Q3FY2024"], "top_k": 5, "rules": ["intent_keyword_match", "doc_type_boost_from_intent", "period_extraction", "top_k_default"]}
    found = R.candidates(R.windows(body), R.question_terms(asked, "item_id"), "item_id")
    wishing = plan.withColumn("prefer_recent", F.lit(True)).withColumn("prefer_numeric", F.lit(True))
    got = {r.doc_id: (r.doc_type, r.period, r.recency, r.numeric, r.total) for r in R.boosted(found, wishing, docs, R.named_periods(R.windows(body)), "item_id").collect()}
    assert got == {1: (60, 40, 30, 20, 550), 2: (25, 0, 27, 0, 252)}  # the 3 of the quarter is a number hit


def test_running_budget_of_one_source_in_shards(spark, tmp_path):
    rows = [(i, "a" * (i % 97), "src") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.used for r in text.running_budget(spark, str(tmp_path), shard=100).collect()}
    used, want = 0, {}
    for i, t, _ in rows:
        used += len(t)
        if used <= 20000:
            want[i] = used
    assert got == want
