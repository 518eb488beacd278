"""Queries of passage retrieval, question planning, transcripts and name resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.operators import entities as N
from factframe.operators import retrieval as R
from factframe.plans.text import _KEYWORDS_SQL, _TOKEN
from factframe.registry import query
from factframe.sources.tables import table

_WINDOWS_SQL = r"""pr AS (SELECT doc_id, unnest(parts) AS p, unnest(list_concat(seps, [''])) AS sep, generate_subscripts(parts, 1) AS i FROM (
  SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS parts, regexp_extract_all(text, '\n\s*\n') AS seps FROM documents WHERE text IS NOT NULL)),
ps AS (SELECT doc_id, p, CAST(coalesce(sum(length(p) + length(sep)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM pr),
w AS (SELECT * FROM (SELECT doc_id, b + c AS start, CASE WHEN length(p) <= 900 THEN p ELSE substr(p, c + 1, 900) END AS passage FROM (
  SELECT doc_id, b, p, unnest(CASE WHEN length(p) <= 900 THEN [0] ELSE range(0, length(p), 450) END) AS c FROM ps WHERE p <> '')) WHERE regexp_matches(passage, '\S'))"""
_NUMBERS_SQL = "list_filter(regexp_extract_all(lower({}), '" + _TOKEN + "'), lambda x: regexp_matches(x, '^[0-9]'))"
_TERMS_SQL = rf"""q AS (SELECT item_id, term, CASE WHEN regexp_matches(term, '^[0-9]') THEN 2 ELSE 1 END AS weight FROM (
  SELECT item_id, unnest(list_distinct({_KEYWORDS_SQL.format('text')} || {_NUMBERS_SQL.format('text')})) AS term FROM benchmark)),
t AS (SELECT doc_id, start, unnest(list_distinct({_KEYWORDS_SQL.format('passage')} || {_NUMBERS_SQL.format('passage')})) AS term FROM w),
c AS (SELECT item_id, doc_id, start, count(*) FILTER (weight = 1) AS n_words, count(*) FILTER (weight = 2) AS n_numbers FROM t JOIN q USING (term) GROUP BY ALL
  HAVING count(*) FILTER (weight = 1) >= 2 OR count(*) FILTER (weight = 2) >= 1)"""


_PREFERRED_SQL = "CASE " + " ".join(f"WHEN intent = '{i}' AND kind = '{k}' THEN {w}" for i, ks in R.PREFERRED.items() for k, w in ks.items()) + " ELSE 0 END"
_CUES_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + f" THEN '{n}'" for n, cues in R.INTENTS.items()) + " ELSE 'general' END"


_YEAR_SQL = "CASE WHEN length({0}) = 2 THEN '20' || {0} ELSE {0} END"
_DOC_KINDS = ("financial_results", "annual_report", "investor_presentation", "earnings_transcript", "brsr", "board_outcome", "regulatory_filing")
# the plans of the questions, and the candidates with the terms of kind and period
_BOOSTED_SQL = rf"""pl AS (SELECT item_id, text, {_CUES_SQL} AS intent, regexp_extract_all(upper(text), '{R.QUARTER}', 1) AS qn, regexp_extract_all(upper(text), '{R.QUARTER}', 2) AS qy, regexp_extract_all(regexp_replace(upper(text), '{R.QUARTER}', ' ', 'g'), '{R.YEAR}', 1) AS ys FROM benchmark),
p AS (SELECT item_id, intent, list_transform(list_zip(qn, qy), lambda z: 'q' || z[1] || 'fy' || {_YEAR_SQL.format('z[2]')}) || list_transform(ys, lambda y: 'fy' || {_YEAR_SQL.format('y')}) AS periods,
  CASE WHEN list_has_any(regexp_split_to_array(lower(text), '\s+'), {list(R.BROADEN)}) THEN 10 WHEN intent = 'financial_metric' AND len({_NUMBERS_SQL.format('text')}) > 0 AND len({_KEYWORDS_SQL.format('text')}) <= 3 THEN 3 ELSE 5 END AS top_k FROM pl),
k AS (SELECT c.*, intent, p.periods, list_extract({list(_DOC_KINDS)}, CAST(doc_id % {len(_DOC_KINDS)} AS INTEGER) + 1) AS kind, lower(regexp_replace(passage, '\s+', '', 'g')) AS squeezed FROM c JOIN p USING (item_id) JOIN w USING (doc_id, start)),
x AS (SELECT item_id, doc_id, start, n_words, n_numbers, n_words + 2 * n_numbers AS score, {_PREFERRED_SQL} AS doc_type, CASE WHEN len(list_filter(periods, lambda y: contains(squeezed, y))) > 0 THEN 40 ELSE 0 END AS period FROM k)"""


def _candidates(spark, sf_dir):
    terms = R.question_terms(table(spark, sf_dir, "benchmark"), "item_id")
    # dealt by document first: hits, best passages and overlaps are all counted within one
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return R.candidates(R.windows(docs), terms, "item_id")


@query(f"WITH {_WINDOWS_SQL} SELECT doc_id, start, length(passage) AS n_chars, md5(passage) AS digest FROM w")
def passage_windows(spark, sf_dir):
    found = R.windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", F.length("passage").cast("long").alias("n_chars"), F.md5(F.col("passage").cast("binary")).alias("digest"))


@query(f"WITH {_WINDOWS_SQL}, {_TERMS_SQL} SELECT item_id, doc_id, start, n_words, n_numbers, n_words + 2 * n_numbers AS score FROM c")
def passage_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


def _chosen_sql(source: str, order: str, k: int, per_document: int) -> str:
    """The greedy fold of each (question, document) over its ranked passages, and the k best of a question."""
    return f"""o AS (SELECT item_id, doc_id, list([{{'r': -{order}, 's': start}}] ORDER BY {order} DESC, start) AS l FROM {source} GROUP BY ALL),
g AS (SELECT item_id, doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(acc) < {per_document} AND len(list_filter(acc, lambda c: abs(c.s - x[1].s) < {R.WINDOW})) = 0 THEN acc || x ELSE acc END)) AS c FROM o),
z AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY c.r, doc_id, c.s) AS place, doc_id, c.s AS start, -c.r AS {order} FROM g QUALIFY place <= {k})"""


_TOPK_SQL = f"""WITH {_WINDOWS_SQL}, {_TERMS_SQL}, s AS (SELECT *, n_words + 2 * n_numbers AS score FROM c), {_chosen_sql("s", "score", 5, 5)}
SELECT item_id, place, doc_id, start, score FROM z"""


@query(_TOPK_SQL)
def passage_topk(spark, sf_dir):
    return R.overlap_free(_candidates(spark, sf_dir), "item_id", 5)


@query(_TOPK_SQL)
def passage_topk_bounded(spark, sf_dir):
    """The same passages, of which only those are built that bounds of terms and documents leave able to be chosen."""
    terms = R.question_terms(table(spark, sf_dir, "benchmark"), "item_id")
    passages = R.windows(table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id"))
    return R.overlap_free(R.bounded_candidates(passages, terms, "item_id", 5), "item_id", 5)


def _planned(spark, sf_dir, baseline: bool = False, date=None, wishes=None):
    """Ranked candidates of every question under its plan, with each term of the total; the baseline is a plan without preferences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*[F.lit(k) for k in _DOC_KINDS]), (F.col("doc_id") % len(_DOC_KINDS)).cast("int")).alias("kind"))
    plan = R.plans(table(spark, sf_dir, "benchmark"), "item_id")
    if baseline:
        plan = plan.withColumn("intent", F.lit("general")).withColumn("periods", F.array().cast("array<string>")).withColumn("top_k", F.lit(5))
    if wishes:
        plan, docs = plan.withColumns(wishes), docs.withColumn("date", date)
    periods = R.named_periods(R.windows(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return R.boosted(_candidates(spark, sf_dir), plan, docs, periods, "item_id"), plan


@query(f"""WITH {_WINDOWS_SQL}, {_TERMS_SQL}, {_BOOSTED_SQL}, s AS (SELECT *, 100 * score + doc_type + period AS total FROM x), {_chosen_sql("s", "total", 10, 10)}
SELECT item_id, place, doc_id, start, total FROM z JOIN p USING (item_id) WHERE place <= top_k""")
def passage_topk_planned(spark, sf_dir):
    ranked, plan = _planned(spark, sf_dir)
    return R.overlap_free(ranked, "item_id", 10, order="total", limits=plan)


_FIVE_SQL = """v AS (SELECT *, item_id % 2 = 0 AS recent, item_id % 3 = 0 AS numeric, CASE WHEN item_id % 4 = 1 THEN DATE '2020-06-01' END AS a, CASE WHEN item_id % 4 IN (1, 2) THEN DATE '2021-12-31' END AS b,
  CASE WHEN doc_id % 13 > 0 THEN DATE '2020-01-01' + CAST(doc_id * 7 % 1000 AS INTEGER) END AS date FROM x),
n AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY date DESC NULLS LAST, doc_id) - 1 AS place FROM (SELECT DISTINCT item_id, doc_id, date FROM v WHERE recent) QUALIFY place < 10),
s AS (SELECT v.*, 100 * score + doc_type + period + CASE WHEN date IS NOT NULL AND coalesce(a, b) IS NOT NULL AND (a IS NULL OR date >= a) AND (b IS NULL OR date <= b) THEN 25 ELSE 0 END
  + coalesce(30 - 3 * n.place, 0) + CASE WHEN numeric AND n_numbers > 0 THEN 20 ELSE 0 END AS total FROM v LEFT JOIN n USING (item_id, doc_id))"""


@query(f"""WITH {_WINDOWS_SQL}, {_TERMS_SQL}, {_BOOSTED_SQL}, {_FIVE_SQL}, {_chosen_sql("s", "total", 10, 10)}
SELECT item_id, place, doc_id, start, total FROM z JOIN p USING (item_id) WHERE place <= top_k""")
def passage_topk_five_terms(spark, sf_dir):
    """All five terms of the total: kind, date window, period, recency among a question's documents, and numbers, by what each question asks for."""
    dated = F.when(F.col("doc_id") % 13 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 7 % 1000).cast("int")))
    day = lambda when, text: F.when(when, F.lit(text).cast("date"))
    i = F.col("item_id")
    wishes = {"prefer_recent": i % 2 == 0, "prefer_numeric": i % 3 == 0, "window_start": day(i % 4 == 1, "2020-06-01"), "window_end": day((i % 4).isin(1, 2), "2021-12-31")}
    ranked, plan = _planned(spark, sf_dir, date=dated, wishes=wishes)
    return R.overlap_free(ranked, "item_id", 10, order="total", limits=plan)


@query(f"""WITH {_WINDOWS_SQL}, {_TERMS_SQL}, s AS (SELECT *, 100 * (n_words + 2 * n_numbers) AS total FROM c), {_chosen_sql("s", "total", 5, 10)} SELECT item_id, place, doc_id, start, total FROM z""")
def passage_topk_baseline(spark, sf_dir):
    """The plan without preferences; a test holds it against unplanned retrieval."""
    ranked, plan = _planned(spark, sf_dir, baseline=True)
    return R.overlap_free(ranked, "item_id", 10, order="total", limits=plan)


@query(f"""WITH {_WINDOWS_SQL}, {_TERMS_SQL}, p AS (SELECT item_id, {_CUES_SQL} AS intent FROM benchmark), k AS (SELECT c.*, intent, list_extract({list(_DOC_KINDS)}, CAST(doc_id % {len(_DOC_KINDS)} AS INTEGER) + 1) AS kind FROM c JOIN p USING (item_id))
SELECT item_id, count(*) AS candidates, CAST(sum({_PREFERRED_SQL}) AS BIGINT) AS boost, round(sum({_PREFERRED_SQL}) / sum(100 * (n_words + 2 * n_numbers) + {_PREFERRED_SQL}), 3) AS boost_share, count(DISTINCT kind) AS n_kinds FROM k GROUP BY item_id""")
def retrieval_aggregate(spark, sf_dir):
    """What the terms of the total add up to for each question: the share of boosts in it, and the kinds of document met."""
    ranked, _ = _planned(spark, sf_dir)
    boost = F.col("doc_type") + F.col("period") + F.col("recency") + F.col("numeric")
    return ranked.groupBy("item_id").agg(F.count("*").alias("candidates"), F.sum(boost).cast("long").alias("boost"), F.round(F.sum(boost) / F.sum("total"), 3).alias("boost_share"), F.count_distinct("kind").alias("n_kinds"))


@query(f"""WITH {_WINDOWS_SQL}, {_TERMS_SQL}, s AS (SELECT *, n_words + 2 * n_numbers AS score FROM c)
SELECT item_id, doc_id, start, score FROM s QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, start) = 1""")
def best_excerpt_per_doc(spark, sf_dir):
    best = _candidates(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.max_by(F.struct("start", "score"), F.struct("score", -F.col("start"))).alias("b"))
    return best.select("item_id", "doc_id", "b.start", "b.score")


_QUESTIONS = (
    "Compare revenue of Q3 FY24 and FY25", "What did management say about margins?", "List all litigation in Q1-FY2023 and q2fy23",
    "What guidance was given for FY 26?", "Which auditor signed?", "Revenue margin in 2024?", "Was anything else reported?",
)
_ASKED_SQL = "a AS (SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{t}')" for i, t in enumerate(_QUESTIONS)) + ") v(item_id, text))"


@query(rf"""WITH {_ASKED_SQL}, p AS (SELECT item_id, text, {_CUES_SQL} AS intent, regexp_extract_all(upper(text), '{R.QUARTER}', 1) AS qn, regexp_extract_all(upper(text), '{R.QUARTER}', 2) AS qy, regexp_extract_all(regexp_replace(upper(text), '{R.QUARTER}', ' ', 'g'), '{R.YEAR}', 1) AS ys FROM a),
e AS (SELECT item_id, text, intent, list_transform(list_zip(qn, qy), lambda z: 'Q' || z[1] || 'FY' || {_YEAR_SQL.format('z[2]')}) || list_transform(ys, lambda y: 'FY' || {_YEAR_SQL.format('y')}) AS found FROM p),
d AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS periods FROM e)
SELECT item_id, intent, periods, CAST(CASE WHEN list_has_any(regexp_split_to_array(lower(text), '\s+'), {list(R.BROADEN)}) THEN 10 WHEN intent = 'financial_metric' AND len({_NUMBERS_SQL.format('text')}) > 0 AND len({_KEYWORDS_SQL.format('text')}) <= 3 THEN 3 ELSE 5 END AS INTEGER) AS top_k FROM d""")
def plan_intent(spark, sf_dir):
    return _asked_plans(spark, sf_dir).drop("rules")


def _asked_plans(spark, sf_dir):
    asked = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(_QUESTIONS)], "item_id long, text string")
    return R.plans(table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(asked), "item_id")


@query(rf"""WITH {_ASKED_SQL}, p AS (SELECT item_id, text, {_CUES_SQL} AS intent FROM a),
f AS (SELECT CASE WHEN intent = 'general' THEN 'intent_fallback' ELSE 'intent_keyword_match' END AS rule FROM p UNION ALL SELECT 'doc_type_boost_from_intent' FROM p WHERE intent <> 'general' UNION ALL SELECT 'period_extraction' FROM p WHERE regexp_matches(upper(text), '{R.YEAR}') OR regexp_matches(upper(text), '{R.QUARTER}')
  UNION ALL SELECT CASE WHEN list_has_any(regexp_split_to_array(lower(text), '\s+'), {list(R.BROADEN)}) THEN 'top_k_broaden_list_query' WHEN intent = 'financial_metric' AND len({_NUMBERS_SQL.format('text')}) > 0 AND len({_KEYWORDS_SQL.format('text')}) <= 3 THEN 'top_k_narrow_specific_metric' ELSE 'top_k_default' END FROM p),
r AS (SELECT unnest({list(R.RULES)}) AS rule)
SELECT r.rule, count(f.rule) AS fired, count(f.rule) = 0 AS dead FROM r LEFT JOIN f USING (rule) GROUP BY r.rule""")
def planner_aggregate(spark, sf_dir):
    """How often each rule fired over a suite of questions; a rule that never fires is dead."""
    fired = _asked_plans(spark, sf_dir).select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("_n"))
    declared = spark.createDataFrame([(r,) for r in R.RULES], "rule string")
    return declared.join(fired, "rule", "left").select("rule", F.coalesce("_n", F.lit(0)).alias("fired"), F.col("_n").isNull().alias("dead"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS answer_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, length(text) AS n_question, CASE WHEN answer_role = 'assistant' THEN length(substr(answer, 1, 3000)) END AS n_answer FROM t WHERE role = 'user'""")
def question_turns(spark, sf_dir):
    """Analysts' turns with the answer that follows, bounded at 3,000 characters as the quoted excerpt is."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").withColumn("answer_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return turns.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("n_question"), F.when(F.col("answer_role") == "assistant", F.length(F.substring("answer", 1, 3000)).cast("long")).alias("n_answer"))


@query("""WITH t AS (SELECT conv_id, turn, role, CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, any_value(total) AS total, coalesce(min(before) FILTER (role = 'user' AND before >= 0.1 * total), CAST(floor(any_value(total) * 0.6) AS BIGINT)) AS cut,
count(*) FILTER (role = 'user' AND before >= 0.1 * total) > 0 AS found FROM t GROUP BY conv_id""")
def prepared_vs_qa(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), "text")
    placed = turns.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(w))
    opens = (F.col("role") == "user") & (F.col("before") >= 0.1 * F.col("total"))
    return placed.groupBy("conv_id").agg(F.max("total").alias("total"), F.coalesce(F.min(F.when(opens, F.col("before"))), F.floor(F.max("total") * 0.6)).alias("cut"), (F.count_if(opens) > 0).alias("found"))


@query("SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY ALL")
def first_turn_per_speaker(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


_NAMES = ("T B Lund", "Tora B Lund", "Tim B Lund", "Dr. T. B. Lund", "Mira Olsen", "M Olsen", "Prof. Max Olsen", "P. Quist", "Pia Quist")


@query()
def entity_resolve_person(spark, sf_dir):
    given = spark.sql("select * from values " + ", ".join(f"({i}L, '{n}')" for i, n in enumerate(_NAMES)) + " as t(mention_id, name)")
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("mention_id"), F.translate("c_name", "#", " ").alias("name"))
    return N.resolve_persons(given.unionByName(customers))
