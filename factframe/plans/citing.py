"""Excerpts with their headings, citations, coverage of suites, registry lookups, and judgments as they are appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factframe.functions import excerpts as X
from factframe.operators.judgments import JudgmentStore
from factframe.operators.storage import fresh_folder
from factframe.plans.passages import _ASKED_SQL, _CUES_SQL, _asked_plans
from factframe.registry import query
from factframe.sources.filings import KIND_SQL, documents
from factframe.sources.tables import LONG_SQL, long_facts, snapshots, table

ANCHOR = "ing"


@query(rf"""
WITH a AS (SELECT doc_id, text, strpos(text, '{ANCHOR}') - 1 AS pos FROM documents WHERE contains(text, '{ANCHOR}')),
b AS (SELECT *, greatest(0, pos - 120) AS s, least(length(text), pos + 120) AS e FROM a),
c AS (SELECT *, length(regexp_extract(reverse(substr(text, 1, s)), '^\S*')) AS l, length(regexp_extract(substr(text, e + 1), '^\S*')) AS r FROM b),
h AS (SELECT doc_id, list_filter(list_transform(list_reverse(string_split(substr(text, greatest(0, pos - 500) + 1, pos - greatest(0, pos - 500)), chr(10))), lambda x: trim(x, ' ')), lambda x: x <> '' AND length(x) <= 80 AND right(x, 1) NOT IN ('.', ',', ';'))[1] AS heading FROM a)
SELECT doc_id, pos AS anchor, regexp_replace(substr(text, s - l + 1, e - s + l + r), '^\s+|\s+$', '', 'g') AS excerpt, heading, replace(substr(text, pos + 1, 120), chr(10), ' ') AS snippet FROM c JOIN h USING (doc_id)""")
def excerpts_around_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around the first place of a word in each document: the excerpt to whole words, the heading before it, and a snippet from there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.instr("text", ANCHOR) - 1).alias("anchor")).where("anchor >= 0")
    text, anchor = F.col("text"), F.col("anchor")
    return docs.select("doc_id", anchor.cast("long").alias("anchor"), X.trimmed_excerpt(text, anchor).alias("excerpt"), X.heading_before(text, anchor).alias("heading"), X.snippet(text, anchor).alias("snippet"))


@query("""
WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 3 THEN 1 ELSE 0 END AS INTEGER) AS fy, CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 1 ELSE 2 END AS half FROM orders WHERE o_orderdate >= DATE '2000-04-01')
SELECT id, 'H' || half || ' FY' || right(CAST(fy AS VARCHAR), 2) AS label, CASE WHEN half = 1 THEN make_date(fy - 1, 9, 30) ELSE make_date(fy, 3, 31) END AS half_end,
  CASE WHEN id % 3 = 0 THEN day WHEN id % 3 = 1 THEN make_date(fy, 3, 31) ELSE make_date(fy + 2, 3, 31) END AS year_end FROM o""")
def halves_and_nearest_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of half years by their labels, and the fiscal year that a statement names nearest before its value."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '2000-04-01'").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("string").alias("value"))
    fy = F.year("day") + (F.month("day") > 3).cast("int")
    half = F.when(F.month("day").between(4, 9), "1").otherwise("2")
    label = F.concat(F.lit("H"), half, F.lit(" FY"), F.right(fy.cast("string"), F.lit(2)))
    far = F.concat(F.lit("Target of FY2099 was set long ago, and much has been said of it since then: "), F.lit("it stands at "))
    said = F.when(F.col("id") % 3 == 0, far).when(F.col("id") % 3 == 1, F.concat(F.lit("FY2098 aside, fy "), F.right(fy.cast("string"), F.lit(2)), F.lit(" closed at "))).otherwise(F.concat(F.lit("By FY"), (fy + 2).cast("string"), F.lit(" we aim for ")))
    told = orders.withColumn("label", label).withColumn("_said", said).withColumn("_text", F.concat("_said", "value", F.lit(", beyond FY2001.")))
    return told.select("id", "label", X.half_year_end(F.col("label")).alias("half_end"), X.nearest_year_end(F.col("_text"), F.length("_said"), F.col("day")).alias("year_end"))


@query(f"""
WITH s AS (SELECT l_suppkey AS company_id, l_orderkey AS evidence_id, min(l_linenumber * 100000000 + l_partkey) AS seq FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seq, evidence_id) AS place, count(*) OVER (PARTITION BY company_id) AS n FROM s),
d AS (SELECT o_orderkey AS evidence_id, {KIND_SQL} || ' of ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS label FROM orders WHERE o_orderkey % 3 > 0)
SELECT company_id, coalesce(label, CAST(evidence_id AS VARCHAR)) || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ' more)' ELSE '' END AS citation, evidence_id AS first_seen, n FROM p LEFT JOIN d USING (evidence_id) WHERE place = 1""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each company rests on: the source seen first, by its label or else its id, and how many more there are."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("company_id"), F.col("l_orderkey").alias("evidence_id")).agg(F.min(F.col("l_linenumber") * F.lit(100_000_000).cast("long") + F.col("l_partkey")).alias("seq"))
    # the first of each company and the number of all: one row leaves each map task
    first = seen.groupBy("company_id").agg(F.min_by("evidence_id", F.struct("seq", "evidence_id")).alias("evidence_id"), F.count("*").alias("n"))
    named = documents(spark, sf_dir).where("evidence_id % 3 > 0").select("evidence_id", F.concat("doc_kind", F.lit(" of "), F.col("source_date").cast("string")).alias("label"))
    label = F.coalesce("label", F.col("evidence_id").cast("string"))
    more = F.when(F.col("n") > 1, F.concat(F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return first.join(named, "evidence_id", "left").select("company_id", F.concat(label, more).alias("citation"), F.col("evidence_id").alias("first_seen"), "n")


@query("""
WITH s AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT user_id, list(event_type ORDER BY first_id) AS kinds, any_value(n) AS n FROM s JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY ALL) USING (user_id) GROUP BY user_id""")
def kinds_in_order_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's different kinds of event in the order in which they were first seen."""
    seen = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "event_type")))
    return seen.groupBy("user_id").agg(ordered["event_type"].alias("kinds"), F.sum("_n").alias("n"))


@query("""SELECT user_id AS finding, count(DISTINCT event_id) AS n_cited, count(DISTINCT event_id) FILTER (event_id IN (SELECT doc_id FROM documents WHERE text <> '')) AS n_usable,
list_sort(list_distinct(list(event_id) FILTER (event_id IN (SELECT doc_id FROM documents WHERE text <> '')))) AS usable FROM events GROUP BY user_id HAVING n_usable > 0""")
def cited_and_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what each finding cites, what is held with content."""
    cited = table(spark, sf_dir, "events").select(F.col("user_id").alias("finding"), F.col("event_id").alias("id")).distinct()
    held = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("id")).distinct()
    counts = cited.groupBy("finding").agg(F.count("*").alias("n_cited"))
    usable = cited.join(held, "id", "left_semi").groupBy("finding").agg(F.count("*").alias("n_usable"), F.array_sort(F.collect_list("id")).alias("usable"))
    return usable.join(counts, "finding").select("finding", "n_cited", "n_usable", "usable")


@query(f"""
WITH {_ASKED_SQL}, p AS (SELECT item_id, item_id % 7 AS subject, {_CUES_SQL} AS intent FROM a), n AS (SELECT count(*) AS n FROM p),
s AS (SELECT subject, count(*) AS k FROM p GROUP BY subject), i AS (SELECT intent, count(*) AS k FROM p GROUP BY intent)
SELECT n.n AS cases, (SELECT count(*) FROM i) AS intents, round(coalesce((SELECT k FROM i WHERE intent = 'general'), 0) / n.n, 4) AS general_share,
  (SELECT min(subject) FROM s WHERE k = (SELECT max(k) FROM s)) AS top_subject, round((SELECT max(k) FROM s) / n.n, 4) AS top_subject_share FROM n""")
def suite_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly a suite asks: its intents, the share of questions without one, and the subject that most are about."""
    plans = _asked_plans(spark, sf_dir).select((F.col("item_id") % 7).alias("subject"), "intent")
    counts = plans.groupBy("subject", "intent").agg(F.count("*").alias("k"))
    subjects = counts.groupBy("subject").agg(F.sum("k").alias("k")).agg(F.min_by("subject", F.struct((-F.col("k")).alias("k"), "subject")).alias("top_subject"), F.max("k").alias("_most"))
    whole = counts.agg(F.sum("k").alias("cases"), F.count_distinct("intent").alias("intents"), F.coalesce(F.sum(F.when(F.col("intent") == "general", F.col("k"))), F.lit(0)).alias("_general"))
    both = whole.join(F.broadcast(subjects), F.lit(True))  # one row each
    return both.select("cases", "intents", F.round(F.col("_general") / F.col("cases"), 4).alias("general_share"), "top_subject", F.round(F.col("_most") / F.col("cases"), 4).alias("top_subject_share"))


#: Metrics by domain.
DOMAINS = {"capital": ("capex",), "leverage": ("cash", "finance_cost", "total_debt"), "results": ("revenue", "total_income", "total_tax")}


def metric_domain(key: str) -> str:
    """The domain of a metric; an unknown key raises an error that says how many there are."""
    for domain, keys in DOMAINS.items():
        if key in keys:
            return domain
    raise KeyError(f"unknown metric {key!r}; there are {sum(map(len, DOMAINS.values()))}")


_DOMAIN_SQL = "CASE " + " ".join(f"WHEN metric IN ({', '.join(repr(k) for k in keys)}) THEN '{d}'" for d, keys in DOMAINS.items()) + " END"


@query(f"WITH {LONG_SQL} SELECT {_DOMAIN_SQL} AS domain, list_sort(list_distinct(list(metric))) AS metrics, count(value) AS n_values, count(DISTINCT company_id) AS n_companies FROM m GROUP BY ALL")
def metrics_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each domain and what is held of them."""
    rows = long_facts(snapshots(spark, sf_dir))
    domain = F.create_map(*[F.lit(x) for d, keys in DOMAINS.items() for k in keys for x in (k, d)])[F.col("metric")]
    return rows.groupBy(domain.alias("domain")).agg(F.array_sort(F.collect_set("metric")).alias("metrics"), F.count("value").alias("n_values"), F.count_distinct("company_id").alias("n_companies"))


_PAST = "id % 7 = 0 OR (id % 5 IN (1, 2) AND (id < 3 OR (id - 3) % 7 = 0))"


@query(f"""
WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT id, CASE WHEN {_PAST} THEN 'dangling' ELSE 'appended' END AS outcome FROM o),
k AS (SELECT id FROM f WHERE outcome = 'appended'), l AS (SELECT id - 3 AS id FROM k WHERE id % 5 IN (1, 2))
SELECT 'first' AS step, id, outcome FROM f
UNION ALL SELECT 'again', id, CASE WHEN outcome = 'appended' THEN 'duplicate' ELSE outcome END FROM f WHERE id % 2 = 0
UNION ALL SELECT 'delete', o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT id FROM k) THEN 'missing' WHEN o_orderkey IN (SELECT id FROM l) THEN 'superseded' ELSE 'deleted' END FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT 'left', id, 'kept' FROM k WHERE id % 4 > 0 OR id IN (SELECT id FROM l)""")
def judgments_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of judgments: what appending says of each, what it says the second time, what can be deleted, and what is left."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    i = F.col("id")
    rows = ids.where("id % 3 = 0").withColumn("supersedes", F.when(i % 7 == 0, -i - 1).when((i % 5).isin(1, 2), i - 3))
    store = JudgmentStore(spark, fresh_folder(spark, "judgments"), buckets=16)
    told = [("first", store.append(rows)), ("again", store.append(rows.where("id % 2 = 0"))), ("delete", store.delete(ids.where("id % 4 = 0")))]
    told.append(("left", store.read().select("id", F.lit("kept").alias("outcome"))))
    return reduce(DataFrame.unionByName, [frame.select(F.lit(name).alias("step"), "id", "outcome") for name, frame in told])
