"""Queries over event ledgers and the evidence catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.operators import events as E
from factframe.operators.asof import asof_before
from factframe.operators import series as S
from factframe.registry import query
from factframe.sources.tables import LINES_SQL, fact_lines, money, quarter_end, table

_KINDS = {"1-URGENT": "financial_results", "2-HIGH": "annual_report", "3-MEDIUM": "investor_presentation", "4-NOT SPECIFIED": "call_transcript"}
_KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " ELSE 'other' END"


def _kind():
    return F.coalesce(F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p])[F.col("o_orderpriority")], F.lit("other"))


@query("""SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1""")
def latest_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return E.latest_per_key(events, ["user_id", "event_type"], F.struct("ts", -F.col("event_id")), ["event_id", "ts", "value"])


@query("""WITH a AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(event_id) AS risk_id, max_by(value, event_id) AS risk_value FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT a.event_id, a.user_id, a.ts, a.value, r.ts AS risk_ts, r.risk_id, r.risk_value FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.ts > r.ts""")
def asof_strictly_before(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    actions = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    risks = events.where("event_type = 'error'").groupBy("user_id", F.col("ts").alias("risk_ts")).agg(F.max("event_id").alias("risk_id"), F.max_by("value", "event_id").alias("risk_value"))
    return S.asof_before(actions, risks, ["user_id"], "ts", "risk_ts", ["risk_ts", "risk_id", "risk_value"])


# half of all events are one user's
_HALF_SQL = "h AS (SELECT event_id, ts, event_type, value, CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS user_id FROM events)"


@query(f"""WITH {_HALF_SQL}, a AS (SELECT event_id, user_id, ts, value FROM h WHERE event_type IN ('purchase', 'click')), r AS (SELECT user_id, ts, max(event_id) AS risk_id, max_by(value, event_id) AS risk_value FROM h WHERE event_type = 'error' GROUP BY ALL)
SELECT a.event_id, a.user_id, a.ts, a.value, r.ts AS risk_ts, r.risk_id, r.risk_value FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.ts > r.ts""")
def asof_of_a_hot_user(spark, sf_dir):
    """As-of association where one user has half of all events: its rows are spread over ranges of time."""
    user = F.when(F.col("event_id") % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", user.alias("user_id"))
    actions = events.where("event_type in ('purchase', 'click')").select("event_id", "user_id", "ts", "value")
    risk = F.struct(F.col("ts").alias("risk_ts"), F.col("event_id").alias("risk_id"), F.col("value").alias("risk_value"))
    found = asof_before(actions, events.where("event_type = 'error'"), ["user_id"], "ts", risk, ["event_id"], name="risk")
    return found.select("event_id", "user_id", "ts", "value", "risk.risk_ts", "risk.risk_id", "risk.risk_value")


_LEDGER_SQL = """l AS (
  SELECT 'rating' AS section, ts AS happened_at, 'rating ' || CAST(user_id AS VARCHAR) AS label, event_id AS evidence_id, value AS amount FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'dividend', ts, 'dividend ' || CAST(user_id AS VARCHAR), event_id, value FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'buyback', ts, 'buyback ' || CAST(user_id AS VARCHAR), event_id, value FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'director_change', ts, 'change ' || CAST(user_id AS VARCHAR), event_id, NULL FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'resolution', ts, 'resolution ' || CAST(user_id AS VARCHAR), event_id, NULL FROM events WHERE event_type = 'error')"""
_SECTIONS = {"view": ("rating", "rating ", True), "purchase": ("dividend", "dividend ", True), "click": ("buyback", "buyback ", True), "signup": ("director_change", "change ", False), "error": ("resolution", "resolution ", False)}


def _ledger(spark, sf_dir):
    """Five kinds of events in one shape, by one pass over the table instead of five unions."""
    m = F.create_map(*[x for k, (section, prefix, amount) in _SECTIONS.items() for x in (F.lit(k), F.struct(F.lit(section).alias("section"), F.lit(prefix).alias("prefix"), F.lit(amount).alias("amount")))])
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(*_SECTIONS)).withColumn("_s", m[F.col("event_type")])
    return rows.select("_s.section", F.col("ts").alias("happened_at"), F.concat("_s.prefix", F.col("user_id").cast("string")).alias("label"), F.col("event_id").alias("evidence_id"), F.when(F.col("_s.amount"), F.col("value")).alias("amount"))


@query(f"WITH {_LEDGER_SQL} SELECT * FROM l")
def event_ledger_union(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query(f"WITH {_LEDGER_SQL} SELECT CAST(happened_at AS DATE) AS day, section, label, min(happened_at) AS first_at, list_sort(list_distinct(list(evidence_id))) AS evidence_ids, count(*) AS n FROM l GROUP BY ALL")
def event_merge_by_day(spark, sf_dir, days=None):
    """One event for each day, section and label; where `days` is given, of the last days only, which are cut off before they are merged."""
    ledger = _ledger(spark, sf_dir)
    if days is not None:
        ledger = E.trailing(ledger.withColumn("_day", F.to_date("happened_at")), "_day", days).drop("_day")
    return E.merge_by_day(ledger, ["section", "label"], "happened_at", "evidence_id")


@query(f"WITH {_LEDGER_SQL} SELECT CAST(happened_at AS DATE) AS day, section, label, evidence_id FROM l WHERE CAST(happened_at AS DATE) >= (SELECT CAST(max(happened_at) AS DATE) - 10 FROM l)")
def what_changed_window(spark, sf_dir):
    return E.trailing(_ledger(spark, sf_dir).select(F.to_date("happened_at").alias("day"), "section", "label", "evidence_id"), "day", 10)


@query(f"WITH {_LEDGER_SQL} SELECT section, count(*) AS n, count(amount) AS n_amounts, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS total, max(CAST(happened_at AS DATE)) AS latest FROM l GROUP BY section")
def capital_allocation(spark, sf_dir):
    return _ledger(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n"), F.count("amount").alias("n_amounts"), F.sum(F.col("amount").cast("decimal(18,4)")).cast("double").alias("total"), F.max(F.to_date("happened_at")).alias("latest"))


@query(f"""WITH {_LEDGER_SQL} SELECT section, happened_at, label, evidence_id FROM l WHERE section IN ('rating', 'dividend', 'director_change')
QUALIFY row_number() OVER (PARTITION BY section ORDER BY happened_at DESC, evidence_id) <= CASE section WHEN 'dividend' THEN 5 ELSE 3 END""")
def summary_topk(spark, sf_dir):
    ledger, newest = _ledger(spark, sf_dir), [F.col("happened_at").desc(), F.col("evidence_id")]
    parts = [E.top_n(ledger.where(F.col("section") == s).drop("section"), s, newest, n, ["happened_at", "label", "evidence_id"]) for s, n in (("rating", 3), ("dividend", 5), ("director_change", 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {LINES_SQL}, {_LEDGER_SQL}
SELECT 'facts' AS section, evidence_id, CAST(company_id AS VARCHAR) AS item, CAST(sum(net) AS DOUBLE) AS amount FROM lines GROUP BY ALL
UNION ALL SELECT 'catalog', o_orderkey, o_orderpriority, o_totalprice FROM orders
UNION ALL SELECT section, evidence_id, label, amount FROM l""")
def drilldown(spark, sf_dir):
    """Everything that rests on each piece of evidence; a caller filters by one id, which reaches every scan."""
    facts = fact_lines(spark, sf_dir).groupBy("evidence_id", "company_id").agg(F.sum("net").cast("double").alias("amount"))
    catalog = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("item"), F.col("o_totalprice").alias("amount"))
    shape = ["section", "evidence_id", "item", "amount"]
    out = facts.select(F.lit("facts").alias("section"), "evidence_id", F.col("company_id").cast("string").alias("item"), "amount")
    return out.unionByName(catalog.withColumn("section", F.lit("catalog")).select(*shape)).unionByName(_ledger(spark, sf_dir).withColumnRenamed("label", "item").select(*shape))


@query(f"""WITH {LINES_SQL}, s AS (SELECT DISTINCT company_id, period, evidence_id FROM lines)
SELECT company_id, max(period) AS period, max_by(evidence_id, (period, evidence_id)) AS evidence_id, count(DISTINCT period) AS n_periods, count(DISTINCT period) > 1 AS spans FROM s GROUP BY company_id""")
def evidence_latest_period(spark, sf_dir):
    used = fact_lines(spark, sf_dir).select("company_id", "period", "evidence_id")
    return used.groupBy("company_id").agg(F.max("period").alias("period"), F.max_by("evidence_id", F.struct("period", "evidence_id")).alias("evidence_id"), F.count_distinct("period").alias("n_periods")).withColumn("spans", F.col("n_periods") > 1)


@query(f"""SELECT o_orderkey AS evidence_id, {_KIND_SQL} AS kind, CAST(o_orderdate AS DATE) AS source_date, o_totalprice AS size FROM orders
WHERE {_KIND_SQL} IN ('financial_results', 'annual_report') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def catalog_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= "1997-01-01") & (F.col("o_orderdate") < "1999-01-01"))
    return orders.select(F.col("o_orderkey").alias("evidence_id"), _kind().alias("kind"), F.col("o_orderdate").cast("date").alias("source_date"), F.col("o_totalprice").alias("size"))


@query(f"SELECT o_custkey AS company_id, {_KIND_SQL} AS kind, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS evidence_id, CAST(max(o_orderdate) AS DATE) AS source_date FROM orders GROUP BY ALL")
def catalog_latest_kind(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id"), _kind().alias("kind")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("evidence_id"), F.max("o_orderdate").cast("date").alias("source_date"))


@query(f"""SELECT {_KIND_SQL} AS kind, count(*) AS n, count(o_orderdate) AS n_dated, CAST(min(o_orderdate) AS DATE) AS earliest, CAST(max(o_orderdate) AS DATE) AS latest,
date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS span_days, round(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25, 2) AS span_years FROM orders GROUP BY ALL""")
def history_depth(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    depth = table(spark, sf_dir, "orders").groupBy(_kind().alias("kind")).agg(F.count("*").alias("n"), F.count("o_orderdate").alias("n_dated"), F.min(day).alias("earliest"), F.max(day).alias("latest"))
    return depth.withColumn("span_days", F.datediff("latest", "earliest").cast("long")).withColumn("span_years", F.round(F.col("span_days") / 365.25, 2))


_SAME_SQL = "SELECT doc_id, source, lang AS kind, CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS DATE) AS day, n_chars AS size FROM documents"


@query(f"""WITH d AS ({_SAME_SQL}), g AS (SELECT *, count(*) OVER w AS n, count(source) OVER w AS n_s FROM d WINDOW w AS (PARTITION BY kind, day)),
u AS (SELECT kind, day, count(DISTINCT source) AS n_sources FROM d GROUP BY ALL)
SELECT doc_id, source, g.kind, g.day, size, g.n > 1 AND u.n_sources = g.n AS merged FROM g JOIN u ON g.kind = u.kind AND g.day = u.day
QUALIFY NOT (g.n > 1 AND u.n_sources = g.n) OR row_number() OVER (PARTITION BY g.kind, g.day ORDER BY size DESC, source, doc_id) = 1""")
def cross_source_dedup(spark, sf_dir):
    """Filings of one kind and day collapse to the largest only if every one has another source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")).alias("day"), F.col("n_chars").alias("size"))
    groups = docs.groupBy("kind", "day").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.min_by("doc_id", F.struct(-F.col("size"), "source", "doc_id")).alias("best"))
    marked = docs.join(groups, ["kind", "day"]).withColumn("merged", (F.col("n") > 1) & (F.col("n") == F.col("n_sources")))
    return marked.where("not merged or doc_id = best").select("doc_id", "source", "kind", "day", "size", "merged")


@query(f"SELECT o_orderpriority AS raw_kind, {_KIND_SQL} AS kind, {_KIND_SQL} = 'other' AS unknown, count(*) AS n FROM orders GROUP BY ALL")
def kind_mapping_unknowns(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counted.select(F.col("o_orderpriority").alias("raw_kind"), _kind().alias("kind"), (_kind() == "other").alias("unknown"), "n")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS source_date, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period FROM orders),
l AS (SELECT *, CAST(CASE month(period) WHEN 6 THEN 1 WHEN 9 THEN 2 WHEN 12 THEN 3 ELSE 4 END AS INTEGER) AS quarter, CAST(year(period) + CASE WHEN month(period) > 3 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year FROM d)
SELECT *, 'Q' || CAST(quarter AS VARCHAR) || ' FY' || right(CAST(fiscal_year AS VARCHAR), 2) AS label, make_date(fiscal_year, 3, 31) AS year_end FROM l""")
def fiscal_labels(spark, sf_dir):
    from factframe.functions.dates import fiscal_quarter, fiscal_year

    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("source_date"), quarter_end(F.col("o_orderdate")).alias("period")).distinct()
    out = days.withColumn("quarter", fiscal_quarter(F.col("period"))).withColumn("fiscal_year", fiscal_year(F.col("period")))
    return out.withColumn("label", F.concat(F.lit("Q"), F.col("quarter").cast("string"), F.lit(" FY"), F.right(F.col("fiscal_year").cast("string"), F.lit(2)))).withColumn("year_end", F.make_date("fiscal_year", F.lit(3), F.lit(31)))


_TOKENS_SQL = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('mr', 'mrs', 'ms', 'dr', 'shri', 'smt', 'sri', 'prof', '')), '|')"


@query(f"SELECT {_TOKENS_SQL.format('p_name')} AS entity_key, count(*) AS n, min(p_partkey) AS first_id, min_by(p_name, p_partkey) AS canonical_name FROM part GROUP BY ALL")
def entity_exact_org(spark, sf_dir):
    from factframe.functions.text import name_tokens

    parts = table(spark, sf_dir, "part").withColumn("entity_key", F.array_join(name_tokens(F.col("p_name")), "|"))
    return parts.groupBy("entity_key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), F.min_by("p_name", "p_partkey").alias("canonical_name"))


@query("""WITH r AS (SELECT user_id, max(ts) AS resigned_at FROM events WHERE event_type = 'error' GROUP BY user_id), a AS (SELECT user_id, event_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view')
SELECT a.user_id, count(DISTINCT day) AS n_calls, any_value(resigned_at) AS resigned_at FROM a JOIN r USING (user_id) GROUP BY a.user_id""")
def former_answerers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    resigned = events.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("resigned_at"))
    answered = events.where("event_type = 'view'").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("n_calls"))
    return answered.join(resigned, "user_id")


@query("""WITH t AS (SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n_deals, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT company_id, day, n_deals, value FROM t WHERE n_deals >= 2""")
def catalyst_merge(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return pending.groupBy(F.col("o_custkey").alias("company_id"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_deals"), F.sum(money("o_totalprice")).cast("double").alias("value")).where("n_deals >= 2")


@query("""SELECT user_id, event_id, ts, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5""")
def ledger_tail_cap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("place", F.row_number().over(w)).where("place <= 5")
