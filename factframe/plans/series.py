"""Queries over quarterly facts: screening, timelines, comparison, signals, trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.functions.dates import month_label
from factframe.functions.finance import DERIVED_SQL, derived
from factframe.operators import series as S
from factframe.registry import query
from factframe.sources.tables import FACTS_SQL, HOLDINGS_SQL, LINES_SQL, LONG_SQL, METRICS, METRICS_SQL, THRESHOLDS, fact_lines, holdings, long_facts, money, snapshots, table

_CHANGE = "(value - prior) / nullif(abs(prior), 0) * 100"
COMPANY = ["company_id"]


@query(f"""WITH {FACTS_SQL}
SELECT company_id, max_by(revenue, period) AS value, max(period) AS period FROM f WHERE revenue IS NOT NULL
GROUP BY company_id HAVING max_by(revenue, period) > 100000""")
def screen_revenue(spark, sf_dir):
    return S.screen(S.latest_value(snapshots(spark, sf_dir), "revenue", COMPANY), F.col("value") > 100000)


@query(f"""WITH {FACTS_SQL}
SELECT company_id, max_by(total_debt - cash, period) AS value, max(period) AS period FROM f WHERE total_debt - cash IS NOT NULL GROUP BY company_id ORDER BY value, company_id""")
def screen_net_debt_low_is_better(spark, sf_dir):
    wide = snapshots(spark, sf_dir).withColumn("net_debt", derived()["net_debt"])
    return S.screen(S.latest_value(wide, "net_debt", COMPANY), F.lit(True), higher_is_better=False)


@query(f"""WITH {FACTS_SQL}, p AS (SELECT company_id, period, total_debt AS value, lag(total_debt) OVER (PARTITION BY company_id ORDER BY period) AS prior FROM f)
SELECT company_id, period, value, prior, {_CHANGE} AS change FROM p""")
def revenue_yoy_keep_nulls(spark, sf_dir):
    wide = snapshots(spark, sf_dir).select("company_id", "period", F.col("total_debt").alias("value"))
    return S.change_keeping_nulls(wide, "value", COMPANY)


@query(f"""WITH {FACTS_SQL}, v AS (SELECT company_id, period, (revenue - total_tax) / nullif(revenue, 0) * 100 AS value FROM f), p AS (
  SELECT *, lag(value) OVER (PARTITION BY company_id ORDER BY period) AS prior FROM v WHERE value IS NOT NULL)
SELECT company_id, period, value, prior, value - prior AS change FROM p""")
def timeline_pct_metric(spark, sf_dir):
    wide = snapshots(spark, sf_dir).select("company_id", "period", derived()["ebit_margin_pct"].alias("value"))
    return S.change_skipping_nulls(wide, "value", COMPANY, points=True)


@query(f"""WITH {FACTS_SQL}, p AS (SELECT company_id, period, cash AS value, lag(cash) OVER (PARTITION BY company_id ORDER BY period) AS prior FROM f WHERE cash IS NOT NULL)
SELECT company_id, period, value, prior, {_CHANGE} AS change FROM p""")
def timeline_abs_metric(spark, sf_dir):
    return S.change_skipping_nulls(snapshots(spark, sf_dir).select("company_id", "period", F.col("cash").alias("value")), "value", COMPANY)


@query(f"""WITH {FACTS_SQL}, t AS (SELECT company_id, period, revenue AS value FROM f WHERE revenue IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period DESC) <= 4),
p AS (SELECT *, lag(value) OVER (PARTITION BY company_id ORDER BY period) AS prior FROM t)
SELECT company_id, period, value, {_CHANGE} AS change FROM p""")
def compare_last_n(spark, sf_dir):
    return S.last_n(snapshots(spark, sf_dir).select("company_id", "period", F.col("revenue").alias("value")), "value", COMPANY, 4)


@query(f"""WITH {FACTS_SQL} SELECT company_id, period, total_debt, cash, cash - total_debt AS net_cash,
CASE WHEN cash - total_debt > 0 THEN 'net cash' WHEN cash - total_debt < 0 THEN 'net debt' WHEN cash - total_debt = 0 THEN 'balanced' END AS label FROM f""")
def leverage(spark, sf_dir, totals=None):
    wide = snapshots(spark, sf_dir, totals=totals).select("company_id", "period", "total_debt", "cash", derived()["net_cash"].alias("net_cash"))
    n = F.col("net_cash")
    return wide.withColumn("label", F.when(n > 0, "net cash").when(n < 0, "net debt").when(n == 0, "balanced"))


@query(f"WITH {FACTS_SQL} SELECT company_id, period, {', '.join(f'{s} AS {n}' for n, s in DERIVED_SQL.items())} FROM f")
def derived_metrics(spark, sf_dir):
    return snapshots(spark, sf_dir).select("company_id", "period", *[e.alias(n) for n, e in derived().items()])


_MERGE_SQL = f"""{LINES_SQL}, e AS (
  SELECT company_id, period, evidence_id, source_date, CASE WHEN kind IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 2 END AS priority, {METRICS_SQL}
  FROM lines GROUP BY company_id, period, evidence_id, source_date, kind),
c AS ({' UNION ALL '.join(f"SELECT company_id, period, evidence_id, source_date, priority, '{m}' AS metric, {m} AS value FROM e WHERE {m} IS NOT NULL" for m in METRICS)}),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY company_id, period, metric ORDER BY priority,
  CASE WHEN priority = 1 THEN -epoch(source_date) ELSE epoch(source_date) END, CASE WHEN priority = 1 THEN -evidence_id ELSE evidence_id END) = 1)"""


def _winners(spark, sf_dir):
    """Facts of all evidence merged into one value per company, period and metric.

    Evidence of priority 1 overwrites (the latest wins), evidence of priority 2
    only fills gaps (the earliest wins). max_by keeps one row per key on each
    map side, so nothing is sorted.
    """
    lines = fact_lines(spark, sf_dir).withColumn("priority", F.when(F.col("kind").isin("1-URGENT", "2-HIGH"), 1).otherwise(2))
    each = lines.groupBy("company_id", "period", "evidence_id", "source_date", "priority").agg(*_metrics())
    first = F.col("priority") == 1
    day, sign = F.datediff("source_date", F.lit("1970-01-01").cast("date")), F.when(first, 1).otherwise(-1)
    rank = F.struct(-F.col("priority"), sign * day, sign * F.col("evidence_id"))
    # one wide row for each piece of evidence, not one for each of its metrics, goes into the merge
    best = [F.max_by(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), "evidence_id", "priority"), F.when(F.col(m).isNotNull(), rank)).alias(m) for m in METRICS]
    merged = each.groupBy("company_id", "period").agg(*best)
    return merged.select("company_id", "period", F.explode(F.array(*METRICS)).alias("w")).where("w is not null").select("company_id", "period", "w.metric", "w.value", "w.evidence_id", "w.priority")


def _metrics():
    from factframe.sources.tables import metric_columns

    return metric_columns()


@query(f"WITH {_MERGE_SQL} SELECT company_id, period, metric, value, evidence_id, priority FROM w")
def snapshot_merge(spark, sf_dir):
    return _winners(spark, sf_dir)


@query(f"WITH {_MERGE_SQL} SELECT company_id, period, {', '.join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in METRICS)} FROM w GROUP BY company_id, period")
def snapshot_wide(spark, sf_dir):
    return _winners(spark, sf_dir).groupBy("company_id", "period").pivot("metric", list(METRICS)).agg(F.first("value"))


@query(f"""WITH {_MERGE_SQL} SELECT company_id, period, string_agg(metric || '=' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR), '; ' ORDER BY metric) AS facts,
list_sort(list_distinct(list(evidence_id))) AS sources FROM w GROUP BY company_id, period""")
def snapshot_map(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.concat("metric", F.lit("="), F.round("value").cast("long").cast("string"))))
    return _winners(spark, sf_dir).groupBy("company_id", "period").agg(F.array_join(pairs, "; ").alias("facts"), F.array_sort(F.collect_set("evidence_id")).alias("sources"))


_NATION = ["nation", "kind"]


@query(f"WITH {HOLDINGS_SQL} SELECT nation, period, kind, share, share - lag(share) OVER (PARTITION BY nation, kind ORDER BY period) AS qoq FROM h")
def ownership_shares(spark, sf_dir):
    return holdings(spark, sf_dir).withColumn("qoq", F.col("share") - S.previous("share", _NATION))


@query(f"""WITH {HOLDINGS_SQL}, d AS (SELECT nation, period, kind, share - lag(share) OVER (PARTITION BY nation, kind ORDER BY period) AS qoq FROM h)
SELECT nation, period, kind, qoq, CASE WHEN qoq > 0 THEN 'up' ELSE 'down' END AS direction FROM d
JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in THRESHOLDS.items())}) t(k, least) ON kind = k WHERE abs(qoq) >= least""")
def ownership_signals_threshold(spark, sf_dir):
    least = spark.sql("select * from values " + ", ".join(f"('{k}', double({v}))" for k, v in THRESHOLDS.items()) + " as t(kind, least)")
    moved = holdings(spark, sf_dir).withColumn("qoq", F.col("share") - S.previous("share", _NATION))
    found = moved.join(F.broadcast(least), "kind").where(F.abs("qoq") >= F.col("least"))  # five fixed rows
    return found.select("nation", "period", "kind", "qoq", F.when(F.col("qoq") > 0, "up").otherwise("down").alias("direction"))


@query(f"""WITH {HOLDINGS_SQL}, d AS (SELECT nation, period, kind, share - lag(share) OVER (PARTITION BY nation, kind ORDER BY period) AS delta FROM h),
w AS (SELECT *, count(*) OVER r AS n, min(delta) OVER r AS low, max(delta) OVER r AS high FROM d WHERE delta IS NOT NULL
  WINDOW r AS (PARTITION BY nation, kind ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT nation, kind, direction, min(period) AS first_period FROM (
  SELECT *, CASE WHEN low > 0 THEN 'rising' WHEN high < 0 THEN 'falling' END AS direction FROM w WHERE n = 3) WHERE direction IS NOT NULL GROUP BY ALL""")
def ownership_streaks(spark, sf_dir):
    return S.streaks(holdings(spark, sf_dir), "share", _NATION)


@query(f"""WITH {FACTS_SQL}, p AS (SELECT company_id, period, coalesce(capex, 0) AS pledged, lag(coalesce(capex, 0)) OVER (PARTITION BY company_id ORDER BY period) AS prior FROM f)
SELECT company_id, period, CASE WHEN prior = 0 THEN 'appeared' ELSE 'cleared' END AS event, pledged FROM p WHERE (prior = 0 AND pledged > 0) OR (prior > 0 AND pledged = 0)""")
def pledge_transitions(spark, sf_dir):
    level = snapshots(spark, sf_dir).select("company_id", "period", F.coalesce("capex", F.lit(0.0)).alias("pledged")).withColumn("_prior", S.previous("pledged", COMPANY))
    turned = level.where("(_prior = 0 and pledged > 0) or (_prior > 0 and pledged = 0)")
    return turned.select("company_id", "period", F.when(F.col("_prior") == 0, "appeared").otherwise("cleared").alias("event"), "pledged")


_POINTS_SQL = """pts AS (SELECT o_orderpriority AS kind, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)"""


def _monthly(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("kind"), F.trunc("o_orderdate", "MM").alias("period")).agg(F.sum(money("o_totalprice")).cast("double").alias("value"))


@query(f"""WITH {_POINTS_SQL}, j AS (SELECT a.kind, a.period, a.value, b.period AS prior_period, b.value AS prior_value, CAST(abs(date_diff('day', b.period, CAST(a.period - INTERVAL 12 MONTH AS DATE))) AS INTEGER) AS gap_days
  FROM pts a JOIN pts b ON a.kind = b.kind AND b.period < a.period AND abs(date_diff('day', b.period, CAST(a.period - INTERVAL 12 MONTH AS DATE))) <= 45)
SELECT *, (value - prior_value) / nullif(abs(prior_value), 0) * 100 AS change FROM j QUALIFY row_number() OVER (PARTITION BY kind, period ORDER BY gap_days, prior_period) = 1""")
def yoy_nearest_45d(spark, sf_dir):
    found = S.yoy_nearest(_monthly(spark, sf_dir), "value", ["kind"])
    return found.withColumn("change", S.percent_change(F.col("value"), F.col("prior_value")))


@query("""WITH d AS (SELECT last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS period, CAST(o_orderdate AS DATE) AS source_date, count(*) AS n_facts, max(o_orderkey) AS seq FROM orders GROUP BY ALL)
SELECT period, source_date, n_facts FROM d QUALIFY row_number() OVER (PARTITION BY period ORDER BY n_facts DESC, seq DESC) = 1""")
def dedup_periods(spark, sf_dir):
    from factframe.sources.tables import quarter_end

    points = table(spark, sf_dir, "orders").groupBy(quarter_end(F.col("o_orderdate")).alias("period"), F.col("o_orderdate").cast("date").alias("source_date")).agg(F.count("*").alias("n_facts"), F.max("o_orderkey").alias("seq"))
    best = points.groupBy("period").agg(F.max_by(F.struct("source_date", "n_facts"), F.struct("n_facts", "seq")).alias("b"))
    return best.select("period", "b.source_date", "b.n_facts")


_TWO_SQL = f"""{LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id, metric ORDER BY period DESC) AS n FROM m WHERE value IS NOT NULL),
t AS (SELECT company_id, metric, max(value) FILTER (n = 1) AS current, max(value) FILTER (n = 2) AS prior, max(period) FILTER (n = 1) AS period FROM r WHERE n <= 2 GROUP BY ALL HAVING count(*) = 2),
g AS (SELECT *, CASE WHEN prior = 0 THEN 0.0 ELSE (current - prior) / abs(prior) * 100 END AS magnitude, metric IN ('finance_cost', 'total_tax', 'total_debt') AS low_is_good FROM t),
k AS (SELECT company_id, metric, period, current, prior, abs(magnitude) AS magnitude, CASE WHEN abs(magnitude) < 2 THEN 'stable' WHEN (magnitude > 0) <> low_is_good THEN 'improving' ELSE 'deteriorating' END AS direction FROM g)"""


def _moves(spark, sf_dir, totals=None):
    two = S.last_two(long_facts(snapshots(spark, sf_dir, totals=totals)), "value", ["company_id", "metric"])
    signed = F.when(F.col("prior") == 0, 0.0).otherwise((F.col("current") - F.col("prior")) / F.abs("prior") * 100)
    low = F.col("metric").isin("finance_cost", "total_tax", "total_debt")
    direction = F.when(F.abs("_m") < 2, "stable").when((F.col("_m") > 0) != low, "improving").otherwise("deteriorating")
    return two.withColumn("_m", signed).select("company_id", "metric", "period", "current", "prior", F.abs("_m").alias("magnitude"), direction.alias("direction"))


@query(f"WITH {_TWO_SQL} SELECT * FROM k")
def metric_moves(spark, sf_dir, totals=None):
    return _moves(spark, sf_dir, totals)


@query(f"WITH {_TWO_SQL} SELECT company_id, metric, direction, magnitude, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY company_id, direction ORDER BY magnitude DESC, metric) AS n FROM k) WHERE n <= 2")
def top_movers(spark, sf_dir, totals=None):
    place = F.row_number().over(Window.partitionBy("company_id", "direction").orderBy(F.col("magnitude").desc(), "metric"))
    return _moves(spark, sf_dir, totals).withColumn("place", place).where("place <= 2").select("company_id", "metric", "direction", "magnitude", "place")


@query(f"""WITH {FACTS_SQL}, r AS (SELECT company_id, period, cash - total_debt AS v, row_number() OVER (PARTITION BY company_id ORDER BY period DESC) AS n FROM f WHERE cash - total_debt IS NOT NULL),
t AS (SELECT company_id, max(v) FILTER (n = 1) AS current, max(v) FILTER (n = 2) AS prior, max(period) FILTER (n = 1) AS period FROM r WHERE n <= 2 GROUP BY ALL HAVING count(*) = 2)
SELECT *, CASE WHEN current > prior THEN 'strengthening' WHEN current < prior THEN 'weakening' ELSE 'unchanged' END AS verdict FROM t""")
def net_cash_trajectory(spark, sf_dir, totals=None):
    wide = snapshots(spark, sf_dir, totals=totals).select("company_id", "period", derived()["net_cash"].alias("net_cash"))
    two = S.last_two(wide, "net_cash", COMPANY)
    return two.withColumn("verdict", F.when(F.col("current") > F.col("prior"), "strengthening").when(F.col("current") < F.col("prior"), "weakening").otherwise("unchanged"))


@query(f"""WITH {FACTS_SQL}, v AS (SELECT company_id, (revenue - total_tax) / nullif(revenue, 0) * 100 AS margin FROM f)
SELECT company_id, count(margin) AS n, min(margin) AS low, max(margin) AS high, max(margin) - min(margin) AS spread,
CASE WHEN max(margin) - min(margin) < 3 THEN 'stable' WHEN max(margin) - min(margin) < 8 THEN 'moderately variable' ELSE 'wide' END AS band FROM v WHERE margin IS NOT NULL GROUP BY company_id HAVING count(*) >= 2""")
def margin_stability(spark, sf_dir, totals=None):
    wide = snapshots(spark, sf_dir, totals=totals).select("company_id", derived()["ebit_margin_pct"].alias("margin")).where("margin is not null")
    spread = wide.groupBy("company_id").agg(F.count("margin").alias("n"), F.min("margin").alias("low"), F.max("margin").alias("high")).where("n >= 2").withColumn("spread", F.col("high") - F.col("low"))
    return spread.withColumn("band", F.when(F.col("spread") < 3, "stable").when(F.col("spread") < 8, "moderately variable").otherwise("wide"))


@query(f"""WITH {LINES_SQL}, y AS (SELECT company_id, year(source_date) AS fy, CAST(sum(net) AS DOUBLE) AS revenue FROM lines GROUP BY ALL),
p AS (SELECT *, lag(revenue) OVER (PARTITION BY company_id ORDER BY fy) AS prior FROM y)
SELECT company_id, count(*) AS n, count(*) FILTER (revenue > prior) AS n_up, round((pow(max_by(revenue, fy) / min_by(revenue, fy), 1.0 / (max(fy) - min(fy))) - 1) * 100, 4) AS cagr_pct
FROM p GROUP BY company_id HAVING count(*) >= 3""")
def growth_cagr(spark, sf_dir, totals=None):
    # a quarter's end is in the year of its lines, and its total is exact
    day, net = ("source_date", "net") if totals is None else ("period", "revenue")
    source = fact_lines(spark, sf_dir) if totals is None else totals
    yearly = source.groupBy("company_id", F.year(day).alias("fy")).agg(F.sum(net).cast("double").alias("revenue"))
    grown = yearly.withColumn("_prior", S.previous("revenue", COMPANY, "fy"))
    out = grown.groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("revenue") > F.col("_prior")).alias("n_up"), F.max_by("revenue", "fy").alias("_last"), F.min_by("revenue", "fy").alias("_first"), (F.max("fy") - F.min("fy")).alias("_years")).where("n >= 3")
    return out.select("company_id", "n", "n_up", F.round((F.pow(F.col("_last") / F.col("_first"), F.lit(1.0) / F.col("_years")) - 1) * 100, 4).alias("cagr_pct"))


@query(f"""WITH {LINES_SQL}, s AS (SELECT company_id, period, p_type AS segment, CAST(sum(net) AS DOUBLE) AS revenue FROM lines JOIN part ON l_partkey = p_partkey GROUP BY ALL),
l AS (SELECT * FROM s QUALIFY period = max(period) OVER (PARTITION BY company_id))
SELECT company_id, max(period) AS period, count(*) AS n_segments, max_by(segment, (revenue, segment)) AS largest, max(revenue) / CAST(sum(CAST(revenue AS DECIMAL(28,4))) AS DOUBLE) * 100 AS share_pct FROM l GROUP BY company_id""")
def segment_concentration(spark, sf_dir, lines=None):
    """Of each company's newest period; `lines` may hold that period's lines only."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("segment"))
    lines = fact_lines(spark, sf_dir) if lines is None else lines
    by = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("company_id", "period", "segment").agg(F.sum("net").cast("double").alias("revenue"))
    newest = by.withColumn("_max", F.max("period").over(Window.partitionBy("company_id"))).where("period = _max")
    return newest.groupBy("company_id").agg(F.max("period").alias("period"), F.count("*").alias("n_segments"), F.max_by("segment", F.struct("revenue", "segment")).alias("largest"), (F.max("revenue") / F.sum(F.col("revenue").cast("decimal(28,4)")).cast("double") * 100).alias("share_pct"))


@query(f"WITH {LONG_SQL} SELECT company_id, metric, count(value) AS n_points FROM m GROUP BY ALL HAVING count(value) BETWEEN 1 AND 26")
def thin_metrics(spark, sf_dir):
    counted = long_facts(snapshots(spark, sf_dir)).groupBy("company_id", "metric").agg(F.count("value").alias("n_points"))
    return counted.where("n_points between 1 and 26")


@query(f"""WITH {LINES_SQL}, f AS (SELECT company_id, period, {METRICS_SQL} FROM lines WHERE l_linestatus = 'F' GROUP BY company_id, period), t AS (SELECT *, CASE WHEN month(period) = 3 THEN 'annual' ELSE 'quarterly' END AS period_type FROM f)
SELECT company_id, period, period_type, revenue, revenue / nullif(total_income, 0) * 100 AS margin_pct FROM t WHERE period_type = 'quarterly'""")
def revenue_standalone_quarterly(spark, sf_dir):
    """Revenue of one basis and one type of period only."""
    wide = snapshots(spark, sf_dir, basis="standalone").withColumn("period_type", F.when(F.month("period") == 3, "annual").otherwise("quarterly"))
    return wide.where("period_type = 'quarterly'").select("company_id", "period", "period_type", "revenue", (F.col("revenue") / F.nullif("total_income", F.lit(0.0)) * 100).alias("margin_pct"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%b %Y') END AS label FROM orders""")
def month_labels(spark, sf_dir):
    """A date as 'Mon YYYY'; text that is no date is passed through."""
    key = F.col("o_orderkey")
    day = F.when(key % 10 > 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select(key.alias("id"), month_label(day, F.lit("undated")).alias("label"))
