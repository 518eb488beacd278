"""Queries of retrieval quality, coverage, redundancy, comparison and grounding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.functions.text import keywords
from factframe.plans.passages import _TERMS_SQL, _WINDOWS_SQL, _candidates
from factframe.plans.text import _KEYWORDS_SQL
from factframe.plans import series as Q
from factframe.registry import ORACLE_SQL, query
from factframe.sources.tables import LINES_SQL, fact_lines, quarter_totals, table

_RANKED_SQL = f"""{_WINDOWS_SQL}, {_TERMS_SQL}, b AS (SELECT item_id, doc_id, max(n_words + 2 * n_numbers) AS score FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM b)"""


def _ranked(spark, sf_dir):
    best = _candidates(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")))


@query(f"""WITH {_RANKED_SQL}, j AS (SELECT r.*, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad FROM r LEFT JOIN labels l USING (doc_id) WHERE place <= 10)
SELECT item_id, count(*) AS retrieved, count(*) FILTER (good) AS relevant, round(count(*) FILTER (good) / count(*), 3) AS precision_at_k, round(1.0 / min(place) FILTER (good), 3) AS reciprocal_rank, count(*) FILTER (bad) AS forbidden FROM j GROUP BY item_id""")
def retrieval_quality(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    top = _ranked(spark, sf_dir).where("place <= 10").join(gold, "doc_id", "left")
    good, bad = F.coalesce("good", F.lit(False)), F.coalesce("bad", F.lit(False))
    return top.groupBy("item_id").agg(F.count("*").alias("retrieved"), F.count_if(good).alias("relevant"), F.round(F.count_if(good) / F.count("*"), 3).alias("precision_at_k"), F.round(F.lit(1.0) / F.min(F.when(good, F.col("place"))), 3).alias("reciprocal_rank"), F.count_if(bad).alias("forbidden"))


_SOURCES = [f"src{i}" for i in range(24)]


@query(f"""WITH v AS (SELECT unnest({_SOURCES}) AS value), n AS (SELECT source AS value, count(*) AS n FROM documents GROUP BY ALL), z AS (SELECT v.value, coalesce(n.n, 0) AS n FROM v LEFT JOIN n USING (value)),
t AS (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM z)
SELECT count(*) FILTER (n = 0) AS missing, count(*) FILTER (n > 0 AND n < 3) AS thin, max(n) AS most, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(count(*)), 3) AS entropy FROM t""")
def dimension_coverage_entropy(spark, sf_dir):
    vocabulary = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in _SOURCES])).alias("value"))
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    filled = vocabulary.join(counts, "value", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    total = filled.agg(F.sum("n").cast("double").alias("_t"))  # one row
    p = F.col("n") / F.col("_t")
    return filled.join(F.broadcast(total), F.col("_t").isNotNull()).agg(F.count_if(F.col("n") == 0).alias("missing"), F.count_if((F.col("n") > 0) & (F.col("n") < 3)).alias("thin"), F.max("n").alias("most"), F.round(-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)) / F.log2(F.count("*").cast("double")), 3).alias("entropy"))


@query(f"""WITH k AS (SELECT item_id, {_KEYWORDS_SQL.format('text')} AS ws FROM benchmark), t AS (SELECT item_id, unnest(ws) AS w FROM k),
o AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id GROUP BY ALL)
SELECT item_a, item_b, shared, shared / (len(x.ws) + len(y.ws) - shared) AS jaccard FROM o JOIN k x ON x.item_id = item_a JOIN k y ON y.item_id = item_b WHERE shared / (len(x.ws) + len(y.ws) - shared) > 0.08""")
def suite_redundancy_jaccard(spark, sf_dir, threshold: float = 0.08):
    """Pairs of cases with similar wording, counted by an inverted join over shared words: pairs with nothing in common never meet."""
    words = table(spark, sf_dir, "benchmark").select("item_id", keywords(F.col("text")).alias("ws"))
    each = words.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    other = each.select(F.col("item_id").alias("item_b"), F.col("n").alias("m"), "w")
    pairs = each.withColumnRenamed("item_id", "item_a").join(other, "w").where("item_a < item_b").groupBy("item_a", "item_b", "n", "m").agg(F.count("*").alias("shared"))
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).where(F.col("jaccard") > threshold).select("item_a", "item_b", "shared", "jaccard")


_TWO_RANKS_SQL = """a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ra FROM documents QUALIFY ra <= 10),
b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) - doc_id % 100 DESC, doc_id) AS rb FROM documents QUALIFY rb <= 10)"""


@query(f"""WITH {_TWO_RANKS_SQL}, j AS (SELECT coalesce(a.source, b.source) AS source, ra, rb FROM a FULL JOIN b ON a.source = b.source AND a.doc_id = b.doc_id)
SELECT source, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) / count(*) AS jaccard, avg(CAST(abs(ra - rb) AS DOUBLE)) AS displacement, count(*) FILTER (ra IS NULL) AS churn_in, count(*) FILTER (rb IS NULL) AS churn_out,
NOT coalesce(bool_or(ra = 1 AND rb = 1), false) AS top_changed FROM j GROUP BY source""")
def ranking_change(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.length("text").alias("n"))
    rank = lambda order, name: docs.withColumn(name, F.row_number().over(Window.partitionBy("source").orderBy(order.desc(), "doc_id"))).where(f"{name} <= 10").select("source", "doc_id", name)
    both = rank(F.col("n_chars"), "ra").join(rank(F.col("n") - F.col("doc_id") % 100, "rb"), ["source", "doc_id"], "full_outer")
    a, b = F.col("ra"), F.col("rb")
    return both.groupBy("source").agg((F.count_if(a.isNotNull() & b.isNotNull()) / F.count("*")).alias("jaccard"), F.avg(F.abs(a - b).cast("double")).alias("displacement"), F.count_if(a.isNull()).alias("churn_in"), F.count_if(b.isNull()).alias("churn_out"), (~F.coalesce(F.bool_or((a == 1) & (b == 1)), F.lit(False))).alias("top_changed"))


_RESULTS_SQL = "g AS (SELECT d.source AS bucket, l.doc_id, l.quality = 1 AS base, coalesce(l.quality = 1 AND l.toxic = 0, false) AS cand FROM labels l JOIN documents d USING (doc_id))"


def _results(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("bucket"))
    return labels.join(docs, "doc_id").select("bucket", "doc_id", (F.col("quality") == 1).alias("base"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("cand"))


@query(f"""WITH {_RESULTS_SQL} SELECT bucket, count(*) AS n, round(avg(CAST(base AS DOUBLE)), 3) AS base_rate, round(avg(CAST(cand AS DOUBLE)), 3) AS cand_rate, round(avg(CAST(cand AS DOUBLE)) - avg(CAST(base AS DOUBLE)), 3) AS delta,
count(*) FILTER (base AND NOT cand) AS regressions FROM g GROUP BY bucket""")
def report_compare(spark, sf_dir):
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return _results(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.round(rate("base"), 3).alias("base_rate"), F.round(rate("cand"), 3).alias("cand_rate"), F.round(rate("cand") - rate("base"), 3).alias("delta"), F.count_if(F.col("base") & ~F.col("cand")).alias("regressions"))


@query(f"""WITH {_RESULTS_SQL}, s AS (SELECT count(*) AS answered, count(*) FILTER (base AND NOT cand) AS regressions, count(*) FILTER (base <> cand) / count(*) AS changed FROM g)
SELECT answered, regressions, CASE WHEN answered < 20 OR changed < 0.2 THEN 'INSUFFICIENT' WHEN regressions > 0 THEN 'NOT_READY' ELSE 'SAFE' END AS verdict FROM s""")
def recommend_verdict(spark, sf_dir):
    s = _results(spark, sf_dir).agg(F.count("*").alias("answered"), F.count_if(F.col("base") & ~F.col("cand")).alias("regressions"), (F.count_if(F.col("base") != F.col("cand")) / F.count("*")).alias("changed"))
    return s.select("answered", "regressions", F.when((F.col("answered") < 20) | (F.col("changed") < 0.2), "INSUFFICIENT").when(F.col("regressions") > 0, "NOT_READY").otherwise("SAFE").alias("verdict"))


@query("SELECT item_id, sha256(CAST(item_id AS VARCHAR)) AS digest FROM benchmark ORDER BY 2 LIMIT 10")
def hash_rank_sample(spark, sf_dir):
    """The n items of lowest hash: a sampling operator, the same on every run."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.col("item_id").cast("string").cast("binary"), 256).alias("digest")).orderBy("digest").limit(10)


@query("""WITH f AS (SELECT user_id AS finding, list_sort(list_distinct(list(event_id))) AS cited FROM events GROUP BY user_id), k AS (SELECT list(o_orderkey) AS ids FROM orders),
e AS (SELECT finding, unnest(cited) AS id FROM f), o AS (SELECT finding, count(*) AS n_cited, count(*) FILTER (o_orderkey IS NULL) AS n_unknown FROM e LEFT JOIN orders ON id = o_orderkey GROUP BY finding)
SELECT finding, n_cited, n_unknown, n_unknown = 0 AS grounded, n_unknown = n_cited AS refused FROM o""")
def closed_world_check(spark, sf_dir):
    cited = table(spark, sf_dir, "events").select(F.col("user_id").alias("finding"), F.col("event_id").alias("id")).distinct()
    allowed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("_ok"))
    out = cited.join(allowed, "id", "left").groupBy("finding").agg(F.count("*").alias("n_cited"), F.count_if(F.col("_ok").isNull()).alias("n_unknown"))
    return out.withColumn("grounded", F.col("n_unknown") == 0).withColumn("refused", F.col("n_unknown") == F.col("n_cited"))


@query("""WITH d AS (SELECT DISTINCT user_id * 100 + day(ts) AS item FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT user_id * 100 + day(ts) AS item FROM events WHERE event_type = 'error')
SELECT 'undisposed' AS violation, item FROM (SELECT item FROM r EXCEPT SELECT item FROM d) UNION ALL SELECT 'unresolved' AS violation, item FROM (SELECT item FROM d EXCEPT SELECT item FROM r)
UNION ALL SELECT 'dangling', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def completeness_gate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.where(F.col("event_type") == kind).select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("item")).distinct()
    disposed, resolved = of("purchase"), of("error")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"))
    name = lambda df, v: df.select(F.lit(v).alias("violation"), "item")
    return name(resolved.join(disposed, "item", "left_anti"), "undisposed").unionByName(name(disposed.join(resolved, "item", "left_anti"), "unresolved")).unionByName(name(customers.join(orders, "item", "left_anti"), "dangling"))


@query("""SELECT doc_id, contains(lower(text), 'stupid') OR contains(lower(text), 'idiot') AS has_forbidden, contains(lower(text), 'the') OR contains(lower(text), 'der') AS has_required,
NOT (contains(lower(text), 'stupid') OR contains(lower(text), 'idiot')) AND (contains(lower(text), 'the') OR contains(lower(text), 'der')) AS passed FROM documents""")
def correctness_score(spark, sf_dir):
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w))
    scored = table(spark, sf_dir, "documents").select("doc_id", has(("stupid", "idiot")).alias("has_forbidden"), has(("the", "der")).alias("has_required"))
    return scored.withColumn("passed", ~F.col("has_forbidden") & F.col("has_required"))


@query(f"""WITH {LINES_SQL}, e AS (SELECT company_id, period, l_returnflag AS kind, count(*) AS n FROM lines GROUP BY ALL), f AS (SELECT company_id, period, l_returnflag AS kind, count(*) AS n FROM lines WHERE l_quantity > 10 GROUP BY ALL)
SELECT company_id, CAST(sum(least(e.n, coalesce(f.n, 0))) AS BIGINT) AS matched, CAST(sum(e.n) AS BIGINT) AS expected, CAST(sum(coalesce(f.n, 0)) AS BIGINT) AS found, CAST(sum(least(e.n, coalesce(f.n, 0))) AS DOUBLE) / CAST(sum(e.n) AS DOUBLE) AS recall
FROM e LEFT JOIN f USING (company_id, period, kind) GROUP BY company_id""")
def fact_multiset_match(spark, sf_dir):
    keys = ["company_id", "period", "kind"]
    lines = fact_lines(spark, sf_dir).withColumn("kind", F.col("l_returnflag"))
    both = lines.groupBy(*keys).agg(F.count("*").alias("e"), F.count_if(F.col("l_quantity") > 10).alias("f"))  # both multisets in one pass
    return both.groupBy("company_id").agg(F.sum(F.least("e", "f")).alias("matched"), F.sum("e").alias("expected"), F.sum("f").alias("found")).withColumn("recall", F.col("matched").cast("double") / F.col("expected").cast("double"))


@query("""SELECT source AS subject, list_sort(list_distinct(list(lang))) AS retrievable, list_sort(list_filter(['de', 'en', 'es', 'fr', 'it'], lambda x: NOT list_contains(list(lang), x))) AS missing FROM documents GROUP BY source""")
def corpus_coverage(spark, sf_dir):
    declared = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "it")])
    found = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("subject")).agg(F.array_sort(F.collect_set("lang")).alias("retrievable"))
    return found.withColumn("missing", F.array_sort(F.array_except(declared, "retrievable")))


@query(f"""WITH p AS (SELECT item_id, list_sort({_KEYWORDS_SQL.format('text')})[1:4] AS dims FROM benchmark)
SELECT count(DISTINCT array_to_string(dims, ',')) AS n_plans, round(avg(CAST(len(dims) AS DOUBLE)), 3) AS mean_width, max(len(dims)) AS max_width, count(DISTINCT array_to_string(dims, ',')) = 1 AS checklist FROM p""")
def plan_diversity(spark, sf_dir):
    plans = table(spark, sf_dir, "benchmark").select(F.slice(F.array_sort(keywords(F.col("text"))), 1, 4).alias("dims"))
    return plans.agg(F.count_distinct(F.array_join("dims", ",")).alias("n_plans"), F.round(F.avg(F.size("dims").cast("double")), 3).alias("mean_width"), F.max(F.size("dims")).cast("long").alias("max_width"), (F.count_distinct(F.array_join("dims", ",")) == 1).alias("checklist"))


@query(f"""WITH m AS ({ORACLE_SQL['margin_stability']}), g AS ({ORACLE_SQL['growth_cagr']}), c AS ({ORACLE_SQL['net_cash_trajectory']}), s AS ({ORACLE_SQL['segment_concentration']}), t AS ({ORACLE_SQL['top_movers']})
SELECT 'business_quality' AS section, company_id, 1 AS place, concat_ws(' ', 'margin', band, format('{{:,.1f}}', spread)) AS text FROM m UNION ALL SELECT 'growth', company_id, 1, concat_ws(' ', 'CAGR', format('{{:,.1f}}', cagr_pct), 'up in', CAST(n_up AS VARCHAR)) FROM g
UNION ALL SELECT 'balance_sheet', company_id, 1, concat_ws(' ', 'net cash', verdict) FROM c UNION ALL SELECT 'segments', company_id, 1, concat_ws(' ', 'largest', largest, format('{{:,.1f}}', share_pct)) FROM s
UNION ALL SELECT 'movers_' || direction, company_id, place, concat_ws(' ', metric, format('{{:,.1f}}', magnitude)) FROM t""")
def report_sections(spark, sf_dir):
    """The company report as one frame: section, company, place, text; built of other queries, rendered at the edge."""

    totals, company = quarter_totals(spark, sf_dir), F.col("company_id")
    text = lambda *parts: F.concat_ws(" ", *parts)
    margin = Q.margin_stability(spark, sf_dir, totals).select(F.lit("business_quality").alias("section"), company, F.lit(1).alias("place"), text(F.lit("margin"), F.col("band"), F.format_number("spread", 1)).alias("text"))
    growth = Q.growth_cagr(spark, sf_dir, totals).select(F.lit("growth").alias("section"), company, F.lit(1).alias("place"), text(F.lit("CAGR"), F.format_number("cagr_pct", 1), F.lit("up in"), F.col("n_up").cast("string")).alias("text"))
    cash = Q.net_cash_trajectory(spark, sf_dir, totals).select(F.lit("balance_sheet").alias("section"), company, F.lit(1).alias("place"), text(F.lit("net cash"), F.col("verdict")).alias("text"))
    segment = Q.segment_concentration(spark, sf_dir).select(F.lit("segments").alias("section"), company, F.lit(1).alias("place"), text(F.lit("largest"), F.col("largest"), F.format_number("share_pct", 1)).alias("text"))
    movers = Q.top_movers(spark, sf_dir, totals).select(F.concat(F.lit("movers_"), F.col("direction")).alias("section"), company, "place", text(F.col("metric"), F.format_number("magnitude", 1)).alias("text"))
    return margin.unionByName(growth).unionByName(cash).unionByName(segment).unionByName(movers)
