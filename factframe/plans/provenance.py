"""Queries of content ids, staleness, versions, diffs and traces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.operators import provenance as P
from factframe.registry import query
from factframe.sources.tables import FACTS_SQL, LINES_SQL, METRICS, fact_lines, snapshots, table


@query(r"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_linestatus) - 1 AS ordinal FROM lineitem)
SELECT l_orderkey AS evidence_id, l_returnflag AS kind, CAST(ordinal AS INTEGER) AS ordinal, sha256(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), l_returnflag, CAST(ordinal AS VARCHAR), CAST(l_partkey AS VARCHAR))) AS assertion_id FROM o""")
def assertion_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]
    numbered = lines.withColumn("ordinal", P.ordinal(["l_orderkey", "l_returnflag"], order))
    return numbered.select(F.col("l_orderkey").alias("evidence_id"), F.col("l_returnflag").alias("kind"), "ordinal", P.content_id(F.col("l_orderkey"), F.col("l_returnflag"), F.col("ordinal"), F.col("l_partkey")).alias("assertion_id"))


_AFFECTS = {"1-URGENT": "a1", "2-HIGH": "b1", "3-MEDIUM": "c2", "4-NOT SPECIFIED": "d1"}
_RUNS_SQL = "runs AS (SELECT o_orderkey AS evidence_id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'O' THEN 'a1' WHEN 'F' THEN 'c2' END AS stored FROM orders)"


@query(f"""WITH {_RUNS_SQL} SELECT r.evidence_id, r.kind, r.stored, e.expected FROM runs r LEFT JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _AFFECTS.items())}) e(kind, expected) ON r.kind = e.kind
WHERE r.stored IS DISTINCT FROM e.expected""")
def stale_runs(spark, sf_dir):
    status = F.col("o_orderstatus")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("kind"), F.when(status == "O", "a1").when(status == "F", "c2").alias("stored"))
    expected = F.create_map(*[F.lit(x) for p in _AFFECTS.items() for x in p])[F.col("kind")]
    return runs.withColumn("expected", expected).where(~F.col("stored").eqNullSafe(F.col("expected")))


_VERSIONS_SQL = "v AS (SELECT o_custkey AS evidence_id, o_orderkey AS run_id, CAST(o_orderkey % 3 AS VARCHAR) || '.' || CAST(o_orderkey % 12 AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '.rc' ELSE '' END AS version FROM orders)"


@query(f"""WITH {_VERSIONS_SQL}, k AS (SELECT *, list_transform(string_split(version, '.'), lambda x: coalesce(try_cast(x AS INTEGER), 0)) AS key FROM v)
SELECT evidence_id, run_id, version FROM k QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY key DESC, run_id DESC) = 1""")
def select_run_version(spark, sf_dir):
    k = F.col("o_orderkey")
    version = F.concat((k % 3).cast("string"), F.lit("."), (k % 12).cast("string"), F.when(k % 7 == 0, ".rc").otherwise(""))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("evidence_id"), k.alias("run_id"), version.alias("version"))
    best = runs.groupBy("evidence_id").agg(F.max_by(F.struct("run_id", "version"), F.struct(P.version_key(F.col("version")), "run_id")).alias("b"))
    return best.select("evidence_id", "b.run_id", "b.version")


@query("""SELECT count(*) AS n_runs, coalesce(CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT), 0) AS n_failed, count(DISTINCT o_custkey) AS n_evidence,
CAST(max(o_orderdate) AS DATE) AS latest, count(DISTINCT o_orderpriority) AS n_fingerprints FROM orders""")
def store_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n_runs"), F.count_if(F.col("o_orderstatus") == "P").alias("n_failed"), F.count_distinct("o_custkey").alias("n_evidence"), F.max("o_orderdate").cast("date").alias("latest"), F.count_distinct("o_orderpriority").alias("n_fingerprints"))


_TWO_SQL = f"""{LINES_SQL}, a AS (SELECT company_id, period, CAST(sum(net) AS DOUBLE) AS value FROM lines WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT company_id, period, CAST(sum(net) AS DOUBLE) AS value FROM lines WHERE l_returnflag <> 'N' GROUP BY ALL)"""


@query(f"""WITH {_TWO_SQL} SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.period, b.period) AS period, a.value AS old, b.value AS new,
CASE WHEN b.company_id IS NULL THEN '-' WHEN a.company_id IS NULL THEN '+' ELSE '~' END AS change FROM a FULL JOIN b ON a.company_id = b.company_id AND a.period = b.period
WHERE a.company_id IS NULL OR b.company_id IS NULL OR a.value <> b.value""")
def profile_diff(spark, sf_dir):
    lines = fact_lines(spark, sf_dir)
    side = lambda condition: lines.where(condition).groupBy("company_id", "period").agg(F.sum("net").cast("double").alias("value"))
    return P.diff(side("l_linestatus = 'F'"), side("l_returnflag <> 'N'"), ["company_id", "period"], "value")


_DIGEST_SQL = " || '|' || ".join(f"coalesce(CAST({c if c in ('company_id', 'period') else f'CAST({c} AS DECIMAL(24,4))'} AS VARCHAR), '')" for c in sorted(("company_id", "period", *METRICS)))


@query(f"""WITH {FACTS_SQL}, h AS (SELECT md5({_DIGEST_SQL}) AS h FROM f)
SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS BIGINT) AS head, CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS BIGINT) AS middle FROM h""")
def profile_digest(spark, sf_dir):
    wide = snapshots(spark, sf_dir)
    return P.digest(wide.select("company_id", "period", *[F.col(m).cast("decimal(24,4)").alias(m) for m in METRICS]))


@query("""WITH RECURSIVE n AS (SELECT o_custkey AS subject, o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT subject, id AS newest, id, supersedes, 0 AS depth FROM n WHERE id NOT IN (SELECT supersedes FROM n WHERE supersedes IS NOT NULL)
  UNION ALL SELECT c.subject, c.newest, n.id, n.supersedes, c.depth + 1 FROM c JOIN n ON n.id = c.supersedes)
SELECT subject, newest, id, CAST(depth AS INTEGER) AS depth FROM c""")
def supersede_chain(spark, sf_dir):
    """Judgments of a subject from the newest back. Links are chains, so the depth is the rank from the end: one window instead of one join a step."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    back = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return urgent.select(F.col("o_custkey").alias("subject"), F.first("o_orderkey").over(back).alias("newest"), F.col("o_orderkey").alias("id"), (F.row_number().over(back) - 1).alias("depth"))


@query(f"""WITH {LINES_SQL} SELECT l.evidence_id, l.company_id, l.l_linenumber, CAST(l.net AS DOUBLE) AS value, o.o_orderpriority AS kind, c.c_name AS source, length(d.text) AS n_chars, substr(d.text, 1, 200) AS excerpt
FROM lines l JOIN orders o ON l.evidence_id = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN documents d ON d.doc_id = l.evidence_id""")
def trace_fact(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("_kind"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.length("text").cast("long").alias("n_chars"), F.substring("text", 1, 200).alias("excerpt"))
    runs = orders.join(customers, "o_custkey").join(docs, "evidence_id", "left")
    return fact_lines(spark, sf_dir).select("evidence_id", "company_id", "l_linenumber", F.col("net").cast("double").alias("value")).join(runs, "evidence_id").select("evidence_id", "company_id", "l_linenumber", "value", F.col("_kind").alias("kind"), "source", "n_chars", "excerpt")


@query("""WITH v AS (SELECT event_id AS view_id, user_id, CAST(ts AS DATE) AS as_of, event_id * 2 AS cites FROM events WHERE event_type = 'view'),
m AS (SELECT v.view_id, o.o_orderkey IS NULL AS missing FROM v LEFT JOIN orders o ON v.cites = o.o_orderkey),
s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT v.view_id, any_value(m.missing) AS missing, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_since FROM v JOIN m USING (view_id) LEFT JOIN s ON s.user_id = v.user_id AND s.day > v.as_of GROUP BY v.view_id""")
def view_staleness(spark, sf_dir):
    """Which views cite evidence that is gone, and how much has come since: a running count per user, not a range join."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    counted = events.where("event_type in ('view', 'purchase')").select("event_id", "user_id", "event_type", day.alias("day"))
    later = Window.partitionBy("user_id").orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(1, Window.unboundedFollowing)
    since = counted.withColumn("n_since", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("long")).over(later), F.lit(0))).where("event_type = 'view'")
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_cites"), F.lit(True).alias("_known"))
    return since.withColumn("_cites", F.col("event_id") * 2).join(known, "_cites", "left").select(F.col("event_id").alias("view_id"), F.col("_known").isNull().alias("missing"), "n_since")


@query(f"""WITH {FACTS_SQL} SELECT company_id, count(*) AS n_periods, {', '.join(f'count({m}) AS n_{m}' for m in METRICS)} FROM f GROUP BY company_id""")
def profile_coverage(spark, sf_dir):
    return snapshots(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n_periods"), *[F.count(m).alias(f"n_{m}") for m in METRICS])


@query(f"""WITH {LINES_SQL}, k AS (SELECT company_id, period, kind, CAST(sum(net) AS DOUBLE) AS revenue, count(DISTINCT evidence_id) AS n_evidence FROM lines GROUP BY ALL)
SELECT company_id, period, kind, revenue, n_evidence FROM k""")
def evidence_by_kind(spark, sf_dir):
    return fact_lines(spark, sf_dir).groupBy("company_id", "period", "kind").agg(F.sum("net").cast("double").alias("revenue"), F.count_distinct("evidence_id").alias("n_evidence"))
