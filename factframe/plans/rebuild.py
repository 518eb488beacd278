"""Queries of build fingerprints, rebuilding, verification, and the sources and sinks of runs."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.operators import ingest as I
from factframe.operators.chains import chains
from factframe.operators.provenance import diff
from factframe.plans.ingest import _FINANCIAL
from factframe.registry import ORACLE_SQL, query
from factframe.sources.filings import KIND_SQL, document_kind, documents, facts, facts_sql
from factframe.sources.tables import table

#: Declared versions: what a build is made of. The revision of the code is no part of it.
VERSIONS = {"builder": "1.0", "ontology": "3", "parser": "2.1", "shared_parser": "1.0"}
ANALYZERS = {"annual_report": "1.2", "call_transcript": "1.0", "financial_results": "2.0", "investor_presentation": "1.1"}


def affects(kind: str) -> str:
    """The digest of what can change a kind's facts: the vocabulary, both parsers and its own analyzer; the builder cannot."""
    parts = [kind, VERSIONS["ontology"], VERSIONS["parser"], VERSIONS["shared_parser"], ANALYZERS[kind]]
    return sha256("|".join(parts).encode()).hexdigest()


def fingerprint() -> str:
    """The digest of the whole build."""
    return sha256("|".join(f"{k}={v}" for k, v in sorted({**VERSIONS, **ANALYZERS}.items())).encode()).hexdigest()


_VERSION_ROWS = [(k, v) for k, v in sorted({**VERSIONS, **ANALYZERS}.items())]
_VERSIONS_SQL = "v(name, version) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _VERSION_ROWS) + ")"
_AFFECTS_SQL = f"""{_VERSIONS_SQL}, digests AS (SELECT name AS kind, sha256(name || '|{VERSIONS['ontology']}|{VERSIONS['parser']}|{VERSIONS['shared_parser']}|' || version) AS digest FROM v WHERE name IN ({', '.join(f"'{k}'" for k in ANALYZERS)}))"""


@query("""WITH v AS (SELECT user_id, event_type AS name, '1.' || count(*) AS version FROM events GROUP BY ALL)
SELECT user_id, sha256(string_agg(name || '=' || version, '|' ORDER BY name)) AS build, count(*) AS n_parts FROM v GROUP BY user_id""")
def build_fingerprints(spark, sf_dir):
    """Each user's build: a digest of what it is made of and the version of each part, by name."""
    parts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.concat(F.lit("1."), F.count("*").cast("string")).alias("version"))
    listed = F.array_sort(F.collect_list(F.struct("name", "version")))
    text = F.array_join(F.transform(listed, lambda r: F.concat(r["name"], F.lit("="), r["version"])), "|")
    return parts.groupBy("user_id").agg(F.sha2(text.cast("binary"), 256).alias("build"), F.count("*").alias("n_parts"))


def _stored(spark, sf_dir):
    """Runs with the digest that they were stored under: an old one for some, none for others."""
    n = F.col("evidence_id")
    known = spark.createDataFrame([(k, affects(k)) for k in ANALYZERS], "doc_kind string, expected string")
    digest = F.when(n % 9 == 0, F.lit(None)).when(n % 7 == 0, "old").otherwise(F.col("expected"))
    return documents(spark, sf_dir).join(F.broadcast(known), "doc_kind", "left").select("evidence_id", "company_id", "doc_kind", "source_date", digest.alias("stored"), "expected")


_STORED_SQL = f"""{_AFFECTS_SQL}, stored AS (SELECT o_orderkey AS evidence_id, o_custkey AS company_id, doc_kind, source_date, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'old' ELSE digest END AS stored, digest AS expected
  FROM (SELECT *, {KIND_SQL} AS doc_kind, CAST(o_orderdate AS DATE) AS source_date FROM orders) LEFT JOIN digests ON kind = doc_kind)"""


@query(f"WITH {_STORED_SQL} SELECT company_id, count(*) AS documents, count(*) FILTER (coalesce(stored = expected, false)) AS current, bool_and(coalesce(stored = expected, false)) AS complete FROM stored GROUP BY company_id")
def corpus_currency(spark, sf_dir):
    """Whether a company's whole corpus may be read: reading fails as a whole if any document has no current run."""
    current = F.coalesce(F.col("stored") == F.col("expected"), F.lit(False))
    return _stored(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("documents"), F.count_if(current).alias("current"), F.bool_and(current).alias("complete"))


@query(f"WITH {_STORED_SQL} SELECT evidence_id, doc_kind FROM stored WHERE stored = expected")
def current_runs(spark, sf_dir):
    """Only the runs that are current; the others are skipped, to be replaced by new ones."""
    return _stored(spark, sf_dir).where(F.col("stored") == F.col("expected")).select("evidence_id", "doc_kind")


def _values(rows):
    """company_id, period, basis, metric, value, from results documents: the latest one's value."""
    out = I.merged(I.financial_documents(rows.where("doc_kind = 'financial_results'")), ["company_id", "period", "basis", "kind"], F.lit(True), F.lit(True))
    return out.select("company_id", "period", "basis", F.col("kind").alias("metric"), "value", "sources")


_BASE_SQL = f"""{_STORED_SQL}, {facts_sql(_FINANCIAL)}, d AS (SELECT *, CASE WHEN starts_with(section, 'consolidated') OR section = 'balance_sheet' THEN 'consolidated' WHEN starts_with(section, 'standalone') THEN 'standalone' END AS basis FROM facts
  WHERE doc_kind = 'financial_results' AND starts_with(kind, 'financial_') AND value IS NOT NULL AND period IS NOT NULL), l AS (SELECT * FROM d WHERE basis IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id, period, basis, kind ORDER BY seq DESC) = 1)"""


@query(f"""WITH {_BASE_SQL} SELECT company_id, period, basis, kind AS metric, max_by(value, (source_date, evidence_id)) AS value, list_sort(list(evidence_id)) AS sources FROM l GROUP BY ALL""")
def incremental_merge(spark, sf_dir):
    """The profile after new documents are merged: only companies that have new ones are derived again, from all their documents; the others are taken as they are."""
    rows = facts(spark, sf_dir, _FINANCIAL)
    fresh = F.col("source_date") >= F.lit("2001-01-01").cast("date")
    touched = rows.where(fresh).select("company_id").distinct()
    before = _values(rows.where(~fresh)).join(touched, "company_id", "left_anti")
    return before.unionByName(_values(rows.join(touched, "company_id", "left_semi")))


@query(f"""WITH {_BASE_SQL}, r AS (SELECT company_id, period, basis, kind AS metric, CASE WHEN evidence_id % 7 = 0 THEN value * 2 ELSE value END AS value, source_date, evidence_id FROM l)
SELECT company_id, period, basis, metric, max_by(value, (source_date, evidence_id)) AS value FROM r GROUP BY ALL""")
def rederive_replacing(spark, sf_dir):
    """The profile derived again with the stale documents analysed anew (here their values double); all other inputs must be there."""
    rows = facts(spark, sf_dir, _FINANCIAL)
    again = rows.where(F.col("evidence_id") % 7 == 0).withColumn("value", F.col("value") * 2)
    kept = rows.where(F.col("evidence_id") % 7 != 0)
    return _values(kept.unionByName(again)).drop("sources")


@query(f"""WITH {_STORED_SQL} SELECT doc_kind, count(*) AS documents, count(*) FILTER (expected IS NULL) AS unknown, count(*) FILTER (expected IS NOT NULL AND stored IS DISTINCT FROM expected) AS stale_only, count(*) FILTER (expected IS NOT NULL) AS from_evidence, count(*) FILTER (stored IS NOT NULL AND expected IS NOT NULL) AS from_assertions FROM stored GROUP BY doc_kind""")
def rebuild_plan(spark, sf_dir):
    """What each mode of a rebuild would work on: everything, what is stored, or what is stale."""
    known = F.col("expected").isNotNull()
    return _stored(spark, sf_dir).groupBy("doc_kind").agg(F.count("*").alias("documents"), F.count_if(~known).alias("unknown"), F.count_if(known & ~F.col("stored").eqNullSafe(F.col("expected"))).alias("stale_only"), F.count_if(known).alias("from_evidence"), F.count_if(known & F.col("stored").isNotNull()).alias("from_assertions"))


@query(f"""WITH {_STORED_SQL}, c AS (SELECT company_id, count(*) FILTER (expected IS NULL) AS unknown, count(*) FILTER (stored IS NULL) AS unread, count(*) FILTER (stored <> expected) AS stale FROM stored GROUP BY company_id)
SELECT company_id, CASE WHEN unknown > 0 THEN 'kinds' WHEN unread > 0 THEN 'runs' WHEN stale > 0 THEN 'currency' ELSE 'none' END AS failed, CASE WHEN unknown > 0 THEN 'register an analyzer' WHEN unread > 0 THEN 'analyse' WHEN stale > 0 THEN 'rebuild stale only' END AS remedy FROM c""")
def store_verification(spark, sf_dir):
    """Checks in order; the first that fails is named with its remedy."""
    known = F.col("expected").isNotNull()
    counts = _stored(spark, sf_dir).groupBy("company_id").agg(F.count_if(~known).alias("u"), F.count_if(F.col("stored").isNull()).alias("r"), F.count_if(F.col("stored") != F.col("expected")).alias("s"))
    first = lambda names: F.when(F.col("u") > 0, names[0]).when(F.col("r") > 0, names[1]).when(F.col("s") > 0, names[2])
    return counts.select("company_id", F.coalesce(first(("kinds", "runs", "currency")), F.lit("none")).alias("failed"), first(("register an analyzer", "analyse", "rebuild stale only")).alias("remedy"))


_LINKS_SQL = "j AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderkey // 2 AS supersedes FROM orders WHERE o_orderkey > 0), n AS (SELECT j.id, j.subject, CASE WHEN p.id IS NOT NULL THEN j.supersedes END AS supersedes FROM j LEFT JOIN j p ON p.id = j.supersedes AND p.subject % 3 = j.subject % 3)"


@query(f"""WITH RECURSIVE {_LINKS_SQL}, c AS (SELECT id AS newest, id, supersedes, 0 AS depth FROM n WHERE id NOT IN (SELECT supersedes FROM n WHERE supersedes IS NOT NULL)
  UNION ALL SELECT c.newest, n.id, n.supersedes, c.depth + 1 FROM c JOIN n ON n.id = c.supersedes) SELECT newest, id, CAST(depth AS INTEGER) AS depth FROM c""")
def judgment_chains(spark, sf_dir):
    """From every judgment that nothing supersedes back along its links, which may meet."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.floor(F.col("o_orderkey") / 2).alias("supersedes"))
    other = orders.select(F.col("id").alias("supersedes"), (F.col("subject") % 3).alias("_s"))
    known = orders.withColumn("_s", F.col("subject") % 3).join(other, ["supersedes", "_s"]).select("id", "supersedes")
    return chains(orders.select("id").join(known, "id", "left")).select("newest", "id", F.col("depth").cast("int").alias("depth"))


_CYCLES_SQL = """
WITH f AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER k AS n, min(o_orderkey) OVER k AS oldest, max(o_orderkey) OVER k AS newest
  FROM orders WINDOW k AS (PARTITION BY o_custkey)),
h AS (SELECT *, max(CASE WHEN i = (n + 1) // 2 THEN id END) OVER (PARTITION BY c) AS middle FROM f)
SELECT CASE WHEN c % 10 = 0 AND id <= middle THEN oldest ELSE newest END AS newest, id,
  CAST(CASE WHEN c % 10 <> 0 THEN n - i WHEN id > middle THEN n - i WHEN i = 1 THEN 0 ELSE (n + 1) // 2 - i + 1 END AS BIGINT) AS depth,
  CASE WHEN c % 10 = 0 THEN 'cycle' WHEN c % 10 = 1 THEN 'dangling' ELSE 'root' END AS ends, CASE WHEN c % 10 = 0 THEN oldest END AS cycle
FROM h"""


@query(_CYCLES_SQL)
def judgment_cycles(spark, sf_dir):
    """Each customer's orders supersede the ones before; of some the oldest supersedes the middle one, or one that isn't there."""
    of = Window.partitionBy("c").orderBy("id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    placed = orders.select("id", "c", F.row_number().over(of).alias("i"), F.lag("id").over(of).alias("before"))
    middle = placed.groupBy("c").agg(F.count("*").alias("n")).select("c", F.floor((F.col("n") + 1) / 2).alias("i"))
    back = placed.join(middle, ["c", "i"]).select("c", F.col("id").alias("middle"))
    oldest = F.when(F.col("c") % 10 == 0, F.col("middle")).when(F.col("c") % 10 == 1, -F.col("id") - 1)
    return chains(placed.join(back, "c").select("id", F.when(F.col("i") == 1, oldest).otherwise(F.col("before")).alias("supersedes")))


@query(f"""WITH {_LINKS_SQL} SELECT j.id, CASE WHEN j.id % 11 = 0 THEN 'duplicate' WHEN n.supersedes IS NULL AND j.supersedes > 0 THEN 'dangling' ELSE 'appended' END AS outcome, EXISTS (SELECT 1 FROM n s WHERE s.supersedes = j.id) AS locked FROM j JOIN n USING (id)""")
def judgment_store(spark, sf_dir):
    """What appending does with each judgment, and whether one may still be deleted: not if another supersedes it."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("_s"), F.floor(F.col("o_orderkey") / 2).alias("supersedes"))
    found = orders.select(F.col("id").alias("supersedes"), "_s", F.lit(True).alias("_found"))
    linked = orders.join(found, ["supersedes", "_s"], "left")
    locked = linked.where("_found").select(F.col("supersedes").alias("id"), F.lit(True).alias("_locked")).distinct()
    outcome = F.when(F.col("id") % 11 == 0, "duplicate").when(F.col("_found").isNull() & (F.col("supersedes") > 0), "dangling").otherwise("appended")
    return linked.join(locked, "id", "left").select("id", outcome.alias("outcome"), F.coalesce("_locked", F.lit(False)).alias("locked"))


@query(f"""SELECT CAST(o_orderdate AS DATE) AS run, count(*) AS found, count(*) FILTER (o_orderstatus = 'F') AS downloaded, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped,
CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS bytes, list_sort(list_distinct(list({KIND_SQL}))) AS kinds FROM orders GROUP BY ALL""")
def acquisition_runs(spark, sf_dir):
    """The record of each acquisition run: counts by outcome, size and kinds."""
    status, size = F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("run")).agg(
        F.count("*").alias("found"), F.count_if(status == "F").alias("downloaded"), F.count_if(status == "P").alias("failed"), F.count_if(status == "O").alias("skipped"),
        F.sum(F.when(status == "F", size).otherwise(0)).cast("double").alias("bytes"), F.array_sort(F.collect_set(document_kind(F.col("o_orderpriority")))).alias("kinds"),
    )


# The kinds of document that each profile of an acquisition selects.
PROFILES = {"default": ("annual_report", "financial_results", "call_transcript", "investor_presentation"), "results_only": ("financial_results",)}


@query(f"SELECT profile, kind, count(*) AS n FROM (SELECT {KIND_SQL} AS kind FROM orders), (VALUES {', '.join(f'({p!r}, {k!r})' for p, ks in PROFILES.items() for k in ks)}) f(profile, wanted) WHERE kind = wanted GROUP BY ALL")
def profile_selection(spark, sf_dir):
    """How many documents each profile selects."""
    wanted = spark.createDataFrame([(p, k) for p, ks in PROFILES.items() for k in ks], "profile string, kind string")
    return documents(spark, sf_dir).groupBy(F.col("doc_kind").alias("kind")).agg(F.count("*").alias("n")).join(F.broadcast(wanted), "kind").select("profile", "kind", "n")


@query("""SELECT o_orderkey AS evidence_id, CASE WHEN o_orderstatus = 'F' THEN text END AS content FROM orders LEFT JOIN documents ON doc_id = o_orderkey WHERE o_orderkey IN (SELECT doc_id FROM documents)""")
def document_content(spark, sf_dir):
    """The text of the catalogue's documents, null where it was not parsed."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_orderstatus").alias("_s"))
    return orders.join(docs, "evidence_id").select("evidence_id", F.when(F.col("_s") == "F", F.col("text")).alias("content"))


@query("""WITH r AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer) SELECT 'index-' || CAST(c_custkey AS VARCHAR) AS evidence_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'annual_report' WHEN c_mktsegment = 'FURNITURE' THEN 'shareholding_pattern' ELSE 'governance_report' END AS kind,
c_name || ' ' || CAST(2000 + c_custkey % 20 AS VARCHAR) AS title, make_date(2000 + CAST(c_custkey % 20 AS INTEGER), 3, 31) AS source_date FROM r WHERE c_acctbal > 0""")
def index_records(spark, sf_dir):
    """Records of three kinds of index to one shape, with ids and dates of their own; records without a file are dropped."""
    year = (2000 + F.col("c_custkey") % 20).cast("int")
    kind = F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "annual_report").when(F.col("c_mktsegment") == "FURNITURE", "shareholding_pattern").otherwise("governance_report")
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("index-"), F.col("c_custkey").cast("string")).alias("evidence_id"), kind.alias("kind"), F.concat_ws(" ", "c_name", year.cast("string")).alias("title"), F.make_date(year, F.lit(3), F.lit(31)).alias("source_date"))


@query("""WITH s(suite, least) AS (VALUES ('core', 20), ('full', 0), ('grounding', 10)), c AS (SELECT item_id, length(text) % 30 AS weight, list_filter(['kb', 'model', 'peers'], lambda x: (item_id + length(x)) % 2 = 0) AS requires FROM benchmark)
SELECT suite, item_id, len(list_filter(requires, lambda x: x NOT IN ('kb', 'peers'))) = 0 AS available FROM c JOIN s ON weight >= least""")
def evaluation_cases(spark, sf_dir):
    """The cases of each suite, and whether what they require is there; ids are unique or the suite is refused."""
    items = table(spark, sf_dir, "benchmark")
    requires = F.filter(F.array(*[F.lit(x) for x in ("kb", "model", "peers")]), lambda x: (F.col("item_id") + F.length(x)) % 2 == 0)
    repeated = items.groupBy("item_id").agg(F.count("*").alias("_n"))
    checked = items.join(repeated, "item_id").withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a case's id is repeated"))))
    suites = F.explode(F.array(*[F.struct(F.lit(s).alias("suite"), F.lit(n).alias("least")) for s, n in (("core", 20), ("full", 0), ("grounding", 10))]))
    out = checked.where("_ok is null").select("item_id", (F.length("text") % 30).alias("_w"), requires.alias("_r"), suites.alias("_s")).where("_w >= _s.least")
    return out.select("_s.suite", "item_id", (F.size(F.array_except("_r", F.array(F.lit("kb"), F.lit("peers")))) == 0).alias("available"))


@query("""WITH t(kind, obligation) AS (VALUES ('fact', 'required'), ('derived', 'required'), ('conclusion', 'required'), ('evidence_note', 'optional'), ('disclosure', 'forbidden'), ('synthesis', 'optional')),
f AS (SELECT event_id, list_extract(['fact', 'derived', 'conclusion', 'evidence_note', 'disclosure', 'other'], CAST(event_id % 6 AS INTEGER) + 1) AS kind, event_id % 4 > 0 AS cited FROM events)
SELECT event_id, coalesce(obligation, 'optional') AS obligation, NOT (coalesce(obligation, 'optional') = 'required' AND NOT cited) AND NOT (coalesce(obligation, 'optional') = 'forbidden' AND cited) AS met FROM f LEFT JOIN t USING (kind)""")
def citation_obligations(spark, sf_dir):
    """Whether each finding must, may or must not cite, and whether it does."""
    n = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("fact", "derived", "conclusion", "evidence_note", "disclosure", "other")]), (n % 6).cast("int"))
    table_of = F.create_map(*[F.lit(x) for p in (("fact", "required"), ("derived", "required"), ("conclusion", "required"), ("evidence_note", "optional"), ("disclosure", "forbidden"), ("synthesis", "optional")) for x in p])
    duty, cited = F.coalesce(table_of[kind], F.lit("optional")), n % 4 > 0
    return table(spark, sf_dir, "events").select("event_id", duty.alias("obligation")).withColumn("met", ~((F.col("obligation") == "required") & ~cited) & ~((F.col("obligation") == "forbidden") & cited))


_CASES_SQL = f"""k AS (SELECT event_id AS case_id, list_extract(['derived', 'negative', NULL], CAST(event_id % 3 AS INTEGER) + 1) AS origin, event_id % 2 = 0 AS difficult, event_id % 5 > 0 AS labelled, event_id * 3 AS evidence_id, list_extract(['financial_results', 'annual_report'], CAST(event_id % 2 AS INTEGER) + 1) AS wanted FROM events)"""


@query(f"""WITH {_CASES_SQL}, o AS (SELECT o_orderkey AS evidence_id, {KIND_SQL} AS kind FROM orders)
SELECT case_id, 'missing_provenance' AS issue FROM k WHERE difficult AND origin IS NULL UNION ALL SELECT case_id, 'missing_label' FROM k WHERE difficult AND origin = 'derived' AND NOT labelled
UNION ALL SELECT case_id, 'missing_evidence' FROM k LEFT JOIN o USING (evidence_id) WHERE origin = 'derived' AND o.kind IS NULL UNION ALL SELECT case_id, 'kind_mismatch' FROM k JOIN o USING (evidence_id) WHERE origin = 'derived' AND labelled AND kind <> wanted""")
def label_validation(spark, sf_dir):
    """What is wrong with a suite's labels: no provenance, no label, evidence that is not there, or of another kind."""
    n = F.col("event_id")
    origin = F.when(n % 3 == 0, "derived").when(n % 3 == 1, "negative")
    cases = table(spark, sf_dir, "events").select(n.alias("case_id"), origin.alias("origin"), (n % 2 == 0).alias("difficult"), (n % 5 > 0).alias("labelled"), (n * 3).alias("evidence_id"), F.when(n % 2 == 0, "financial_results").otherwise("annual_report").alias("wanted"))
    known = documents(spark, sf_dir).select("evidence_id", F.col("doc_kind").alias("kind"))
    derived = F.col("origin") == "derived"
    found = cases.join(known, "evidence_id", "left")
    issues = F.array(
        F.when(F.col("difficult") & F.col("origin").isNull(), "missing_provenance"), F.when(F.col("difficult") & derived & ~F.col("labelled"), "missing_label"),
        F.when(derived & F.col("kind").isNull(), "missing_evidence"), F.when(derived & F.col("labelled") & (F.col("kind") != F.col("wanted")), "kind_mismatch"),
    )
    return found.select("case_id", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))


# Intents of a research question in order with their cues, and the dimensions of each with their priorities.
RESEARCH_INTENTS = {
    "comparison": ("compare", "versus", " vs ", " vs. ", "against its peer", "relative to", "better than", "which is stronger", "peer comparison"),
    "invest_decision": ("should i invest", "should i buy", "worth investing", "worth buying", "is it a good investment", "investment case", "should we invest", "would you invest", "is this a buy", "attractive investment"),
    "risk_assessment": ("key risks", "what are the risks", "risk to", "risks to", "downside", "what could go wrong", "bear case", "biggest risk", "red flags"),
    "thematic": ("exposed", "exposure", "how does it handle", "impact of", "affected by", "sensitivity to", "dependent on", "reliance on"),
}
DIMENSIONS = {
    "invest_decision": {"business_quality": 9, "valuation": 8, "balance_sheet": 7, "what_changed": 6, "risks": 5, "management_credibility": 4},
    "risk_assessment": {"risks": 10, "balance_sheet": 8, "what_changed": 6, "management_credibility": 4},
    "comparison": {"business_quality": 9, "competitive_position": 8, "valuation": 7, "balance_sheet": 6, "what_changed": 4},
    "thematic": {"risks": 8, "business_quality": 7, "what_changed": 5},
    "targeted": {"what_changed": 5},
}
_ASKED = (("Should I invest in A, and what are the risks?", 1), ("How do the two compare?", 1), ("What are the risks to the plan?", 2), ("What is the impact of tariffs?", 1), ("Who signed the accounts?", 1), ("A versus B", 2))
_RESEARCH_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + f" THEN '{n}'" for n, cues in RESEARCH_INTENTS.items()) + " ELSE 'targeted' END"


@query(f"""WITH q AS (SELECT item_id, text, 1 + item_id % 2 AS subjects FROM benchmark UNION ALL SELECT * FROM (VALUES {', '.join(f"({-i - 1}, '{t}', {n})" for i, (t, n) in enumerate(_ASKED))}) v), p AS (SELECT item_id, subjects, CASE WHEN subjects > 1 THEN 'comparison' ELSE {_RESEARCH_SQL} END AS intent FROM q),
d(intent, dimension, priority) AS (VALUES {', '.join(f"('{i}', '{d}', {n})" for i, ds in DIMENSIONS.items() for d, n in ds.items())})
SELECT item_id, intent, dimension, priority, row_number() OVER (PARTITION BY item_id ORDER BY priority DESC) AS place FROM p JOIN d USING (intent) WHERE NOT (dimension = 'competitive_position' AND subjects < 2)""")
def research_plan(spark, sf_dir):
    """What each question has to look into, in order of priority; more than one subject makes a comparison, and a single one has no peers."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", (1 + F.col("item_id") % 2).alias("subjects"))
    asked = items.unionByName(spark.createDataFrame([(-i - 1, t, n) for i, (t, n) in enumerate(_ASKED)], "item_id long, text string, subjects long"))
    found = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.lower("text").contains(c)), F.lit(name)) for name, cues in RESEARCH_INTENTS.items()], F.lit("targeted"))
    plan = asked.select("item_id", "subjects", F.when(F.col("subjects") > 1, "comparison").otherwise(found).alias("intent"))
    parts = spark.createDataFrame([(i, d, n) for i, ds in DIMENSIONS.items() for d, n in ds.items()], "intent string, dimension string, priority int")
    out = plan.join(F.broadcast(parts), "intent").where(~((F.col("dimension") == "competitive_position") & (F.col("subjects") < 2)))
    return out.select("item_id", "intent", "dimension", "priority", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("priority"))).cast("long").alias("place"))


_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH a AS (SELECT user_id AS subject, {_NORM.format("event_type || '!  ' || props")} AS key, max(CASE WHEN value > 5 THEN 'high' ELSE 'low' END) AS confidence FROM events WHERE day(ts) <= 15 GROUP BY ALL), b AS (SELECT user_id AS subject, {_NORM.format("upper(event_type) || ' ' || props")} AS key, max(CASE WHEN value > 6 THEN 'high' ELSE 'low' END) AS confidence FROM events WHERE day(ts) > 15 GROUP BY ALL)
SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN a.confidence <> b.confidence THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.subject = b.subject AND a.key = b.key""")
def view_diff(spark, sf_dir):
    """Two versions of a view, matched by their statements without case and marks: added, removed, changed in confidence, or unchanged."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+", " "))
    events = table(spark, sf_dir, "events")
    side = lambda keep, text, level: events.where(keep).groupBy(F.col("user_id").alias("subject"), plain(text).alias("key")).agg(F.max(F.when(F.col("value") > level, "high").otherwise("low")).alias("_c"))
    old = side(F.dayofmonth("ts") <= 15, F.concat("event_type", F.lit("!  "), "props"), 5).withColumnRenamed("_c", "_a")
    new = side(F.dayofmonth("ts") > 15, F.concat(F.upper("event_type"), F.lit(" "), "props"), 6).withColumnRenamed("_c", "_b")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged")
    return old.join(new, ["subject", "key"], "full_outer").select("subject", "key", change.alias("change"))


@query(f"""WITH p AS (SELECT company_id, period, basis, metric, value FROM ({ORACLE_SQL['ingest_financial_profile']})), f AS (SELECT company_id || '/' || CAST(period AS VARCHAR) || '/' || basis || '/' || metric AS path, value FROM p),
a AS (SELECT * FROM f WHERE NOT contains(path, 'standalone/financial_cash')), b AS (SELECT path, CASE WHEN contains(path, 'net_profit') THEN value + 1 ELSE value END AS value FROM f WHERE NOT contains(path, '-03-31'))
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN '-' WHEN a.path IS NULL THEN '+' ELSE '~' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.value <> b.value""")
def profile_path_diff(spark, sf_dir):
    """Two profiles flattened to a path and a leaf a row, and what differs between them."""
    profile = I.financial_profile(facts(spark, sf_dir, _FINANCIAL))
    leaves = profile.select(F.concat_ws("/", F.col("company_id").cast("string"), F.col("period").cast("string"), "basis", "metric").alias("path"), "value")
    left = leaves.where(~F.col("path").contains("standalone/financial_cash"))
    right = leaves.where(~F.col("path").contains("-03-31")).withColumn("value", F.when(F.col("path").contains("net_profit"), F.col("value") + 1).otherwise(F.col("value")))
    return diff(left, right, ["path"], "value").select("path", "change")


@query("""WITH d(metric, domain) AS (VALUES ('financial_revenue', 'financial'), ('esg_headcount', 'esg'), ('ownership_fpi', 'ownership')), k AS (SELECT l_orderkey AS evidence_id, list_extract(['financial_revenue', 'esg_headcount', 'ownership_fpi', 'other'], CAST(l_partkey % 4 AS INTEGER) + 1) AS metric FROM lineitem)
SELECT domain, count(*) AS n FROM k JOIN d USING (metric) GROUP BY domain""")
def domain_routing(spark, sf_dir):
    """Facts by the domain of their metric; metrics that are in no registry are in no domain."""
    registry = spark.createDataFrame([("financial_revenue", "financial"), ("esg_headcount", "esg"), ("ownership_fpi", "ownership")], "metric string, domain string")
    metric = F.get(F.array(*[F.lit(m) for m in ("financial_revenue", "esg_headcount", "ownership_fpi", "other")]), (F.col("l_partkey") % 4).cast("int"))
    counted = table(spark, sf_dir, "lineitem").groupBy(metric.alias("metric")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(registry), "metric").groupBy("domain").agg(F.sum("n").alias("n"))
