"""Queries that turn documents' facts into profiles, ledgers and rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.operators import ingest as I
from factframe.registry import query
from factframe.sources.filings import KIND_SQL, documents, facts, facts_sql
from factframe.sources.tables import table

_FINANCIAL = ("financial_revenue", "financial_net_profit", "financial_cash", "report_period_type")
_BASIS_SQL = "CASE WHEN starts_with(section, 'consolidated') THEN 'consolidated' WHEN starts_with(section, 'standalone') THEN 'standalone' WHEN section IN ('balance_sheet', 'cash_flow_statement') THEN 'consolidated' END"


@query(f"""WITH {facts_sql(_FINANCIAL)} SELECT evidence_id, seq, CASE WHEN starts_with(kind, 'financial_') THEN 'financial' WHEN starts_with(kind, 'esg_') THEN 'esg' WHEN starts_with(kind, 'ownership_') THEN 'ownership' END AS family,
{_BASIS_SQL} AS basis, value IS NOT NULL AND period IS NOT NULL AS is_numeric, NOT (kind = 'financial_revenue' AND unit <> 'CRORE_INR') AS unit_fits FROM facts""")
def fact_guards(spark, sf_dir):
    """What decides whether a fact reaches a snapshot: family, basis, number and period, unit of a revenue."""
    kind = F.col("kind")
    family = F.when(kind.startswith("financial_"), "financial").when(kind.startswith("esg_"), "esg").when(kind.startswith("ownership_"), "ownership")
    return facts(spark, sf_dir, _FINANCIAL).select(
        "evidence_id", "seq", family.alias("family"), I.basis_of(F.col("section")).alias("basis"), (F.col("value").isNotNull() & F.col("period").isNotNull()).alias("is_numeric"), (~((kind == "financial_revenue") & (F.col("unit") != "CRORE_INR"))).alias("unit_fits")
    )


@query(f"""WITH {facts_sql(_FINANCIAL)}, t AS (SELECT evidence_id, scope AS report FROM facts WHERE kind = 'report_period_type' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq) = 1)
SELECT f.evidence_id, company_id, period, {_BASIS_SQL} AS basis, coalesce(report, 'quarterly') AS period_type, kind AS metric, value FROM facts f LEFT JOIN t USING (evidence_id)
WHERE doc_kind = 'financial_results' AND starts_with(kind, 'financial_') AND value IS NOT NULL AND period IS NOT NULL AND {_BASIS_SQL} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY f.evidence_id, period, basis, kind ORDER BY seq DESC) = 1""")
def ingest_results(spark, sf_dir):
    """A results document by itself: the last value of each kind, its basis and period type."""
    mine = I.financial_documents(facts(spark, sf_dir, _FINANCIAL).where("doc_kind = 'financial_results'"))
    return mine.select("evidence_id", "company_id", "period", "basis", "period_type", F.col("kind").alias("metric"), "value")


@query(f"""WITH {facts_sql(_FINANCIAL)},
d AS (SELECT *, CASE WHEN doc_kind = 'financial_results' THEN {_BASIS_SQL} ELSE 'consolidated' END AS basis FROM facts
  WHERE starts_with(kind, 'financial_') AND value IS NOT NULL AND period IS NOT NULL AND doc_kind <> 'other' AND NOT (doc_kind = 'call_transcript' AND kind = 'financial_revenue' AND unit <> 'CRORE_INR')),
v AS (SELECT * FROM d WHERE basis IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id, period, basis, kind ORDER BY seq DESC) = 1),
r AS (SELECT evidence_id, scope AS report FROM facts WHERE kind = 'report_period_type' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq) = 1),
s AS (SELECT evidence_id, period, scope AS stated FROM facts WHERE kind = 'report_period_type' AND period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id, period ORDER BY seq DESC) = 1),
n AS (SELECT evidence_id, period, basis, scope AS spoken FROM v WHERE kind = 'financial_revenue'),
w AS (SELECT v.*, CASE doc_kind WHEN 'annual_report' THEN 'annual' WHEN 'investor_presentation' THEN coalesce(stated, 'annual') WHEN 'call_transcript' THEN coalesce(spoken, report, 'quarterly') ELSE coalesce(report, 'quarterly') END AS own_type,
  CASE doc_kind WHEN 'financial_results' THEN 0 WHEN 'annual_report' THEN 1 ELSE 2 END AS class FROM v LEFT JOIN r USING (evidence_id) LEFT JOIN s USING (evidence_id, period) LEFT JOIN n USING (evidence_id, period, basis)),
m AS (SELECT company_id, period, basis, own_type AS period_type FROM w QUALIFY row_number() OVER (PARTITION BY company_id, period, basis ORDER BY class = 2, source_date, evidence_id) = 1),
c AS (SELECT company_id, period, basis, count(DISTINCT evidence_id) AS n_sources FROM w GROUP BY ALL)
SELECT company_id, period, basis, period_type, kind AS metric, value, n_sources FROM w JOIN m USING (company_id, period, basis) JOIN c USING (company_id, period, basis)
WHERE NOT (doc_kind = 'call_transcript' AND kind = 'financial_revenue' AND scope <> period_type)
QUALIFY row_number() OVER (PARTITION BY company_id, period, basis, kind ORDER BY class, CASE WHEN class = 0 THEN -epoch(source_date) ELSE epoch(source_date) END, CASE WHEN class = 0 THEN -evidence_id ELSE evidence_id END) = 1""")
def ingest_financial_profile(spark, sf_dir):
    """Results, annual reports, transcripts and presentations merged into one series per company."""
    return I.financial_profile(facts(spark, sf_dir, _FINANCIAL))


_ESG = ("esg_csr_spend", "esg_headcount", "esg_attrition")


@query(f"""WITH {facts_sql(_ESG)}, v AS (SELECT *, doc_kind = 'financial_results' OR (doc_kind = 'annual_report' AND kind = 'esg_csr_spend') AS over FROM facts
  WHERE value IS NOT NULL AND period IS NOT NULL AND doc_kind IN ('financial_results', 'annual_report', 'call_transcript') QUALIFY row_number() OVER (PARTITION BY evidence_id, period, kind ORDER BY seq DESC) = 1),
c AS (SELECT company_id, period, kind, count(*) AS n_sources FROM v GROUP BY ALL)
SELECT company_id, period, kind AS metric, value, n_sources FROM v JOIN c USING (company_id, period, kind)
QUALIFY row_number() OVER (PARTITION BY company_id, period, kind ORDER BY NOT over, CASE WHEN over THEN -epoch(source_date) END, CASE WHEN over THEN -evidence_id END, doc_kind = 'call_transcript', source_date, evidence_id) = 1""")
def ingest_esg_profile(spark, sf_dir, filed=None):
    """Sustainability reports (here the first kind of document) overwrite; of annual reports only CSR spending does; all else fills gaps."""
    rows = I.numeric(facts(spark, sf_dir, _ESG, filed), "esg_").where(F.col("doc_kind").isin("financial_results", "annual_report", "call_transcript"))
    values = I.last_of_document(rows, ["period", "kind"], ["value"])
    over = (F.col("doc_kind") == "financial_results") | ((F.col("doc_kind") == "annual_report") & (F.col("kind") == "esg_csr_spend"))
    out = I.merged(values, ["company_id", "period", "kind"], over, F.col("doc_kind") != "call_transcript")
    return out.select("company_id", "period", F.col("kind").alias("metric"), "value", F.size("sources").cast("long").alias("n_sources"))


_OWNERSHIP = ("ownership_promoter", "ownership_fpi", "ownership_dii")


@query(f"""WITH {facts_sql(_OWNERSHIP)}, v AS (SELECT * FROM facts WHERE value IS NOT NULL AND period IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id, period, kind ORDER BY seq DESC) = 1)
SELECT company_id, period, kind AS metric, max_by(value, (source_date, evidence_id)) AS value, list_sort(list(evidence_id)) AS sources FROM v GROUP BY ALL""")
def ingest_ownership_profile(spark, sf_dir):
    """Holdings overwrite by period: the latest document's value, and all that stated one."""
    values = I.last_of_document(I.numeric(facts(spark, sf_dir, _OWNERSHIP), "ownership_"), ["period", "kind"], ["value"])
    out = I.merged(values, ["company_id", "period", "kind"], F.lit(True), F.lit(True))
    return out.select("company_id", "period", F.col("kind").alias("metric"), "value", "sources")


_STRATEGY = ("strategy_guidance", "strategy_priority", "strategy_aspiration", "strategy_csat")


@query(f"""WITH {facts_sql(_STRATEGY)} SELECT company_id, source_date, replace(kind, 'strategy_', '') AS kind, CASE WHEN kind = 'strategy_csat' THEN NULL ELSE text END AS text, CASE WHEN kind = 'strategy_csat' THEN value END AS score, evidence_id, seq FROM facts
WHERE (doc_kind = 'investor_presentation' AND (kind <> 'strategy_csat' OR (value IS NOT NULL AND period IS NOT NULL))) OR (doc_kind = 'call_transcript' AND kind = 'strategy_guidance')""")
def ingest_strategy(spark, sf_dir, filed=None):
    """Statements of presentations, guidance of transcripts, and satisfaction scores, which need a number and a period."""
    rows, score = facts(spark, sf_dir, _STRATEGY, filed), F.col("kind") == "strategy_csat"
    deck = (F.col("doc_kind") == "investor_presentation") & (~score | (F.col("value").isNotNull() & F.col("period").isNotNull()))
    call = (F.col("doc_kind") == "call_transcript") & (F.col("kind") == "strategy_guidance")
    return rows.where(deck | call).select("company_id", "source_date", F.replace("kind", F.lit("strategy_"), F.lit("")).alias("kind"), F.when(~score, F.col("text")).alias("text"), F.when(score, F.col("value")).alias("score"), "evidence_id", "seq")


@query("""SELECT conv_id AS evidence_id, turn, CASE role WHEN 'user' THEN 'analyst' WHEN 'assistant' THEN 'management' ELSE role END AS role, CASE WHEN role = 'user' THEN text END AS question_text FROM conversations""")
def ingest_participants(spark, sf_dir):
    """Who speaks in a call; only an analyst's text is a question."""
    role = F.when(F.col("role") == "user", "analyst").when(F.col("role") == "assistant", "management").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("evidence_id"), "turn", role.alias("role"), F.when(F.col("role") == "user", F.col("text")).alias("question_text"))


_ANNUAL = ("audit_kam_title", "risk_factor", "governance_rpt_amount", "governance_rpt_category")


@query(f"""WITH {facts_sql(_ANNUAL)} SELECT company_id, text AS title, evidence_id, source_date FROM facts WHERE doc_kind = 'annual_report' AND kind = 'audit_kam_title'
QUALIFY row_number() OVER (PARTITION BY company_id, text ORDER BY source_date, evidence_id, seq) = 1""")
def ingest_audit_matters(spark, sf_dir):
    """Key audit matters: distinct titles, the first that is met stays."""
    rows = facts(spark, sf_dir, _ANNUAL).where("doc_kind = 'annual_report' and kind = 'audit_kam_title'")
    return rows.groupBy("company_id", F.col("text").alias("title")).agg(F.min_by(F.struct("evidence_id", "source_date"), F.struct("source_date", "evidence_id", "seq")).alias("_f")).select("company_id", "title", "_f.*")


@query(f"""WITH {facts_sql(_ANNUAL)}, a AS (SELECT *, 'rpt_row_' || CAST(char_offset AS VARCHAR) AS row FROM facts WHERE doc_kind = 'annual_report' AND starts_with(kind, 'governance_rpt')),
x AS (SELECT * FROM a WHERE kind = 'governance_rpt_amount' QUALIFY row_number() OVER (PARTITION BY evidence_id, row ORDER BY seq) = 1),
y AS (SELECT evidence_id, row, text AS category FROM a WHERE kind = 'governance_rpt_category' QUALIFY row_number() OVER (PARTITION BY evidence_id, row ORDER BY seq) = 1)
SELECT x.evidence_id, company_id, period, coalesce(category, '') AS category, coalesce(value, 0.0) AS amount FROM x LEFT JOIN y USING (evidence_id, row) WHERE period IS NOT NULL""")
def related_party_disclosures(spark, sf_dir):
    """Related-party balances, newest period first: rows are assembled by section, from the first fact of each kind; a row needs a dated amount."""
    rows = facts(spark, sf_dir, _ANNUAL).where("doc_kind = 'annual_report'").withColumn("amount", F.struct("period", F.coalesce("value", F.lit(0.0)).alias("value")))
    section = F.concat(F.lit("rpt_row_"), F.col("char_offset").cast("string"))
    out = I.rows_by_section(rows, section, {"_a": ("governance_rpt_amount", "amount"), "_c": ("governance_rpt_category", "text")}, "_a").where("_a.period is not null")
    return out.select("evidence_id", "company_id", "_a.period", F.coalesce("_c", F.lit("")).alias("category"), F.col("_a.value").alias("amount")).orderBy(F.desc("period"), "evidence_id", "category", "amount")


_AGM = ("resolution_title", "resolution_type", "vote_pct_for", "resolution_outcome")


@query(f"""WITH {facts_sql(_AGM)}, f AS (SELECT evidence_id, company_id, source_date, char_offset AS number, kind, text, value FROM facts QUALIFY row_number() OVER (PARTITION BY evidence_id, char_offset, kind ORDER BY seq) = 1)
SELECT evidence_id, company_id, source_date, 'resolution_' || CAST(number AS VARCHAR) AS section, max(text) FILTER (kind = 'resolution_title') AS title, coalesce(max(text) FILTER (kind = 'resolution_type'), '') AS resolution_type,
max(text) FILTER (kind = 'resolution_outcome') AS outcome, max(value) FILTER (kind = 'vote_pct_for') AS pct_for FROM f GROUP BY ALL HAVING count(*) FILTER (kind = 'resolution_title') > 0""")
def ingest_resolutions(spark, sf_dir, filed=None):
    """Resolutions of a meeting, assembled by section; one without a title is left out."""
    section = F.concat(F.lit("resolution_"), F.col("char_offset").cast("string"))
    fields = {"title": ("resolution_title", "text"), "_type": ("resolution_type", "text"), "outcome": ("resolution_outcome", "text"), "pct_for": ("vote_pct_for", "value")}
    out = I.rows_by_section(facts(spark, sf_dir, _AGM, filed), section, fields, "title")
    return out.select("evidence_id", "company_id", "source_date", "section", "title", F.coalesce("_type", F.lit("")).alias("resolution_type"), "outcome", "pct_for")


_DIVIDEND = ("dividend_per_share", "dividend_type", "dividend_record_date", "dividend_payment_date")


@query(f"""WITH {facts_sql(_DIVIDEND)}, t AS (SELECT evidence_id, char_offset, text AS dividend_type FROM facts WHERE kind = 'dividend_type' QUALIFY row_number() OVER (PARTITION BY evidence_id, char_offset ORDER BY seq DESC) = 1),
r AS (SELECT evidence_id, text AS record_date FROM facts WHERE kind = 'dividend_record_date' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq) = 1),
p AS (SELECT evidence_id, text AS payment_date FROM facts WHERE kind = 'dividend_payment_date' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq) = 1)
SELECT f.evidence_id, company_id, source_date, value AS per_share, coalesce(dividend_type, '') AS dividend_type, record_date, payment_date FROM facts f LEFT JOIN t USING (evidence_id, char_offset) LEFT JOIN r USING (evidence_id) LEFT JOIN p USING (evidence_id)
WHERE kind = 'dividend_per_share' AND value IS NOT NULL""")
def ingest_dividends(spark, sf_dir):
    """An amount meets the type stated at the same place (the last one there) and the first dates of its document."""
    rows = facts(spark, sf_dir, _DIVIDEND)
    types = rows.where("kind = 'dividend_type'").groupBy("evidence_id", "char_offset").agg(F.max_by("text", "seq").alias("dividend_type"))
    out = rows.where("kind = 'dividend_per_share' and value is not null").join(types, ["evidence_id", "char_offset"], "left")
    for name in ("record_date", "payment_date"):
        out = out.join(I.first_of_document(rows, f"dividend_{name}", "text", name), "evidence_id", "left")
    return out.select("evidence_id", "company_id", "source_date", F.col("value").alias("per_share"), F.coalesce("dividend_type", F.lit("")).alias("dividend_type"), "record_date", "payment_date")


_SEGMENT = ("segment_name", "segment_revenue", "segment_ebit")


@query(f"""WITH {facts_sql(_SEGMENT)}, n AS (SELECT evidence_id, seq, char_offset, text AS name FROM facts WHERE kind = 'segment_name' AND period IS NOT NULL),
o AS (SELECT evidence_id, char_offset, name FROM n QUALIFY row_number() OVER (PARTITION BY evidence_id, char_offset ORDER BY seq DESC) = 1),
r AS (SELECT f.evidence_id, company_id, period, name, value AS revenue FROM facts f JOIN o USING (evidence_id, char_offset) WHERE kind = 'segment_revenue' AND period IS NOT NULL AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f.evidence_id, period, name ORDER BY f.seq DESC) = 1),
x AS (SELECT f.evidence_id, company_id, period, value, f.seq, name FROM facts f JOIN n ON n.evidence_id = f.evidence_id AND starts_with(f.text || ' and more', n.name) WHERE kind = 'segment_ebit' AND period IS NOT NULL AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f.evidence_id, f.seq ORDER BY n.seq) = 1),
e AS (SELECT evidence_id, company_id, period, name, value AS ebit FROM x QUALIFY row_number() OVER (PARTITION BY evidence_id, period, name ORDER BY seq DESC) = 1)
SELECT coalesce(r.evidence_id, e.evidence_id) AS evidence_id, coalesce(r.company_id, e.company_id) AS company_id, coalesce(r.period, e.period) AS period, coalesce(r.name, e.name) AS name, revenue, ebit
FROM r FULL JOIN e ON r.evidence_id = e.evidence_id AND r.period = e.period AND r.name = e.name""")
def ingest_segments(spark, sf_dir):
    """A segment's revenue stands at the place of its name; its EBIT is found by an excerpt that begins with a name, the first that fits."""
    rows = facts(spark, sf_dir, _SEGMENT)
    names = rows.where("kind = 'segment_name' and period is not null").select("evidence_id", F.col("seq").alias("_at"), "char_offset", F.col("text").alias("name"))
    places = names.groupBy("evidence_id", "char_offset").agg(F.max_by("name", "_at").alias("name"))
    dated = rows.where("period is not null and value is not null").select("evidence_id", "company_id", "period", "kind", "value", "seq", "char_offset", F.concat("text", F.lit(" and more")).alias("excerpt"))
    key = ["evidence_id", "company_id", "period", "name"]
    revenue = dated.where("kind = 'segment_revenue'").join(places, ["evidence_id", "char_offset"]).groupBy(*key).agg(F.max_by("value", "seq").alias("revenue"))
    found = dated.where("kind = 'segment_ebit'").join(names.drop("char_offset"), "evidence_id").where(F.col("excerpt").startswith(F.col("name")))
    first = found.groupBy("evidence_id", "company_id", "period", "seq", "value").agg(F.min_by("name", "_at").alias("name"))
    ebit = first.groupBy(*key).agg(F.max_by("value", "seq").alias("ebit"))
    return revenue.join(ebit, key, "full_outer").select(*key, "revenue", "ebit")


_RATING = ("credit_instrument", "credit_rating", "credit_outlook", "credit_amount", "credit_agency")


@query(f"""WITH {facts_sql(_RATING)}, i AS (SELECT *, text = 'text 3' AS esg FROM facts WHERE kind = 'credit_instrument'),
a AS (SELECT evidence_id, text AS agency FROM facts WHERE kind = 'credit_agency' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq) = 1),
m AS (SELECT i.evidence_id, i.seq AS at, f.kind, f.text, f.value FROM i JOIN facts f ON f.evidence_id = i.evidence_id AND f.kind <> 'credit_instrument' AND f.kind <> 'credit_agency' AND (CASE WHEN esg THEN f.section IN ('balance_sheet', 'notes') ELSE f.section = i.section END)
  QUALIFY row_number() OVER (PARTITION BY i.evidence_id, i.seq, f.kind ORDER BY f.seq) = 1)
SELECT i.evidence_id, i.company_id, i.seq, coalesce(agency, '') AS agency, i.text AS instrument, max(m.text) FILTER (m.kind = 'credit_rating') AS rating, max(m.text) FILTER (m.kind = 'credit_outlook') AS outlook, max(m.value) FILTER (m.kind = 'credit_amount') AS amount
FROM i LEFT JOIN a USING (evidence_id) LEFT JOIN m ON m.evidence_id = i.evidence_id AND m.at = i.seq GROUP BY i.evidence_id, i.company_id, i.seq, agency, i.text""")
def ingest_ratings(spark, sf_dir):
    """Each instrument with the first rating, outlook and amount of its own section; an ESG score takes those of two document-wide sections."""
    rows = facts(spark, sf_dir, _RATING)
    agency = I.first_of_document(rows, "credit_agency", "text", "_agency")
    wide = F.array(F.lit("balance_sheet"), F.lit("notes"))
    instruments = rows.where("kind = 'credit_instrument'").select("evidence_id", "company_id", "seq", F.col("text").alias("instrument"), F.when(F.col("text") == "text 3", wide).otherwise(F.array("section")).alias("_sections"))
    stated = rows.where("kind in ('credit_rating', 'credit_outlook', 'credit_amount')").groupBy("evidence_id", "section", "kind").agg(F.min_by(F.struct("seq", "text", "value"), "seq").alias("_f"))
    looked = instruments.withColumn("section", F.explode("_sections")).join(stated, ["evidence_id", "section"], "left")
    first = lambda kind, column: F.min_by(F.col(f"_f.{column}"), F.when(F.col("kind") == kind, F.col("_f.seq")))
    out = looked.groupBy("evidence_id", "company_id", "seq", "instrument").agg(first("credit_rating", "text").alias("rating"), first("credit_outlook", "text").alias("outlook"), first("credit_amount", "value").alias("amount"))
    return out.join(agency, "evidence_id", "left").select("evidence_id", "company_id", "seq", F.coalesce("_agency", F.lit("")).alias("agency"), "instrument", "rating", "outlook", "amount")


_CAPITAL = ("buyback_bought", "buyback_offered", "buyback_record", "buyback_amount", "fundraise_type", "fundraise_amount", "acquisition_target", "acquisition_stake")


@query(f"""WITH {facts_sql(_CAPITAL)}, f AS (SELECT evidence_id, company_id, source_date, kind, value, text, seq FROM facts), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY evidence_id, kind ORDER BY seq) = 1),
d AS (SELECT evidence_id, company_id, source_date, max(value) FILTER (kind = 'buyback_bought') AS bought, max(value) FILTER (kind = 'buyback_offered') AS offered, count(*) FILTER (kind = 'buyback_record') AS records, max(value) FILTER (kind = 'buyback_amount') AS amount, count(*) FILTER (starts_with(kind, 'buyback')) AS n_buyback FROM o GROUP BY ALL),
m AS (SELECT evidence_id, value AS amount FROM o WHERE kind = 'fundraise_amount'), k AS (SELECT evidence_id, value AS stake FROM f WHERE kind = 'acquisition_stake' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY seq) = 1)
SELECT 'buyback' AS event, evidence_id, company_id, source_date, CASE WHEN bought IS NOT NULL THEN 'extinguishment' WHEN offered IS NOT NULL THEN 'announcement' WHEN records > 0 THEN 'schedule' ELSE 'unknown' END AS item, amount FROM d WHERE n_buyback > 0
UNION ALL SELECT DISTINCT 'fundraise', f.evidence_id, company_id, source_date, text, amount FROM f LEFT JOIN m USING (evidence_id) WHERE kind = 'fundraise_type'
UNION ALL SELECT 'acquisition', f.evidence_id, company_id, source_date, text, stake FROM f LEFT JOIN k USING (evidence_id) WHERE kind = 'acquisition_target'""")
def ingest_capital_events(spark, sf_dir, filed=None):
    """Buybacks, fundraises and acquisitions of a document: what is stated once for the document is repeated on each of its targets."""
    rows, key = facts(spark, sf_dir, _CAPITAL, filed), ["evidence_id", "company_id", "source_date"]
    first = lambda kind: F.min_by("value", F.when(F.col("kind") == kind, F.col("seq")))
    whole = rows.groupBy(*key).agg(first("buyback_bought").alias("_b"), first("buyback_offered").alias("_o"), F.count_if(F.col("kind") == "buyback_record").alias("_r"), first("buyback_amount").alias("_amount"), F.count_if(F.col("kind").startswith("buyback")).alias("_n"))
    step = F.when(F.col("_b").isNotNull(), "extinguishment").when(F.col("_o").isNotNull(), "announcement").when(F.col("_r") > 0, "schedule").otherwise("unknown")
    buyback = whole.where("_n > 0").select(F.lit("buyback").alias("event"), *key, step.alias("item"), F.col("_amount").alias("amount"))
    raised = I.first_of_document(rows, "fundraise_amount", "value", "amount")
    funds = rows.where("kind = 'fundraise_type'").select(*key, F.col("text").alias("item")).distinct().join(raised, "evidence_id", "left").select(F.lit("fundraise").alias("event"), *key, "item", "amount")
    stake = I.first_of_document(rows.where("value is not null"), "acquisition_stake", "value", "amount")
    deals = rows.where("kind = 'acquisition_target'").select(*key, F.col("text").alias("item")).join(stake, "evidence_id", "left").select(F.lit("acquisition").alias("event"), *key, "item", "amount")
    return buyback.unionByName(funds).unionByName(deals)


@query(f"""WITH {facts_sql(_CAPITAL)} SELECT company_id, source_date, text AS target_name, evidence_id, seq FROM facts WHERE kind = 'acquisition_target' ORDER BY source_date DESC, evidence_id DESC, seq DESC""")
def acquisitions(spark, sf_dir):
    """The acquisition ledger, newest first; a total order."""
    rows = facts(spark, sf_dir, _CAPITAL).where("kind = 'acquisition_target'")
    return rows.select("company_id", "source_date", F.col("text").alias("target_name"), "evidence_id", "seq").orderBy(F.desc("source_date"), F.desc("evidence_id"), F.desc("seq"))


_AUDIT = ("audit_firm", "audit_opinion", "other_fact")


@query(f"""WITH {facts_sql(_AUDIT)}, f AS (SELECT * FROM facts WHERE doc_kind = 'financial_results' AND kind IN ('audit_firm', 'audit_opinion') QUALIFY row_number() OVER (PARTITION BY evidence_id, kind ORDER BY seq) = 1)
SELECT company_id, source_date, max(text) FILTER (kind = 'audit_firm') AS firm, max(text) FILTER (kind = 'audit_opinion') AS opinion, evidence_id FROM f GROUP BY company_id, source_date, evidence_id""")
def auditor_history(spark, sf_dir):
    """Firm and opinion of each results document that states either, newest first."""
    rows = facts(spark, sf_dir, _AUDIT).where("doc_kind = 'financial_results'")
    first = lambda kind: F.min_by("text", F.when(F.col("kind") == kind, F.col("seq")))
    out = rows.groupBy("company_id", "source_date", "evidence_id").agg(first("audit_firm").alias("firm"), first("audit_opinion").alias("opinion"))
    return out.where("firm is not null or opinion is not null").select("company_id", "source_date", "firm", "opinion", "evidence_id").orderBy(F.desc("source_date"), "evidence_id")


@query(f"""WITH {facts_sql(_FINANCIAL)}, g AS (SELECT evidence_id, count(DISTINCT kind) AS n_kinds, count(*) AS n_facts FROM facts GROUP BY ALL)
SELECT o_orderkey AS evidence_id, o_custkey AS company_id, {KIND_SQL} AS doc_kind, coalesce(n_facts, 0) AS n_facts, coalesce(n_kinds, 0) AS n_kinds, CASE WHEN g.evidence_id IS NULL THEN 'failed' ELSE 'ok' END AS status, CASE WHEN g.evidence_id IS NULL THEN 'no facts' END AS error
FROM orders LEFT JOIN g ON g.evidence_id = o_orderkey""")
def analysis_runs(spark, sf_dir):
    """One run for each document; a document that gave nothing is recorded as failed, not dropped."""
    found = facts(spark, sf_dir, _FINANCIAL).groupBy("evidence_id").agg(F.count("*").alias("n_facts"), F.count_distinct("kind").alias("n_kinds"))
    runs = documents(spark, sf_dir).join(found, "evidence_id", "left")
    failed = F.col("n_facts").isNull()
    return runs.select("evidence_id", "company_id", "doc_kind", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_kinds", F.lit(0)).alias("n_kinds"), F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "no facts").alias("error"))


@query(f"""WITH {facts_sql(_FINANCIAL)}, p AS (SELECT evidence_id, company_id, seq, row_number() OVER (PARTITION BY company_id ORDER BY source_date, evidence_id, seq) AS n FROM facts),
f AS (SELECT company_id, evidence_id, min(n) AS first_at FROM p GROUP BY ALL) SELECT company_id, evidence_id, rank() OVER (PARTITION BY company_id ORDER BY first_at) AS place FROM f QUALIFY place <= 60""")
def hydrated_documents(spark, sf_dir):
    """The first 60 distinct documents of each company in the order of its claims."""
    first = facts(spark, sf_dir, _FINANCIAL).groupBy("company_id", "evidence_id", "source_date").agg(F.min("seq").alias("_seq"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("source_date", "evidence_id", "_seq"))
    return first.withColumn("place", place.cast("long")).where("place <= 60").select("company_id", "evidence_id", "place")
