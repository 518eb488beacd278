"""Queries over document text: risks, targets, guidance, quality, classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factframe.functions import filings as L
from factframe.functions import text as X
from factframe.registry import query
from factframe.sources.tables import table

_LINES_SQL = """l AS (SELECT doc_id, source, lang, i, trim(list_extract(string_split(text, chr(10)), i)) AS line FROM (
  SELECT doc_id, source, lang, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE text IS NOT NULL)"""


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").where("text is not null")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim("line"))


@query("""SELECT lower(trim(text)) AS risk_key, max_by(doc_id, (doc_id)) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def risks_dedup_latest(spark, sf_dir):
    """The newest of equal texts; texts are grouped by a hash of 128 bits, and only winners are looked up again."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lower(F.trim("text")).alias("risk_key"))
    best = docs.groupBy(F.md5("risk_key").alias("_h")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return docs.withColumn("_h", F.md5("risk_key")).join(best, ["_h", "doc_id"]).select("risk_key", "doc_id", "n")


_NORM_SQL = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""SELECT {_NORM_SQL.format('text')} AS risk_key, count(DISTINCT source) AS n_sources, count(*) AS n, max_by(text, (doc_id)) AS display FROM documents WHERE text IS NOT NULL
GROUP BY ALL HAVING count(DISTINCT source) >= 2""")
def risk_recurrence(spark, sf_dir):
    """Texts that sources repeat, whatever their case and marks; grouped by a hash, shown in the wording of the newest."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    keyed = docs.select("doc_id", "source", F.md5(X.normalised(F.col("text"))).alias("_h"))
    best = keyed.groupBy("_h").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n"), F.max("doc_id").alias("doc_id")).where("n_sources >= 2")
    return docs.select("doc_id", X.normalised(F.col("text")).alias("risk_key"), F.col("text").alias("display")).join(best, "doc_id").select("risk_key", "n_sources", "n", "display")


def _risks(spark, sf_dir):
    """Lines of documents stand for risk texts, sources for the periods that state them."""
    return _lines(spark, sf_dir).select("doc_id", "source", "i", F.col("line").alias("text"))


_RISKS_SQL = f"{_LINES_SQL}, r AS (SELECT doc_id, source, i - 1 AS i, line AS text FROM l)"
_PLAUSIBLE_SQL = f"length(trim(text)) >= 50 AND NOT regexp_matches(trim(text), '{X.BOILERPLATE}')"


@query(f"WITH {_RISKS_SQL} SELECT doc_id, i, length(text) AS n_chars FROM r WHERE {_PLAUSIBLE_SQL}")
def risk_plausible(spark, sf_dir):
    return _risks(spark, sf_dir).where(X.plausible_risk(F.col("text"))).select("doc_id", "i", F.length("text").cast("long").alias("n_chars"))


_GROUPED_SQL = f"""{_RISKS_SQL}, p AS (SELECT *, lower(trim(text)) AS risk_key FROM r WHERE {_PLAUSIBLE_SQL}),
k AS (SELECT risk_key, count(DISTINCT source) AS recurrence, min(source) AS earliest, max(source) AS latest FROM p GROUP BY risk_key)"""


def _grouped_risks(spark, sf_dir):
    """risk_key (hash of the text), recurrence, earliest and latest statement, and one text of each: whole texts are no shuffle keys."""
    rows = _risks(spark, sf_dir).where(X.plausible_risk(F.col("text"))).withColumn("text", F.lower(F.trim("text")))
    return rows.groupBy(F.md5("text").alias("risk_key")).agg(F.count_distinct("source").alias("recurrence"), F.min("source").alias("earliest"), F.max("source").alias("latest"), F.any_value("text").alias("text"))


@query(f"WITH {_GROUPED_SQL} SELECT md5(risk_key) AS risk_key, recurrence, earliest, latest FROM k WHERE recurrence >= 2")
def recurring_risks(spark, sf_dir):
    """Plausible risks stated in two periods or more, with the first and the last of them."""
    return _grouped_risks(spark, sf_dir).where("recurrence >= 2").select("risk_key", "recurrence", "earliest", "latest")


_CONFIDENT_SQL = f"(recurrence >= 2 OR regexp_matches(risk_key, '{X.STRONG_RISK}') OR len(list_distinct(list_transform(regexp_extract_all(risk_key, '{X.WEAK_RISK}', 1), lambda x: lower(x)))) >= 2)"


@query(f"WITH {_GROUPED_SQL} SELECT md5(risk_key) AS risk_key, {_CONFIDENT_SQL} AS confident, recurrence, latest FROM k ORDER BY 2 DESC, 3 DESC, 4 DESC, 1")
def report_risks(spark, sf_dir):
    """All plausible risks: those to rely on first, then by recurrence, then by recency."""
    marked = _grouped_risks(spark, sf_dir).select("risk_key", X.high_confidence_risk(F.col("text"), F.col("recurrence")).alias("confident"), "recurrence", "latest")
    return marked.orderBy(F.desc("confident"), F.desc("recurrence"), F.desc("latest"), "risk_key")


_STATED = ("Margin guidance stays at 31-33% for the year.", "We reiterate 31-33% and capex of 12,600 crores.", "Target: <3 tCO2e per tonne, 50 - 60 MTPA, 6x.", "Aiming for 31-33%, 31-33% and 50 - 60 mtpa.", "No number here but 12 pages.")
_STATED_SQL = "s(id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(_STATED)) + ")"
_TARGETS_SQL = f"list_distinct(list_transform(regexp_extract_all(text, '{X.TARGET}'), lambda x: regexp_replace(lower(trim(x)), '\\s+', ' ', 'g')))"


@query(rf"""WITH {_STATED_SQL}, d AS (SELECT doc_id, source, text FROM documents UNION ALL SELECT -1 - id, 'stated ' || CAST(id // 2 AS VARCHAR), text FROM s),
t AS (SELECT doc_id, source, unnest({_TARGETS_SQL}) AS target FROM d) SELECT target, count(DISTINCT source) AS n_sources, count(*) AS n FROM t GROUP BY target HAVING count(DISTINCT source) >= 2""")
def repeated_targets(spark, sf_dir):
    """Numbers with a unit that come back on another date, here in another source; each counts once an entry."""
    stated = spark.createDataFrame([(-1 - i, f"stated {i // 2}", t) for i, t in enumerate(_STATED)], "doc_id long, source string, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").unionByName(stated)
    found = docs.select("doc_id", "source", F.explode(X.target_tokens(F.col("text"))).alias("target"))
    return found.groupBy("target").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n")).where("n_sources >= 2")


@query(r"""SELECT doc_id, regexp_extract(text, '(?i)licensed under the ([A-Za-z]+)[^.\n]*', 1) AS party, length(text) AS n_chars FROM documents WHERE regexp_matches(text, '(?i)licensed under the ')""")
def rpt_regex_capture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)licensed under the "))
    return docs.select("doc_id", F.regexp_extract("text", r"(?i)licensed under the ([A-Za-z]+)[^.\n]*", 1).alias("party"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, source, lang, strpos(lower(text), 'license') AS position FROM documents WHERE contains(lower(text), 'license')")
def strategy_keyword(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where(F.contains(low, F.lit("license"))).select("doc_id", "source", "lang", F.instr(low, "license").cast("long").alias("position"))


_TOKEN = X.TOKEN.replace("'", "''")
_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_KEYWORDS_SQL = rf"list_distinct(list_filter(regexp_extract_all(lower({{}}), '{_TOKEN}'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[a-z]') AND x NOT IN ({_STOP_SQL})))"


@query(rf"""SELECT doc_id, len(regexp_extract_all(lower(text), '{_TOKEN}')) AS n_tokens, len({_KEYWORDS_SQL.format('text')}) AS n_keywords,
len(list_distinct(list_filter(regexp_extract_all(lower(text), '{_TOKEN}'), lambda x: regexp_matches(x, '^[0-9]')))) AS n_numbers FROM documents""")
def tokenize_keywords(spark, sf_dir):
    """Counts of tokens, words and numbers; a text is split once, in a projection of its own."""
    words, size = F.col("words"), lambda c: F.size(c).cast("long")
    split = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("words"))
    return split.select("doc_id", size(words).alias("n_tokens"), size(X.keywords_of(words)).alias("n_keywords"), size(X.numbers_of(words)).alias("n_numbers"))


_EDGES = r"""[.,;:!?"''()/\[\]{}|\\-]+"""


@query(rf"""WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS n, greatest(1, ceil(length(text) / 3000)) AS pages, list_filter(regexp_split_to_array(substr(coalesce(text, ''), 1, 8000), '[\s\p{{Z}}]+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT *, list_filter(list_transform(words, lambda x: regexp_replace(x, '^{_EDGES}|{_EDGES}$', '', 'g')), lambda x: length(x) >= 2) AS core FROM p),
g AS (SELECT doc_id, n, pages, len(words) AS words, len(list_filter(core, lambda x: regexp_matches(x, '[^\x00-\x7F₹–—‘’“”…\x{{00A0}}]') OR (regexp_matches(x, '[A-Za-z][0-9][A-Za-z]') AND regexp_matches(x, '[a-z]')) OR regexp_matches(x, '^l[A-Z]'))) AS garbled FROM c)
SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(garbled AS INTEGER) AS garbled, CASE WHEN n = 0 THEN 0.0 ELSE round(0.4 * least(1.0, n / pages / 200.0) + 0.6 * greatest(0.0, 1 - 50.0 * coalesce(garbled / nullif(words, 0), 0.0)), 4) END AS score FROM g""")
def text_quality(spark, sf_dir):
    pages = F.greatest(F.lit(1), F.ceil(F.length("text") / 3000))
    counts = X.garbled_words(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", counts["words"].alias("words"), counts["garbled"].alias("garbled"), X.quality_score(F.col("text"), pages).alias("score"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_ascii,
length(regexp_replace(text, '[^\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}]', '', 'g')) AS n_indian, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 50 THEN NULL WHEN length(regexp_replace(text, '[^\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}]', '', 'g')) > 0.3 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) THEN 'other' ELSE 'en' END AS script FROM documents""")
def script_share(spark, sf_dir):
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", "")).cast("long")
    out = table(spark, sf_dir, "documents").select("doc_id", only(r"\p{L}").alias("n_letters"), only("A-Za-z").alias("n_ascii"), only(r"\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsTelugu}").alias("n_indian"), only("0-9").alias("n_digits"))
    return out.withColumn("script", F.when(F.col("n_letters") >= 50, F.when(F.col("n_indian") > 0.3 * F.col("n_letters"), "other").otherwise("en")))


_SAID = (
    "We are targeting a margin of 26 to 28 percent. Our guidance is 11500 crores of capex.\nGuidance  is 11500 crores of capex. The stated range of 3x holds, aiming to achieve 40 by next year.",
    "Our aspiration\nis 20 percent growth and we intend to increase capacity to 35 million tonnes",
    "No outlook is given here for 2025",
)
_SAID_SQL = "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(_SAID)) + ") v(doc_id, text)"


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents {_SAID_SQL}),
g AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '\n', ' ', 'g'), '{X.GUIDANCE}', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS s FROM d),
u AS (SELECT doc_id, s, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM g), f AS (SELECT doc_id, min(i) AS i FROM u GROUP BY doc_id, lower(x))
SELECT u.doc_id, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.i) - 1 AS place, x AS statement FROM u JOIN f ON u.doc_id = f.doc_id AND u.i = f.i QUALIFY place < 3""")
def find_guidance(spark, sf_dir):
    said = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_SAID)], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(said)
    return docs.select("doc_id", F.posexplode(X.guidance_statements(F.col("text"))).alias("place", "statement")).withColumn("place", F.col("place").cast("long"))


_SCANNED = ("3.27,951.46 and 2.21.071.22", "69.327.15 (45.339 45)", "79.66L.92 - nil", "3,38.407.31 | 2,37,983", "5.6 apples, (1,234.5)")


@query()
def ocr_number_fix(spark, sf_dir):
    """One row for each number of each document, with its position, after the text is repaired; look-arounds have no counterpart in the other engine, so a test holds it against plain code."""
    scanned = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(_SCANNED)], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(scanned)
    tokens = docs.select("doc_id", F.posexplode(X.number_tokens(X.fix_ocr_numbers(F.col("text")))).alias("position", "token"))
    return tokens.withColumn("value", X.parse_number(F.col("token")))


_SUBJECTS = (
    "Sub: Schedule of investor calls\n", "Sub - Submission of presentation\n", "SUB: Note on related party transactions of the half year\n", "Sub: note uncler Regu1ation 23 ( 9 )\n",
    "Sub: Intimation regarding the Annual Report\n", "Sub: Intimation under Regulation 30\n", "", "Sub:\n",
)
_CLAIMED = ("investor_presentation", "earnings_transcript", "annual_report", "brsr", "regulatory_filing", "financial_results")
_FILED_SQL = f"""f AS (SELECT doc_id, list_extract({list(_CLAIMED)}, CAST(doc_id % 6 AS INTEGER) + 1) AS claimed, list_extract([{', '.join(f"'{x}'" for x in _SUBJECTS)}], CAST(doc_id // 6 % 8 AS INTEGER) + 1) || text AS text,
  CASE WHEN doc_id % 11 > 0 THEN doc_id % 12 END AS pages FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, lower(trim(regexp_extract(substr(text, 1, 3000), '{L.SUBJECT}', 1))) AS subject FROM f),
c AS (SELECT *, CASE WHEN claimed <> 'regulatory_filing' AND regexp_matches(subject, '{L.REGULATORY}') THEN 'reclassified'
  WHEN regexp_matches(subject, '{L.NOTICE}') AND NOT regexp_matches(subject, CASE claimed {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SUBSTANTIVE.items())} ELSE '' END) THEN 'notice'
  WHEN pages < CASE claimed {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.LEAST_PAGES.items())} END THEN 'too_short' ELSE 'passed' END AS rule FROM h)"""


def _filed(spark, sf_dir):
    """Documents under a subject line, a claimed kind and a count of pages."""
    n = F.col("doc_id")
    pick = lambda names, by: F.get(F.array(*[F.lit(x) for x in names]), by.cast("int"))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", pick(_CLAIMED, n % 6).alias("claimed"), F.concat(pick(_SUBJECTS, F.floor(n / 6) % 8), "text").alias("text"), F.when(n % 11 > 0, n % 12).alias("pages"))


@query(f"WITH {_FILED_SQL} SELECT doc_id, claimed, CASE rule WHEN 'reclassified' THEN 'regulatory_filing' ELSE claimed END AS kind, rule IN ('reclassified', 'passed') AS substantive, rule FROM c")
def classify_document(spark, sf_dir):
    verdict = L.classified(F.col("claimed"), F.col("text"), F.col("pages"))
    return _filed(spark, sf_dir).select("doc_id", "claimed", verdict.alias("_v")).select("doc_id", "claimed", "_v.*")


@query(f"""WITH {_FILED_SQL}, x AS (SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS parsed FROM orders)
SELECT doc_id, claimed AS kind_before, 'regulatory_filing' AS kind_after FROM c JOIN x USING (doc_id) WHERE parsed AND rule = 'reclassified'""")
def reclassify_documents(spark, sf_dir):
    """The catalogue's documents that were parsed and whose subject line contradicts their kind."""
    parsed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    verdict = L.classified(F.col("claimed"), F.col("text"), F.col("pages"))
    marked = _filed(spark, sf_dir).join(parsed, "doc_id", "left_semi").select("doc_id", F.col("claimed").alias("kind_before"), verdict["kind"].alias("kind_after"))
    return marked.where("kind_before <> kind_after")


@query("""SELECT page_id, regexp_matches(lower(ltrim(substr(html, 1, 256))), '^(<!doctype html|<html)') AS is_shell, length(html) AS n_chars, length(trim(regexp_replace(html, '<[^>]*>', ' ', 'g'))) AS n_text FROM pages""")
def html_guard(spark, sf_dir):
    head = F.lower(F.ltrim(F.substring("html", 1, 256)))
    return table(spark, sf_dir, "pages").select("page_id", head.rlike("^(<!doctype html|<html)").alias("is_shell"), F.length("html").cast("long").alias("n_chars"), F.length(F.trim(F.regexp_replace("html", "<[^>]*>", " "))).cast("long").alias("n_text"))


@query("""WITH d AS (SELECT doc_id, source, length(text) AS n FROM documents), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM d)
SELECT doc_id, source, n, used FROM s WHERE used <= 20000""")
def running_budget(spark, sf_dir, shard: int = 5_000):
    """Each source's documents up to a budget of characters: running sums inside shards of ids, on top of the sums of the shards before, so a large source is many windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"), F.floor(F.col("doc_id") / shard).alias("_shard"))
    sums = docs.groupBy("source", "_shard").agg(F.sum("n").alias("_n"))
    before = sums.select("source", "_shard", (F.sum("_n").over(Window.partitionBy("source").orderBy("_shard")) - F.coalesce("_n", F.lit(0))).alias("_before")).where("_before <= 20000")
    inside = F.sum("n").over(Window.partitionBy("source", "_shard").orderBy("doc_id"))
    return docs.join(before, ["source", "_shard"]).select("doc_id", "source", "n", (inside + F.coalesce("_before", F.lit(0))).alias("used")).where("used <= 20000")


@query(rf"""WITH {_LINES_SQL} SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(*) >= 3""")
def recurring_lines(spark, sf_dir):
    """Lines that come back, grouped by a hash; a line's text is looked up for those that do."""
    lines = _lines(spark, sf_dir).where(F.length("line") >= 20).select("doc_id", "i", "line", F.md5("line").alias("_h"))
    seen = lines.groupBy("_h").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min(F.struct("doc_id", "i")).alias("_at")).where("n >= 3")
    shown = seen.select("_h", "n", "n_docs", F.col("_at.doc_id").alias("doc_id"), F.col("_at.i").alias("i"))
    return lines.join(shown, ["_h", "doc_id", "i"]).select("line", "n", "n_docs", F.col("doc_id").alias("first_doc"))
