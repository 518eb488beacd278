"""One report of each company: all sections in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factframe.operators.storage import written
from factframe.plans import claims as C
from factframe.plans import series as S
from factframe.plans import text as T
from factframe.plans.ingest import ingest_esg_profile
from factframe.registry import ORACLE_SQL, query
from factframe.sources.tables import filed_lines, newest_lines, quarter_totals

# The sections in the order in which a report holds them.
SECTIONS = (
    "the_call", "what_changed", "business_quality", "management_credibility", "balance_sheet", "valuation",
    "risks", "catalysts", "competitive_position", "esg_governance", "open_questions", "evidence_appendix",
)


def _joined(*parts: str | Column) -> Column:
    return F.concat_ws(" ", *[F.lit(p[1:]) if isinstance(p, str) and p[0] == "=" else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def _digits(column: str) -> Column:
    return F.regexp_extract(column, r"\d+", 0).cast("long")


def section_lines(spark: SparkSession, sf_dir: str) -> dict[str, list[DataFrame]]:
    """company_id and text of every line, by section; what a section says comes from its own query.

    Lines are joined once, and what several sections read is written once.
    """
    company, filed = F.col("company_id").cast("long"), filed_lines(spark, sf_dir)
    totals = quarter_totals(spark, sf_dir, filed)
    esg = written(ingest_esg_profile(spark, sf_dir, filed).drop("n_sources"), "esg")
    catalysts = written(C.section_catalysts(spark, sf_dir, filed), "catalysts")
    credibility = written(C.section_credibility(spark, sf_dir, filed), "credibility")
    lines = lambda frame, *parts, of=company: frame.select(of.alias("company_id"), _joined(*parts).alias("text"))
    newest = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("period")))
    return {
        "the_call": [lines(C.section_the_call(spark, sf_dir, totals), "line", "item")],
        "what_changed": [lines(C.section_what_changed(spark, sf_dir), "day", "subject", "n_evidence", of=_digits("subject"))],
        "business_quality": [
            lines(S.margin_stability(spark, sf_dir, totals), "=margin", "band"),
            lines(S.growth_cagr(spark, sf_dir, totals), "=revenue up in", "n_up", "=of", "n"),
            lines(S.segment_concentration(spark, sf_dir, newest_lines(spark, sf_dir, totals, filed)), "=largest segment", "largest"),
            lines(S.top_movers(spark, sf_dir, totals), "direction", "metric"),
        ],
        "management_credibility": [lines(credibility, "finding", "title", "source_date")],
        "balance_sheet": [
            lines(S.net_cash_trajectory(spark, sf_dir, totals), "=net cash", "verdict"),
            lines(S.leverage(spark, sf_dir, totals).withColumn("_i", newest).where("_i = 1"), "label", "=at", "period"),
        ],
        "valuation": [lines(C.section_valuation(spark, sf_dir), "note")],
        "risks": [lines(T._grouped_risks(spark, sf_dir), "risk_key", "=seen", "recurrence", of=_digits("latest"))],
        "catalysts": [lines(catalysts, "catalyst", "item", "day")],
        "competitive_position": [lines(C.section_competitive_position(spark, sf_dir, totals), "metric", "=place", "place")],
        "esg_governance": [lines(C.section_esg(spark, sf_dir, esg), "metric", "direction")],
        "open_questions": [lines(C.section_open_questions(spark, sf_dir, esg, catalysts, credibility), "question", "item")],
        "evidence_appendix": [lines(C.section_appendix(spark, sf_dir, catalysts, credibility), "citation")],
    }


def _line_sql() -> str:
    """The lines of all sections for DuckDB."""
    digits = "CAST(regexp_extract({}, '\\d+') AS BIGINT)"
    parts = {
        "the_call": [("section_the_call", "company_id", ("line", "item"), "")],
        "what_changed": [("section_what_changed", digits.format("subject"), ("day", "subject", "n_evidence"), "")],
        "business_quality": [
            ("margin_stability", "company_id", ("'margin'", "band"), ""),
            ("growth_cagr", "company_id", ("'revenue up in'", "n_up", "'of'", "n"), ""),
            ("segment_concentration", "company_id", ("'largest segment'", "largest"), ""),
            ("top_movers", "company_id", ("direction", "metric"), ""),
        ],
        "management_credibility": [("section_credibility", "company_id", ("finding", "title", "source_date"), "")],
        "balance_sheet": [
            ("net_cash_trajectory", "company_id", ("'net cash'", "verdict"), ""),
            ("leverage", "company_id", ("label", "'at'", "period"), "QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period DESC) = 1"),
        ],
        "valuation": [("section_valuation", "company_id", ("note",), "")],
        "risks": [("report_risks", digits.format("latest"), ("risk_key", "'seen'", "recurrence"), "")],
        "catalysts": [("section_catalysts", "company_id", ("catalyst", "item", "day"), "")],
        "competitive_position": [("section_competitive_position", "company_id", ("metric", "'place'", "place"), "")],
        "esg_governance": [("section_esg", "company_id", ("metric", "direction"), "")],
        "open_questions": [("section_open_questions", "company_id", ("question", "item"), "")],
        "evidence_appendix": [("section_appendix", "company_id", ("citation",), "")],
    }
    out = []
    for i, section in enumerate(SECTIONS):
        for name, company, words, only in parts[section]:
            out.append(f"SELECT {i} AS section_seq, '{section}' AS section, CAST({company} AS BIGINT) AS company_id, concat_ws(' ', {', '.join(f'CAST({w} AS VARCHAR)' for w in words)}) AS text FROM ({ORACLE_SQL[name]}) {only}")
    return "\nUNION ALL ".join(out)


@query(f"""WITH lines AS ({_line_sql()})
SELECT company_id, section_seq, section, row_number() OVER (PARTITION BY company_id, section_seq ORDER BY text) AS place, text FROM lines""")
def assembled_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every company's report: the call first, then the body, open questions, and the evidence last."""
    return _placed(_all_lines(spark, sf_dir))


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = section_lines(spark, sf_dir)
    return reduce(DataFrame.unionByName, [f.withColumn("section_seq", F.lit(i)) for i, name in enumerate(SECTIONS) for f in made[name]])


def _placed(lines: DataFrame) -> DataFrame:
    """The lines with the names of their sections, which are no part of the shuffle, and their places."""
    name = F.get(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section_seq"))
    place = F.row_number().over(Window.partitionBy("company_id", "section_seq").orderBy("text")).cast("long")
    return lines.select("company_id", "section_seq", name.alias("section"), place.alias("place"), "text")


@query(f"""WITH r AS ({ORACLE_SQL['assembled_report']}),
s AS (SELECT company_id, section_seq, '## ' || section || chr(10) || string_agg('- ' || text, chr(10) ORDER BY place) AS part FROM r GROUP BY company_id, section_seq, section)
SELECT company_id, count(*) AS n_sections, string_agg(part, chr(10) || chr(10) ORDER BY section_seq) AS markdown FROM s GROUP BY company_id""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's report as one text, made where its lines are dealt to; a section without lines is left out."""
    lines = _placed(_all_lines(spark, sf_dir).repartition("company_id"))
    each = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), "text").alias("line"))))
    parts = lines.groupBy("company_id", "section_seq", "section").agg(F.array_join(each["line"], "\n").alias("_lines"))
    part = F.struct("section_seq", F.concat(F.lit("## "), "section", F.lit("\n"), "_lines").alias("part"))
    whole = F.array_sort(F.collect_list(part))
    return parts.groupBy("company_id").agg(F.count("*").alias("n_sections"), F.array_join(whole["part"], "\n\n").alias("markdown"))
