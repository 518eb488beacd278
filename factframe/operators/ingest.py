"""Documents' facts into company snapshots, ledgers and rows: who overwrites whom, and what belongs together.

Within a document the last value of a kind counts, or the first where so said;
across documents a merge is one max_by or min_by over (date, document), so no
key's facts are ever gathered or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT = ["evidence_id", "company_id", "doc_kind", "source_date"]
#: Transcripts and presentations are merged after all other documents and fill gaps only.
SUPPLEMENTARY = ("call_transcript", "investor_presentation")


def basis_of(section: Column) -> Column:
    """Basis from a section's prefix; balance sheet and cash flow are consolidated, other sections have none."""
    return F.when(section.startswith("consolidated"), "consolidated").when(section.startswith("standalone"), "standalone").when(section.isin("balance_sheet", "cash_flow_statement"), "consolidated")


def numeric(facts: DataFrame, family: str) -> DataFrame:
    """Facts of a family with a number and a period."""
    return facts.where(F.col("kind").startswith(family) & F.col("value").isNotNull() & F.col("period").isNotNull())


def last_of_document(facts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each document and key the columns of the fact emitted last."""
    return facts.groupBy(*DOCUMENT, *keys).agg(F.max_by(F.struct(*columns), "seq").alias("_f")).select(*DOCUMENT, *keys, "_f.*")


def first_of_document(facts: DataFrame, kind: str, column: str, name: str, *keys: str) -> DataFrame:
    """For each document (and keys) a column of the first fact of a kind."""
    return facts.where(F.col("kind") == kind).groupBy("evidence_id", *keys).agg(F.min_by(column, "seq").alias(name))


def merged(values: DataFrame, keys: Sequence[str], overwrites: Column, first: Column) -> DataFrame:
    """One value a key: the latest that overwrites; else the earliest that fills gaps, `first` ones before the others."""
    latest = F.max_by("value", F.when(overwrites, F.struct("source_date", "evidence_id")))
    order = F.struct(F.when(first, 0).otherwise(1), "source_date", "evidence_id")
    earliest = F.min_by("value", F.when(~overwrites, order))
    return values.groupBy(*keys).agg(F.coalesce(latest, earliest).alias("value"), F.array_sort(F.collect_set("evidence_id")).alias("sources"))


def financial_documents(facts: DataFrame) -> DataFrame:
    """DOCUMENT, period, basis, kind, value, scope, period_type: each document's own snapshot values.

    Only results state a basis; all other documents are consolidated. A revenue
    of a transcript counts in crore only. A document's period type is that of
    its report; a transcript's is the scope of its revenue, a presentation's is
    stated for each period, an annual report's is annual.
    """
    results, revenue, stated = F.col("doc_kind") == "financial_results", F.col("kind") == "financial_revenue", F.col("kind") == "report_period_type"
    spoken = (F.col("doc_kind") == "call_transcript") & revenue
    numbers = F.col("kind").startswith("financial_") & F.col("value").isNotNull() & F.col("period").isNotNull()
    fits = numbers & (F.col("doc_kind") != "other") & ~(spoken & (F.col("unit") != "CRORE_INR")) & F.col("basis").isNotNull()
    rows = facts.withColumn("basis", F.when(results, basis_of(F.col("section"))).otherwise("consolidated")).withColumn("_fits", F.coalesce(fits, F.lit(False))).where(stated | F.col("_fits"))
    # the widest window comes first, so facts that lie by document stay where they are
    by = lambda *keys: Window.partitionBy("evidence_id", *keys)
    rows = rows.withColumn("_report", F.min_by("scope", F.when(stated, F.col("seq"))).over(by()))
    rows = rows.withColumn("_stated", F.max_by("scope", F.when(stated, F.col("seq"))).over(by("period")))
    rows = rows.withColumn("_spoken", F.max_by("scope", F.when(F.col("_fits") & revenue, F.col("seq"))).over(by("period", "basis")))
    out = last_of_document(rows.where("_fits"), ["period", "basis", "kind", "_report", "_stated", "_spoken"], ["value", "scope"])
    kind = F.col("doc_kind")
    period_type = F.when(kind == "annual_report", "annual").when(kind == "investor_presentation", F.coalesce("_stated", F.lit("annual"))).when(kind == "call_transcript", F.coalesce("_spoken", "_report", F.lit("quarterly"))).otherwise(F.coalesce("_report", F.lit("quarterly")))
    return out.withColumn("period_type", period_type).drop("_report", "_stated", "_spoken")


def financial_snapshots(values: DataFrame, source: str = "evidence_id") -> DataFrame:
    """company_id, period, basis, period_type, metrics (kind, value), sources: one row a snapshot, of financial_documents().

    Results overwrite, the latest last; annual reports fill gaps, then
    transcripts and presentations do. The document that comes first in that
    order gives a snapshot its period type, and a transcript's revenue of
    another scope does not attach to it, although the transcript stays a source.
    Values are shuffled once, by snapshot; `source` is what stands for a document.
    """
    key, supplement = ["company_id", "period", "basis"], F.col("doc_kind").isin(*SUPPLEMENTARY)
    order = F.struct(F.when(supplement, 1).otherwise(0), "source_date", "evidence_id")
    typed = values.where(F.col("company_id").isNotNull()).withColumn("_type", F.min_by("period_type", order).over(Window.partitionBy(*key)))
    attached = ~((F.col("doc_kind") == "call_transcript") & (F.col("kind") == "financial_revenue") & (F.col("scope") != F.col("_type")))
    results = F.col("doc_kind") == "financial_results"
    latest = F.max_by("value", F.when(results, F.struct("source_date", "evidence_id")))
    earliest = F.min_by("value", F.when(~results & attached, order))
    each = typed.groupBy(*key, "_type", "kind").agg(F.coalesce(latest, earliest).alias("value"), F.count_if(attached).alias("_n"), F.collect_set(source).alias("_sources"))
    metrics = F.collect_list(F.when(F.col("_n") > 0, F.struct("kind", "value")))
    return each.groupBy(*key, F.col("_type").alias("period_type")).agg(metrics.alias("metrics"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sources")))).alias("sources"))


def financial_profile(facts: DataFrame) -> DataFrame:
    """company_id, period, basis, period_type, metric, value, n_sources: the merged snapshots, one row a metric."""
    made = financial_snapshots(financial_documents(facts))
    out = made.select("company_id", "period", "basis", "period_type", F.explode("metrics").alias("_m"), F.size("sources").cast("long").alias("n_sources"))
    return out.select("company_id", "period", "basis", "period_type", F.col("_m.kind").alias("metric"), "_m.value", "n_sources")


def rows_by_section(facts: DataFrame, section: Column, fields: dict[str, tuple[str, str]], needed: str) -> DataFrame:
    """One row for each (document, section): the first fact of each kind; sections without the needed field are left out.

    fields: name -> (kind, column).
    """
    first = [F.min_by(F.col(column), F.when(F.col("kind") == kind, F.col("seq"))).alias(name) for name, (kind, column) in fields.items()]
    return facts.withColumn("section", section).groupBy("evidence_id", "company_id", "source_date", "section").agg(*first).where(F.col(needed).isNotNull())
