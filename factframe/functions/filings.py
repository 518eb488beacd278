"""What a document of the catalogue is, by its subject line and its pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The subject line, what reclassifies a document, what makes a kind substantive, and page floors.
SUBJECT = r"(?i)Sub\s*[:\-]\s*([^\n]{0,200})"
REGULATORY = r"related party transaction|regulation 23\(9\)|reg\. 23\(9\)|reg 23\(9\)|\b23\s*\(\s*9\s*\)"
NOTICE = r"schedule of|intimation of schedule|intimation under regulation|intimation regarding"
SUBSTANTIVE = {
    "investor_presentation": "presentation|analyst day|investor meet|investor day",
    "earnings_transcript": "transcript",
    "annual_report": "annual report",
    "brsr": "business responsibility|brsr|sustainability",
}
LEAST_PAGES = {"investor_presentation": 5, "earnings_transcript": 5, "annual_report": 10, "brsr": 5}


def one_of(column: Column, choices: dict) -> Column:
    """The value of a column's key among literal choices, else null."""
    return F.create_map(*[F.lit(x) for pair in choices.items() for x in pair])[column]


def classified(kind: Column, text: Column, pages: Column) -> Column:
    """(kind, substantive, rule): the first rule that applies, on the subject line of the first 3,000 characters and the pages."""
    subject = F.lower(F.trim(F.regexp_extract(F.substring(text, 1, 3000), SUBJECT, 1)))
    wanted = F.lit(False)
    for name, words in SUBSTANTIVE.items():
        wanted = F.when(kind == name, ~subject.rlike(words) & subject.rlike(NOTICE)).otherwise(wanted)
    verdict = lambda k, ok, rule: F.struct(k.alias("kind"), F.lit(ok).alias("substantive"), F.lit(rule).alias("rule"))
    return (
        F.when((kind != "regulatory_filing") & subject.rlike(REGULATORY), verdict(F.lit("regulatory_filing"), True, "reclassified"))
        .when(wanted, verdict(kind, False, "notice"))
        .when(F.coalesce(pages < one_of(kind, LEAST_PAGES), F.lit(False)), verdict(kind, False, "too_short"))
        .otherwise(verdict(kind, True, "passed"))
    )
