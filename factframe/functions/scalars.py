"""Formatting, keys and lenient parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit -> text before, decimals, text after; other units have two decimals.
UNITS = {
    "CRORE_INR": ("", 0, " cr"), "PERCENT": ("", 2, "%"), "USD_BILLION": ("$", 2, "B"), "USD_MILLION": ("$", 1, "M"), "COUNT": ("", 0, ""), "RUPEES": ("Rs ", 2, ""), "RUPEES_PER_SHARE": ("Rs ", 2, "/share"),
    "TCO2E": ("", 0, " tCO2e"), "MEGAJOULE": ("", 0, " MJ"), "KILOLITRE": ("", 0, " KL"), "METRIC_TONNE": ("", 0, " MT"), "MILLION_TONNES": ("", 2, " Mt"),
}


def format_value(value: Column, unit: Column) -> Column:
    """A value as tables show it: grouped thousands, decimals by unit, three without a unit; half to even."""
    out = F.when(unit.isNull(), F.format_number(value, 3))
    for name, (before, decimals, after) in UNITS.items():
        number = F.format_number(value, decimals)
        out = out.when(unit == name, F.concat(F.lit(before), F.replace(number, F.lit(","), F.lit("")) if name == "PERCENT" else number, F.lit(after)))
    return out.otherwise(F.format_number(value, 2))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\W+", "_"), "^_+|_+$", "")


def safe_cell(text: Column) -> Column:
    """A table cell: blanks collapsed, bars escaped."""
    return F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def clean_role(role: Column) -> Column:
    """A role without what follows it: a date of effect, 'of the Company', 'subject to'."""
    out = F.regexp_replace(F.trim(role), "[ ,]+$", "")
    for tail in (r"(?i)\s+(?:effective|w\.?e\.?f\.?|with\s+effect).*$", r"(?i)\s+of\s+the\s+Company.*$", r"(?i),?\s+subject\s+to.*$"):
        out = F.trim(F.regexp_replace(out, tail, ""))
    return out


def clamp(text: Column, least: int = 1, most: int = 5) -> Column:
    """A score as a whole number within bounds; what is none is the least."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(text.try_cast("int"), F.lit(least))))


def lenient_json(text: Column) -> Column:
    """The JSON object in a text: without fences, or else from its first to its last brace; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^`+(?:\s*(?i:json))?|`+$", ""), r"^\s+|\s+$", "")
    inner = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.when(F.get_json_object(bare, "$").startswith("{"), bare), F.when(F.get_json_object(inner, "$").isNotNull(), inner))


def pinned(fingerprint: Column, assertions: Column, documents: Column, built: Column) -> Column:
    """The line that names a build; parts without a number are left out, and without a build there is none."""
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}")))
    line = F.concat_ws(" · ", F.concat(F.lit("build "), fingerprint), part(assertions, "assertions"), part(documents, "documents"), F.concat(F.lit("profile built "), F.substring(built, 1, 10)))
    return F.when(F.coalesce(fingerprint, F.lit("")) != "", line).otherwise("")


def encoded(text: Column, whole: Column, number: Column) -> Column:
    """(raw, value_type) of a value that is one of text, whole number, number, or nothing; types are told apart, so 5, 5.0 and '5' stay three values."""
    pair = lambda raw, kind: F.struct(raw.cast("string").alias("raw"), F.lit(kind).alias("value_type"))
    return F.when(text.isNotNull(), pair(text, "str")).when(whole.isNotNull(), pair(whole, "int")).when(number.isNotNull(), pair(number, "float")).otherwise(pair(F.lit(None), "null"))


def decoded(value: Column) -> Column:
    """The inverse of encoded(): text, whole, number."""
    of = lambda kind, to: F.when(value["value_type"] == kind, value["raw"].cast(to))
    return F.struct(of("str", "string").alias("text"), of("int", "long").alias("whole"), of("float", "double").alias("number"))


#: Keys of wall-clock times, which no hash may depend on.
VOLATILE = ("analyzed_at", "built_at", "created_at")


def canonical_json(entries: Column) -> Column:
    """A map of text as JSON with its keys sorted and wall-clock keys dropped."""
    kept = F.filter(F.map_entries(entries), lambda e: ~e["key"].isin(*VOLATILE))
    return F.to_json(F.map_from_entries(F.array_sort(kept)))
