"""Column expressions for excerpts and for labels of halves of fiscal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The width of an excerpt, how far back a heading may stand and its length; how labels of half years and of years are written, and how near before a value.
AROUND, LOOKBACK, LONGEST_HEADING = 240, 500, 80
HALF_YEAR = r"(?i)^\s*H([12])\s*FY(\d{2})"
YEAR, REACH = r"(?i)FY\s?(\d{2,4})\b", 60


def snippet(text: Column, offset: Column, length: int = 120) -> Column:
    """So many characters from a 0-based offset, line breaks as blanks."""
    return F.translate(F.substring(text, offset + 1, F.lit(length)), "\n", " ")


def trimmed_excerpt(text: Column, anchor: Column, width: int = AROUND) -> Column:
    """The text around a 0-based anchor, both ends moved outward to white space, so no word is cut."""
    begin, end = F.greatest(F.lit(0), anchor - width // 2), F.least(F.length(text), anchor + width // 2)
    left = F.length(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), begin)), r"^\S*", 0))
    right = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^\S*", 0))
    return F.regexp_replace(F.substring(text, begin - left + 1, end - begin + left + right), r"^\s+|\s+$", "")


def heading_before(text: Column, anchor: Column) -> Column:
    """The nearest line before an anchor that may be a heading: not blank, at most 80 characters, no end of a sentence; null if there is none near."""
    begin = F.greatest(F.lit(0), anchor - LOOKBACK)
    lines = F.transform(F.reverse(F.split(F.substring(text, begin + 1, anchor - begin), "\n")), lambda s: F.trim(s))
    able = F.filter(lines, lambda s: (s != "") & (F.length(s) <= LONGEST_HEADING) & ~F.right(s, F.lit(1)).isin(".", ",", ";"))
    return F.get(able, F.lit(0))


def _full_year(year: Column) -> Column:
    return F.when(F.length(year) == 4, year.cast("int")).otherwise(2000 + year.cast("int"))


def half_year_end(label: Column) -> Column:
    """'H1 FY26' is 30 September 2025, 'H2 FY23' 31 March 2023; null if it is no such label."""
    half, year = F.regexp_extract(label, HALF_YEAR, 1), F.regexp_extract(label, HALF_YEAR, 2)
    return F.when(half == "1", F.make_date(1999 + F.nullif(year, F.lit("")).cast("int"), F.lit(9), F.lit(30))).when(half == "2", F.make_date(2000 + F.nullif(year, F.lit("")).cast("int"), F.lit(3), F.lit(31)))


def nearest_year_end(text: Column, offset: Column, fallback: Column, reach: int = REACH) -> Column:
    """31 March of the last fiscal year that is named in the 60 characters before a 0-based offset; else the fallback."""
    begin = F.greatest(F.lit(0), offset - reach)
    years = F.regexp_extract_all(F.substring(text, begin + 1, offset - begin), F.lit(YEAR), F.lit(1))
    last = F.get(years, F.size(years) - 1)
    return F.coalesce(F.make_date(_full_year(last), F.lit(3), F.lit(31)), fallback)
