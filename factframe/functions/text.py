"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no question content.
STOP_WORDS = (
    "the", "for", "and", "are", "was", "were", "been", "being", "has", "have", "had", "this", "that", "these", "those", "with", "from", "its", "their", "they", "which", "what", "how",
    "does", "did", "will", "would", "can", "could", "about", "over", "under", "than", "then", "not", "yes", "you", "your", "our", "she", "them", "his", "her", "there", "here", "such",
    "any", "all", "but", "also",
)
# Titles dropped from names.
HONORIFICS = ("mr", "mrs", "ms", "dr", "shri", "smt", "sri", "prof")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    """Lower case, marks to blanks, blanks collapsed; accented letters stay."""
    return one_line(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def name_tokens(name: Column) -> Column:
    plain = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.filter(plain, lambda t: ~t.isin("", *HONORIFICS))


# Fixed value: a word, with one apostrophe inside, or a number.
TOKEN = r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)?"


def tokens(text: Column) -> Column:
    """Words and numbers, lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keywords_of(words: Column) -> Column:
    """Of tokens the distinct words of three letters or more that are not stop words; a token begins with a letter or a digit, and digits come first."""
    return F.filter(F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS])), lambda t: (t >= "a") & (F.length(t) >= 3))


def numbers_of(words: Column) -> Column:
    return F.filter(F.array_distinct(words), lambda t: t < "a")


def keywords(text: Column) -> Column:
    return keywords_of(tokens(text))


def numbers(text: Column) -> Column:
    return numbers_of(tokens(text))


def parse_number(text: Column) -> Column:
    """Commas and blanks dropped, parentheses negative, a dash or nothing is zero; null if it is no number, as a lone comma."""
    plain = F.regexp_replace(F.trim(text), "[, ]", "")
    negative = plain.rlike(r"^\(.*\)$")
    value = F.regexp_replace(plain, r"^\(|\)$", "").try_cast("double")
    return F.when(F.trim(text).isin("-", ""), F.lit(0.0)).otherwise(F.when(negative, -value).otherwise(value))


# How OCR mangles grouped numbers, in the order of repair: a one read as L, then periods for commas.
OCR_REPAIRS = (
    (r"(?<=\d)L(?=[.\d])", "1"),
    (r"(?<!\d)(\d{1,2})\.(\d{2}),(\d{3})\.(\d{2})(?!\d)", "$1,$2,$3.$4"),
    (r"(?<!\d)(\d{1,2})\.(\d{2})\.(\d{3})\.(\d{2})(?!\d)", "$1,$2,$3.$4"),
    (r"(?<!\d)(\d+)\.(\d{3})\.(\d{2})(?!\d)", "$1,$2.$3"),
    (r"(?<!\d)(\d+)\.(\d{3}) (\d{2})(?!\d)", "$1,$2.$3"),
)
# Fixed value: a number in parentheses, a dash that stands alone, or a grouped number.
NUMBER = r"\([\d,]+(?:\.\d+)?\)|(?<!\w)-(?!\w)|[\d,]+(?:\.\d+)?"


def fix_ocr_numbers(text: Column) -> Column:
    """Restore grouping commas that OCR has read as periods or blanks."""
    for pattern, by in OCR_REPAIRS:
        text = F.regexp_replace(text, pattern, by)
    return text


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


# Characters beyond ASCII that financial text may hold.
SAFE = "₹–—‘’“”…\u00a0"
#: Marks stripped from both ends of a word before it is looked at.
_EDGES = r"""[.,;:!?"'()/\[\]{}|\\-]+"""


def garbled_words(text: Column, most: int = 8000) -> Column:
    """(words, garbled) over the part of a text that the score is defined on.

    A word is garbled by a character beyond ASCII that is not safe, by a digit
    between letters unless all its letters are capitals, or by a small l before
    a capital at its start; a word of one character never is.
    """
    words = F.filter(F.split(F.substring(text, 1, most), r"[\s\p{Z}]+"), lambda w: w != "")
    core = F.filter(F.transform(words, lambda w: F.regexp_replace(w, f"^{_EDGES}|{_EDGES}$", "")), lambda w: F.length(w) >= 2)
    bad = F.filter(core, lambda w: w.rlike(rf"[^\x00-\x7F{SAFE}]") | (w.rlike("[A-Za-z][0-9][A-Za-z]") & w.rlike("[a-z]")) | w.rlike("^l[A-Z]"))
    return F.struct(F.size(words).alias("words"), F.size(bad).alias("garbled"))


def quality_score(text: Column, pages: Column) -> Column:
    """0.4 for density (200 characters a page is full) and 0.6 for clean words; 0 for an empty text."""
    counts = garbled_words(text)
    density = F.least(F.lit(1.0), F.length(text) / pages / 200.0)
    clean = F.greatest(F.lit(0.0), 1 - 50.0 * F.coalesce(counts["garbled"] / F.nullif(counts["words"], F.lit(0)), F.lit(0.0)))
    return F.when((F.coalesce(F.length(text), F.lit(0)) == 0) | (pages <= 0), F.lit(0.0)).otherwise(F.round(0.4 * density + 0.6 * clean, 4))


# What marks a risk text as boilerplate, and the vocabulary that makes one trustworthy.
BOILERPLATE = r"(?i)https?://|\bw\.e\.f\.?\b|\bceased to be\b|\bappointed as\b|\bmember of the committee\b|\(C\)\s*\(N?ED\)|^\**\s*[\d.]+\s*$"
STRONG_RISK = r"(?i)\b(risk|adverse|litigation|non-compliance|penalt|vulnerab|threat)\w*"
WEAK_RISK = r"(?i)\b(may|could|uncertain|impact|competit|regulat|disrupt|volatil|exposure|challeng)\w*"


def plausible_risk(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 50) & ~F.trim(text).rlike(BOILERPLATE)


def high_confidence_risk(text: Column, recurrence: Column) -> Column:
    """It recurs, or has a strong term, or two different weak ones."""
    weak = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WEAK_RISK), F.lit(1)), F.lower))
    return (recurrence >= 2) | text.rlike(STRONG_RISK) | (F.size(weak) >= 2)


# Cues of forward guidance, with a number within 80 characters.
GUIDANCE = r"(?i)\b((?:target(?:ing)?|guidance|aspir\w+|stated\s+range|aiming\s+to\s+achieve|intend(?:ing)?\s+to\s+increase)[^.\n]{0,80}?\d[^.\n]{0,40})"
# Fixed value: a number or range with a unit, as targets are stated.
TARGET = r"(?i)(?:<\s*)?\d[\d,]*(?:\.\d+)?(?:\s*-\s*\d[\d,]*(?:\.\d+)?)?\s*(?:%|x\b|mtpa|tco2e?|crores?|cr\b)"


def guidance_statements(text: Column, most: int = 3) -> Column:
    """The first statements in the order of the text, each once whatever its case; line ends are blanks."""
    found = F.transform(F.regexp_extract_all(F.regexp_replace(text, "\n", " "), F.lit(GUIDANCE), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    low = F.transform(found, F.lower)
    return F.slice(F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def target_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(TARGET), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")))
