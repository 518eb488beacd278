"""Facts in the text of letters, as column expressions; one letter, a few facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factframe.functions.dates import written_date
from factframe.functions.scalars import clean_role

_AMOUNT = r"\d[\d,]*(?:\.\d+)?"


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match; null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def day_after(text: Column, words: str) -> Column:
    """The written date that follows some words closely; null if none does."""
    return F.to_date(written_date(group(text, rf"(?i){words}[^\n.]{{0,20}}?(\w+ \d{{1,2}}, \d{{4}})")))


def dividends(text: Column) -> Column:
    """[(dividend_type, per_share)] in the order of the text."""
    rule = r"(?i)\b(interim|final|special) dividend of Rs\.? ?(\d+(?:\.\d+)?)"
    return F.zip_with(F.regexp_extract_all(text, F.lit(rule), F.lit(1)), F.regexp_extract_all(text, F.lit(rule), F.lit(2)), lambda kind, n: F.struct(F.lower(kind).alias("dividend_type"), n.cast("double").alias("per_share")))


def buyback(text: Column) -> Column:
    """(bought, price, offered, record_date)."""
    return F.struct(
        amount(group(text, rf"(?i)bought back ({_AMOUNT}) equity shares")).alias("bought"),
        amount(group(text, rf"(?i)each at Rs\.? ({_AMOUNT})")).alias("price"),
        amount(group(text, rf"(?i)({_AMOUNT}) having been offered")).alias("offered"),
        day_after(text, "record date").alias("record_date"),
    )


def sections(text: Column) -> Column:
    """(cover, a, b): a letter cut at its headings of annexures; an absent part is null."""
    parts = F.split(text, r"(?m)^Annexure [AB]$\n")
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^Annexure ([AB])$"), F.lit(1))
    of = lambda name: F.when(F.array_position(heads, name) > 0, F.get(parts, F.array_position(heads, name).cast("int")))
    return F.struct(parts[0].alias("cover"), of("A").alias("a"), of("B").alias("b"))


def acquisition(text: Column) -> Column:
    """(target, stake_pct, value, unit, consideration, completion): the deal from annexure A, its completion from B."""
    part = sections(text)
    deal = part["a"]
    unit = group(deal, r"USD [\d.]+ (million|billion)")
    return F.struct(
        group(deal, r"% of (.+? Limited)").alias("target"),
        group(deal, r"acquire ([\d.]+)%").cast("double").alias("stake_pct"),
        group(deal, r"USD ([\d.]+) ").cast("double").alias("value"),
        F.concat(F.lit("usd_"), unit).alias("unit"),
        group(deal, r"payable in (\w+)").alias("consideration"),
        day_after(part["b"], "completion is expected by").alias("completion"),
    )


def ratings(text: Column) -> Column:
    """[(instrument, amount, rating, outlook, action)] of the lines of four cells whose second is an amount."""
    cells = F.transform(F.split(text, "\n"), lambda line: F.transform(F.split(line, r"\|"), lambda x: F.trim(x)))
    tables = F.filter(cells, lambda x: (F.size(x) == 4) & F.get(x, F.lit(1)).rlike(r"^Rs\."))
    cell = lambda x, k: F.get(x, F.lit(k))
    return F.transform(
        tables,
        lambda x: F.struct(
            cell(x, 0).alias("instrument"), amount(group(cell(x, 1), rf"({_AMOUNT})")).alias("amount"), group(cell(x, 2), r"^(\S+)").alias("rating"),
            F.lower(group(cell(x, 2), r"\((\w+)\)")).alias("outlook"), cell(x, 3).alias("action"),
        ),
    )


def complements(text: Column) -> Column:
    """(for, against): the first two shares that make up a hundred, among numbers of four decimals."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,3}\.\d{4})\b"), F.lit(1)), lambda x: x.cast("double"))
    able = F.filter(F.transform(numbers, lambda x, i: F.struct(x.alias("a"), F.get(numbers, i + 1).alias("b"))), lambda p: F.abs(p["a"] + p["b"] - 100) < 1e-6)
    return F.struct(F.get(able, F.lit(0))["a"].alias("pct_for"), F.get(able, F.lit(0))["b"].alias("pct_against"))


def resolutions(text: Column) -> Column:
    """[(number, title, resolution_type, pct_for, pct_against, outcome)]: a special one needs three quarters, an ordinary one more than half."""
    blocks = F.filter(F.split(text, r"(?m)^Item "), lambda b: b.rlike(r"^\d+\. "))

    def one(block: Column) -> Column:
        votes, special = complements(block), block.contains("Special resolution")
        passed = F.when(special, votes["pct_for"] >= 75).otherwise(votes["pct_for"] > 50)
        return F.struct(
            group(block, r"^(\d+)\. ").cast("int").alias("number"), group(block, r"^\d+\. ([^\n]+)").alias("title"), F.when(special, "special").otherwise("ordinary").alias("resolution_type"),
            votes["pct_for"].alias("pct_for"), votes["pct_against"].alias("pct_against"), F.when(passed, "passed").otherwise("not_passed").alias("outcome"),
        )

    return F.transform(blocks, one)


def holdings(text: Column) -> Column:
    """{context: percent} of tagged shares: the last of a context counts; a letter with a value above 1.5 is in percent, else in shares of one."""
    tag = r"<share context='([^']+)'>([\d.]+)</share>"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(tag), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(tag), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    most = F.array_max(F.transform(last, lambda p: p["v"].cast("double")))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.round(p["v"].cast("double") * F.when(most > 1.5, 1).otherwise(100), 4))))


def values_after(text: Column, label: str) -> Column:
    """The numbers of the row that follows a label, in its line or the next: parentheses are negative, a lone dash is zero."""
    row = group(text, rf"{label}\s*\n?([^\n]*)")
    found = F.regexp_extract_all(row, F.lit(rf"\({_AMOUNT}\)|{_AMOUNT}|(?<!\S)-(?!\S)"), F.lit(0))
    return F.transform(found, lambda x: F.when(x == "-", 0.0).when(x.startswith("("), -amount(F.regexp_replace(x, r"[()]", ""))).otherwise(amount(x)))


#: Rows of a statement; some hold positive values only.
ROWS = {"revenue": "Revenue from operations", "other_income": "Other income", "receivables": "Trade receivables"}
POSITIVE = ("receivables",)


def results(text: Column) -> Column:
    """(period_type, period, rows): rows are (metric, value), the first value of each row that is one the metric may have."""
    period_type = group(text, r"(?i)\b(quarter|year) ended")
    rows = [F.struct(F.lit(name).alias("metric"), F.get(F.filter(values_after(text, label), lambda v: (v > 0) if name in POSITIVE else F.lit(True)), F.lit(0)).alias("value")) for name, label in ROWS.items()]
    return F.struct(period_type.alias("period_type"), day_after(text, r"(?:quarter|year) ended").alias("period"), F.filter(F.array(*rows), lambda r: r["value"].isNotNull()).alias("rows"))


def board(text: Column) -> Column:
    """[(topic, name, role, amount)]: appointments and resignations with their roles, and issues with their sums."""
    rule = r"(?i)\b(appointment|resignation) of ([A-Z]\w+ [A-Z]\w+) as ([^;\n]+)"
    at = lambda k: F.regexp_extract_all(text, F.lit(rule), F.lit(k))
    people = F.transform(F.arrays_zip(at(1).alias("t"), at(2).alias("n"), at(3).alias("r")), lambda x: F.struct(F.lower(x["t"]).alias("topic"), x["n"].alias("name"), clean_role(F.regexp_replace(x["r"], r",? effective .*$", "")).alias("role"), F.lit(None).cast("double").alias("amount")))
    sums = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)issue of shares of up to Rs\.? ({_AMOUNT}) crore"), F.lit(1)), lambda x: F.struct(F.lit("issue").alias("topic"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("role"), amount(x).alias("amount")))
    return F.concat(people, sums)


def segment_lines(text: Column) -> Column:
    """The lines that may name a segment: a word or more, no sentence, no total, not all capitals."""
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^[A-Za-z][\w ]*$") & ~s.rlike(r"(?i)^(total|revenue|result|note)") & ~s.rlike(r"^[A-Z ]+$"))


def emissions(text: Column) -> Column:
    """(year_end, rows): rows are (scope, tonnes) of the scopes that are measured."""
    scopes = F.array(*[F.struct(F.lit(n).alias("scope"), amount(group(text, rf"Scope {n} emissions: ({_AMOUNT}) tonnes")).alias("tonnes")) for n in (1, 2, 3)])
    return F.struct(F.make_date(group(text, r"to 31 March (\d{4})").cast("int"), F.lit(3), F.lit(31)).alias("year_end"), F.filter(scopes, lambda r: r["tonnes"].isNotNull()).alias("rows"))


def chart(text: Column) -> Column:
    """[(year, percent)]: labels and values of a chart, first label to first value."""
    years, values = F.regexp_extract_all(text, F.lit(r"\bFY(\d{4})\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)%"), F.lit(1))
    n = F.least(F.size(years), F.size(values))
    return F.zip_with(F.slice(years, F.lit(1), n), F.slice(values, F.lit(1), n), lambda y, v: F.struct(y.cast("int").alias("year"), v.cast("double").alias("percent")))


def bullets(text: Column) -> Column:
    """The items of the list that follows the heading of risks."""
    lines = F.split(F.substr(text, F.greatest(F.lit(1), F.locate("\nRisks\n", text))), "\n")
    return F.filter(F.transform(lines, lambda s: F.regexp_extract(s, r"^(?:[-*]|\d+\)) +(.+)$", 1)), lambda s: s != "")


def aspiration(text: Column) -> Column:
    return group(text, r"(?i)(our aim is to [^.\n]+)")
