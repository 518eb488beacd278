"""Letters that Spark writes from orders: what companies send to an exchange, one an order, of ten kinds.

Every figure, date and name of a letter is one of its row, so what is read from
its text can be held against the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.sources.tables import table

KINDS = ("dividend", "buyback", "acquisition", "rating", "meeting", "holding", "results", "board", "emissions", "deck")


def _day(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")


def _fixed(number: Column, decimals: int = 2) -> Column:
    return number.cast(f"decimal(18,{decimals})").cast("string")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind and text of every order's letter."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"), F.to_date("o_orderdate").alias("d"))
    i, c, p, d = (F.col(x) for x in ("id", "c", "p", "d"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    price, grouped = _fixed(p), F.format_number(p, 2)
    in_favour = 55 + c % 4000 / 100
    share = F.when(i % 4 == 1, 1.0).otherwise(0.01)  # some documents are in percent, the others in shares of one
    texts = {
        "dividend": say(
            "Outcome of the meeting held on ", _day(d), ".\nThe Board recommends ", F.when(i % 20 == 0, "a final").otherwise("an interim"), " dividend of Rs. ", _fixed(c % 40 + 0.25), " a share",
            F.when(i % 3 == 0, say(" and a special dividend of Rs ", (c % 7 + 1).cast("string"), " a share")).otherwise(""), ".\nThe record date is ", _day(F.date_add(d, 10)), ".",
            F.when(i % 40 == 0, "").otherwise(say(" It will be paid on ", _day(F.date_add(d, 25)), ".")),
        ),
        "buyback": say("In the window of ", _day(d), " the Company bought back ", F.format_number(i * 1000 + c, 0), " equity shares of Rs. 10 each at Rs. ", grouped, " a share, ", F.format_number(c * 10_000, 0), " having been offered.\nRecord date: ", _day(F.date_add(d, 5)), "\n"),
        "acquisition": say(
            "Signed on ", _day(d), ".\nAnnexure A\nThe Company will acquire ", _fixed(c % 90 + 5.5), "% of Target ", c.cast("string"), " Limited at a value of USD ", price, F.when(c % 3 == 0, " billion").otherwise(" million"), ", payable in ",
            F.when(i % 20 == 2, "cash").otherwise("shares"), ".\n", F.when(i % 30 == 2, "").otherwise(say("Annexure B\nCompletion is expected by ", _day(F.date_add(d, 200)), ".\n")),
        ),
        "rating": say("Agency: ", F.when(c % 2 == 0, "Northern Ratings").otherwise("Careful Credit"), "\nTerm loan | Rs. ", grouped, " crore | AA+ (Stable) | reaffirmed\nnothing else is rated here\nCommercial paper | Rs. ", c.cast("string"), " crore | A1+ | ", F.when(c % 5 == 0, "downgraded").otherwise("assigned"), "\n"),
        "meeting": say("Item 1. Adoption of accounts\nOrdinary resolution. Turnout 71.5000 of 4,", c.cast("string"), " holders\nFor ", _fixed(in_favour, 4), " against ", _fixed(100 - in_favour, 4), "\nItem 2. Pay of director ", c.cast("string"), "\nSpecial resolution. Turnout 60.2500\nFor ", _fixed(F.lit(99.5), 4), " against ", _fixed(F.lit(0.5), 4), "\n"),
        "holding": say(
            "<doc><share context='Promoters'>", _fixed((40 + c % 30) * share, 6), "</share><share context='MutualFunds'>", _fixed((c % 11 + 2) * share, 6), "</share><share context='MutualFunds'>", _fixed((c % 11 + 3) * share, 6),
            "</share><share context='Insurers'>", _fixed((i % 9 + 1) * share, 6), "</share></doc>",
        ),
        "results": say("Unaudited results of the ", F.when(i % 20 == 6, "quarter").otherwise("year"), " ended ", _day(F.last_day(d)), "\nParticulars | this | before\nRevenue from operations ", grouped, " (", F.format_number(c, 0), ")\nOther income\n- ", c.cast("string"), ".50\nTrade receivables (", c.cast("string"), ") 0\nTotal\n"),
        "board": say("The Board approved the appointment of Anna Berg as Finance Chief of the Company, effective ", _day(d), ";\nthe resignation of Otto Lund as Director, subject to approval;\nand the issue of shares of up to Rs. ", grouped, " crore.\nSteel ", c.cast("string"), "\nTotal revenue\nBANKING\n"),
        "emissions": say("Report of 1 April ", (F.year(d) - 1).cast("string"), " to 31 March ", F.year(d).cast("string"), "\nScope 1 emissions: ", grouped, " tonnes\nScope 2 emissions: ", c.cast("string"), " tonnes\nScope 3 emissions: not measured\n"),
        "deck": say(
            "Margin by year\nFY", (F.year(d) - 2).cast("string"), " FY", (F.year(d) - 1).cast("string"), " FY", F.year(d).cast("string"), "\n", (c % 20).cast("string"), ".5% ", (c % 30).cast("string"), "% ", (c % 40).cast("string"), ".25%\nOur aim is to serve ", c.cast("string"),
            " towns by sea.\nRisks\n- Currency swings\n* Loss of ", c.cast("string"), " people\n1) Floods\nThank you\n",
        ),
    }
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % len(KINDS) + 1).cast("int"))
    text = F.lit(None).cast("string")
    for name in reversed(KINDS):
        text = F.when(F.col("kind") == name, texts[name]).otherwise(text)
    return rows.withColumn("kind", kind).select("id", "kind", text.alias("text"))
