"""Extractors over the letters that Spark writes from orders; the oracles take the answers from the orders' own columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factframe.functions import letters as L
from factframe.registry import query
from factframe.sources.letters import KINDS, letters

# the orders behind the letters of a kind
_OF = "SELECT o_orderkey AS id, o_custkey AS c, o_totalprice AS p, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 10 = {}"


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return letters(spark, sf_dir).where(F.col("kind") == kind).select("id", "text")


def _t() -> Column:
    return F.col("text")


@query(f"""WITH o AS ({_OF.format(0)}), r AS (SELECT *, d + 10 AS record_date, CASE WHEN id % 40 > 0 THEN d + 25 END AS paid FROM o)
SELECT id, CASE WHEN id % 20 = 0 THEN 'final' ELSE 'interim' END AS dividend_type, CAST(c % 40 + 0.25 AS DOUBLE) AS per_share, record_date, paid FROM r UNION ALL SELECT id, 'special', c % 7 + 1, record_date, paid FROM r WHERE id % 3 = 0""")
def letters_dividends(spark, sf_dir):
    """Dividends declared, with the dates that they share."""
    found = _of(spark, sf_dir, "dividend").select("id", F.explode(L.dividends(_t())).alias("f"), L.day_after(_t(), "record date is").alias("record_date"), L.day_after(_t(), "paid on").alias("paid"))
    return found.select("id", "f.*", "record_date", "paid")


@query(f"SELECT id, CAST(id * 1000 + c AS DOUBLE) AS bought, p AS price, CAST(c * 10000 AS DOUBLE) AS offered, d + 5 AS record_date FROM ({_OF.format(1)})")
def letters_buybacks(spark, sf_dir):
    """Shares bought back, their price, what was offered, and the record date."""
    return _of(spark, sf_dir, "buyback").select("id", L.buyback(_t()).alias("f")).select("id", "f.*")


@query(f"""SELECT id, 'Target ' || c || ' Limited' AS target, CAST(c % 90 + 5.5 AS DOUBLE) AS stake_pct, p AS value, CASE WHEN c % 3 = 0 THEN 'usd_billion' ELSE 'usd_million' END AS unit,
CASE WHEN id % 20 = 2 THEN 'cash' ELSE 'shares' END AS consideration, CASE WHEN id % 30 <> 2 THEN d + 200 END AS completion FROM ({_OF.format(2)})""")
def letters_acquisitions(spark, sf_dir):
    """Deals: the target and terms from one annexure, the completion from the other."""
    return _of(spark, sf_dir, "acquisition").select("id", L.acquisition(_t()).alias("f")).select("id", "f.*")


@query(f"""SELECT id, 'Signed on ' || strftime(d, '%B %-d, %Y') || '.' || chr(10) AS cover, CASE WHEN id % 30 <> 2 THEN 'Completion is expected by ' || strftime(d + 200, '%B %-d, %Y') || '.' || chr(10) END AS b FROM ({_OF.format(2)})""")
def letters_annexures(spark, sf_dir):
    """Letters cut at the headings of their annexures; an absent one is null."""
    return _of(spark, sf_dir, "acquisition").select("id", L.sections(_t()).alias("f")).select("id", "f.cover", "f.b")


@query(f"""WITH o AS ({_OF.format(3)}), a AS (SELECT *, CASE WHEN c % 2 = 0 THEN 'Northern Ratings' ELSE 'Careful Credit' END AS agency FROM o)
SELECT id, agency, 'Term loan' AS instrument, p AS amount, 'AA+' AS rating, 'stable' AS outlook, 'reaffirmed' AS action FROM a
UNION ALL SELECT id, agency, 'Commercial paper', c, 'A1+', NULL, CASE WHEN c % 5 = 0 THEN 'downgraded' ELSE 'assigned' END FROM a""")
def letters_ratings(spark, sf_dir):
    """Rated instruments line by line, with the agency of the letter."""
    return _of(spark, sf_dir, "rating").select("id", L.group(_t(), r"(?m)^Agency: (.+)$").alias("agency"), F.explode(L.ratings(_t())).alias("f")).select("id", "agency", "f.*")


_VOTES_SQL = f"""WITH o AS ({_OF.format(4)}), v AS (SELECT *, 55 + c % 4000 / 100 AS f FROM o),
r AS (SELECT id, 1 AS number, 'Adoption of accounts' AS title, 'ordinary' AS resolution_type, round(f, 4) AS pct_for, round(100 - f, 4) AS pct_against FROM v
UNION ALL SELECT id, 2, 'Pay of director ' || c, 'special', 99.5, 0.5 FROM v)"""


@query(f"{_VOTES_SQL} SELECT *, 'passed' AS outcome FROM r")
def letters_resolutions(spark, sf_dir):
    """Resolutions with their votes, which are the two shares that make up a hundred, and whether they passed."""
    return _of(spark, sf_dir, "meeting").select("id", F.explode(L.resolutions(_t())).alias("f")).select("id", "f.*")


@query(f"""WITH o AS ({_OF.format(5)}) SELECT id, h.k AS context, h.v AS percent, CASE WHEN h.k = 'MutualFunds' THEN 'public' WHEN h.k = 'Insurers' THEN 'public' ELSE 'promoter' END AS class
FROM (SELECT id, unnest([{{'k': 'Promoters', 'v': CAST(40 + c % 30 AS DOUBLE)}}, {{'k': 'MutualFunds', 'v': c % 11 + 3}}, {{'k': 'Insurers', 'v': id % 9 + 1}}]) AS h FROM o)""")
def letters_holdings(spark, sf_dir):
    """Holders and their shares in percent: the last value of a context, on the scale that the letter's values show; and their class."""
    rows = _of(spark, sf_dir, "holding").select("id", F.explode(L.holdings(_t())).alias("context", "percent"))
    return rows.withColumn("class", F.when(F.col("context").isin("MutualFunds", "Insurers"), "public").otherwise("promoter"))


@query(f"""WITH o AS ({_OF.format(6)}) SELECT id, CASE WHEN id % 20 = 6 THEN 'quarter' ELSE 'year' END AS period_type, last_day(d) AS period, r.m AS metric, r.v AS value
FROM (SELECT *, unnest([{{'m': 'revenue', 'v': p}}, {{'m': 'other_income', 'v': 0.0}}]) AS r FROM o)""")
def letters_results(spark, sf_dir):
    """Figures of results by their labels; a row that must be positive and isn't has none."""
    found = _of(spark, sf_dir, "results").select("id", L.results(_t()).alias("f"))
    return found.select("id", "f.period_type", "f.period", F.explode("f.rows").alias("r")).select("id", "period_type", "period", "r.*")


@query(f"SELECT id, [p, -CAST(c AS DOUBLE)] AS revenue, [0.0::DOUBLE, CAST(c + 0.5 AS DOUBLE)] AS other_income, [-CAST(c AS DOUBLE), 0.0::DOUBLE] AS receivables FROM ({_OF.format(6)})")
def letters_row_values(spark, sf_dir):
    """All numbers of the row after a label: in its line or the next, in parentheses, or a dash."""
    return _of(spark, sf_dir, "results").select("id", *[L.values_after(_t(), label).alias(name) for name, label in L.ROWS.items()])


@query(f"""WITH o AS ({_OF.format(7)}) SELECT id, 'appointment' AS topic, 'Anna Berg' AS name, 'Finance Chief' AS role, NULL::DOUBLE AS amount FROM o
UNION ALL SELECT id, 'resignation', 'Otto Lund', 'Director', NULL FROM o UNION ALL SELECT id, 'issue', NULL, NULL, p FROM o""")
def letters_board(spark, sf_dir):
    """A board's decisions, topic by topic, in one shape."""
    return _of(spark, sf_dir, "board").select("id", F.explode(L.board(_t())).alias("f")).select("id", "f.*")


@query(f"SELECT id, 'Steel ' || c AS segment FROM ({_OF.format(7)})")
def letters_segments(spark, sf_dir):
    """Lines that may name a segment: no total, no sentence, not all capitals."""
    return _of(spark, sf_dir, "board").select("id", F.explode(L.segment_lines(_t())).alias("segment"))


@query(f"""WITH o AS ({_OF.format(8)}) SELECT id, make_date(CAST(year(d) AS INTEGER), 3, 31) AS year_end, r.s AS scope, r.t AS tonnes FROM (SELECT *, unnest([{{'s': 1, 't': p}}, {{'s': 2, 't': CAST(c AS DOUBLE)}}]) AS r FROM o)""")
def letters_emissions(spark, sf_dir):
    """Emissions by scope, of those that are measured, for the year that the report covers."""
    found = _of(spark, sf_dir, "emissions").select("id", L.emissions(_t()).alias("f"))
    return found.select("id", "f.year_end", F.explode("f.rows").alias("r")).select("id", "year_end", "r.*")


@query(f"""WITH o AS ({_OF.format(9)}) SELECT id, r.y AS year, r.v AS percent, 'our aim is to serve ' || c || ' towns by sea' AS aim
FROM (SELECT *, unnest([{{'y': year(d) - 2, 'v': CAST(c % 20 + 0.5 AS DOUBLE)}}, {{'y': year(d) - 1, 'v': c % 30}}, {{'y': year(d), 'v': c % 40 + 0.25}}]) AS r FROM o)""")
def letters_charts(spark, sf_dir):
    """Values of a chart with their labels, first to first, and the aim that the deck states."""
    rows = _of(spark, sf_dir, "deck").select("id", F.explode(L.chart(_t())).alias("f"), F.lower(L.aspiration(_t())).alias("aim"))
    return rows.select("id", F.col("f.year").cast("long").alias("year"), "f.percent", "aim")


@query(f"SELECT id, ['Currency swings', 'Loss of ' || c || ' people', 'Floods'] AS risks FROM ({_OF.format(9)})")
def letters_risks(spark, sf_dir):
    """The items of a report's list of risks."""
    return _of(spark, sf_dir, "deck").select("id", L.bullets(_t()).alias("risks"))


@query("""WITH k AS (SELECT o_orderkey AS id, list_extract(['dividend', 'buyback', 'acquisition', 'rating', 'meeting', 'holding', 'results', 'board', 'emissions', 'deck'], CAST(o_orderkey % 10 AS INTEGER) + 1) AS kind FROM orders),
n AS (SELECT *, CASE kind WHEN 'dividend' THEN CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END WHEN 'rating' THEN 2 WHEN 'meeting' THEN 2 WHEN 'board' THEN 3 WHEN 'emissions' THEN 2 WHEN 'results' THEN 2 WHEN 'holding' THEN 3 WHEN 'deck' THEN 3 ELSE 1 END AS facts FROM k)
SELECT kind, CASE WHEN kind IN ('deck', 'holding') AND id % 4 = 1 THEN 'no analyzer' ELSE 'ok' END AS status, count(*) AS letters, CAST(sum(CASE WHEN kind IN ('deck', 'holding') AND id % 4 = 1 THEN 0 ELSE facts END) AS BIGINT) AS facts FROM n GROUP BY ALL""")
def letters_dispatched(spark, sf_dir):
    """Letters to the extractor of their kind; a kind that no extractor knows is an error row, not a lost letter."""
    known = F.when(F.col("kind").isin("deck", "holding") & (F.col("id") % 4 == 1), F.concat(F.lit("unknown "), "kind")).otherwise(F.col("kind"))
    counts = {
        "dividend": F.size(L.dividends(_t())), "buyback": F.lit(1), "acquisition": F.lit(1), "rating": F.size(L.ratings(_t())), "meeting": F.size(L.resolutions(_t())), "holding": F.size(L.holdings(_t())),
        "results": F.size(L.results(_t())["rows"]), "board": F.size(L.board(_t())), "emissions": F.size(L.emissions(_t())["rows"]), "deck": F.size(L.chart(_t())),
    }
    facts = reduce(lambda out, k: F.when(known == k, counts[k]).otherwise(out), KINDS, F.lit(None).cast("int"))
    done = letters(spark, sf_dir).select("kind", facts.alias("n"))
    return done.groupBy("kind", F.when(F.col("n").isNull(), "no analyzer").otherwise("ok").alias("status")).agg(F.count("*").alias("letters"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("facts"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 < 3 THEN CAST(ts AS DATE) END AS day FROM events""")
def written_dates_parsed(spark, sf_dir):
    """Days as letters write them, with their month in words; other forms and none are null."""
    from factframe.functions.dates import written_date
    from factframe.sources.tables import table

    n, ts = F.col("event_id") % 5, F.col("ts")
    said = F.when(n == 0, F.concat(F.lit("on "), F.date_format(ts, "MMMM d, yyyy"), F.lit(" the"))).when(n == 1, F.date_format(ts, "MMMM dd yyyy")).when(n == 2, F.concat(F.lit("dated "), F.lower(F.date_format(ts, "MMMM d, yyyy")))).when(n == 3, F.date_format(ts, "d/M/yyyy")).otherwise("")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_date(written_date(said)).alias("day"))
