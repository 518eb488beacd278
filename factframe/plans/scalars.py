"""Queries of formatting, keys, hashes and lenient parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from factframe.functions import scalars as S
from factframe.registry import query
from factframe.sources.tables import table

_UNITS = [*S.UNITS, "OTHER"]
_FORMAT_SQL = "CASE " + " ".join(f"WHEN unit = '{u}' THEN '{b}' || format('{{:{'' if u == 'PERCENT' else ','}.{d}f}}', value) || '{a}'" for u, (b, d, a) in S.UNITS.items()) + " WHEN unit IS NULL THEN format('{:,.3f}', value) ELSE format('{:,.2f}', value) END"


@query(f"""WITH v AS (SELECT o_orderkey AS id, o_totalprice AS value, CASE WHEN o_orderkey % 17 > 0 THEN list_extract({_UNITS}, CAST(o_orderkey % {len(_UNITS)} AS INTEGER) + 1) END AS unit FROM orders) SELECT id, {_FORMAT_SQL} AS shown FROM v""")
def formatted_values(spark, sf_dir):
    n = F.col("o_orderkey")
    unit = F.when(n % 17 > 0, F.get(F.array(*[F.lit(u) for u in _UNITS]), (n % len(_UNITS)).cast("int")))
    return table(spark, sf_dir, "orders").select(n.alias("id"), S.format_value(F.col("o_totalprice"), unit).alias("shown"))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '\W+', '_', 'g'), '_') AS slug, regexp_replace(trim(regexp_replace(p_name || chr(10) || ' | ' || p_type, '\s+', ' ', 'g')), '\|', '\\|', 'g') AS cell FROM part""")
def slugs_and_cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), S.safe_cell(F.concat("p_name", F.lit("\n | "), "p_type")).alias("cell"))


_TAILS = (", ", " with effect from May 1", " of the Company, subject to approval", " w.e.f. June", ", subject to consent")


@query("SELECT c_custkey AS id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Director' AS role FROM customer")
def roles_cleaned(spark, sf_dir):
    """Roles without what follows them."""
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), (F.col("c_custkey") % len(_TAILS)).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.clean_role(F.concat(F.initcap("c_mktsegment"), F.lit(" Director"), tail)).alias("role"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 < 2 THEN greatest(1, least(5, CAST(trunc(value) - 30 AS INTEGER))) ELSE 1 END AS score, CASE WHEN event_id % 4 = 2 THEN ['low', 'medium', 'high'][1 + user_id % 3] ELSE 'low' END AS confidence FROM events""")
def scores_clamped(spark, sf_dir):
    """Scores within 1 to 5, and confidence among three words, else low: replies hold one, the other, or neither."""
    n = F.col("event_id")
    words = F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("user_id") % 3).cast("int"))
    raw = F.when(n % 4 < 2, (F.col("value").cast("int") - 30).cast("string")).when(n % 4 == 2, words).otherwise("unsure")
    given = table(spark, sf_dir, "events").select(n.alias("id"), raw.alias("raw"))
    known = F.coalesce(F.when(F.col("raw").isin("high", "medium", "low"), F.col("raw")), F.lit("low"))
    return given.select("id", S.clamp(F.col("raw")).alias("score"), known.alias("confidence"))


@query("SELECT event_id AS id, CASE WHEN event_id % 6 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def replies_parsed(spark, sf_dir):
    """The object in a reply, bare, fenced or amid words; cut ones, lists and prose have none."""
    n, props = F.col("event_id") % 6, F.col("props")
    raw = F.when(n == 0, props).when(n == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Sure! "), props, F.lit(" Hope it helps."))).when(n == 3, F.substring(props, 1, 6)).when(n == 4, "[1, 2]").otherwise("no object")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object(S.lenient_json(raw), "$.k").alias("k"))


@query("""SELECT user_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'build ' || left(md5(CAST(user_id AS VARCHAR)), 8) || ' · ' || CAST(count(*) AS VARCHAR) || ' assertions' || CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN ' · ' || CAST(count(*) FILTER (event_type = 'view') AS VARCHAR) || ' documents' ELSE '' END
|| ' · profile built ' || strftime(max(ts), '%Y-%m-%d') END AS footer FROM events GROUP BY user_id""")
def build_pins(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("d"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("at"))
    pin = F.when(F.col("user_id") % 5 > 0, F.left(F.md5(F.col("user_id").cast("string")), F.lit(8)))
    return seen.select("user_id", S.pinned(pin, F.col("n"), F.col("d"), F.col("at")).alias("footer"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'null' END AS value_type, CASE WHEN event_id % 4 = 0 THEN event_type END AS text, CASE WHEN event_id % 4 = 1 THEN user_id END AS whole, CASE WHEN event_id % 4 = 2 THEN value END AS number FROM events""")
def value_round_trip(spark, sf_dir):
    """Values to text with a type and back."""
    n = F.col("event_id") % 4
    given = [F.when(n == 0, F.col("event_type")), F.when(n == 1, F.col("user_id")), F.when(n == 2, F.col("value"))]
    return table(spark, sf_dir, "events").select("event_id", S.encoded(*given).alias("_e")).select("event_id", "_e.value_type", S.decoded(F.col("_e")).alias("_d")).select("event_id", "value_type", "_d.*")


@query("""SELECT event_id, left(sha256('{"event":"' || event_type || '","user":"' || CAST(user_id AS VARCHAR) || '"}'), 16) AS id FROM events""")
def canonical_ids(spark, sf_dir):
    """Ids of canonical JSON: the order of keys and the time of the run change nothing."""
    entries = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("built_at"), F.current_timestamp().cast("string"), F.lit("event"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.substring(F.sha2(S.canonical_json(entries).cast("binary"), 256), 1, 16).alias("id"))


@query("""WITH m AS (SELECT o_custkey AS company_id, 'Name ' || CAST(o_orderkey % 4 AS VARCHAR) AS name, o_orderkey AS id FROM orders), g AS (SELECT company_id, min_by(name, id) AS canonical, list_distinct(list(name)) AS names FROM m GROUP BY company_id)
SELECT company_id, canonical, list_sort(list_filter(names, lambda x: x <> canonical)) AS aliases FROM g""")
def alias_sets(spark, sf_dir):
    """All names of an entity but its canonical one, which is the first."""
    named = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("Name "), (F.col("o_orderkey") % 4).cast("string")).alias("name"), "o_orderkey")
    sets = named.groupBy("company_id").agg(F.min_by("name", "o_orderkey").alias("canonical"), F.collect_set("name").alias("_all"))
    return sets.select("company_id", "canonical", F.array_sort(F.array_remove("_all", F.col("canonical"))).alias("aliases"))
