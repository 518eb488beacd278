"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factframe.llm import alignment, chat, decontaminate, ecoc, kneser_ney, mixing, order_minhash, packing, periodic, resample, tokenids, warc, webp
from factframe.llm.common import bounded, fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer() -> str:
    """The path of the tokenizer that op9 and op10 count with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of each page, and its place in the merged index."""
    pages = _read(spark, sf_dir, "pages")
    # the table has no capture time: one second after another, by id
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))), "yyyyMMddHHmmss")
    rows = warc.archive(pages.select("page_id", "url", stamp.alias("timestamp"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")))
    # one row for each range of the index
    ranges = rows.groupBy("range").agg(F.count("*").alias("_n"))
    before = ranges.select("range", (F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).alias("_before"))
    placed = rows.join(bounded(before), "range").withColumn("place", F.col("_before") + F.col("position"))
    return placed.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "place")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs, _read(spark, sf_dir, "labels"))
    scored = kneser_ney.with_toxicity(docs, model)
    score = F.col("toxic_score")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc.identify_languages(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op4_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_features(webp.store(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chat(chat.canonical_turns(rows))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode_corpus(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, a tenth of which are first made to repeat from some word on."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    # one part of the texts by a regular expression, the others as they are
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).alias("w"))
    at = words.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    at = at.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    made = at.select("doc_id", F.expr(f"if(n > 0, array_join(concat(slice(w, 1, a), {tail}), ' '), text)").alias("text"))
    found = periodic.periodic_runs(made)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.array_join(lines, "").alias("lines"), "collapsed")
    return digest.select(
        "doc_id",
        "n_runs",
        (-F.col("m.s")).alias("start"),
        F.col("m.l").alias("length"),
        (-F.col("m.p")).alias("period"),
        F.floor(1000 * F.col("m.l") / -F.col("m.p")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.Alignment(docs, tokenizer(), public_tokenizers.path("piece_bpe_32k.model")).documents()


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_order_minhash": op2_order_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_lossless_webp": op4_lossless_webp,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_decontamination": op8_decontamination,
    "op9_token_ids": op9_token_ids,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_source_mixing": op13_source_mixing,
}

_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|<?/?SYS>>|/?INST\])', '\1\2\\\3', 'g')"""

# base32 of a digest in hex: five hex digits are four letters
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '')"

# crc32 of the decimal digits of an id: a byte is taken in, eight steps follow
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(coalesce(url, '')) AS url, sha1(coalesce(html, '')) AS h, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM pages),
k AS (SELECT *, regexp_extract(url, '^[a-z]+://(?:www\.)?([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query, max(page_id) OVER (PARTITION BY h) AS largest FROM p),
u AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query AS url_key FROM k)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to,
  url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS place FROM u""",
    "op5_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op8_decontamination": r"""
WITH w AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ') AS h FROM documents),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(h) - 3), lambda i: array_to_string(h[i:i+4], ' '))) AS s FROM w WHERE len(h) >= 5),
v AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ') AS h FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(h) - 3), lambda i: array_to_string(h[i:i+4], ' '))) AS s FROM v WHERE len(h) >= 5),
n AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(size) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(size) >= 0.8""",
    "op11_periodic_runs": rf"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC32} AS h FROM documents),
c AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM c),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS m,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM x
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, m.l AS length, m.p AS period, 1000 * m.l // m.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
