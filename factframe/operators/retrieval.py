"""Lexical passage retrieval: windows, scoring, boosts, overlap-free top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factframe.functions.text import keywords, numbers, tokens
from factframe.operators.storage import bounded, written

WINDOW, STRIDE = 900, 450


#: What stands between paragraphs.
BREAK = r"\n\s*\n"


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, passage: paragraphs, sliced every STRIDE characters if longer than WINDOW; blank ones are left out.

    Starts come from the running length of the paragraphs and of what stands
    between them, so a passage can be found again in the original text.
    """
    parts, between = F.split(F.col(text), BREAK), F.regexp_extract_all(text, F.lit(BREAK), F.lit(0))
    sizes = F.zip_with(parts, between, lambda p, b: F.length(p) + F.coalesce(F.length(b), F.lit(0)))
    before = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    paragraphs = docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(parts).alias("_i", "_p"), before.alias("_b")).select("doc_id", F.get("_b", F.col("_i")).alias("_start"), "_p").where(F.col("_p") != "")
    cuts = F.when(F.length("_p") <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("_p") - 1, F.lit(STRIDE)))
    # slices are cut before they are exploded: a long paragraph is not copied once for each
    slices = F.transform(cuts, lambda c: F.struct(c.alias("cut"), F.substring(F.col("_p"), c + 1, F.lit(WINDOW)).alias("text")))
    sliced = paragraphs.select("doc_id", "_start", F.explode(slices).alias("_s"))
    return sliced.select("doc_id", (F.col("_start") + F.col("_s.cut")).cast("long").alias("start"), F.col("_s.text").alias("passage")).where(F.col("passage").rlike(r"\S"))


def question_terms(questions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, weight: words count 1, numbers 2."""
    words = questions.select(key, F.explode(keywords(F.col(text))).alias("term"), F.lit(1).alias("weight"))
    return words.unionByName(questions.select(key, F.explode(numbers(F.col(text))).alias("term"), F.lit(2).alias("weight")))


#: Fiscal periods as text states them, blanks and case aside.
PERIOD = r"(?:q[1-4])?fy\d{4}"


def named_periods(passages: DataFrame) -> DataFrame:
    """doc_id, start, periods: the fiscal periods that passages name, for those that name any."""
    named = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("passage", r"\s+", "")), F.lit(PERIOD), F.lit(0)))
    return passages.where(F.col("passage").rlike("(?i)f\\s*y")).select("doc_id", "start", named.alias("periods")).where(F.size("periods") > 0)


def candidates(passages: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Passages with at least two word hits or a number hit for a question, with their score.

    An inverted join on terms: a passage is split into tokens once, and only
    tokens that some question asks for are kept. Where passages come of
    documents dealt by doc_id, hits are summed without another shuffle.
    """
    found = passages.select("doc_id", "start", F.explode(F.array_distinct(tokens(F.col("passage")))).alias("term"))
    hits = found.join(terms, "term").groupBy(key, "doc_id", "start").agg(F.count_if(F.col("weight") == 1).alias("n_words"), F.count_if(F.col("weight") == 2).alias("n_numbers"))
    return hits.where("n_words >= 2 or n_numbers >= 1").withColumn("score", F.col("n_words") + 2 * F.col("n_numbers"))


def overlap_free(ranked: DataFrame, key: str, k: int, per_document: int | None = None, order: str = "score", limits: DataFrame | None = None) -> DataFrame:
    """The first k passages of each question by (order desc, doc_id, start) that don't overlap a chosen one of the same document.

    limits (key, top_k) has a question's own number, k at most.

    Only a document's own slices overlap, so each (question, document) is first
    thinned by itself, a fold over its ranked slices; then the k best of a
    question are taken. A document contributes at most k, whatever its length.
    """
    most = per_document or k
    rank = F.struct((-F.col(order)).cast("long").alias("r"), F.col("start").cast("long").alias("s"))
    mine = ranked.groupBy(key, "doc_id").agg(F.array_sort(F.collect_list(rank)).alias("_all"))
    free = lambda acc, x: (F.size(acc) < most) & F.forall(acc, lambda c: F.abs(c["s"] - x["s"]) >= WINDOW)
    chosen = F.aggregate("_all", F.array().cast("array<struct<r:bigint,s:bigint>>"), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    thinned = mine.select(key, "doc_id", F.explode(chosen).alias("_c"))
    # the row number's limit holds within each map task too, so k rows of a question leave it
    placed = thinned.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_c.r", "doc_id", "_c.s"))).where(F.col("place") <= k)
    if limits is not None:
        placed = placed.join(limits.select(key, "top_k"), key).where("place <= top_k")
    return placed.select(key, "place", "doc_id", F.col("_c.s").alias("start"), (-F.col("_c.r")).alias(order))


# Intents in order of precedence with their cues; the kinds of document that each prefers, with their boosts.
INTENTS = {
    "governance": ("board", "director", "auditor", "remuneration", "appointment", "resignation", "independent director", "committee"),
    "capital_action": ("dividend", "buyback", "acquisition", "acquire", "merger", "fundraise", "rights issue", "qip", "preferential allotment"),
    "esg": ("esg", "brsr", "emission", "sustainability", "carbon", "diversity", "csr"),
    "ownership": ("shareholding", "promoter", "pledge", "fii", "dii", "institutional holding", "stake"),
    "risk": ("risk factor", "risk", "exposure", "litigation", "contingent liability", "regulatory action"),
    "guidance": ("guidance", "outlook", "target", "forecast", "aspiration"),
    "narrative": ("management said", "management's view", "management view", "what did management", "commentary", "management commentary", "strategy", "said about", "view on", "management believes"),
    "financial_metric": ("revenue", "margin", "profit", "eps", "ebitda", "turnover", "net income", "growth rate", "debt", "earnings per share"),
}
PREFERRED = {
    "financial_metric": {"financial_results": 60, "annual_report": 40, "investor_presentation": 20},
    "guidance": {"earnings_transcript": 60, "investor_presentation": 45, "annual_report": 20},
    "risk": {"annual_report": 60, "brsr": 25, "regulatory_filing": 20},
    "governance": {"agm_notice": 55, "board_outcome": 50, "corporate_governance_report": 50, "annual_report": 25},
    "capital_action": {"board_outcome": 55, "dividend": 50, "buyback": 50, "acquisition": 50},
    "esg": {"brsr": 70, "annual_report": 30},
    "ownership": {"shareholding_pattern": 70, "annual_report": 20},
    "narrative": {"earnings_transcript": 55, "annual_report": 35, "investor_presentation": 25},
}
BROADEN = ("all", "every", "list", "various", "multiple")
QUARTER, YEAR = r"\bQ([1-4])\s?-?\s?FY\s?(\d{2,4})\b", r"\bFY\s?(\d{2,4})\b"
RULES = ("intent_keyword_match", "intent_fallback", "doc_type_boost_from_intent", "period_extraction", "top_k_broaden_list_query", "top_k_narrow_specific_metric", "top_k_default")


def plans(questions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, intent, periods, top_k and rules: how each question is to be searched, by rules in order, and which of them fired."""
    q = F.col(text)
    intent = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.lower(q).contains(c)), F.lit(name)) for name, cues in INTENTS.items()], F.lit("general"))
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    capital = F.upper(q)
    quarters = F.zip_with(F.regexp_extract_all(capital, F.lit(QUARTER), F.lit(1)), F.regexp_extract_all(capital, F.lit(QUARTER), F.lit(2)), lambda n, y: F.concat(F.lit("Q"), n, F.lit("FY"), year(y)))
    years = F.transform(F.regexp_extract_all(F.regexp_replace(capital, QUARTER, " "), F.lit(YEAR), F.lit(1)), lambda y: F.concat(F.lit("FY"), year(y)))
    planned = questions.select(key, q.alias("_q"), intent.alias("intent"), F.array_distinct(F.concat(quarters, years)).alias("periods"))
    broad = F.arrays_overlap(F.split(F.lower("_q"), r"\s+"), F.array(*[F.lit(w) for w in BROADEN]))
    narrow = (F.col("intent") == "financial_metric") & (F.size(numbers(F.col("_q"))) > 0) & (F.size(keywords(F.col("_q"))) <= 3)
    general = F.col("intent") == "general"
    rules = F.filter(
        F.array(
            F.when(general, "intent_fallback").otherwise("intent_keyword_match"),
            F.when(~general, "doc_type_boost_from_intent"),
            F.when(F.size("periods") > 0, "period_extraction"),
            F.when(broad, "top_k_broaden_list_query").when(narrow, "top_k_narrow_specific_metric").otherwise("top_k_default"),
        ),
        lambda r: r.isNotNull(),
    )
    return planned.select(key, "intent", "periods", F.when(broad, 10).when(narrow, 3).otherwise(5).alias("top_k"), rules.alias("rules"))


# What each term of a total adds; a preference for recent documents reaches a question's first RECENT, beyond which it adds nothing.
RECENT, RECENT_BOOST, RECENT_STEP = 10, 30, 3
WINDOW_BOOST, PERIOD_BOOST, NUMERIC_BOOST = 25, 40, 20


def recency(found: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """key, doc_id, recency: the place, from 0, of a question's newest documents, undated ones last, by doc_id where dates are equal.

    Only the first RECENT of a question are kept; the window's limit holds
    within map tasks, so no more than that leaves one.
    """
    mine = found.select(key, "doc_id").distinct().join(docs.select("doc_id", "date"), "doc_id")
    order = Window.partitionBy(key).orderBy(F.col("date").desc_nulls_last(), "doc_id")
    placed = mine.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= RECENT)
    return placed.select(key, "doc_id", (F.col("_r") - 1).alias("recency"))


def boosted(found: DataFrame, plan: DataFrame, docs: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """Each term of a candidate's total: score * 100, kind of document, date window, period named, recency and number.

    docs: doc_id, kind, and date where a plan asks for it. periods: of
    named_periods(). plan: key, intent, periods, and optionally prefer_recent,
    prefer_numeric (booleans), window_start and window_end (dates, open where null).
    """
    weights = F.lit(0)
    for name, kinds in PREFERRED.items():
        weights = F.when(F.col("intent") == name, F.coalesce(F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("kind")], F.lit(0))).otherwise(weights)
    wishes = [c for c in ("prefer_recent", "prefer_numeric", "window_start", "window_end") if c in plan.columns]
    wanted = F.transform("_wanted", F.lower)
    both = found.join(plan.select(key, "intent", F.col("periods").alias("_wanted"), *wishes), key).join(docs, "doc_id").join(periods, ["doc_id", "start"], "left")
    out = both.withColumn("doc_type", weights).withColumn("period", F.when(F.exists(wanted, lambda w: F.exists("periods", lambda p: p.contains(w))), PERIOD_BOOST).otherwise(0)).drop("periods")
    ends = [c for c in ("window_start", "window_end") if c in wishes]
    inside = F.col("date").isNotNull() if ends else F.lit(False)
    if ends:
        inside = inside & F.coalesce(*ends).isNotNull()
        for c in ends:
            inside = inside & (F.col(c).isNull() | ((F.col("date") >= F.col(c)) if c == "window_start" else (F.col("date") <= F.col(c))))
    out = out.withColumn("window", F.when(inside, WINDOW_BOOST).otherwise(0))
    numeric = F.col("prefer_numeric") & (F.col("n_numbers") > 0) if "prefer_numeric" in wishes else F.lit(False)
    out = out.withColumn("numeric", F.when(numeric, NUMERIC_BOOST).otherwise(0))
    if "prefer_recent" in wishes:
        asking = plan.where("prefer_recent").select(key)
        newest = recency(found.join(asking, key, "left_semi"), docs, key).withColumnRenamed("recency", "_place")
        out = out.join(newest, [key, "doc_id"], "left").withColumn("recency", F.coalesce(RECENT_BOOST - RECENT_STEP * F.col("_place"), F.lit(0))).drop("_place")
    else:
        out = out.withColumn("recency", F.lit(0))
    total = F.col("score") * 100 + F.col("doc_type") + F.col("window") + F.col("period") + F.col("recency") + F.col("numeric")
    return out.withColumn("total", total).drop("_wanted", "intent", *wishes)


#: One document in so many is scored in full to bound what a question's k-th passage reaches.
PROBED = 8


def bounded_candidates(passages: DataFrame, terms: DataFrame, key: str, k: int) -> DataFrame:
    """The candidates that can be among a question's first k, and maybe some more, with their scores.

    Each term has an upper bound, its weight. The rarest half of a question's
    terms picks k documents, and one document in PROBED is scored too; the k-th
    largest of their best passages' scores is one that the k-th passage chosen
    reaches, because each document's best passage is always chosen. The commonest terms
    whose weights together stay below it can't carry a passage there alone: only
    passages with one of the other, essential, terms are built, of these only
    those that could reach the bound with all the common terms, and only they are
    scored in full. Ties at the bound are kept.
    """
    vocabulary = bounded(terms.select("term").distinct())
    kept = F.array_distinct(tokens(F.col("passage")))
    asked = written(passages.select("doc_id", "start", F.explode(kept).alias("term")).join(vocabulary, "term"), "postings")
    often = asked.groupBy("term").agg(F.count("*").alias("_n"))
    # terms of a question by rarity; a question's terms are few
    rare = Window.partitionBy(key).orderBy(F.coalesce("_n", F.lit(0)), "term", "weight")
    ordered = terms.join(bounded(often), "term", "left")
    ordered = ordered.withColumn("_i", F.row_number().over(rare)).withColumn("_of", F.count("*").over(Window.partitionBy(key)))
    ordered = written(ordered.withColumn("_rest", F.sum("weight").over(rare.rowsBetween(0, Window.unboundedFollowing))).drop("_n"), "terms")
    first = asked.join(bounded(ordered.where("2 * _i <= _of + 1").select("term", key, "weight")), "term")
    best = first.groupBy(key, "doc_id", "start").agg(F.sum("weight").alias("_s")).groupBy(key, "doc_id").agg(F.max("_s").alias("_s"))
    placed = best.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s")))).where(F.col("_p") <= k)
    # full scores of these and of one document in PROBED: what the k-th passage chosen reaches at least
    few = written(placed, "first").select(key, "doc_id").join(asked, "doc_id").join(terms, [key, "term"])
    probed = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(PROBED)) == 0).join(bounded(terms), "term")
    sums = few.select(key, "doc_id", "start", "term", "weight").unionByName(probed.select(key, "doc_id", "start", "term", "weight"))
    best = sums.distinct().groupBy(key, "doc_id", "start").agg(F.sum("weight").alias("_s")).groupBy(key, "doc_id").agg(F.max("_s").alias("_s"))
    ranked = best.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s")))).where(F.col("_p") <= k)
    reach = ranked.where(F.col("_p") == k).select(key, F.col("_s").alias("_reach"))
    # essential: this term and all commoner ones together could reach the bound
    split = written(ordered.join(reach, key, "left").withColumn("_reach", F.coalesce("_reach", F.lit(0))).withColumn("_essential", F.col("_rest") >= F.col("_reach")), "essential")
    common = split.groupBy(key).agg(F.sum(F.when(~F.col("_essential"), F.col("weight")).otherwise(0)).alias("_common"), F.max("_reach").alias("_reach"))
    some = asked.join(bounded(split.where("_essential").select("term", key, "weight")), "term").groupBy(key, "doc_id", "start").agg(F.count_if(F.col("weight") == 1).alias("_w"), F.count_if(F.col("weight") == 2).alias("_d"))
    able = some.join(bounded(common), key).where("_w + 2 * _d + _common >= _reach").select(key, "doc_id", "start", "_w", "_d", "_common")
    whole = written(able, "able")
    # what the common terms add, for those left
    more = whole.where("_common > 0").join(split.where("not _essential").select(key, "term", "weight"), key).join(asked, ["doc_id", "start", "term"], "left_semi")
    added = more.groupBy(key, "doc_id", "start").agg(F.count_if(F.col("weight") == 1).alias("_mw"), F.count_if(F.col("weight") == 2).alias("_md"))
    full = whole.join(added, [key, "doc_id", "start"], "left").select(key, "doc_id", "start", (F.col("_w") + F.coalesce("_mw", F.lit(0))).alias("n_words"), (F.col("_d") + F.coalesce("_md", F.lit(0))).alias("n_numbers"))
    scored = full.where("n_words >= 2 or n_numbers >= 1").withColumn("score", F.col("n_words") + 2 * F.col("n_numbers"))
    return scored.join(bounded(common.select(key, "_reach")), key).where("score >= _reach").drop("_reach")
