"""Quality by importance resampling: two hashed n-gram models and Gumbel top-k.

A *target* model is counted over documents labelled as good, a *raw* model over
all documents. A document's log weight is the sum of log(p_target / p_raw) over
its hashed n-grams (words, runs of marks, and pairs of neighbours; a pair of
equal neighbours has one bucket of its own, so stutter counts as such). The
sample is the k largest of log weight + Gumbel noise, which is sampling without
replacement in proportion to the weights. k is a parameter, as a number or as a
share of all documents; by default it is the share of good ones among the
training labels.

Defined results: a null or empty text has log weight 0; a null id takes the
noise of id null; repeated rows get equal noise and are taken or left together,
so that more than k are taken where the last of them repeats;
an empty table gives an empty result; without any good label all weights are 0
and every row is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factframe.llm.common import bounded, free_name, label_sample, training_labels, unit_hash, written
from factframe.llm.hashing import Tokens, chunks, mix, pair

BUCKETS = 10_000
TARGET_ROWS = 20_000
#: Pseudo-counts for each bucket of the target model, at most as many as it has counts, spread as the raw model.
PRIOR = 50.0
_SCALE = float(1 << 20)


def ngram_buckets(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket) of every hashed n-gram; the last bucket is a repeated neighbour."""
    tokens = Tokens(texts, marks=True)
    single = (mix(tokens.hash) % np.uint64(buckets - 1)).astype(np.int64)
    same = tokens.doc[1:] == tokens.doc[:-1]
    double = (pair(tokens.hash[:-1], tokens.hash[1:]) % np.uint64(buckets - 1)).astype(np.int64)
    double = np.where(tokens.hash[1:] == tokens.hash[:-1], buckets - 1, double)[same]
    return np.concatenate([tokens.doc, tokens.doc[1:][same]]), np.concatenate([single, double])


@dataclass(frozen=True)
class Ratio:
    """log(p_target / p_raw) by bucket, and the share of good ones among the training labels."""

    log_ratio: np.ndarray
    share: float = 1.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> Ratio:
    """Count both models: raw over every document, target over a hash sample of at most about `target_rows` good ones."""
    known = training_labels(labels, label)
    share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    good = label_sample(known.where("label = 1"), target_rows).select("doc_id", F.lit(1).alias("_target"))
    marked = docs.select("doc_id", "text").join(bounded(good), "doc_id", "left").select("text", "_target")
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch, texts in chunks(batches):
            doc, bucket = ngram_buckets(texts, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            chosen = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            target += np.bincount(bucket[chosen[doc]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], schema=schema)

    counted = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counted.collect():  # `buckets` rows at most
        raw[bucket], target[bucket] = r, t
    if target.sum() == 0:
        return Ratio(np.zeros(buckets))
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    prior = min(PRIOR * buckets, target.sum()) * p_raw  # pulls sparse buckets towards no evidence
    return Ratio(np.log((target + prior) / (target.sum() + prior.sum())) - np.log(p_raw), share)


def with_log_weight(docs: DataFrame, ratio: Ratio, column: str = "log_weight") -> DataFrame:
    """Append the log importance weight of every row's whole text; all other columns pass through."""
    table = docs.sparkSession.sparkContext.broadcast(ratio.log_ratio)  # `buckets` doubles

    def score(batches):
        log_ratio = table.value
        for batch, texts in chunks(batches):
            doc, bucket = ngram_buckets(texts, len(log_ratio))
            weights = np.bincount(doc, weights=log_ratio[bucket], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=[*batch.schema.names, column])

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(score, schema)


def gumbel_key(weight: str = "log_weight", seed: int = 1) -> Column:
    """log weight + Gumbel noise, as an integer of 2**-20 steps, so that ranks are exact."""
    noise = -F.log(-F.log(unit_hash(F.lit(seed), F.col("doc_id"))))
    return F.round((F.col(weight) + noise) * _SCALE).cast("long")


def radix_threshold(keys: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest of a long column, and how many rows equal to it belong to the k.

    Four passes, each a histogram of 16 more bits (65,536 rows at most reach the
    driver): no sort, and no task that holds all rows.
    """
    lifted = keys.select((F.col(column).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))).alias("k")).where("k is not null")
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        here = lifted if shift == 48 else lifted.where(F.shiftrightunsigned("k", shift + 16) == F.lit(prefix))
        histogram = here.groupBy(F.shiftrightunsigned("k", shift).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("b")).count().collect()
        for bucket, n in sorted(map(tuple, histogram), reverse=True):
            if n >= left:
                prefix = (prefix << 16) | bucket
                break
            left -= n
    return prefix - (1 << 63), left


def selection(scored: DataFrame, ratio: Ratio, k: int | float | None = None, seed: int = 1, weight: str = "log_weight") -> Column:
    """A Boolean column expression over doc_id and the weight's column: is the row among the k (a number, or a share below 1) sampled?

    `scored` is read five or six times and should be a written table of (doc_id, log_weight).
    """
    keyed = scored.select("doc_id", gumbel_key(seed=seed).alias("_key"), F.xxhash64(F.lit(~seed), "doc_id").alias("_tie"))
    n = keyed.count()
    k = ratio.share if k is None else k
    k = (round(k * n) if isinstance(k, float) else min(n, k)) if ratio.log_ratio.any() else n
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    key, left = radix_threshold(keyed, "_key", k)
    equal = keyed.where(F.col("_key") == F.lit(key))
    tie = radix_threshold(equal, "_tie", left)[0] if equal.count() > left else -(1 << 63)
    mine = gumbel_key(weight, seed)
    return (mine > F.lit(key)) | ((mine == F.lit(key)) & (F.xxhash64(F.lit(~seed), "doc_id") >= F.lit(tie)))


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | float | None = None, seed: int = 1, **options) -> DataFrame:
    """One row per document: doc_id, log_weight and selected (among the k drawn)."""
    ratio = fit(docs, labels, **options)
    scored = written(with_log_weight(docs.select("doc_id", "text"), ratio).select("doc_id", "log_weight"), "resample")
    return scored.withColumn("selected", selection(scored, ratio, k, seed))


def keep_resampled(docs: DataFrame, labels: DataFrame, k: int | float | None = None, seed: int = 1, **options) -> DataFrame:
    """The drawn documents, with their own columns. Weights are computed again in the last pass, which is cheaper than a join of whole texts."""
    ratio = fit(docs, labels, **options)
    scored = written(with_log_weight(docs.select("doc_id", "text"), ratio).select("doc_id", "log_weight"), "resample")
    weight = free_name(docs, "log_weight")
    return with_log_weight(docs, ratio, weight).where(selection(scored, ratio, k, seed, weight)).select(*docs.columns)
