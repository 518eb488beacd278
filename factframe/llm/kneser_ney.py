"""Toxicity by class-conditional Kneser-Ney models.

For each class c (toxic, ordinary) a bigram model interpolates
    p_c(w | v) = (max(n_c(v w) - D, 0) + (S + D t_c(v)) p_c(w)) / (n_c(v) + S)
    p_c(w)     = max(k_c(w) - D, 0) / K_c + lambda_c p(w)
    p(w)       = max(k(w) - D, 0) / K + lambda / (types + 1)
n counts occurrences and t_c(v) the different words after v; k_c(w), the
continuation count, counts the different words before w in texts of the class,
and k(w) those that both classes have met, so an expression that is rare, or
known to one class only, leans on the same backoff in either class. Every
level's discount D is n1 / (n1 + 2 n2) of its own counts of counts, lambda is
the mass that discounting sets free, and nothing is cut off. The strength S
(the Pitman-Yor form of the model) makes rare contexts lean on continuation
counts.

Texts are compared by length-normalised log-likelihoods. A toxic text is mostly
ordinary words, so under the toxic hypothesis each word comes of the toxic model
at a rate r and else of the ordinary one,
    log p_toxic(text) = sum log((1 - r) p_ordinary(w | v) + r p_toxic(w | v)),
and the evidence is log p_toxic(text) - log p_ordinary(text), every word with its
sign, divided by the number of words. A logistic curve that rises with this one
number gives the score. S, r and the curve are those that explain the training
rows best that the counts left out; S is at most 100,000, so that frequent pairs
count beside their words.

Defined results: a null or empty text scores as the curve does at zero evidence;
if either class has no training row every score is the share of label 1 among
the training rows; repeated rows count each time; of differing labels of one
doc_id the largest counts; labels other than 0 and 1 and null ids are left out.
About PER_CLASS labelled rows and CHARS_PER_CLASS characters of each class are
learned from, whatever the number and length of the documents; every document is
scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factframe.llm.common import bounded, label_sample, training_labels, unit_hash, written
from factframe.llm.hashing import Tokens, chunks, pair

#: Documented bound: about so many labelled documents of each class are learned from.
PER_CLASS = 4_000
#: And of these about so many characters of each class: pairs that reach the driver are bounded whatever the documents' length.
CHARS_PER_CLASS = 60_000_000
#: Strengths and rates of toxic words tried.
STRENGTHS = (1e3, 1e4, 1e5)
RATES = (1e-3, 1e-2, 3e-2)
#: Words added to a text's length, so that a few words are no certain evidence.
LENGTH_PRIOR = 20


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row of each wanted key in the sorted keys; len(keys) if absent."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def contexts(tokens: Tokens) -> np.ndarray:
    """The hash of the word before each; 0 begins a text."""
    previous = np.zeros(len(tokens.hash), np.uint64)
    same = tokens.doc[1:] == tokens.doc[:-1]
    previous[1:][same] = tokens.hash[:-1][same]
    return previous


def discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) of counts of counts, kept off 0 and 1."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


@dataclass
class Model:
    """Sorted tables by hash, a column for either class; an absent key has the last row. Sizes are bounded by the sample."""

    words: np.ndarray
    word_p: np.ndarray  # (words + 1, 2)
    pairs: np.ndarray
    pair_n: np.ndarray  # (pairs + 1, 2) discounted counts
    contexts: np.ndarray
    context_n: np.ndarray  # (contexts + 1, 2)
    context_free: np.ndarray  # (contexts + 1, 2) what discounting sets free
    share: float = 0.0
    curve: tuple[float, float] | None = None  # intercept and slope
    strength: float = STRENGTHS[-1]
    rate: float = RATES[0]

    def log_p(self, tokens: Tokens, strength: float) -> np.ndarray:
        """(tokens, 2): log p_c(w | v) for the ordinary and the toxic class."""
        previous = contexts(tokens)
        context = _lookup(self.contexts, previous)
        p = self.word_p[_lookup(self.words, tokens.hash)]
        n = self.pair_n[_lookup(self.pairs, pair(previous, tokens.hash))]
        return np.log((n + (strength + self.context_free[context]) * p) / (self.context_n[context] + strength))

    def evidence(self, texts: list[str | None], choices: list[tuple[float, float]] | None = None) -> np.ndarray:
        """(texts, choices) for each (strength, rate): the length-normalised difference of the two log-likelihoods."""
        tokens, columns, ratios = Tokens(texts), [], {}
        length = np.diff(tokens.per_doc()) + LENGTH_PRIOR
        for strength, rate in choices or [(self.strength, self.rate)]:
            if strength not in ratios:
                both = self.log_p(tokens, strength)
                ratios[strength] = np.exp(both[:, 1] - both[:, 0])
            difference = np.log1p(rate * (ratios[strength] - 1))
            columns.append(np.bincount(tokens.doc, weights=difference, minlength=len(texts)) / length)
        return np.stack(columns, axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        z = self.curve[0] + self.curve[1] * self.evidence(texts)[:, 0]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def bigram_counts(sample: DataFrame) -> DataFrame:
    """key (of the pair), context, word, n0, n1: how often two neighbours occur in texts of either class; (text, label) rows are summed within chunks first."""
    names = ["key", "context", "word", "n0", "n1"]

    def count(batches):
        for batch, texts in chunks(batches):
            tokens = Tokens(texts)
            if not len(tokens.hash):
                continue
            previous, toxic = contexts(tokens), (batch.column(1).to_numpy(zero_copy_only=False) == 1)[tokens.doc]
            keys, first, inverse = np.unique(pair(previous, tokens.hash), return_index=True, return_inverse=True)
            sums = [np.bincount(inverse, weights=w, minlength=len(first)).astype(np.int64) for w in (~toxic, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, previous[first], tokens.hash[first])] + [pa.array(x) for x in sums], names=names)

    counted = sample.select("text", "label").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return counted.groupBy("key", "context", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _arrow(df: DataFrame) -> dict[str, np.ndarray]:
    return {n: c.to_numpy() for n, c in zip(df.columns, df.toArrow().columns, strict=True)}


def estimate(pairs: dict[str, np.ndarray], words: dict[str, np.ndarray], before: dict[str, np.ndarray], share: float = 0.0) -> Model:
    """The model of the docstring.

    pairs: key, n0, n1. words: word, k0, k1 (continuations by class),
    k (those of both). before: context, n0, n1, t0, t1 (occurrences and types).
    """
    both = lambda t, a: np.column_stack([t[a + "0"], t[a + "1"]]).astype(float)
    row = lambda x: np.vstack([x, np.zeros((1, 2))])
    k, shared = both(words, "k"), words["k"].astype(float)
    total, d = shared.sum(), discount(words["k"])
    free = d * np.count_nonzero(shared) / total if total else 1.0
    backoff = np.append(np.maximum(shared - d, 0) / max(total, 1.0), 0.0) + free / (len(shared) + 1)
    each = np.array([discount(k[:, c]) for c in (0, 1)])
    sums = np.maximum(k.sum(0), 1.0)
    p = np.maximum(row(k) - each, 0) / sums + np.where(k.sum(0) > 0, each * np.count_nonzero(k, axis=0) / sums, 1.0) * backoff[:, None]
    of_pairs, key = np.array([discount(pairs[c]) for c in ("n0", "n1")]), pairs["key"].view(np.uint64)
    by_key, by_word, by_context = np.argsort(key), np.argsort(words["word"].view(np.uint64)), np.argsort(before["context"].view(np.uint64))
    n = np.zeros((len(key) + 1, 2), np.float32)
    for c in (0, 1):
        n[:-1, c] = np.maximum(pairs[f"n{c}"][by_key] - of_pairs[c], 0)
    return Model(
        words["word"].view(np.uint64)[by_word],
        p[np.append(by_word, len(by_word))],
        key[by_key],
        n,
        before["context"].view(np.uint64)[by_context],
        row(both(before, "n")[by_context]),
        row(both(before, "t")[by_context] * of_pairs),
        share,
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Count over the sampled training rows in Spark; the driver gets the tables, whose size the sample bounds."""
    rows = training_labels(labels, label).where("label in (0, 1)")
    sizes = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    sample = docs.select("doc_id", "text").join(bounded(label_sample(rows, per_class)), "doc_id")
    sample = written(sample.select("text", F.col("label").cast("int").alias("label"), (unit_hash(F.lit("part"), F.col("doc_id")) < 0.85).alias("counted")), "toxic-sample")
    # long texts: each class keeps a share of its rows by a hash of their text
    held = {r["label"]: r["chars"] or 0 for r in sample.groupBy("label").agg(F.sum(F.length("text")).alias("chars")).collect()}
    for value, chars in held.items():
        if chars > CHARS_PER_CLASS:
            sample = sample.where((F.col("label") != value) | (unit_hash(F.lit("chars"), F.col("text")) < CHARS_PER_CLASS / chars))
    pairs = written(bigram_counts(sample.where("counted")), "toxic-counts")
    words = pairs.groupBy("word").agg(F.count_if(F.expr("n0 > 0")).alias("k0"), F.count_if(F.expr("n1 > 0")).alias("k1"), F.count_if(F.expr("n0 > 0 and n1 > 0")).alias("k"))
    before = pairs.groupBy("context").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.expr("n0 > 0")).alias("t0"), F.count_if(F.expr("n1 > 0")).alias("t1"))
    narrow = pairs.select("key", F.col("n0").cast("int").alias("n0"), F.col("n1").cast("int").alias("n1"))  # most of what reaches the driver
    model = estimate(_arrow(narrow), _arrow(words), _arrow(before), share)
    if not (sizes.get(0) and sizes.get(1)):
        return model

    shared_model, choices = docs.sparkSession.sparkContext.broadcast(model), list(product(STRENGTHS, RATES))
    names = ["label", *(f"f{i}" for i in range(len(choices)))]

    def measure(batches):
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, shared_model.value.evidence(texts, choices).T)], names=names)

    rest = sample.where("not counted").select("text", "label").mapInArrow(measure, "label int" + "".join(f", {n} double" for n in names[1:])).toPandas()
    shared_model.unpersist()
    y = rest["label"].to_numpy()
    if len(set(y)) < 2:
        return model
    # classes are drawn apart: their rows weigh as the classes do among all training rows
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    least = np.inf
    for (strength, rate), name in zip(choices, names[1:], strict=True):
        x = rest[name].to_numpy()
        curve = logistic(x[:, None], y, weight)
        z = np.clip(curve[0] + curve[1] * x, -60, 60)
        loss = float((weight * np.log1p(np.exp(np.where(y == 1, -z, z)))).sum())
        if curve[1] > 0 and loss < least:
            least, model.curve, model.strength, model.rate = loss, (float(curve[0]), float(curve[1])), strength, rate
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on standardised columns; returns intercept and slopes of the plain ones."""
    middle, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * w * len(y) / 100
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * (ridge * len(y) / 100 + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.concatenate([[w[0] - slopes @ middle], slopes])


def with_toxicity(docs: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """Append the score of every row's whole text; all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts), pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
