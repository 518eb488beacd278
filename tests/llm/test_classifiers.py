"""Toxicity, language identification and importance resampling."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factframe.llm import ecoc, hashing, kneser_ney, resample
from factframe.llm.common import fold
from factframe.llm.hashing import Tokens

ORDINARY = "river stone garden window morning paper bridge music letter market summer winter train coffee table mountain".split()
BAD = "grumpf zonkle blarg".split()


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = [rng.choice(ORDINARY) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        junk = i % 5 == 1
        if junk:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), int(toxic), int(not junk)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic", "quality")


def test_toxicity_held_out(toy):
    docs, labels = toy
    scored = kneser_ney.with_toxicity(docs, kneser_ney.fit(docs, labels)).join(labels, "doc_id").where(fold("doc_id") == 0)
    rows = scored.select("toxic_score", "toxic").collect()
    assert len(rows) > 40 and all((r.toxic_score >= 0.5) == (r.toxic == 1) for r in rows)


def test_toxicity_learns_from_all_rows_below_the_bound(toy, monkeypatch):
    """A rare class does not cut the other one down to its size."""
    docs, labels = toy
    learned, written = {}, kneser_ney.written

    def spy(df, name):
        out = written(df, name)
        learned[name] = out
        return out

    monkeypatch.setattr(kneser_ney, "written", spy)
    kneser_ney.fit(docs, labels)
    got = {r["label"]: r["count"] for r in learned["toxic-sample"].groupBy("label").count().collect()}
    assert got == {r.toxic: r["count"] for r in labels.where(fold("doc_id") != 0).groupBy("toxic").count().collect()}
    assert got[0] > 2 * got[1]


def test_toxicity_learns_from_a_bounded_number_of_characters(toy, monkeypatch):
    docs, labels = toy
    monkeypatch.setattr(kneser_ney, "CHARS_PER_CLASS", 20_000)
    small = kneser_ney.fit(docs, labels)
    monkeypatch.setattr(kneser_ney, "CHARS_PER_CLASS", 10**9)
    assert 0 < len(small.pairs) < len(kneser_ney.fit(docs, labels).pairs)
    scored = kneser_ney.with_toxicity(docs, small).join(labels, "doc_id").where(fold("doc_id") == 0).select("toxic_score", "toxic").collect()
    assert sum((r.toxic_score >= 0.5) == (r.toxic == 1) for r in scored) > 0.9 * len(scored)


def test_toxicity_never_learns_from_held_out_labels(toy):
    """Turning every label of fold 0 changes no score."""
    docs, labels = toy
    turned = labels.withColumn("toxic", F.when(fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda given: {r.doc_id: r.toxic_score for r in kneser_ney.with_toxicity(docs, kneser_ney.fit(docs, given)).collect()}
    assert score(labels) == score(turned) and labels.where(fold("doc_id") == 0).count() > 40


def test_kneser_ney_probabilities_equal_brute_force(spark, monkeypatch):
    """p(w | v) of both classes from plain counts over plain words; every distribution sums to one."""
    monkeypatch.setattr(kneser_ney, "unit_hash", lambda *a: F.lit(0.0))  # all rows are counted
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    texts = [[rng.choice(words[: 6 + 6 * (i % 2)]) for _ in range(rng.randint(1, 9))] for i in range(30)]
    rows = [(i, " ".join(t), i % 2) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = kneser_ney.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))

    pairs = [Counter(), Counter()]
    for _, text, toxic in rows:
        t = text.split()
        pairs[toxic].update(zip([None, *t], t))
    d = lambda counts: min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if (n1 := sum(c == 1 for c in counts)) + (n2 := sum(c == 2 for c in counts)) else 0.5
    every = {w for c in pairs for _, w in c}
    known = len(every)
    both = Counter(w for v, w in pairs[0] if (v, w) in pairs[1])
    d0, total = d(both.values()), sum(both.values())
    shared = lambda w: (max(both[w] - d0, 0) + d0 * len(both) / (known + 1)) / total

    def word(c, w):
        k = Counter(x for _, x in pairs[c])
        return (max(k[w] - d(k.values()), 0) + d(k.values()) * len(k) * shared(w)) / sum(k.values())

    def conditional(c, v, w, strength):
        after = {x: n for (u, x), n in pairs[c].items() if u == v}
        n, dd = sum(after.values()), d(pairs[c].values())
        return (max(after.get(w, 0) - dd, 0) + (strength + dd * len(after)) * word(c, w)) / (n + strength)

    assert abs(sum(word(1, w) for w in [*every, "?"]) - 1) < 1e-9
    assert abs(sum(conditional(0, "w1", w, 100.0) for w in [*every, "?"]) - 1) < 1e-9
    for text in ["w1 w2 w3", "w11 w0", "nowhere w1 seen", *(r[1] for r in rows[:6])]:
        got, t = model.log_p(Tokens([text]), 100.0), text.split()
        for i, (v, w) in enumerate(zip([None, *t], t)):
            for c in (0, 1):
                assert abs(np.exp(got[i, c]) - conditional(c, v, w, 100.0)) < 1e-6

    # the whole score: both signs of every word's difference, divided by the length
    model.curve, model.strength, model.rate = (-0.3, 90.0), 500.0, 0.02
    texts = ["w1 w2 w3", "w11 w0", "nowhere w1 seen", "", None, *(r[1] for r in rows)]
    signs = set()
    for text, score in zip(texts, model.scores(texts).tolist(), strict=True):
        t, summed = (text or "").split(), 0.0
        for v, w in zip([None, *t], t):
            ordinary, toxic = (conditional(c, v, w, 500.0) for c in (0, 1))
            part = math.log(0.98 * ordinary + 0.02 * toxic) - math.log(ordinary)
            signs.add(part > 0)
            summed += part
        assert score == pytest.approx(1 / (1 + math.exp(0.3 - 90.0 * summed / (len(t) + kneser_ney.LENGTH_PRIOR))), abs=1e-5)
    assert signs == {True, False}


def test_a_frequent_pair_counts_beside_its_words():
    """At the largest strength too: the same words with another pair get another score."""

    def model(pair_toxic):
        hashes = Tokens(["so long"]).hash
        key = np.array([hashing.pair(hashes[:1], hashes[1:])[0]], np.uint64).view(np.int64)
        word = hashes.view(np.int64)
        pairs = {"key": key, "n0": np.array([900]), "n1": np.array([pair_toxic])}
        words = {"word": word, "k0": np.array([40, 60]), "k1": np.array([40, 60]), "k": np.array([30, 50])}
        before = {"context": word[:1], "n0": np.array([60_000]), "n1": np.array([60_000]), "t0": np.array([500]), "t1": np.array([500])}
        found = kneser_ney.estimate(pairs, words, before)
        return found.evidence(["so long"], [(max(kneser_ney.STRENGTHS), 0.01)])[0, 0]

    assert model(30_000) > model(900) > model(2)
    assert model(30_000) - model(900) > 0.0002


def test_toxicity_of_conflicting_labels_and_repeated_rows(spark, toy):
    """The largest label of an id counts, whatever the order; null ids and labels count for nothing."""
    docs, labels = toy
    more = spark.createDataFrame([(3, 0, 1), (3, 1, 1), (None, 1, 1), (5, None, 1), (6, 7, 1)], "doc_id long, toxic int, quality int")
    rows = {r.doc_id: r.label for r in kneser_ney.training_labels(labels.unionByName(more), "toxic").collect()}
    assert rows.get(3, 1) == 1 and None not in rows and len(rows) == labels.where(fold("doc_id") != 0).count()
    scores = kneser_ney.with_toxicity(docs, kneser_ney.fit(docs, labels.unionByName(more))).collect()
    assert len(scores) == docs.count()


def test_toxicity_odd_rows(toy, odd_documents, no_documents):
    docs, labels = toy
    model = kneser_ney.fit(docs, labels)
    rows = kneser_ney.with_toxicity(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.toxic_score <= 1 for r in rows)
    assert all(r.toxic_score < 0.5 for r in rows if not r.text)
    assert kneser_ney.with_toxicity(no_documents, model).count() == 0
    nothing = kneser_ney.fit(no_documents, labels.limit(0))
    assert nothing.curve is None and kneser_ney.with_toxicity(odd_documents, nothing).count() == odd_documents.count()


def test_resampling_keeps_good_and_drops_junk(toy):
    docs, labels = toy
    got = resample.importance_resample(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 400
    # k is the share of good ones among the training labels: all but a few at the border are taken as they are labelled
    assert abs(sum(r.selected for r in got) - 0.8 * 400) < 12
    assert sum(r.selected != (r.quality == 1) for r in got) < 12
    kept = resample.keep_resampled(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.selected}


def test_resampling_draws_exactly_k(toy):
    docs, labels = toy
    for k in (0, 1, 37, 400, 1000):
        assert resample.importance_resample(docs, labels, k=k).where("selected").count() == min(k, 400)


def test_log_weights_equal_brute_force(toy):
    """Counts of hashed n-grams document by document, in plain Python."""
    docs, labels = toy
    texts, quality = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    raw, target, buckets = Counter(), Counter(), 500
    grams = {i: resample.ngram_buckets([t], buckets)[1].tolist() for i, t in texts.items()}
    for i, g in grams.items():
        raw.update(g)
        target.update(g if quality[i] == 1 and zlib.crc32(str(i).encode()) % 5 else [])
    p = {b: (raw[b] + 0.5) / (sum(raw.values()) + 0.5 * buckets) for b in range(buckets)}
    mass = min(resample.PRIOR * buckets, sum(target.values()))
    ratio = {b: np.log((target[b] + mass * p[b]) / (sum(target.values()) + mass * sum(p.values()))) - np.log(p[b]) for b in range(buckets)}
    got = resample.importance_resample(docs, labels, buckets=buckets).collect()
    assert all(abs(r.log_weight - sum(ratio[b] for b in grams[r.doc_id])) < 1e-6 for r in got)
    # the k drawn are those of the largest weight and noise
    share = sum(q == 1 for i, q in quality.items() if zlib.crc32(str(i).encode()) % 5) / sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in quality)
    assert sum(r.selected for r in got) == round(share * len(got))


def test_radix_threshold_against_sorting(spark):
    values = [5, -3, 5, 2**62, -(2**62), 0, 7, 7, 7, -1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        want = sorted(values, reverse=True)[k - 1]
        got, left = resample.radix_threshold(df, "v", k)
        assert got == want and left == k - sum(v > want for v in values)


def test_resampling_odd_rows(toy, odd_documents, no_documents):
    _, labels = toy
    assert resample.importance_resample(odd_documents, labels).count() == odd_documents.count()
    assert resample.keep_resampled(no_documents, labels).count() == 0


def test_codewords_differ():
    for n in (2, 3, 4, 6, 12):
        code = ecoc.codewords(n)
        assert min(np.sum(code[i] != code[j]) for i in range(n) for j in range(i)) >= 1


def test_languages(spark, sf_dir, odd_documents, no_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = ecoc.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = ecoc.identify(odd_documents, ecoc.fit(docs)).collect()
    assert len(odd) == odd_documents.count()
    assert {r.lang_pred for r in odd if r.doc_id in (2, 3, 5)} == {"und"}
    assert all(r.lang_pred == "und" for r in ecoc.identify(odd_documents, ecoc.fit(no_documents)).collect())
    assert ecoc.identify_languages(no_documents).count() == 0 and ecoc.identify_languages(odd_documents).count() == len(odd)


def test_language_margins_equal_brute_force():
    """n-grams of words with their edges and mean log odds, character by character; decoding as the least weighted loss."""
    rng = np.random.default_rng(4)
    slots = 64
    book = ecoc.codebook(["a", "b", "c"], rng.integers(0, 50, (3, slots)).astype(float))
    texts = ["ab, cde f", "x", "", "one  two-three", None, "é_1 ÀB"]
    got, letter = book.margins(texts)
    assert letter.tolist() == [True, True, False, True, False, True]
    for i, t in enumerate(texts):
        raw = b" " + bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in (t or "").lower().encode()) + b" "
        sums, n = np.zeros(len(book.odds)), 0
        for order in (2, 3, 4):
            for at in range(len(raw) - order + 1):
                gram = raw[at : at + order]
                inner = gram[1:-1] if order > 2 else (gram.replace(b" ", b"") or b" ")
                if 32 in inner or gram == b"  ":
                    continue
                value = (int.from_bytes(gram, "big") + order) * 0x9E3779B1 & 0xFFFFFFFF
                sums, n = sums + book.odds[:, value >> (32 - 6)], n + 1
        assert np.allclose(got[i], sums / max(n, 1))
    losses = book.losses(got)
    for i in range(len(texts)):
        for k in range(3):
            each = [np.log(1 + np.exp(-np.clip(m * s * c, -30, 30))) * w for m, s, c, w in zip(got[i], book.scale, book.code[k], book.weight)]
            assert abs(losses[i, k] - sum(each) / sum(book.weight)) < 1e-9


def test_fold_is_the_same_in_python(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), fold(F.col("id")).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in df.collect())
