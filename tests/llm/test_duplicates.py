"""Order MinHash against brute force, and its parts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factframe.llm import order_minhash as O
from factframe.llm.hashing import Tokens, shingles


def slow_lcs(x, y, band):
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(len(x)):
        for j in range(len(y)):
            same = x[i] == y[j] and abs(i - j) <= band
            table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + 1 if same else 0)
    return table[-1, -1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_lcs_with_a_wide_band(x, y):
    assert O.banded_lcs(np.array(x, np.uint64), np.array(y, np.uint64), 20) == slow_lcs(x, y, 20)


def test_lcs_band_limits_matches():
    x, y = np.arange(10, dtype=np.uint64), np.roll(np.arange(10, dtype=np.uint64), 5)
    assert O.banded_lcs(x, y, 10) == 5 and O.banded_lcs(x, y, 2) == 0


def test_tokens_match_plain_splitting():
    import re

    texts = ["Hello, the World", "", None, "étion le-la  x", "a" * 10]
    tokens = Tokens(texts)
    assert np.diff(tokens.per_doc()).tolist() == [len(re.findall(r"\w+", (t or "").lower())) for t in texts]
    again = Tokens(["the hello"])
    assert again.hash[0] == tokens.hash[1] and again.hash[1] == tokens.hash[0]
    assert len(shingles(tokens.hash[:3], 5)) == 1


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, texts = [], []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: len(base) // 2] + [rng.choice(vocabulary) for _ in range(len(base) // 2)]))
    texts += texts[:3]
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def brute(rows):
    hashes = {i: Tokens([t]).hash for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in rows:
        for j, y in rows[:i]:
            if x == y or O.similar(hashes[i], hashes[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def test_classes_equal_brute_force(copies):
    df, rows = copies
    got = {r.doc_id: r.class_id for r in O.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(rows)


def plain_words(text):
    return re.findall(r"\w+", text.lower())


def plain_alignment(x, y):
    """The longest common subsequence of words is at least 0.8 of both texts; words in common bound it."""
    x, y = plain_words(x), plain_words(y)
    least = 0.8 * (len(x) + len(y)) - 1e-9
    return bool(x and y) and 2 * (Counter(x) & Counter(y)).total() >= least and 2 * quick_lcs(x, y) >= least


def quick_lcs(x, y):
    """A row of the table at a time."""
    row = np.zeros(len(y) + 1, int)
    codes = {w: i for i, w in enumerate({*x, *y})}
    other = np.array([codes[w] for w in y])
    for w in x:
        best = np.maximum(row[1:], np.where(other == codes[w], row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(best)
    return int(row[-1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_quick_lcs(x, y):
    assert quick_lcs(x, y) == slow_lcs(x, y, 20)


def plain_classes(texts, links):
    """Class of each text, the least number of its class, by `links` of all pairs."""
    label = np.arange(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and links(texts[i], texts[j]):
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label


def test_a_large_bucket_of_near_copies(spark, monkeypatch):
    """4,000 texts that differ from one origin in 3 to 24 words of 60: buckets of many classes, dealt into many blocks."""
    monkeypatch.setattr(O, "BLOCK_WORDS", 15_000)
    rng = random.Random(11)
    texts = np.tile(np.arange(60), (4000, 1))
    for row in texts:
        row[rng.sample(range(60), rng.randint(3, 24))] = [1000 + rng.randrange(2000) for _ in range(1)]
    df = spark.createDataFrame([(i, " ".join(f"o{w}" for w in row)) for i, row in enumerate(texts.tolist())], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in O.near_duplicates(df).collect()}
    label = np.array([got[i] for i in range(len(texts))])
    linked = joined = 0
    for i in range(0, len(texts), 7):
        close = np.flatnonzero((texts == texts[i]).sum(1) >= 48)
        linked, joined = linked + len(close) - 1, joined + int((label[close] == label[i]).sum()) - 1
    assert linked > 5_000 and joined >= 0.97 * linked
    # no class holds a text that shares too few words with all others of it
    words = [Counter(row) for row in texts.tolist()]
    for c in np.unique(label):
        members = np.flatnonzero(label == c)
        for i in members[:: max(1, len(members) // 40)] if len(members) > 1 else []:
            assert max((words[i] & words[j]).total() for j in members if j != i) >= 48
    assert np.bincount(label).max() > 500 and (np.bincount(label) > 0).sum() > 100


def test_moved_and_cut_texts_equal_brute_force(spark, monkeypatch):
    """Classes by alignment, from plain code; many pairs share words and shingles but not their order."""
    monkeypatch.setattr(O, "BLOCK_WORDS", 1_000)
    rng, texts = random.Random(12), []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(10):
            copy = list(base)
            kind = rng.randrange(4)
            if kind == 0:  # the two halves change places, or a third moves to the end
                cut = rng.choice([30, 20])
                copy = copy[cut:] + copy[:cut]
            elif kind == 1:
                copy = copy[rng.randint(0, 8) : 60 - rng.randint(0, 8)]
            elif kind == 2:
                copy[rng.randrange(60)] = f"n{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    texts = list(dict.fromkeys(texts))
    want = plain_classes(texts, plain_alignment)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in O.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want.tolist()
    assert 12 < len(set(want.tolist())) < len(texts) / 2


@pytest.mark.parametrize("every", [10, 20, 40])
def test_texts_with_single_words_replaced_are_one_class(spark, every):
    rows = []
    for group in range(20):
        base = [f"w{group}x{i}" for i in range(400)]
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(w if i % every else "other" for i, w in enumerate(base)))]
    got = {r.doc_id: r.class_id for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(20)) >= 18


def test_recall_of_buckets_against_all_pairs(spark, sf_dir):
    """Every document whose id is divisible by 5 against all: pairs of aligned similarity 0.8 are in one class."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = missed = 0
    for i, t in rows:
        for j, u in rows if i % 5 == 0 else []:
            if i != j and plain_alignment(t, u):
                found, missed = found + (got[i] == got[j]), missed + (got[i] != got[j])
    assert found > 20 and missed <= 0.1 * (found + missed)


def test_one_of_each_stays(copies):
    df, rows = copies
    kept = {r.doc_id for r in O.keep_one_of_each(df).collect()}
    assert kept == set(brute(rows).values())


def test_reordered_text_is_not_a_duplicate(spark):
    words = [f"w{i}" for i in range(200)]
    blocks = [words[i : i + 50] for i in range(0, 200, 50)]
    moved = [w for b in blocks[::-1] for w in b]
    assert not O.similar(Tokens([" ".join(words)]).hash, Tokens([" ".join(moved)]).hash)


def test_odd_rows(spark, odd_documents, no_documents):
    got = O.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    kept = O.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5, 6]  # null and empty texts are equal; the repeated row stays once
    assert O.near_duplicates(no_documents).count() == 0 and O.keep_one_of_each(no_documents).count() == 0


def test_repeated_and_null_ids_with_other_texts(spark):
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (7, "red green blue black white grey"), (7, "cat dog cow hen pig goat"), (7, "cat dog cow hen pig goat")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in O.keep_one_of_each(df).collect()) == sorted(set(t for _, t in rows))


def joined_rows(spark, since):
    """Rows that joins of the executions after `since` have put out."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    for i in range(since, store.executionsCount()):
        made = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(made), store.planGraph(made).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    rows += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return rows


def test_components_meet_each_link_a_few_times(spark):
    """Dense groups beside a long path: rounds that the path needs do not meet the groups' links again."""
    name, rng = lambda i: hashlib.md5(str(i).encode()).digest(), random.Random(5)
    dense = [(g * 1000 + i, g * 1000 + j) for g in range(1, 4) for i in range(40) for j in range(i)]
    path = [(i, i + 1) for i in range(300)]
    links = [(name(a), name(b)) for a, b in dense + path]
    rng.shuffle(links)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    found = {r["node"]: r["label"] for r in O.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    rows = joined_rows(spark, since)
    for group in [range(301), *(range(g * 1000, g * 1000 + 40) for g in range(1, 4))]:
        assert {bytes(found[name(i)]) for i in group} == {min(map(name, group))}
    assert len(found) == 421
    assert 2 * len(links) <= rows <= 4 * len(links)
