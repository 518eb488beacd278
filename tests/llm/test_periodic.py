"""Periodic runs against a plain scan of every shift."""

import random

import pytest

from factframe.llm import periodic


def plain_runs(words, min_exp=4, least_words=6):
    found = []
    for q in range(1, len(words) // min_exp + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(least_words, min_exp * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found)


def plain_collapse(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def some_text(draw, size, letters):
    words = [bytes([97 + draw.randrange(letters)]) for _ in range(size)]
    if size > 10 and draw.random() < 0.6:
        a = draw.randrange(size)
        p = 1 + draw.randrange(max(1, (size - a) // 4 + 1))
        for i in range(a, size):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("min_exp, least_words", [(4, 6), (2, 2), (3, 12)])
def test_scan_finds_what_a_plain_scan_finds(min_exp, least_words):
    draw = random.Random(7)
    for _ in range(300):
        texts = sorted((some_text(draw, draw.choice([0, 1, 5, 6, 8, 9, 20, 61, 150]), draw.choice([1, 2, 3, 10])) for _ in range(draw.randint(1, 5))), key=lambda x: -len(x))
        found = periodic.scan(periodic.number_words(texts), [*map(len, texts)], min_exp=min_exp, least_words=least_words)
        for words, runs in zip(texts, found, strict=True):
            assert sorted(runs) == plain_runs(words, min_exp, least_words)
            assert periodic.collapse(words, runs) == plain_collapse(words, runs)


def long_texts():
    draw = random.Random(3)
    out = ["w " * 9_000, " ".join(f"a{i % 1_100} b{i % 1_100}" for i in range(11_000)), " ".join(f"x{draw.randrange(9)}" for _ in range(9_000))]
    period = [f"t{draw.randrange(500)}" for _ in range(2_300)]
    return [*out, " ".join([f"h{i}" for i in range(700)] + period * 5 + ["end"])]


def test_long_texts_are_cut_into_ranges_of_shifts(spark, monkeypatch):
    monkeypatch.setattr(periodic, "WHOLE_BYTES", 4_000)
    texts = long_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(rows).collect()}
    monkeypatch.setattr(periodic, "WHOLE_BYTES", 1 << 30)
    whole = {r["doc_id"]: r for r in periodic.periodic_runs(rows).collect()}
    assert got == whole
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 9_000, 1)]
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 22_000, 2_200)]
    assert (700, 11_500, 2_300) in [tuple(r) for r in got[3]["runs"]]
    assert len(got[3]["collapsed"].split()) == 700 + 2_300 + 1 - sum(r["length"] - r["period"] for r in got[3]["runs"] if r["period"] < 2_300)


def test_odd_tables(spark, odd_documents, no_documents):
    taken = odd_documents.withColumnRenamed("node", "runs").withColumnRenamed("n", "a.b")
    got = periodic.periodic_runs(taken)
    assert got.columns == [*taken.columns, "n_words", "runs_", "collapsed"]
    rows = got.collect()
    assert len(rows) == taken.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (2, 3):
        assert (by_id[i]["n_words"], by_id[i]["runs_"], by_id[i]["collapsed"]) == (0, [], "")
    assert by_id[4]["runs_"] == [] and by_id[4]["n_words"] == 40_000 and by_id[4]["runs"] == "x"
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert periodic.periodic_runs(no_documents).count() == 0


def test_white_space_is_ascii_only(spark):
    text = "\x0b" + "\t".join(["a\u00a0b", "c d"] * 4) + "\x0c\n"
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (8, [(0, 8, 2)], "a\u00a0b c d")
