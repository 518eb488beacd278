"""Mixing of sources against plain loops."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factframe.llm import mixing


def plain_targets(words, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above `most` times a source's words is shared again."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(words.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * words[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * words[s])
            left -= target[s]
            open_.remove(s)
    return target


def plain_rates(sizes, target, most=3):
    """Rates of one source by halving the bracket of its tilt."""
    words = sum(sizes)
    if target >= most * words:
        return {x: float(most) for x in sizes}
    unit = words / len(sizes)
    rate = lambda t, x: min(float(most), math.exp(min(t * x / unit, math.log(most) + 1)))
    low, high = -1e4, 1e4
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(x * rate(middle, x) for x in sizes) < target else (low, middle)
    return {x: rate(low, x) for x in sizes}


def check(rows, exact=2.0):
    """Every column of the result, given (source, text) in it; targets are met within `exact` words or the least document."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    assert [r["size"] for r in rows] == size
    words, held = Counter(), defaultdict(list)
    for r, n in zip(rows, size, strict=True):
        words[r["source"]] += n
        held[r["source"]].append(r)
    targets = plain_targets(dict(words))
    for s, mine in held.items():
        assert {r["source_size"] for r in mine} == {words[s]}
        assert all(r["target"] == pytest.approx(targets[s], rel=1e-12) for r in mine)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in mine)
        sizes = [r["size"] for r in mine if r["size"]]
        if not sizes:
            continue
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - targets[s]) <= max(exact, min(sizes))
        rates, off = plain_rates(sizes, targets[s]), 0
        for r in mine:
            if r["size"]:
                assert abs(r["copies"] - rates[r["size"]]) <= 2
                off += not math.floor(rates[r["size"]] - 1e-6) <= r["copies"] <= math.ceil(rates[r["size"]] + 1e-6)
        assert off <= max(2, len(mine) // 5)  # most documents have the floor or the ceiling of their rate


def test_query_against_plain_loops(spark):
    from factframe.llm.queries import op13_source_mixing

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op13_source_mixing(spark, sf_dir).join(docs.select("doc_id", "text", "source"), "doc_id").withColumn("copies", F.expr("if(size = 0, 0, taken div size)")).collect()
    assert len(rows) == docs.count()
    check(rows, 40.0)


def test_full_sources_give_up_their_excess(spark):
    texts = [("big", "w " * n) for n in range(1, 300)] + [("a", "x " * 10), ("a", "x " * 7), ("b", "y"), (None, "z " * 900), (None, None), ("", " \t"), ("none", None)]
    rows = mixing.mix(spark.createDataFrame(texts, "source string, text string"), keep_text=True).collect()
    check(rows)
    by_source = {r["source"]: r["target"] for r in rows}
    assert (by_source["a"], by_source["b"], by_source[""], by_source["none"]) == (51.0, 3.0, 0.0, 0.0)
    assert sum(by_source.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_reruns_agree_under_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 50)
    rows = [(i % 997, f"s{i % 4}" if i % 3 else "s0", "w " * (3 + i % 5)) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    first, second = (sorted(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (1, 7))
    assert first == second
    check(mixing.mix(docs, keep_text=True).collect(), 8.0)


def test_tilts_meet_the_targets(spark):
    from factframe.llm.common import Scratch

    sizes = spark.createDataFrame([(0, 1, 5), (0, 40, 2), (0, 20_000, 1), (1, 7, 100), (2, 3, 10), (2, 9, 1)], "rank long, size long, n long")
    sources = spark.createDataFrame([(0, 20_085, 8, 150.0), (1, 700, 100, 2_000.0), (2, 39, 11, 117.0)], "rank long, words long, documents long, target double")
    state = {r["rank"]: r for r in mixing.tilts(sizes, sources, Scratch(spark)).collect()}
    assert state[2]["tilt"] is None
    for rank, sizes in ((0, [1] * 5 + [40] * 2 + [20_000]), (1, [7] * 100)):
        r = state[rank]
        assert sum(x * min(3.0, math.exp(min(2.0, r["tilt"] * x / r["unit"]))) for x in sizes) == pytest.approx(r["target"], abs=0.5)


def test_odd_tables(spark, odd_documents, no_documents):
    taken = odd_documents.withColumnRenamed("node", "taken").withColumnRenamed("n", "a.b")
    got = mixing.mix(taken)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "score", "label", "a.b", "taken", "size", "source_size", "target", "copies", "taken_"]
    rows = got.collect()
    assert len(rows) == taken.count()
    assert {r["taken_"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert {r["source_size"] for r in rows if r["source"] is None} == {0}
    assert mixing.mix(no_documents).count() == 0
