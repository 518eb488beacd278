"""Chains by pointer doubling and greedy matching, against plain loops."""

import random
from collections import defaultdict

from factframe.operators.chains import chains
from factframe.operators.matching import greedy_matches
from factframe.operators.ranks import numbered


def plain_chains(link):
    """{(newest, id): (depth, ends, cycle)} by walking."""
    cycle_of = {}
    for start in link:
        seen, at = [], start
        while at in link and at not in seen:
            seen.append(at)
            at = link[at]
        if at in seen:
            ring = seen[seen.index(at) :]
            cycle_of |= dict.fromkeys(ring, min(ring))
    out = {}
    targets = {t for t in link.values() if t in link}
    for head in [x for x in link if x not in targets] + sorted(set(cycle_of.values())):
        inside, at, way = head in cycle_of, head, []
        while True:
            way.append(at)
            to = link[at]
            if to is None or to not in link:
                ends = ("root" if to is None else "dangling", None)
                break
            if (to in cycle_of and not inside) or (inside and to == cycle_of[head]):
                ends = ("cycle", cycle_of[to])
                break
            at = to
        out |= {(head, x): (i, *ends) for i, x in enumerate(way)}
    return out


def made(spark, link):
    rows = chains(spark.createDataFrame(list(link.items()), "id long, supersedes long"))
    return {(r["newest"], r["id"]): (r["depth"], r["ends"], r["cycle"]) for r in rows.collect()}


def test_chains_of_any_shape(spark):
    draw = random.Random(4)
    link = {i: draw.choice([None, draw.randrange(120), draw.randrange(120), 500 + i]) if draw.random() < 0.5 else max(0, i - 1) for i in range(120)}
    link |= {900: 900, 901: 900, 910: 911, 911: 912, 912: 910, 913: 911}
    assert made(spark, link) == plain_chains(link)


def test_a_long_chain_and_a_long_cycle(spark):
    link = {i: i - 1 if i else None for i in range(10_000)}
    link |= {20_000 + i: 20_000 + (i + 1) % 700 for i in range(700)} | {30_000: 20_005}
    got = made(spark, link)
    assert len(got) == 10_701
    assert got[9_999, 0] == (9_999, "root", None) and got[20_000, 20_699] == (699, "cycle", 20_000) and got[30_000, 30_000] == (0, "cycle", 20_000)


def test_chains_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (1, 5), (2, 1)], "id long, supersedes long")
    assert {(r["newest"], r["id"], r["ends"]) for r in chains(rows).collect()} == {(2, 2, "dangling"), (2, 1, "dangling")}
    assert chains(rows.limit(0)).count() == 0


def test_greedy_matches_equal_a_plain_loop(spark):
    draw = random.Random(9)
    some = lambda: (draw.choice("ab"), draw.choice([1, 2, 3, None]), draw.choice([7, 8, None]))
    expected = [(*some(), i) for i in range(260)]
    found = [(*some(), i) for i in range(200)]
    shape = "company string, x long, y long, place long"
    got = greedy_matches(*(spark.createDataFrame(rows, shape).coalesce(1) for rows in (expected, found)), ["company"], ["x", "y"], ["place"], width=17)
    left, want = list(found), defaultdict(int)
    rank = lambda e: (-((e[1] is not None) + (e[2] is not None)), (e[1] is not None) + 2 * (e[2] is not None), e[3])
    claimed = 0
    for company, x, y, _ in sorted(expected, key=rank):
        for i, f in enumerate(left):
            if f[0] == company and (x is None or f[1] == x) and (y is None or f[2] == y):
                claimed += 1
                want[company] += 1
                left.pop(i)
                break
    rows = got.collect()
    assert len(rows) == claimed and {c: sum(r["company"] == c for r in rows) for c in "ab"} == dict(want)
    assert len({r["fact"] for r in rows}) == claimed == len({r["expectation"] for r in rows})


def test_rounds_share_one_shuffle_and_large_scopes_go_by_shards(spark, monkeypatch):
    from factframe.operators import matching

    draw = random.Random(11)
    company = lambda: draw.choice(["a"] * 8 + ["b", "c", None])
    some = lambda n: [(company(), draw.choice([1, 2, None]), draw.choice([7, 8, None]), i) for i in range(n)]
    expected, found = (spark.createDataFrame(some(n), "company string, x long, y long, place long").coalesce(1) for n in (300, 220))
    cut = []
    monkeypatch.setattr(matching, "written", lambda df, name: cut.append(name) or df.localCheckpoint())
    match = lambda within: sorted(map(tuple, matching.greedy_matches(expected, found, ["company"], ["x", "y"], ["place"], width=17, within=within).collect()))
    small = match(10_000)
    assert len(cut) <= 1 and len(small) > 100
    mixed, large = match(150), match(0)
    assert small == mixed == large
    assert {r[0] for r in small} == {"a", "b", "c"}


def test_row_numbers_by_shards(spark):
    rows = [("k", i, i % 3) for i in range(500)] + [(None, i, 0) for i in range(40)] + [("m", 5, 1)]
    got = numbered(spark.createDataFrame(rows, "key string, place long, rest long").repartition(5), ["key"], ["place"], width=13).collect()
    for key in ("k", None, "m"):
        mine = sorted(((r["place"], r["number"]) for r in got if r["key"] == key))
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
