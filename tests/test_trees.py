"""Nested documents against the json module."""

import json
import random

import pytest

from factframe.operators.trees import VOLATILE, canonical, rebuilt, tree_diff, tree_nodes


def some(draw, depth=0):
    kind = draw.random()
    if depth < 4 and kind < 0.4:
        names = ["a", "b c", "d.e", 'q"t', "é", "built_at", "x[0]", "", "Z", "created_at", "日"]
        return {k: some(draw, depth + 1) for k in draw.sample(names, draw.randint(0, 5))}
    if depth < 4 and kind < 0.6:
        return [some(draw, depth + 1) for _ in range(draw.randint(0, 12))]
    return draw.choice([None, True, 7, -3, 2.5, "text", 'q"\\ \n\t', "é日\U0001f600", "", "[1]"])


def stripped(node):
    if isinstance(node, dict):
        return {k: stripped(v) for k, v in node.items() if k not in VOLATILE}
    return [stripped(x) for x in node] if isinstance(node, list) else node


def text(node):
    return json.dumps(node, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def leaves(node, path=()):
    if isinstance(node, (dict, list)):
        for k, v in node.items() if isinstance(node, dict) else enumerate(node):
            yield from leaves(v, (*path, k))
    else:
        yield path, text(node)


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(3)
    return [some(draw) for _ in range(60)] + [{}, [], None, [[[[[]]]]], {"a": {"created_at": {"x": 1}}}]


def frame(spark, documents):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "id long, document string")


def test_canonical_text(spark, documents):
    got = {r["id"]: r["canonical"] for r in canonical(frame(spark, documents), ["id"]).collect()}
    assert got == {i: text(stripped(d)) for i, d in enumerate(documents)}


def test_nodes_rebuild_the_document(spark, documents):
    nodes = tree_nodes(frame(spark, documents), ["id"])
    assert {r["id"]: r["document"] for r in rebuilt(nodes, ["id"]).collect()} == {i: text(d) for i, d in enumerate(documents)}
    rows = nodes.collect()
    assert len({(r["id"], r["path"]) for r in rows}) == len(rows)
    for i, d in enumerate(documents):
        assert sorted(r["leaf"] for r in rows if r["id"] == i and r["kind"] == "leaf") == sorted(v for _, v in leaves(d))


def test_differences(spark, documents):
    others = documents[1:] + documents[:1]
    got = tree_diff(frame(spark, documents), frame(spark, others), ["id"]).collect()
    for i, (left, right) in enumerate(zip(documents, others)):
        a, b = dict(leaves(left)), dict(leaves(right))
        want = sorted(("-" if k not in b else "+" if k not in a else "~", a.get(k, ""), b.get(k, "")) for k in a.keys() | b.keys() if a.get(k) != b.get(k))
        assert sorted((r["change"], r["old"] or "", r["new"] or "") for r in got if r["id"] == i) == want


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "5")], "id long, document string")
    assert [(r["id"], r["canonical"]) for r in canonical(rows, ["id"]).collect()] == [(2, "5")]
    assert canonical(rows.limit(0), ["id"]).count() == 0
