"""Packing and decontamination against brute force; the pipeline's stages."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from factframe.llm import decontaminate, packing


def brute_padding(lengths, counts, buckets):
    best = None
    for k in range(min(buckets, len(lengths))):
        for cut in combinations(lengths[:-1], k):
            bounds = sorted([*cut, lengths[-1]])
            cost = sum(min(b for b in bounds if b >= n) * c for n, c in zip(lengths, counts))
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = sorted(rng.choice(60, size=rng.integers(1, 9), replace=False).tolist())
        counts = rng.integers(1, 50, len(lengths)).tolist()
        for buckets in (1, 2, 3, 4):
            bounds = packing.optimal_boundaries(np.array(lengths), np.array(counts), buckets)
            assert len(bounds) <= buckets and bounds[-1] == lengths[-1]
            cost = sum(min(b for b in bounds if b >= n) * c for n, c in zip(lengths, counts))
            assert cost == brute_padding(lengths, counts, buckets)


def test_boundaries_of_many_lengths_equal_the_plain_program():
    """Exact lengths up to 100,000, against the program without the envelope."""
    rng = np.random.default_rng(3)
    lengths = np.unique(np.concatenate([np.arange(300), rng.integers(1, 100_000, 400)]))
    counts = rng.integers(1, 10_000, len(lengths))
    rows, best = np.cumsum(counts), lengths * np.cumsum(counts)
    for buckets in range(1, 9):
        bounds = packing.optimal_boundaries(lengths, counts, buckets)
        at = np.searchsorted(bounds, lengths)
        assert len(bounds) <= buckets and int((np.array(bounds)[at] * counts).sum()) == best[-1]
        best = np.array([min([best[j], *(best[:j] + lengths[j] * (rows[j] - rows[:j]))]) for j in range(len(lengths))])


def test_repeated_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 10)
    df = spark.range(2000).selectExpr("cast(null as long) as doc_id", "'a b c' as text")
    rows = packing.pack(df, token_budget=30).collect()
    assert len(rows) == 2000 and len({(r.batch_id, r.slot) for r in rows}) == 2000 and max(r.batch_id for r in rows) == 199


def test_batches_keep_the_budget(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, buckets=6, token_budget=4096).collect()
    assert len(rows) == docs.count() and all(r.padding == r.bucket_length - r.length >= 0 for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for batch in batches.values():
        assert len({r.bucket for r in batch}) == 1 and sorted(r.slot for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0].bucket_length <= 4096
    # all but one batch of a bucket are full
    for bucket in {r.bucket for r in rows}:
        mine = [b for b in batches.values() if b[0].bucket == bucket]
        assert sum(len(b) < max(1, 4096 // max(1, b[0].bucket_length)) for b in mine) <= 1


def test_lengths_in_tokens_equal_the_library(odd_documents):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = sorted(((r.doc_id or -1), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_documents.collect())
    assert sorted(((r.doc_id or -1), r.length) for r in packing.pack(odd_documents, path).collect()) == want


def test_packing_is_the_same_under_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    rows = [(i % 90, "w " * (1 + i % 40)) for i in range(900)] + [(None, "w w w")] * 40 + [(5, "w w w")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(tuple, packing.pack(docs.repartition(n), token_budget=100).collect()), key=repr) for n in (1, 6))
    assert one == two and len(one) == len(rows)


def plain_packing(rows, buckets, budget):
    """(doc_id, length) by bucket, in the order of the operator's draw, cut into batches."""
    lengths = sorted({n for _, n, _ in rows})
    counts = [sum(n == x for _, n, _ in rows) for x in lengths]
    bounds = packing.optimal_boundaries(np.array(lengths), np.array(counts), buckets)
    out, batch = [], 0
    for k, bound in enumerate(bounds):
        inside = sorted(((draw % 64, draw, i, n) for i, n, draw in rows if (bounds[k - 1] if k else -1) < n <= bound), key=lambda r: r)
        room = max(1, budget // max(1, bound))
        for j, (_, _, i, n) in enumerate(inside):
            out.append((i, n, k, bound, batch + j // room, j % room, bound - n))
        batch += -(-len(inside) // room)
    return sorted(out)


def test_whole_packing_against_a_plain_loop(spark, sf_dir):
    from pyspark.sql import functions as F

    from factframe.llm.queries import op10_packing

    got = sorted(map(tuple, op10_packing(spark, sf_dir).collect()))
    rows = spark.createDataFrame([r[:2] for r in got], "doc_id long, length long").withColumn("draw", F.xxhash64("doc_id", "length")).collect()
    assert got == plain_packing([tuple(r) for r in rows], packing.BUCKETS, packing.TOKEN_BUDGET)


def test_packing_odd_rows(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    assert len(rows) == odd_documents.count() and sorted(r.length for r in rows)[:3] == [0, 0, 1]
    assert packing.pack(no_documents).count() == 0


def words(text):
    import re

    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def runs(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_containment_equals_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts, tests = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    parts = [(5000 + i, "intro words here " + " ".join(words(t)[: int(len(words(t)) * share)]) + " outro") for i, (_, t) in enumerate(tests[:10]) for share in (0.5 + 0.05 * i,)]
    extra = [(-1, "two words"), (-2, ""), (-3, None), (-4, tests[0][1])]
    texts += [*parts, (6000, "here are two words and more"), (6001, None), (6002, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    its = spark.createDataFrame(tests + extra, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(df, its).collect()}
    want = {}
    for item, t in tests + extra:
        k = min(5, len(words(t)))
        mine = runs(t, k) if k else set()
        for doc, x in texts:
            share = len(mine & runs(x, k)) / len(mine) if mine else 0
            if share >= 0.8:
                want[doc, item] = share
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert (6000, -1) in got


def test_decontamination_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "fox jumps over the lazy dog near the river"), (None, "kurzer text ohne nummer"), (3, None)], "item_id long, text string")
    left = decontaminate.remove_contaminated(odd_documents, items)
    assert left.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3, 4, 5, 6]
    assert decontaminate.remove_contaminated(no_documents, items).count() == 0
    assert decontaminate.contained_items(odd_documents, items.limit(0)).count() == 0


def test_native_operators_have_no_python_in_their_plans(spark, sf_dir, capsys):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    decontaminate.contained_items(docs, items).explain()
    from factframe.llm import queries

    queries.op5_chat_formatting(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Scan" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, last = documents, documents.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == documents.columns and 0 < docs.count() <= last
        last = docs.count()
    packed = P.pack(spark, docs, sf_dir)
    assert packed.count() == last and packed.select("doc_id").distinct().count() == last


def test_pipeline_of_odd_tables(spark, odd_documents, no_documents, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names, empty tables: each stage gives its defined rows."""
    import corpus_pipeline as P

    def tables(name, labels, items):
        where = f"{tmp_path}/{name}"
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        return where

    clash = odd_documents
    for name in ("toxic_score", "_toxic", "log_weight", "_node", "_id"):
        clash = clash.withColumn(name, F.lit("mine"))
    labels = [(i, int(i % 3 > 0), i % 2) for i in range(8)] + [(None, 1, 1), (1, None, None)]
    some, none = tables("some", labels, [(1, "fox jumps over the lazy dog near the river"), (None, None)]), tables("none", [], [])
    for where in (some, none):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, clash, where)
            assert out.columns == clash.columns and out.count() <= clash.count(), name
            assert stage(spark, no_documents, where).count() == 0, name
        assert P.pack(spark, clash, where).count() == clash.count() and P.pack(spark, no_documents, where).count() == 0
    # without labels and items, only repeated and equal texts go
    kept = clash
    for name, stage in P.STAGES[:-1]:
        kept = P.written(stage(spark, kept, none), f"odd-{name}")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5, 6]


def test_queries_return_contract_columns(spark, sf_dir):
    from factframe.llm.queries import QUERIES

    want = {
        "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op9_token_ids": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op1_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op4_lossless_webp": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op5_chat_formatting": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    }
    for name, columns in want.items():
        assert columns <= set(QUERIES[name](spark, sf_dir).columns), name


def test_equal_and_long_items_in_many_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_ROWS", 50)
    long = " ".join(f"l{i}" for i in range(900))
    same = "one two three four five six seven eight"
    items = spark.createDataFrame([(1, long), (2, same), (3, same), (4, same.upper()), (5, same), (5, long), (6, "x y"), (7, None), (None, same)], "item_id long, text string")
    docs = spark.createDataFrame([(10, "so " + same + " then"), (11, "a " + long), (12, "nothing x y here"), (13, " ".join(f"l{i}" for i in range(400)))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 3) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(10, 2): 1.0, (10, 3): 1.0, (10, 4): 1.0, (11, 1): 1.0, (11, 5): round(896 / 900, 3), (12, 6): 1.0}
