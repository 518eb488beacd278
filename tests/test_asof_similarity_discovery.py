"""As-of association over ranges, similarity join by prefixes, discovery of files, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factframe.operators.asof import asof_before
from factframe.operators.similarity import similar_candidates, similar_sets
from factframe.sources.discovery import readable_rows, skipped_files


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("width", [60, 3_600, 10_000_000])
def test_asof_equals_a_plain_scan(spark, width):
    draw = random.Random(2)
    left = [(i, draw.choice(["a", "a", "b", None]), at(draw.randrange(400)), draw.choice([None, "x"])) for i in range(300)]
    right = [(i, draw.choice(["a", "a", "b"]), at(draw.randrange(0, 400, 3)), draw.choice([None, 1.0, 2.0])) for i in range(150)]
    frames = [spark.createDataFrame(rows, shape).repartition(3) for rows, shape in ((left, "id long, key string, ts timestamp, note string"), (right, "no long, key string, ts timestamp, x double"))]
    got = {r["id"]: (r["note"], tuple(r["value"]) if r["value"] else None) for r in asof_before(*frames, ["key"], "ts", F.struct("no", "x"), ["no"], width).collect()}
    for i, key, ts, note in left:
        before = [(t, no, x) for no, k, t, x in right if k == key and t < ts]
        assert got[i] == (note, max(before)[1:] if before and key is not None else None)
    assert asof_before(frames[0], frames[1].limit(0), ["key"], "ts", F.col("x")).where("value is not null").count() == 0
    assert asof_before(frames[0].limit(0), frames[1], ["key"], "ts", F.col("x")).count() == 0


def test_a_hot_key_is_spread_over_ranges(spark):
    """Half of all rows are one key's; no task of the window holds more than twice the median."""
    rows = [(i, "hot" if i % 2 else f"k{i % 50}", at(i)) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(4)
    ranged = frame.groupBy("key", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("r")).count()
    sizes = sorted(r["count"] for r in ranged.where("key = 'hot'").collect())
    assert sizes[-1] <= 30 and len(sizes) > 300
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        done = asof_before(frame.where("id % 5 > 0"), frame.where("id % 5 = 0"), ["key"], "ts", F.col("id"), ["id"])
        held = sorted(r["count"] for r in done.repartition(16, "key", F.floor(F.unix_micros("ts") / 3_600_000_000)).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert held[-1] <= 2 * held[len(held) // 2]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_similar_sets_equal_all_pairs(spark, threshold):
    draw = random.Random(6)
    sets = {i: {int(draw.paretovariate(0.7)) % 60 for _ in range(draw.randint(0, 12))} for i in range(150)}
    sets |= {200 + i: set(sets[i]) for i in range(10)}
    frame = spark.createDataFrame([(i, [*s, *[*s][:1]]) for i, s in sets.items()] + [(None, [1, 2])], "id long, words array<int>")
    got = {(r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in similar_sets(frame, "id", "words", threshold).collect()}
    want = {(a, b): (len(x & y), len(x & y) / len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b and x | y and len(x & y) / len(x | y) > threshold}
    assert got == want and want


def test_prefixes_meet_far_fewer_pairs_than_all_common_members(spark):
    draw = random.Random(1)
    rows = [(i, sorted({f"w{int(draw.paretovariate(0.6)) % 4000:04}" for _ in range(20)})) for i in range(400)]
    often = {}
    for _, words in rows:
        for w in words:
            often[w] = often.get(w, 0) + 1
    ranked = spark.createDataFrame([(i, sorted(words, key=lambda w: (often[w], w))) for i, words in rows], "id long, members array<string>")
    met = similar_candidates(ranked, "id", 0.6).count()
    plain = sum(n * (n - 1) // 2 for n in often.values())
    assert met * 10 < plain


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_wide_and_small_sets_meet(spark, threshold):
    """Sets on both sides of the size up to which members are carried along."""
    draw = random.Random(9)
    base = list(range(90))
    sets = {i: set(base[: draw.randint(40, 90)]) - {draw.randrange(90) for _ in range(draw.randint(0, 20))} for i in range(60)}
    frame = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, words array<int>")
    got = {(r["a"], r["b"]): r["shared"] for r in similar_sets(frame, "id", "words", threshold).collect()}
    assert got == {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) > threshold}
    assert min(map(len, sets.values())) < 64 < max(map(len, sets.values()))


def test_a_pair_is_not_shuffled_to_its_sets(spark):
    """Two sets are counted where they meet: one join finds pairs, and no exchange of pairs follows it."""
    frame = spark.createDataFrame([(i, [i % 7, i % 5 + 10]) for i in range(50)], "id long, words array<int>")
    plan = similar_sets(frame, "id", "words", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan


def test_unreadable_empty_and_stale_files_are_named(spark, tmp_path):
    folder = tmp_path / "all companies"
    rows = spark.createDataFrame([(i, f"c{i}", 1 + (i >= 10)) for i in range(40)], "id long, name string, schema_version int")
    for name, part in (("a", rows.where("id >= 10")), ("b", rows.where("id < 10")), ("c", rows.limit(0))):
        part.coalesce(1).write.parquet(f"{folder}/{name}")
    whole = next((folder / "a").glob("*.parquet")).read_bytes()
    (folder / "a" / "cut.parquet").write_bytes(whole[: len(whole) // 2])
    (folder / "a" / "none.parquet").write_bytes(b"")
    got = readable_rows(spark, f"file://{folder}", rows.schema, ("schema_version", 2))
    assert sorted(r["id"] for r in got.collect()) == list(range(10, 40))
    skipped = {r["file"].rpartition("/")[2] if "cut" in r["file"] or "none" in r["file"] else r["file"].rpartition("/")[0][-1]: r["reason"] for r in skipped_files(spark, f"file://{folder}", rows.schema, ("schema_version", 2)).collect()}
    assert skipped == {"cut.parquet": "unreadable", "none.parquet": "unreadable", "b": "stale", "c": "empty"}
