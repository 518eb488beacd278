from pyspark.sql import functions as F

from factframe.streaming import ledger


def test_latest_rows_do_not_depend_on_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    out = str(tmp_path / "out")
    ledger.keep_latest(ledger.read_events(spark, source), ["user_id", "event_type"], out, str(tmp_path / "ck")).awaitTermination()
    kept = spark.read.parquet(f"{out}/version=0")
    want = ledger.merge_latest(None, events, ["user_id", "event_type"])
    assert kept.select("user_id", "event_type", "event_id").exceptAll(want.select("user_id", "event_type", "event_id")).isEmpty()
    assert kept.count() == want.count()


def test_windowed_counts_drop_duplicates(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.unionByName(events).coalesce(1).write.parquet(source)
    q = ledger.windowed_counts(ledger.read_events(spark, source)).writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.day.date(), r.event_type): r.n for r in spark.sql("select * from counted").collect()}
    want = {(r.day, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_latest_rows_survive_a_missing_version(spark, sf_dir, tmp_path):
    """A batch goes on from the newest version there is, whatever its number."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, out, keys = str(tmp_path / "in"), str(tmp_path / "out"), ["user_id", "event_type"]
    first, second = events.where("event_id < 500"), events.where("event_id >= 500")
    ledger.merge_latest(None, first, keys).write.parquet(f"{out}/version=-3")  # as if later versions had gone
    second.coalesce(1).write.parquet(source)
    ledger.keep_latest(ledger.read_events(spark, source), keys, out, str(tmp_path / "ck")).awaitTermination()
    kept = spark.read.parquet(f"{out}/version=0").select("user_id", "event_type", "event_id")
    want = ledger.merge_latest(None, events, keys).select("user_id", "event_type", "event_id")
    assert kept.exceptAll(want).isEmpty() and want.exceptAll(kept).isEmpty()
