"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "screen_revenue", "snapshot_merge", "derived_metrics", "yoy_nearest_45d", "ownership_streaks", "metric_moves", "segment_concentration",
    "latest_per_key", "asof_strictly_before", "event_merge_by_day", "risk_recurrence", "tokenize_keywords", "passage_windows", "passage_candidates",
    "assertion_ids", "profile_diff", "trace_fact", "retrieval_quality", "suite_redundancy_jaccard",
]


def main() -> None:
    where = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from factframe.catalogue import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first compiles
            began = time.perf_counter()
            QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, total of best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
