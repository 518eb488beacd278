"""Ledger operators: latest per key, merging, trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """The row of greatest `order` for each key, by partial aggregation instead of a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_b")).select(*keys, "_b.*")


def merge_by_day(df: DataFrame, keys: Sequence[str], at: str, evidence: str) -> DataFrame:
    """One event per calendar day and keys, with the first time and the sorted distinct ids."""
    return df.groupBy(F.to_date(at).alias("day"), *keys).agg(F.min(at).alias("first_at"), F.array_sort(F.collect_set(evidence)).alias("evidence_ids"), F.count("*").alias("n"))


def trailing(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows at most `days` before the newest; the maximum is one row, so its broadcast is bounded."""
    newest = df.agg(F.max(day).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(day) >= F.date_sub("_newest", days)).drop("_newest")


def top_n(df: DataFrame, section: str, order: Sequence[Column], n: int, columns: Sequence[str]) -> DataFrame:
    """A named section of the n first rows."""
    return df.orderBy(*order).limit(n).select(F.lit(section).alias("section"), *columns)


def number_in_group(keys: Sequence[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
