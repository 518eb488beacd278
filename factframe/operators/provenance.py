"""Content ids, run currency, digests, diffs and supersede chains."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by unit separators, with nulls marked so that they differ from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]).cast("binary"), 256)


def ordinal(keys: Sequence[str], order: Sequence[Column | str]) -> Column:
    """0-based counter in emission order."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def version_key(version: Column) -> Column:
    """Dotted version as an array of integers; other segments count as 0."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


#: Sums of a digest are taken modulo this, so that they stay whole numbers of 64 bits over any number of rows.
DIGEST_MODULUS = 2**63


def digest(df: DataFrame) -> DataFrame:
    """One row that is equal for equal multisets of rows, in any order and partitioning: the count, and sums of two parts of each row's MD5.

    The sums are exact decimals, of which the remainder by DIGEST_MODULUS is kept.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns)])
    number = lambda at: F.conv(F.substring(F.md5(text), at, 12), 16, 10).cast("decimal(15,0)")
    part = lambda at: F.coalesce((F.sum(number(at)) % F.lit(Decimal(DIGEST_MODULUS))).cast("long"), F.lit(0))
    return df.agg(F.count("*").alias("n"), part(1).alias("head"), part(13).alias("middle"))


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, old, new, change: '-' only left, '+' only right, '~' different; equal rows are left out."""
    a, b = left.select(*keys, F.col(value).alias("old"), F.lit(True).alias("_a")), right.select(*keys, F.col(value).alias("new"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    change = F.when(F.col("_b").isNull(), "-").when(F.col("_a").isNull(), "+").when(~F.col("old").eqNullSafe(F.col("new")), "~")
    return both.withColumn("change", change).where("change is not null").select(*keys, "old", "new", "change")
