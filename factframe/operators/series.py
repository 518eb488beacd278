"""Time-series operators over long facts (company, period, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent_change(current: Column, prior: Column) -> Column:
    """Relative change in percent; null if either is null or the prior is zero."""
    return (current - prior) / F.nullif(F.abs(prior), F.lit(0.0)) * 100


def previous(value: str, keys: Sequence[str], order: str = "period") -> Column:
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(order))


def change_keeping_nulls(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Change against the row before, even where that is null (a gap breaks the chain)."""
    prior = previous(value, keys)
    return df.withColumn("prior", prior).withColumn("change", percent_change(F.col(value), F.col("prior")))


def change_skipping_nulls(df: DataFrame, value: str, keys: Sequence[str], points: bool = False) -> DataFrame:
    """Change against the latest earlier value; in percentage points or in percent."""
    some = df.where(F.col(value).isNotNull()).withColumn("prior", previous(value, keys))
    return some.withColumn("change", F.col(value) - F.col("prior") if points else percent_change(F.col(value), F.col("prior")))


def last_n(df: DataFrame, value: str, keys: Sequence[str], n: int) -> DataFrame:
    """The n newest values; change is taken inside the truncated list, so its first row has none."""
    newest = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    kept = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
    return kept.withColumn("change", percent_change(F.col(value), previous(value, keys)))


def latest_value(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """The newest period that has a value, per key; partial aggregation, no sort."""
    some = df.where(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(F.max_by(value, "period").alias("value"), F.max("period").alias("period"))


def screen(latest: DataFrame, condition: Column, higher_is_better: bool = True) -> DataFrame:
    """Filter companies by their latest value and order them by merit, ties by company."""
    order = F.col("value").desc() if higher_is_better else F.col("value").asc()
    return latest.where(condition).orderBy(order, "company_id")


def streaks(df: DataFrame, value: str, keys: Sequence[str], length: int = 3) -> DataFrame:
    """First run of `length` consecutive available changes of one sign, per key and direction."""
    w = Window.partitionBy(*keys).orderBy("period")
    delta = df.withColumn("delta", F.col(value) - F.lag(value).over(w)).where("delta is not null")
    frame = w.rowsBetween(1 - length, 0)
    marked = delta.withColumn("_n", F.count("delta").over(frame)).withColumn("_low", F.min("delta").over(frame)).withColumn("_high", F.max("delta").over(frame))
    direction = F.when(F.col("_low") > 0, "rising").when(F.col("_high") < 0, "falling")
    found = marked.where(F.col("_n") == length).withColumn("direction", direction).where("direction is not null")
    return found.groupBy(*keys, "direction").agg(F.min("period").alias("first_period"))


def yoy_nearest(df: DataFrame, value: str, keys: Sequence[str], days: int = 45) -> DataFrame:
    """The earlier point nearest to one year before, at most `days` off; the earlier one wins a tie.

    The range join is made an equi-join: both sides carry the quarter-year slot
    of the wanted date, and the earlier side is repeated into its neighbours.
    """
    slot = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (2 * days + 1))
    wanted = F.add_months("period", -12)
    left = df.select(*keys, "period", F.col(value).alias("value"), wanted.alias("_wanted")).withColumn("_slot", slot(F.col("_wanted")))
    right = df.select(*keys, F.col("period").alias("prior_period"), F.col(value).alias("prior_value")).withColumn("_slot", F.explode(F.array(*[slot(F.col("prior_period")) + i for i in (-1, 0, 1)])))
    near = left.join(right, [*keys, "_slot"]).withColumn("gap_days", F.abs(F.datediff("prior_period", "_wanted"))).where((F.col("gap_days") <= days) & (F.col("prior_period") < F.col("period")))
    best = near.groupBy(*keys, "period", "value").agg(F.min_by(F.struct("prior_period", "prior_value", "gap_days"), F.struct("gap_days", "prior_period")).alias("_b"))
    return best.select(*keys, "period", "value", "_b.prior_period", "_b.prior_value", "_b.gap_days")


def last_two(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """current and prior: the two newest non-null values."""
    newest = Window.partitionBy(*keys).orderBy(F.col("period").desc())
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_n") == n, F.col(c)))
    return ranked.groupBy(*keys).agg(pick(1, value).alias("current"), pick(2, value).alias("prior"), pick(1, "period").alias("period")).where("prior is not null")


def asof_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, columns: Sequence[str]) -> DataFrame:
    """Left rows with the latest right row strictly before them (null if none): one union, one sort, no range join."""
    tagged = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    other = right.select(*keys, F.col(right_at).alias("_at"), F.lit(2).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*columns).alias("_r"))
    # at equal times the left row comes first, so it does not see the right one
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = tagged.unionByName(other).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_l.*", *[F.col(f"_r.{c}") for c in columns])
