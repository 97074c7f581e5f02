"""Estimates with margins of error: answers, comparisons, sums, rates and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions import stats
from tabulon.operators.merge import best_by


def sample_estimates(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, estimate (mean) and moe (90 % margin of the mean) of samples."""
    moe = F.lit(stats.Z90) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*keys).agg(F.avg(value).alias("estimate"), moe.alias("moe"))


def answers(asked: DataFrame, estimates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """asked with the first estimate row of its keys (by order), MOE in percent, and an error text where there is none."""
    first = best_by(estimates, keys, order)
    out = asked.join(first, keys, "left")
    return out.withColumn("moe_pct", F.round(stats.moe_percent(F.col("estimate"), F.col("moe")), 6)).withColumn("error", F.when(F.col("estimate").isNull(), "no data found"))


def compared(estimates: DataFrame) -> DataFrame:
    """estimates with the coefficient of variation and its reliability band."""
    cv = stats.cv_percent(F.col("estimate"), F.col("moe"))
    return estimates.withColumn("cv_pct", cv).withColumn("reliability", stats.cv_band(F.col("cv_pct")))


def summed(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of estimates over components, with the margin of the sum."""
    return estimates.groupBy(*keys).agg(F.sum("estimate").alias("estimate"), stats.sum_moe(F.col("moe")).alias("moe"))


def changes(estimates: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Each estimate with that of the period before it and the change."""
    spec = W.Window.partitionBy(*keys).orderBy(year)
    return estimates.withColumn("before", F.lag("estimate").over(spec)).withColumn("change", F.col("estimate") - F.col("before"))


def significant_pairs(estimates: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs of keys of one group whose estimates differ beyond their margins. Groups are small (places of a region)."""
    other = estimates.select(F.col(group).alias("_g"), F.col(key).alias(f"{key}_b"), F.col("estimate").alias("estimate_b"), F.col("moe").alias("moe_b"))
    pairs = estimates.join(other, (F.col(group) == F.col("_g")) & (F.col(key) < F.col(f"{key}_b"))).drop("_g")
    return pairs.withColumn("differs", stats.differ(F.col("estimate"), F.col("estimate_b"), F.col("moe"), F.col("moe_b")))


def rendered(estimate: Column, moe: Column) -> Column:
    """`1,234 (±56, 4.5%)`."""
    shown = F.format_number(F.round(estimate).cast("long"), 0)
    return F.when(moe.isNull(), shown).otherwise(F.concat(shown, F.lit(" (±"), F.format_number(F.round(moe).cast("long"), 0), F.lit(", "), F.format_string("%.1f", stats.moe_percent(estimate, moe)), F.lit("%)")))
