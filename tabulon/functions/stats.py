"""Margins of error, reliability bands and other measures of estimates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a 90 % interval.
Z90 = 1.645


def moe_percent(estimate: Column, moe: Column) -> Column:
    return F.when(estimate > 0, moe / estimate * 100).otherwise(0.0)


def cv_percent(estimate: Column, moe: Column) -> Column:
    """Coefficient of variation; null unless both are known and the estimate is positive."""
    return F.when((estimate > 0) & moe.isNotNull(), moe / Z90 / estimate * 100)


def cv_band(cv: Column) -> Column:
    return F.when(cv < 15, "reliable").when(cv < 30, "caution").when(cv >= 30, "unreliable")


def moe_ratio_band(ratio: Column) -> Column:
    return F.when(ratio < 0.10, "high").when(ratio < 0.30, "medium").when(ratio >= 0.30, "low")


def spatial_category(weight: Column) -> Column:
    return F.when(weight < 0.30, "nationally_stable").when(weight < 0.38, "regionally_variable").when(weight >= 0.38, "locally_clustered")


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "auto").when(confidence >= 0.75, "review").otherwise("low")


def topology_quality(silhouette: Column) -> Column:
    return F.when(silhouette > 0.5, "excellent").when(silhouette > 0.3, "good").otherwise("needs_tuning")


def sum_moe(moe: Column) -> Column:
    """Margin of error of a sum of estimates (an aggregate)."""
    return F.sqrt(F.sum(moe * moe))


def ratio_moe(num: Column, den: Column, num_moe: Column, den_moe: Column) -> Column:
    return F.when(den > 0, F.sqrt(num_moe * num_moe + (num / den) ** 2 * den_moe * den_moe) / den)


def differ(a: Column, b: Column, moe_a: Column, moe_b: Column) -> Column:
    """Whether two estimates' intervals don't overlap."""
    return F.abs(a - b) > moe_a + moe_b


def cost_tokens(chars: Column) -> Column:
    return chars / 4.0


def plan_cost(n: Column, strategy: Column) -> Column:
    """US dollars for n variables: all by the ensemble, all by one agent, or a fifth by the ensemble."""
    multi = F.when(strategy == "multi", n).when(strategy == "hybrid", F.floor(n * 0.2)).otherwise(0)
    return multi * 0.006 + (n - multi) * 0.001
