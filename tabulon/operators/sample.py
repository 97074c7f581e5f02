"""Samples that are the same on every run: seeded, by quota with fill, by strata, first per prefix; review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def seeded_order(key: Column, seed: str = "42") -> Column:
    """A pseudo-random order of keys that depends on the seed alone."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows (fewer, if there are fewer) in a seeded order; each task keeps n at most."""
    return rows.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def quota_fill(rows: DataFrame, key: str, family: str, quotas: list[tuple[str, int]], target: int, seed: str = "42") -> DataFrame:
    """Of each listed family as many rows as its quota and the slots left by those before it, then others up to target.

    Slots left are a running sum over the families that have rows, which are few; no row is moved to find it. Rows without
    a family are of no listed one, so they fill up like others. Rows of one key are in no set order among each other.
    """
    at = W.Window.partitionBy(family).orderBy(seeded_order(F.col(key), seed), key)
    names = [q[0] for q in quotas]
    quota = F.coalesce(*[F.when(F.col(family) == n, F.lit(k)) for n, k in quotas], F.lit(0))
    place = F.coalesce(*[F.when(F.col(family) == n, F.lit(i)) for i, n in enumerate(names)])
    listed = rows.filter(F.col(family).isin(names))
    sizes = listed.groupBy(family).agg(F.count("*").alias("_n")).withColumn("_take", F.least(F.col("_n"), quota)).withColumn("_at", place)
    run = F.sum("_take").over(W.Window.orderBy("_at").rowsBetween(W.Window.unboundedPreceding, -1))
    slots = sizes.withColumn("_take", F.greatest(F.lit(0), F.least(F.col("_take"), F.lit(target) - F.coalesce(run, F.lit(0))))).select(family, "_take")
    first = listed.withColumn("_place", F.row_number().over(at)).join(F.broadcast(slots), family).filter(F.col("_place") <= F.col("_take")).drop("_place", "_take")
    left = max(0, target - (slots.agg(F.sum("_take")).first()[0] or 0))
    return first.unionByName(seeded_sample(rows.filter(~F.coalesce(F.col(family).isin(names), F.lit(False))), key, left, seed))


def mixed_strata(rows: DataFrame, key: str, family: str, complexity: str, size: int, families: int = 20, seed: str = "42") -> DataFrame:
    """rows with `stratum` of a sample of `size`: two fifths of rows of the largest families, then of each complexity a quarter of three tenths, then any others.

    Every stratum is the first rows in a seeded order among those that no stratum before it has, and what one can't fill
    goes to the last. Families of equal size go by name, and a null family or complexity is one of its own. Each task keeps
    no more rows of a stratum than are asked for, so no stratum is sorted whole.
    """
    order = [seeded_order(F.col(key), seed), F.col(key)]
    largest = rows.groupBy(F.col(family).alias("_f")).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), F.col("_f").asc_nulls_first()).limit(families)
    of_families = rows.join(F.broadcast(largest), rows[family].eqNullSafe(largest["_f"]), "left_semi").orderBy(*order).limit(size * 2 // 5)
    first = of_families.select(F.col(key), F.lit("family").alias("stratum"))
    each = size * 3 // 10 // 4
    left = rows.join(F.broadcast(first.select(key)), key, "left_anti")
    place = F.row_number().over(W.Window.partitionBy(complexity).orderBy(*order))
    second = left.withColumn("_place", place).filter(F.col("_place") <= each).select(F.col(key), F.lit("complexity").alias("stratum"))
    both = first.unionByName(second)
    rest = rows.join(F.broadcast(both.select(key)), key, "left_anti").orderBy(*order).limit(max(0, size - both.count()))
    return rows.join(F.broadcast(both.unionByName(rest.select(F.col(key), F.lit("random").alias("stratum")))), key)


def first_per_prefix(rows: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """(prefix, key): the smallest key that begins with each prefix."""
    arms = [F.when(F.col(key).startswith(p), F.lit(p)) for p in prefixes]
    return rows.select(F.explode(F.filter(F.array(*arms), lambda p: p.isNotNull())).alias("prefix"), key).groupBy("prefix").agg(F.min(key).alias(key))


def review_buckets(rows: DataFrame, key: str, confidence: str, cap: int = 50) -> DataFrame:
    """rows with `bucket`: auto from 0.9, review from 0.75, low below; of the review bucket the `cap` surest rows stay."""
    c = F.col(confidence)
    placed = rows.withColumn("bucket", F.when(c >= 0.9, "auto").when(c >= 0.75, "review").otherwise("low"))
    queue = placed.filter("bucket = 'review'").orderBy(c.desc(), key).limit(cap)
    return placed.filter("bucket <> 'review'").unionByName(queue)


def numbered(rows: DataFrame, key: str, blocks: int = 256) -> DataFrame:
    """rows with `number` from 0 by a numeric key, nulls first; repeated keys are in no set order among each other.

    Blocks of about equally many rows are numbered apart and offset. Their bounds are quantiles of the key, so there are
    never more than `blocks` sums to order, whatever the number of rows and the spread of the key.
    """
    shares = [i / blocks for i in range(1, blocks)]
    bounds = rows.agg(F.percentile_approx(key, F.lit(shares), 16 * blocks)).first()[0] or []
    dealt = rows.withColumn("_block", F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<double>"), lambda b: F.coalesce(b <= F.col(key), F.lit(False)))))
    sums = dealt.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.Window.orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.Window.partitionBy("_block").orderBy(key))
    return dealt.join(sums.select("_block", before.alias("_before")), "_block").withColumn("number", F.col("_before") + place - 1).drop("_block", "_before")
