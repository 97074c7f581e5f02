"""Mixing sources to target weights.

Tokens are summed per source, targets are filled from the weights, and each document is emitted floor(rate) times plus
one hash-seeded Bernoulli copy whose probability is the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.common import cut, hash_share, lookup_join, table

#: Words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _positions(keys: DataFrame, key: str) -> DataFrame:
    """keys (unique) with their position from 0 in code point order, null last. Ranges are sorted apart, then offset."""
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = cut(keys.repartitionByRange(n, F.col(key).asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    before = spread.groupBy("_range").count().withColumn("__tb_before", F.sum("count").over(W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)))
    inside = F.row_number().over(W.Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_last()))
    placed = spread.join(before.select("_range", "__tb_before"), "_range")
    return placed.withColumn("position", F.coalesce("__tb_before", F.lit(0)) + inside - 1).drop("_range", "__tb_before")


def source_targets(docs: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Per source: source, source_size, target, rate.

    Sources in code point order (null last) take the weights in turn, repeating. The weights share all tokens; a target
    stops at max_repeat times its source's size and the excess is shared again by weight until none is above. Each round
    is one aggregation over the sources; sums are exact whole numbers. A source without tokens has target and rate 0.
    """
    stats = docs.groupBy(source).agg(F.sum(size).alias("source_size"))
    placed = _positions(stats, source)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    placed = cut(placed.select(source, "source_size", weight.cast("long").alias("_weight")))
    whole = placed.agg(F.sum("source_size").alias("t"), F.sum("_weight").alias("w")).first()
    cap = F.col("source_size") * F.lit(int(max_repeat))
    left, open_weight = whole.t or 0, whole.w or 0
    while True:
        above = F.col("_weight").cast("double") * F.lit(float(left)) > cap.cast("double") * F.lit(float(open_weight))
        now = placed.agg(F.sum(F.when(above, cap)).alias("c"), F.sum(F.when(~above, F.col("_weight"))).alias("w")).first()
        if (whole.t or 0) - (now.c or 0) == left:
            break
        left, open_weight = (whole.t or 0) - (now.c or 0), now.w or 0
        if not open_weight:
            break
    share = F.lit(0.0) if not open_weight else F.col("_weight").cast("double") * F.lit(float(left)) / F.lit(float(open_weight))
    target = F.least(cap.cast("double"), share) if open_weight else cap.cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), target / F.col("source_size").cast("double"))).otherwise(F.lit(0.0))
    return placed.select(source, "source_size", target.alias("target"), rate.alias("rate"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, seed: int = 1) -> DataFrame:
    """docs with source_size, target, rate and copies: how often the mix takes each row.

    copies is floor(rate) plus one if the hash of seed and key falls below the rate's fraction, so reruns agree and a
    row's copies don't depend on other rows of its source beyond the rate; never over max_repeat. Rows with equal keys
    are taken alike; null keys count as the empty key. Null sizes count as 0. An empty table gives an empty result.
    Columns of docs with the names of the new ones are replaced.
    """
    docs = docs.drop("source_size", "target", "rate", "copies").withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    targets = cut(source_targets(docs.select(source, size), source, size, weights, max_repeat))
    whole = F.floor("rate")
    extra = (hash_share(F.lit(f"mix{seed}"), F.col(key)) < F.col("rate") - whole).cast("long")
    return lookup_join(docs, targets, source).withColumn("copies", whole.cast("long") + extra)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row copies times, with its repetition number from 0 in `copy`; rows without copies leave."""
    taken = mixed.filter(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", taken, "source", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
placed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM sized GROUP BY source),
whole AS (SELECT CAST(sum(source_size) AS BIGINT) AS t FROM placed),
filled AS (
  SELECT p.*, t, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM placed p, whole),
flags AS (SELECT *, weight::DOUBLE * (t - capped_before)::DOUBLE > (3 * source_size)::DOUBLE * weight_from::DOUBLE AS above FROM filled),
rest AS (SELECT (any_value(t) - coalesce(sum(3 * source_size) FILTER (above), 0))::DOUBLE AS left_over, (sum(weight) FILTER (NOT above))::DOUBLE AS open_weight FROM flags),
targets AS (
  SELECT source, source_size, CASE WHEN open_weight IS NULL THEN (3 * source_size)::DOUBLE ELSE least((3 * source_size)::DOUBLE, weight::DOUBLE * left_over / open_weight) END AS target FROM flags, rest),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets),
copied AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, s.source,
         CAST(floor(rate) AS BIGINT) + CAST((('0x' || substr(md5('mix1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) < rate - floor(rate) AS BIGINT) AS copies
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM copied
"""
