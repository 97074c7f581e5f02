"""Chat formatting after cumulative-snapshot collapse. DataFrame operations only.

Logs of a growing conversation hold each earlier state as a conversation of its own. Rolling fingerprints of the turn
prefixes find those that prefix a longer one; an anti-join keeps the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.common import cut, table

START, END = "<|im_start|>", "<|im_end|>\n"


def _parts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with an id, and those without."""
    return turns.filter(F.col("conv_id").isNotNull()), turns.filter(F.col("conv_id").isNull())


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, place (from 1), turns (of the conversation) and the 128-bit fingerprint of the turns up to it.

    A fingerprint is the running XOR of hashes that hold a turn's place, role and text. A turn without conv_id is a
    conversation of its own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark_a, mark_b = F.xxhash64("place", "hash_a"), F.xxhash64("place", "hash_b", F.lit(1))
    own = W.Window.partitionBy("conv_id")
    order = own.orderBy(F.col("turn").asc_nulls_first(), "role_hash", "hash_a", "hash_b")
    compact = lambda df: df.select("conv_id", "turn", F.xxhash64(role).alias("role_hash"), F.xxhash64(role, text).alias("hash_a"), F.xxhash64(F.lit("b"), text, role).alias("hash_b"))
    named, alone = _parts(turns)
    placed = compact(named).withColumn("place", F.row_number().over(order)).withColumn("turns", F.count("*").over(own))
    run = order.rowsBetween(W.Window.unboundedPreceding, 0)
    first = compact(alone).withColumn("place", F.lit(1))
    return placed.select("conv_id", "place", "turns", F.bit_xor(mark_a).over(run).alias("mark_a"), F.bit_xor(mark_b).over(run).alias("mark_b")).union(
        first.select("conv_id", "place", F.lit(1).cast("long").alias("turns"), mark_a.alias("mark_a"), mark_b.alias("mark_b"))
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns, copies and marks of the conversations that are no prefix of a longer one; of equal ones the smallest id.

    Equal conversations meet in an aggregation, so a conversation that is logged very often is one row before the join.
    """
    marks = cut(turn_prefixes(turns))
    ends = marks.filter(F.col("place") == F.col("turns")).groupBy("mark_a", "mark_b", "turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = marks.filter(F.col("place") < F.col("turns")).select("mark_a", "mark_b", F.col("place").alias("turns")).distinct()
    return ends.join(inner, ["mark_a", "mark_b", "turns"], "left_anti").select("conv_id", "turns", "copies", "mark_a", "mark_b")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One rendered row per maximal conversation: conv_id, n_turns, n_copies, rendered.

    Turns are in order of turn, then role, then text hash; null roles and texts are empty. A row without conv_id is a
    conversation of one turn; equal ones collapse like others. Repeated rows are repeated turns. Other columns are
    ignored. Empty in, empty out.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "_id")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))
    line = F.struct(F.col("turn"), F.xxhash64(role).alias("role_hash"), F.xxhash64(role, text).alias("hash_a"), F.xxhash64(F.lit("b"), text, role).alias("hash_b"), shown.alias("line"))
    named, alone = _parts(turns)
    mine = named.join(kept, named.conv_id == kept["_id"], "left_semi")
    whole = mine.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(line)).getField("line"), "").alias("rendered"))
    out = lambda df: df.select("conv_id", F.col("turns").cast("long").alias("n_turns"), F.col("copies").alias("n_copies"), "rendered")
    single = alone.select(F.xxhash64(role, text).alias("hash_a"), F.xxhash64(F.lit("b"), text, role).alias("hash_b"), F.lit(1).alias("place"), shown.alias("line"))
    single = single.groupBy(F.xxhash64("place", "hash_a").alias("mark_a"), F.xxhash64("place", "hash_b", F.lit(1)).alias("mark_b")).agg(F.min("line").alias("rendered"))
    lone = single.join(kept.filter(F.col("_id").isNull() & (F.col("turns") == 1)), ["mark_a", "mark_b"]).withColumn("conv_id", F.col("_id"))
    return out(whole.join(kept, whole.conv_id == kept["_id"])).union(out(lone))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH rows_ AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
numbered AS (SELECT conv_id, alone, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id, alone) AS turns,
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM rows_),
prefixes AS (SELECT conv_id, place, turns, string_agg(line, '' ORDER BY place) OVER (PARTITION BY conv_id, alone ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM numbered),
ends AS (SELECT min(conv_id) AS conv_id, turns, count(*) AS copies, so_far FROM prefixes WHERE place = turns GROUP BY turns, so_far)
SELECT conv_id, turns AS n_turns, copies AS n_copies, so_far AS rendered FROM ends e
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place < p.turns AND p.place = e.turns AND p.so_far = e.so_far)
"""
