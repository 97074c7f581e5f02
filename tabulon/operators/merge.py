"""Consolidation of records: priorities, upserts, exclusions, expansions and differences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def best_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Of the rows of a key, the first by order, which must end in a unique column."""
    spec = W.Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(spec)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows, new's values first. Columns of both, by name."""
    names = [c for c in old.columns if c != key]
    right = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_new"))
    both = old.join(right, old[key] == right["_key"], "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names])


def without(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return rows.join(listed.select(key).distinct(), key, "left_semi")


def prefix_expand(prefixes: DataFrame, rows: DataFrame, prefix: str, value: str, delimiter: str) -> DataFrame:
    """prefixes joined with the rows whose value begins with one and a delimiter or the end; an equi-join on the value's head."""
    head = rows.withColumn("_head", F.substring_index(value, delimiter, 1))
    return prefixes.join(head, prefixes[prefix] == head["_head"]).drop("_head")


def catalog_diff(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """key, change (added, removed, relabelled), old and new label of the rows that differ."""
    a, b = old.select(key, F.col(label).alias("old_label")), new.select(key, F.col(label).alias("new_label"))
    both = a.withColumn("_o", F.lit(1)).join(b.withColumn("_n", F.lit(1)), key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old_label").eqNullSafe(F.col("new_label")), "relabelled")
    return both.select(key, change.alias("change"), "old_label", "new_label").filter(F.col("change").isNotNull())


def consolidation_stats(rows: DataFrame, source: str, kept: DataFrame) -> DataFrame:
    """Per source: rows before the merge and their share of the rows after it, in percent."""
    total = kept.agg(F.count("*").alias("_total"))
    return rows.groupBy(source).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(source, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 2).alias("share"))


def quota_sample(rows: DataFrame, family: str, quotas: Column, order: Column) -> DataFrame:
    """Of each family its first rows by order, as many as its quota."""
    spec = W.Window.partitionBy(family).orderBy(order)
    return rows.withColumn("place", F.row_number().over(spec)).filter(F.col("place") <= quotas)


class GreedyBatches:
    """Numbers rows by a running cost: a batch ends before its cost would pass the budget. Null costs count as 0."""

    def __init__(self):
        self.sum, self.batch = 0.0, 0

    def next(self, cost: float | None, budget: float) -> int:
        cost = cost or 0.0
        if self.sum > 0 and self.sum + cost > budget:
            self.sum, self.batch = 0.0, self.batch + 1
        self.sum += cost
        return self.batch


def running_batches(rows: DataFrame, group: str, order: str, cost: str, budget: float) -> DataFrame:
    """(group, order, batch): a greedy batch number, from 0, in each group.

    Rows are sorted in their tasks and numbered as they pass, so a group of any size needs no memory but its sum; it does
    pass through one task, as a batch depends on all before it. Rows of one order go by cost; null groups are one group.
    """
    own = rows.select(group, order, F.col(cost).cast("double").alias("_cost"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, state = object(), GreedyBatches()
        for batch in batches:
            out = []
            for name, c in zip(batch.column(group).to_pylist(), batch.column("_cost").to_pylist(), strict=True):
                if name != at:
                    at, state = name, GreedyBatches()
                out.append(state.next(c, budget))
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(order), pa.array(out, pa.int32())], [group, order, "batch"])

    kinds = dict(own.dtypes)
    dealt = own.repartition(group).sortWithinPartitions(group, order, "_cost")
    return dealt.mapInArrow(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, batch int")
