"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, skew_join


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): each node of edges with the smallest node that it can reach.

    Every round takes the least label of the neighbours, then the label's label, so long chains halve. All is written
    to the shared folder after each round, and the round before is freed. Stops when no label changes. Edges of a hub
    and nodes of a large component are dealt over several tasks. Edges with a null end are left out, repeated ones count
    once, and a node with an edge to itself alone isn't returned. Empty in, empty out. Other columns are ignored.
    """
    work = Scratch(edges.sparkSession)
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).dropna()
    both = work.cut("edges", both.union(both.select("dst", "src")).filter(F.col("src") != F.col("dst")).distinct())
    first = work.cut("first", both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label"), F.count("*").alias("n")))
    labels, degrees = first.select("node", "label"), first.select(F.col("node").alias("src"), "n")
    turn = 0
    while True:
        near = skew_join(both, labels.withColumnRenamed("node", "src"), "src", counts=degrees).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        better = work.cut(f"better{turn}", labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        target = better.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        jumped = work.cut(f"labels{turn + 1}", skew_join(better, target, "next").select("node", "label", F.least("next", "beyond").alias("next")))
        changed = jumped.filter(F.col("next") != F.col("label")).limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        work.free(f"better{turn}", f"labels{turn}")
        turn += 1
        if not changed:
            work.free("edges", "first")
            return labels
