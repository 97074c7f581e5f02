"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tabulon.operators.chunk import pack
from tabulon.operators.merge import GreedyBatches


class BatchTable:
    """greedy_batches(TABLE(key, ordinal, cost) PARTITION BY (key) ORDER BY (ordinal), budget): key, ordinal, batch."""

    def __init__(self):
        self.state = GreedyBatches()

    def eval(self, row, budget: float):
        yield row[0], row[1], self.state.next(row[2], float(budget))


class ChunkTable:
    """text_chunks(text, most, overlap): number (from 0), chunk of a text's paragraphs."""

    def eval(self, text: str, most: int, overlap: int):
        parts = [" ".join(p.split()) for p in (text or "").split("\n")]
        yield from enumerate(pack([p for p in parts if p], most, overlap, "\n"))


def register(spark: SparkSession) -> None:
    """Makes greedy_batches and text_chunks known to the session's SQL."""
    spark.udtf.register("greedy_batches", udtf(BatchTable, returnType="key bigint, ordinal bigint, batch int"))
    spark.udtf.register("text_chunks", udtf(ChunkTable, returnType="number int, chunk string"))
