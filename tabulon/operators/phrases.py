"""Phrases of several lengths, counted together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import STOP_WORDS, tokens
from tabulon.operators import kernels


def counted(docs: DataFrame, text: Column, lengths: tuple[int, ...]) -> DataFrame:
    """(phrase, n): how often each run of so many words is in the texts; words are of letters, stop words are left out.

    All lengths at a place are starts of one run of the longest length, so that alone moves, counted before and dealt by its
    shortest start; the shorter ones are summed where they arrive, in order.
    """
    least, most = min(lengths), max(lengths)
    words = docs.select(F.array_join(tokens(text), " ").alias("words")).filter("words <> ''")
    runs = words.mapInArrow(kernels.window_counts(least, most, STOP_WORDS), "head string, tail string, n long")
    return runs.repartition("head").sortWithinPartitions("head", "tail").mapInArrow(kernels.start_counts(least, sorted(lengths)), "phrase string, n long")
