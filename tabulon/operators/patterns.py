"""Many patterns in many texts at once: pairs of a text and a pattern that it contains, without meeting every text with every pattern.

A pattern is known by an anchor: its rarest run of GRAM characters among the patterns' own runs, or the whole of a shorter
pattern. Texts are cut into their distinct runs of the anchors' lengths, and only those that are anchors move: an equi-join on
the anchor gives candidates, which are verified by containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an anchor, and the most anchors that are broadcast.
GRAM, SMALL_ANCHORS = 4, 100_000


def grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of n characters of a text; none if it is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def anchors(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, anchor) of the distinct patterns that aren't null or empty: of a pattern's runs the one that fewest patterns hold, then the least."""
    distinct = patterns.select(F.col(pattern).alias("pattern")).filter(F.length("pattern") > 0).distinct()
    short = distinct.filter(F.length("pattern") <= GRAM).select("pattern", F.col("pattern").alias("anchor"))
    runs = distinct.filter(F.length("pattern") > GRAM).select("pattern", F.explode(grams(F.col("pattern"), GRAM)).alias("anchor"))
    held = runs.groupBy("anchor").agg(F.count("*").alias("n"))
    return short.unionByName(runs.join(held, "anchor").groupBy("pattern").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor")))


def holding(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Every row with each distinct pattern that its text contains, in a new column of the pattern's name.

    Rows with a null text and null patterns are in no pair; an empty pattern is in every text that isn't null. Either side
    may have any number of rows; the work grows with the texts' characters and with the candidates that share an anchor.
    Only patterns are sent around while they are few: rows don't move and are never broadcast.
    """
    asked = anchors(patterns, pattern).withColumnsRenamed({"pattern": pattern, "anchor": "_anchor"})
    lengths = sorted(r[0] for r in asked.select(F.length("_anchor")).distinct().collect())  # GRAM values at most
    whole = rows.filter(F.col(text).isNotNull())
    runs = F.flatten(F.array(*[grams(F.col(text), n) for n in lengths])) if lengths else F.array().cast("array<string>")
    cut = whole.withColumn("_anchor", F.explode(runs))
    few = asked.select("_anchor").distinct()
    cut = cut.join(F.broadcast(few) if few.limit(SMALL_ANCHORS + 1).count() <= SMALL_ANCHORS else few, "_anchor", "left_semi")
    met = cut.join(F.broadcast(asked) if asked.limit(SMALL_ANCHORS + 1).count() <= SMALL_ANCHORS else asked.hint("merge"), "_anchor")
    met = met.filter(F.col(text).contains(F.col(pattern))).select(*rows.columns, pattern)
    empty = patterns.filter(F.length(pattern) == 0).limit(1).select(F.lit("").alias(pattern))
    return met.unionByName(whole.join(F.broadcast(empty), F.length(pattern) == 0).select(*rows.columns, pattern))  # one row at most


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(text, pattern): the distinct pairs where the text contains the pattern, as in holding; both keep their names, which differ."""
    return holding(texts.select(text).distinct(), text, patterns, pattern)
