"""Rubrics for answers and rollups of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names and phrases that the rubric looks for.
TOOLS = ["get_demographic_data", "compare_locations", "search_census_knowledge"]
ADAPTIVE = ["instead", "alternative", "however", "but", "although", "different approach", "another way", "let me try"]
REASONING = ["because", "therefore", "first", "then", "next", "finally", "this means", "as a result", "consequently"]
CHAIN = ["first", "then", "next", "step", "because", "therefore"]
WORDS = {
    "limitation": ["not available", "limitation", "cannot", "not collected"],
    "disambiguation": ["clarify", "which", "specify", "need more", "ambiguous"],
    "caveat": ["caveat", "limitation", "note that", "however", "but"],
}


def count_of(text: Column, words: list[str]) -> Column:
    """How many of words occur in text."""
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def reasoning_chain(text: Column, most: int = 5) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_join(F.slice(F.filter(lines, lambda x: F.lower(x).rlike("|".join(CHAIN))), 1, most), " | ")


def correctness(text: Column, kind: Column, truth: Column) -> Column:
    """By kind: the share of the true ids that are named, or whether a word of the kind occurs, or by length."""
    low = F.lower(text)
    share = F.when(F.size(truth) > 0, F.least(F.lit(1.0), F.aggregate(truth, F.lit(0.0), lambda a, t: a + low.contains(F.lower(t)).cast("double")) / F.size(truth))).otherwise(0.0)
    out = F.when(kind == "variable", share)
    for k, words in WORDS.items():
        out = out.when(kind == k, (count_of(low, words) > 0).cast("double"))
    return out.otherwise(F.when(F.length(text) > 100, 0.8).otherwise(0.3))


def plan_quality(text: Column, kind: Column) -> Column:
    data = text.contains(TOOLS[0]) | text.contains(TOOLS[1])
    search = text.contains(TOOLS[2])
    return (
        F.when(kind.isin("variable", "geographic", "calculation"), F.when(data, 0.9).when(search, 0.7).otherwise(0.3))
        .when(kind.isin("limitation", "caveat", "concept"), F.when(search, 0.9).when(F.length(text) > 200, 0.7).otherwise(0.4))
        .otherwise(F.when(F.length(text) > 150, 0.8).otherwise(0.5))
    )


def rubric(answers: DataFrame, text: str, kind: str, truth: str) -> DataFrame:
    """answers with correctness, plan_quality, coordination, adaptation, clarity and passed."""
    t, low = F.col(text), F.lower(F.col(text))
    tools = count_of(t, TOOLS)
    scored = answers.withColumns({
        "correctness": correctness(t, F.col(kind), F.col(truth)),
        "plan_quality": plan_quality(t, F.col(kind)),
        "coordination": F.when(tools == 0, 0.0).when(tools == 1, 0.8).otherwise(0.9),
        "adaptation": F.least(count_of(low, ADAPTIVE) / 3.0, F.lit(1.0)),
        "clarity": F.when(F.length(t) > 200, 0.3).otherwise(0.1) + F.least(count_of(low, REASONING) / 5.0, F.lit(0.7)),
    })
    return scored.withColumn("passed", (F.col("correctness") >= 0.7) & (F.col("plan_quality") >= 0.6))


def smoke_grade(top_text: Column, expect: Column, avoid: Column) -> Column:
    """1 if half of the expected terms and none to avoid are in the first 200 characters, 0.5 if some expected one is, else 0."""
    head = F.lower(F.substring(top_text, 1, 200))
    n = lambda words: F.aggregate(words, F.lit(0), lambda a, w: a + head.contains(F.lower(w)).cast("int"))
    return F.when((n(expect) >= F.floor(F.size(expect) / 2)) & (n(avoid) == 0), 1.0).when(n(expect) > 0, 0.5).otherwise(0.0)


def rollup_by(results: DataFrame, category: str, passed: Column, scores: list[str]) -> DataFrame:
    """Per category: total, passed, pass rate, and the mean of the rows' mean scores."""
    mean = sum((F.col(s) for s in scores[1:]), F.col(scores[0])) / len(scores)
    n = F.sum(passed.cast("int"))
    return results.groupBy(category).agg(F.count("*").alias("total"), n.alias("passed"), F.round(n / F.count("*"), 6).alias("pass_rate"), F.round(F.avg(mean), 6).alias("mean_score"))


def compare_runs(base: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """key, base score, new score and improvement of what both runs hold."""
    return base.select(key, F.col(score).alias("base_score")).join(new.select(key, F.col(score).alias("new_score")), key).withColumn("improvement", F.round(F.col("new_score") - F.col("base_score"), 6))
