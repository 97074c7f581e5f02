"""Texts that contain patterns, against every pair, and without nested loops in the plan."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import geo, lexical, patterns


@pytest.mark.parametrize("small", [100_000, 0])
def test_against_every_pair(spark, monkeypatch, small):
    monkeypatch.setattr(patterns, "SMALL_ANCHORS", small)
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [some(rng.randrange(0, 30)) for _ in range(120)] + ["", None, "abc", "aaaa" * 200]
    keys = [some(rng.randrange(1, 8)) for _ in range(90)] + ["", None, "a", "aaaa", "aaaaa", "never there at all"]
    df = lambda rows, c: spark.createDataFrame([(x, 1) for x in rows + rows[:5]], f"{c} string, extra int")
    got = [tuple(r) for r in patterns.contained(df(texts, "t"), "t", df(keys, "k"), "k").collect()]
    want = {(t, k) for t in texts for k in keys if t is not None and k is not None and k in t}
    assert len(got) == len(set(got)) and set(got) == want


def test_plans_have_no_nested_loops(spark):
    queries = spark.createDataFrame([(i, f"text {i} of words") for i in range(50)], "query_id int, q string")
    dim = spark.createDataFrame([(f"text {i}", f"C{i}", i) for i in range(50)], "key string, code string, ordinal int")
    loose = lexical.first_contained(queries, dim, "q", "key")
    places = geo.match_places(dim.select(F.col("key").alias("place")), queries.select(F.col("q").alias("name")))
    words = dim.select(F.lit("x").alias("concept_id"), F.col("key").alias("keyword"))
    scored = lexical.candidate_scores(words, queries.select(F.col("q").alias("variable_id"), F.col("q").alias("label"), F.col("q").alias("concept")))
    for df in (loose, places, scored):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The one nested loop that may stay is the empty pattern's, of one row at most.
        assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2
    assert loose.count() == 50 and scored.count() == 15


def test_concept_keywords(spark):
    concepts = spark.createDataFrame([(1, "Home Value", "Median value"), (2, "My Home Value x", None), (3, "none", "a  b"), (4, None, None)], "concept_id int, concept string, definition string")
    keys = spark.createDataFrame([("homevalue", ["A", "home value"], 0), ("home", ["B"], 1), ("value", ["C"], 2)], "key string, keywords array<string>, ordinal int")
    got = {}
    for r in lexical.concept_keywords(concepts, keys).orderBy("place").collect():
        got.setdefault(r.concept_id, []).append(r.keyword)
    assert got == {1: ["A", "home value", "median", "value"], 2: ["A", "home value", "B", "C"], 3: ["a", "b"]}
