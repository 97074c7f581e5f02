"""Answers within a state, prefixes of any number of lengths, records over several files, quotas, numbers and scratch folders."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabulon.operators import answer, enrich, sample, vector
from tabulon.sources import files, sinks

ESTIMATES = [
    ("us", "United States", "V", 1000.0, 10.0), ("state", "Missouri", "V", 500.0, 9.0), ("state", "Illinois", "V", 400.0, 9.0),
    ("county", "Greene County, Missouri", "V", 70.0, 7.0), ("county", "Greene County, Illinois", "V", 60.0, 7.0),
    ("place", "Springfield city, Illinois", "V", 10.0, 1.0), ("place", "Springfield city, Missouri", "V", 99.0, 3.0), ("place", "Springfield town, Vermont", "V", 5.0, None), ("place", "Lone city", "V", 7.0, 1.0),
]


def test_answers_stay_in_their_state(spark):
    estimates = spark.createDataFrame(ESTIMATES, "level string, name string, code string, estimate double, moe double")
    asked = ["Springfield, MO", "Springfield, IL", "Springfield, Vermont", "Springfield, TX", "Springfield", "Missouri", "Greene County, MO", "Greene County, Illinois", "USA", "Lone, TX", "Ohio", None]
    requests = spark.createDataFrame([(i, x, "v") for i, x in enumerate(asked)] + [(99, "USA", None)], "request_id int, location string, variable string")
    codes = spark.createDataFrame([("v", "V")], "variable string, code string")
    got = {r.request_id: (r.name, r.estimate, r.error is None) for r in answer.answer(requests, codes, estimates).collect()}
    assert [got[i][0] for i in range(len(asked))] == [
        "Springfield city, Missouri", "Springfield city, Illinois", "Springfield town, Vermont", None, "Springfield city, Illinois", "Missouri",
        "Greene County, Missouri", "Greene County, Illinois", "United States", "Lone city", None, None,
    ]
    assert got[0][1] == 99.0 and not got[3][2] and got[99] == (None, None, False)
    sure = {r.request_id: (r.confidence, r.candidates) for r in answer.answer(requests, codes, estimates).collect()}
    assert sure[4] == ("low", 2) and sure[0] == ("low", 1) and sure[3][1] == 0


def test_prefixes_of_many_lengths(spark):
    dim = [("k" * n, f"c{n}", n) for n in range(1, 1200)] + [("a", "first", 2), ("a", "zero", 1), (None, "none", 0), ("", "empty", 0), ("ab", "ab", 9)]
    dim = spark.createDataFrame(dim, "id string, category string, ordinal int")
    rows = spark.createDataFrame([("k" * 1150,), ("k" * 1300,), ("a",), ("abc",), ("abc",), ("zz",), (None,)], "id string")
    got = sorted((r.id or "", r.category) for r in enrich.category_by_prefix(rows, "id", dim).collect())
    # An equal key first, else the first prefix by ordinal.
    assert got == sorted([("k" * 1150, "c1150"), ("k" * 1300, "c1"), ("a", "zero"), ("abc", "zero"), ("abc", "zero"), ("zz", "uncategorized"), ("", "uncategorized")])
    assert {r.category for r in enrich.category_by_prefix(rows, "id", dim.limit(0)).collect()} == {"uncategorized"}


def test_records_over_several_files(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_text(json.dumps(data))
    put("a.json", [{"variable_id": "W", "n": 1}, {"variable_id": "V", "n": 1}, {"n": 5}])
    put("b.json", [{"variable_id": "V", "n": 2}, {"variable_id": "U", "n": 2}])
    put("c.json", {"variables": {"U": {"n": 3}}})
    got = {r.variable_id: json.loads(r.record)["n"] for r in files.enriched_records(spark, str(tmp_path)).collect()}
    assert got == {"W": 1, "V": 2, "U": 3}


def test_quota_fill_keeps_rows_without_family(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, None)], "id int, family string")
    assert {r.id for r in sample.quota_fill(rows, "id", "family", [("x", 1)], 3).collect()} == {1, 2, 3}
    assert sample.quota_fill(rows, "id", "family", [("x", 1)], 2).count() == 2


def test_numbered_by_any_keys(spark):
    keys = [None, -5, -5, 0, 3, 10**15] + list(range(100, 900, 3))
    got = sample.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 16).collect()
    assert sorted(r.number for r in got) == list(range(len(keys)))
    by = sorted(got, key=lambda r: r.number)
    assert [r.k for r in by] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sample.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_nearest_leaves_out_what_has_no_score(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.5, 0.5]), (5, [float("nan"), 1.0])], "id int, v array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [0.0, 0.0])], "q int, w array<double>")
    got = [(r.q, r.id, r["rank"]) for r in vector.nearest(rows, queries, vector.cosine(F.col("v"), F.col("w")), "q", "id", 5).collect()]
    assert sorted(got) == [(10, 1, 1), (10, 4, 2)]


def test_scratch_asks_for_a_shared_folder():
    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named if k == "spark.checkpoint.dir" else master))
    assert sinks.scratch(session("spark://h:7077", "hdfs://a/b/")).startswith("hdfs://a/b/sinks/")
    assert os.path.isdir(sinks.scratch(session("local[2]")))
    for master in ("local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            sinks.scratch(session(master))


def test_weights_of_scores_that_sum_to_zero(spark):
    """Three scores of 0 have no shares, as in the SQL: NaN for each category, not 1 for the first."""
    rows = spark.createDataFrame([(1, c, 0.0) for c in (0, 1, 3)] + [(2, 0, 0.6), (2, 1, 0.2), (2, 3, 0.2)], "id int, c int, score double")
    got = [(r.id, r.c, str(round(r.weight, 6))) for r in vector.category_weights(rows, "id", "c", 0.15).orderBy("id", "c").collect()]
    assert got == [(1, 0, "nan"), (1, 1, "nan"), (1, 3, "nan"), (2, 0, "0.6"), (2, 1, "0.2"), (2, 3, "0.2")]
    assert {r.weight for r in vector.category_weights(rows.filter("id = 1"), "id", "c", 0.15, log=True).collect()} <= {1.0, 1 / 3}


def test_geography_weights_of_a_vector_against_all_centroids(spark, tmp_path):
    """A vector whose similarity to every centroid is negative has NaN as its linear weight, in the query and in its SQL."""
    import duckdb

    from tabulon.plans.registry import ORACLE_SQL, QUERIES
    from tests.conftest import same

    rows = [(i, [1.0, i / 10], i % 4) for i in range(8)] + [(8, [-1.0, -0.1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("geography_weights", "category_weights_linear"):
        got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), own.sql(ORACLE_SQL[name]).df()
        same(got, want)
        assert got[got.vec_id == 8].weight.isna().all() and len(got[got.vec_id == 8]) == (1 if name == "geography_weights" else 4)
