"""The stored index: searches equal those over texts, appends equal a rebuild, slices are skipped, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions.text import tokens
from tabulon.operators import lexical, textindex




@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 30, 120]))), 1) for i in range(500)]
    rows += [(900, None, 1), (901, "", 1), (None, "w1 w2", 1), (7, "again w1 w1", 1), (902, "Mixed CASE words!", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, tf int").cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(12)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3])))) for i in range(30)] + [(50, "unheard w1"), (51, ""), (52, None), (53, "w1 w1 w2")]
    return spark.createDataFrame(rows, "query_id int, q string").select("query_id", tokens(F.col("q")).alias("words")).cache()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def plain_bm25(corpus, asked, k):
    named = corpus.filter("doc_id IS NOT NULL")
    return rows(lexical.bm25(asked, lexical.postings(named, "doc_id", F.col("text")), "doc_id", k), "query_id", "doc_id", "score", "rank")


@pytest.mark.parametrize("k", [1, 4])
def test_searches_equal_those_over_texts(spark, corpus, asked, tmp_path, monkeypatch, k):
    monkeypatch.setattr(textindex, "SLICE_DOCS", 8)
    index = textindex.build_index(corpus, "doc_id", F.col("text"), f"{tmp_path}/x")
    assert rows(textindex.bm25_indexed(index, asked, k), "query_id", "id", "score", "rank") == plain_bm25(corpus, asked, k)
    named = corpus.filter("doc_id IS NOT NULL")
    plain = lexical.keyword_search(asked, lexical.postings(named, "doc_id", F.col("text")), "doc_id", k)
    columns = ("matches", "score", "confidence", "rank")
    assert rows(textindex.overlap_indexed(index, asked, k), "query_id", "id", *columns) == rows(plain, "query_id", "doc_id", *columns)
    weights = spark.createDataFrame([(i, i % 10 / 10) for i in range(0, 500, 2)], "doc_id long, weight double")
    plain = lexical.keyword_search(asked, lexical.postings(named, "doc_id", F.col("text")), "doc_id", k, weights)
    assert rows(textindex.overlap_indexed(index, asked, k, weights), "query_id", "id", *columns) == rows(plain, "query_id", "doc_id", *columns)


def test_appends_and_merges_equal_a_rebuild(spark, corpus, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SLICE_DOCS", 16)
    part = lambda *rest: corpus.filter(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == rest[0] if len(rest) == 1 else (F.coalesce(F.col("doc_id"), F.lit(0)) % 3).isin(*rest))
    one = textindex.build_index(part(0), "doc_id", F.col("text"), f"{tmp_path}/x")
    two = textindex.append_index(one, part(0, 1), "doc_id", F.col("text"))
    three = textindex.append_index(two, part(2), "doc_id", F.col("text"))
    four = textindex.merge_index(three)
    whole = plain_bm25(corpus, asked, 3)
    stats = rows(textindex.token_stats(four), "token", "df", "tf")
    for index in (three, four, textindex.open_index(spark, one.path)):
        assert rows(textindex.bm25_indexed(index, asked, 3), "query_id", "id", "score", "rank") == whole
        assert rows(textindex.token_stats(index), "token", "df", "tf") == stats
    assert textindex.open_index(spark, one.path).version == 4 and len(four.segments) == 1 and len(three.segments) == 3
    # An earlier version stays what it was.
    old = textindex.open_index(spark, one.path, 1)
    assert old.n_docs == one.n_docs < four.n_docs and old.segments == one.segments
    with pytest.raises(ValueError):
        textindex.open_index(spark, one.path, 9)


def test_segments_without_manifest_are_not_seen(spark, corpus, asked, tmp_path, monkeypatch):
    """A job that is lost before its manifest is written leaves the version before as it was."""
    index = textindex.build_index(corpus.filter("doc_id < 100"), "doc_id", F.col("text"), f"{tmp_path}/x")
    before = rows(textindex.bm25_indexed(index, asked, 2), "query_id", "id", "score")
    real = textindex._publish
    monkeypatch.setattr(textindex, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        textindex.append_index(index, corpus, "doc_id", F.col("text"))
    monkeypatch.setattr(textindex, "_publish", real)
    again = textindex.open_index(spark, index.path)
    assert again.version == 1 and rows(textindex.bm25_indexed(again, asked, 2), "query_id", "id", "score") == before
    assert textindex.append_index(again, corpus, "doc_id", F.col("text")).version == 2


def test_slices_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SLICE_DOCS", 4)
    docs = spark.createDataFrame([(i, "a b " + "c " * (i % 40)) for i in range(800)] + [(1000 + i, "a a a a b b b b rare") for i in range(3)], "doc_id long, text string")
    index = textindex.build_index(docs, "doc_id", F.col("text"), f"{tmp_path}/x")
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["rare", "a"])], "query_id int, words array<string>")
    counted = {r.query_id: (r.slices, r.scored) for r in textindex.bm25_indexed(index, asked, 2, counted=True).collect()}
    assert counted[1][0] > 50 and counted[1][1] < counted[1][0] / 2
    assert rows(textindex.bm25_indexed(index, asked, 2), "query_id", "id", "score", "rank") == rows(lexical.bm25(asked, lexical.postings(docs, "doc_id", F.col("text")), "doc_id", 2), "query_id", "doc_id", "score", "rank")


def test_few_tokens_read_few_folders(spark, corpus, asked, tmp_path):
    index = textindex.build_index(corpus, "doc_id", F.col("text"), f"{tmp_path}/x")
    plan = textindex._asked_blocks(index, spark.createDataFrame([("w1",)], "token string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,w1)]" in plan


def test_phrases_and_empty_tables(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick the brown"), (3, "Brown, fox"), (4, None)], "doc_id long, text string")
    index = textindex.build_index(docs, "doc_id", F.col("text"), f"{tmp_path}/x")
    asked = spark.createDataFrame([(1, ["quick", "brown"]), (2, ["brown", "fox"]), (3, []), (4, ["fox", "brown"]), (5, ["own"])], "query_id int, words array<string>")
    assert rows(textindex.phrase_search(index, docs, "doc_id", F.col("text"), asked), "query_id", "id") == [(1, 1), (2, 1), (2, 3)]
    none = textindex.build_index(docs.limit(0), "doc_id", F.col("text"), f"{tmp_path}/none")
    assert none.n_docs == 0 and textindex.bm25_indexed(none, asked, 3).count() == 0 and textindex.overlap_indexed(none, asked, 3).count() == 0
    assert textindex.append_index(none, docs, "doc_id", F.col("text")).n_docs == 3
