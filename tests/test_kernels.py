"""What a slice's task does, and that searches and merges of the index move no single postings."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.operators import kernels, textindex


def test_blocks_of_slices(monkeypatch):
    """Slices over several batches, ids of several rows, texts cut into small parts that are joined again."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(3), rng.randrange(40), 7, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 9)))) for _ in range(200))
    want = {}
    for s, i, _, text in rows:
        for w in text.split(" "):
            want[s, w, i] = want.get((s, w, i), 0) + 1
    monkeypatch.setattr(kernels, "ROWS", 5)
    monkeypatch.setattr(kernels, "PAIRS", 50)
    whole = pa.RecordBatch.from_pylist([dict(zip(("slice", "id", "dl", "words"), r)) for r in rows])
    blocks = [r for b in kernels.slice_blocks(whole.slice(a, 7) for a in range(0, 200, 7)) for r in b.to_pylist()]
    assert len({(r["slice"], r["token"]) for r in blocks}) == len(blocks)
    assert {(r["slice"], r["token"], i): n for r in blocks for i, n in zip(r["ids"], r["tfs"])} == want
    assert all(r["n"] == len(r["ids"]) == len(set(r["ids"])) and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == 7 for r in blocks)


@pytest.mark.parametrize("tokens", [1, 1024])
def test_best_overlaps(monkeypatch, tokens):
    monkeypatch.setattr(kernels, "TOKENS", tokens)
    lists = [([3, 1, 9], [0, 4], [1.0, 2.0]), ([9, 1], [4], [1.0]), ([5], [0], [3.0])]
    rows = [{"_block": 0, "slice": 8, "ids": i, "tfs": [1] * len(i), "dls": [1] * len(i), "places": p, "needed": [0] * len(p), "weights": w} for i, p, w in lists]
    more = {"_block": 0, "slice": 8, "ids": [9, 5, 7], "tfs": [1, 2, 1], "dls": None, "places": None, "needed": None, "weights": [0.5, 0.4, 0.9]}
    schema = pa.schema([("_block", pa.int32()), ("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("needed", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])
    run = lambda k, rows, weighted: sorted(tuple(r.values())[1:] for b in kernels.best_overlaps(k, weighted)(iter([pa.RecordBatch.from_pylist(rows[:2], schema), pa.RecordBatch.from_pylist(rows[2:], schema)])) for r in b.to_pylist())
    assert run(2, rows, False) == [(0, 1, 1, 1.0), (0, 5, 3, 3.0), (4, 1, 3, 3.0), (4, 9, 3, 3.0)]
    # An id of several weights counts for each; ids without weight or hits don't.
    assert run(9, [*rows, more], True) == sorted([(0, 5, 3, 3 * 1.4), (0, 5, 3, 3 * 1.4), (0, 9, 1, 1.5), (4, 9, 3, 4.5)])


def test_searches_move_blocks(spark, tmp_path):
    """Postings of a common token aren't exploded into rows for each query that asks for it."""
    docs = spark.createDataFrame([(i, f"the w{i % 7} the end") for i in range(40)], "doc_id long, text string")
    index = textindex.build_index(docs, "doc_id", F.col("text"), f"{tmp_path}/x")
    asked = spark.createDataFrame([(q, ["the", f"w{q}"]) for q in range(9)], "query_id int, words array<string>")
    weights = spark.createDataFrame([(1, 0.5), (1, 0.5), (8, 0.4), (2, 0.1)], "doc_id long, weight double")
    found = textindex.overlap_indexed(index, asked, 3, weights)
    assert [(r.id, r.matches, r.rank) for r in found.filter("query_id = 1").orderBy("rank").collect()] == [(1, 2, 1), (1, 2, 2), (8, 2, 3)]
    for df in (found, textindex.overlap_indexed(index, asked, 3), textindex.bm25_indexed(index, asked, 3), textindex.phrase_search(index, docs, "doc_id", F.col("text"), asked)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(ids" not in plan and "explode(arrays_zip(ids" not in plan


def test_merges_keep_full_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "SLICE_DOCS", 4)
    docs = lambda a, z: spark.createDataFrame([(i, f"a b w{i % 7}") for i in range(a, z)], "doc_id long, text string")
    one = textindex.build_index(docs(0, 200), "doc_id", F.col("text"), f"{tmp_path}/x")
    two = textindex.append_index(one, docs(190, 201), "doc_id", F.col("text"))
    merged = textindex.merge_index(two)
    sizes = lambda i: {r.slice: r.n for r in i.slices().groupBy("slice").agg(F.count("*").alias("n")).collect()}
    full = {s for s, n in sizes(two).items() if n >= 2}
    assert full and full <= set(sizes(merged)) and sum(sizes(merged).values()) == 201 and len(merged.segments) == 1
    assert {r.token: r.df for r in textindex.token_stats(merged).collect()} == {r.token: r.df for r in textindex.token_stats(two).collect()}


def test_phrases_against_a_plain_count(spark, monkeypatch):
    """Every phrase of two to four words, of texts in small parts; what moves is one run a place, not one row a phrase."""
    from collections import Counter

    from tabulon.operators import phrases

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["red", "Blue", "the", "rod", "x9", "a-b"]) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "", "red", "red the blue"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for lengths in ((2, 3), (2, 3, 4), (2,), (3, 4)):
        want = Counter()
        for t in texts:
            w = [x for x in (t or "").lower().replace("-", " ").split() if x not in ("the", "a", "x9")]
            want.update(" ".join(w[i : i + n]) for n in lengths for i in range(len(w) - n + 1))
        got = phrases.counted(df, F.col("text"), lengths)
        assert {r.phrase: r.n for r in got.collect()} == want
        got = phrases.counted(df, F.col("text"), lengths)._jdf.queryExecution().executedPlan().toString()
        assert got.count("Exchange hashpartitioning") + got.count("REPARTITION_BY_COL") <= 2 and got.count("Exchange") == 1
    assert phrases.counted(df.limit(0), F.col("text"), (2, 3)).count() == 0


def test_packing_keeps_few_rows_as_python_strings(spark):
    """Chunks of a batch come from Arrow rows, FOLDED at a time; nulls, empty rows and more rows than that."""
    from tabulon.operators import chunk

    rows = [(i, None if i % 7 == 0 else [f"s{i}"] * (i % 5)) for i in range(3 * chunk.FOLDED + 5)]
    df = spark.createDataFrame(rows, "id int, parts array<string>").coalesce(1)
    got = {r.id: r.x for r in df.select("id", chunk.packed(F.col("parts"), 6, 0, " ").alias("x")).collect()}
    assert got == {i: None if p is None else chunk.pack(p, 6, 0, " ") for i, p in rows}
