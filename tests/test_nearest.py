"""Exact nearest vectors against all pairs, with fewer pairs scored, on odd vectors."""

import random

import numpy as np
import pytest

from tabulon.operators import nearest


def plain(rows, queries, k, metric, others=False):
    fine = lambda v: v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and (metric == "l2" or any(v))
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and fine(v)]
    first = {}
    for i, v in queries:
        if i is not None and fine(v):
            first[i] = min(first.get(i, v), v)
    out = []
    for q, w in first.items():
        w = np.array(w, float)
        score = lambda v: round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9) if metric == "cosine" else round(float(1 - ((v - w) ** 2).sum()), 9)  # noqa: E731, B023
        best = sorted((-score(v), i) for i, v in rows if not (others and i == q))[:k]
        out += [(q, i, round(-s, 6), n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def table(seed, n, centres):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 6)) * 4
    rows = [(i, (middle[i % centres] + rng.normal(size=6) * 0.3).tolist()) for i in range(n)]
    rows += [(5000 + i, rows[i][1]) for i in range(9)] + [rows[3], (None, rows[4][1]), (6001, None), (6002, [0.0] * 6), (6003, [1.0, None, 0, 0, 0, 0]), (6004, [float("nan")] * 6), (6005, [1.0] * 5), (6006, [float("inf"), 1, 1, 1, 1, 1])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]


@pytest.mark.parametrize(("metric", "others", "block"), [("cosine", False, 50), ("l2", True, 20), ("l2", False, 32_768)])
def test_against_all_pairs(spark, monkeypatch, metric, others, block):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearest, "CELL_ROWS", 20 if block < 1_000 else 4_096)
    rows = table(3, 400, 12)
    queries = [rows[i] for i in random.Random(1).sample(range(len(rows)), 40)] + [rows[3], rows[-1], rows[-6], (None, rows[0][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "q long, w array<double>")
    got = nearest.nearest_vectors(df, asked, "id", "v", "q", "w", 4, metric, others=others)
    assert sorted((r.q, r.id, round(r.score, 6), r["rank"]) for r in got.collect()) == plain(rows, queries, 4, metric, others)


def test_most_pairs_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 100)
    monkeypatch.setattr(nearest, "CELL_ROWS", 60)
    rows = table(5, 4000, 40)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame(rows[::60], "q long, w array<double>")
    for metric in ("cosine", "l2"):
        n = nearest.nearest_vectors(df, asked, "id", "v", "q", "w", 5, metric, counted=True).first()
        assert n.pairs < n.all / 4


def test_threshold_and_empty_tables(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    df, asked = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(rows[:1], "q long, w array<double>")
    assert [r.id for r in nearest.nearest_vectors(df, asked, "id", "v", "q", "w", 3, "cosine", 0.6).orderBy("rank").collect()] == [0, 1]
    assert nearest.nearest_vectors(df.limit(0), asked, "id", "v", "q", "w", 3).count() == 0
    assert nearest.nearest_vectors(df, asked.limit(0), "id", "v", "q", "w", 3).count() == 0
