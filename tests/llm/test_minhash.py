"""b-bit MinHash: estimates, recall against brute force, hot groups and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import common, jaccard, minhash
from tests.llm.test_llm import ODD, brute_components, documents


def near(spark, rows, words=3, percent=85):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, rows), words, percent).collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice(["p", "q", "r"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = list(ODD)
    for family in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([2, 5, 30, 90, 300]))]
        for k in range(rng.randrange(2, 14)):
            rows.append((100 * (family + 1) + k, " ".join(edited(rng, words, rng.choice([0, 0, 0.01, 0.02, 0.04, 0.1])))))
    rows += [(None, rows[-1][1]), rows[-1], (9000, None)]
    assert near(spark, rows) == brute_components(rows, 3, 85)


def test_estimates_near_the_true_similarity(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for true in (0.0, 0.3, 0.6, 0.85, 1.0):
        for n in (40, 400, 3000):
            both, own = int(n * true), (n - int(n * true)) // 2
            items = np.unique(rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64))
            a, b = items[: both + own], np.concatenate([items[:both], items[both + own :]])
            sign = minhash.packed(minhash.minima([np.sort(a), np.sort(b)]))
            pairs.append((both / max(1, both + 2 * own), sign[0].tolist(), sign[1].tolist()))
    df = spark.createDataFrame(pairs, "true double, a array<long>, b array<long>")
    got = df.select("true", minhash.estimate(F.col("a"), F.col("b")).alias("about")).collect()
    assert all(abs(r.true - r.about) < 0.16 for r in got)
    assert all(r.about == 1 for r in got if r.true == 1)
    assert 0.6 < minhash.least_estimate(85) < 0.7


def test_bands_meet_at_the_limit():
    """Two sets of similarity 0.85 share a band, each of many times."""
    rng = np.random.default_rng(8)
    for n in (40, 200):
        for _ in range(300):
            items = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            own = round(0.15 * len(items) / 2)
            a, b = items[own:], items[: len(items) - own]
            entries = minhash.band_entries(minhash.minima([a, b]))
            assert (entries[0] == entries[1]).any()


def test_kept_rows(spark):
    rows = [(4, "a b c d e f"), (2, "A b  c d e f"), (9, "x y z w v"), (3, ""), (5, None), (None, "n o p q"), (None, "n o p q")]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got == {(4, 2, False), (2, 2, True), (9, 9, True), (3, 3, True), (5, 5, True), (None, None, True)}
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_with_everything_hot(spark, monkeypatch):
    for module in (common, jaccard):
        monkeypatch.setattr(module, "HOT_ROWS", 3)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.015))) for i in range(150)] + [(1000 + i, " ".join(base)) for i in range(40)]
    # A passage that many unlinked texts share.
    rows += [(2000 + i, " ".join(base[:60] + [f"v{i}x{j}" for j in range(40)])) for i in range(60)]
    assert near(spark, rows) == brute_components(rows, 3, 85)
