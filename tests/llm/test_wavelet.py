"""Ranked search by wavelet trees against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tabulon.llm import wavelet
from tests.conftest import DATA
from tests.llm.test_llm import ODD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(rows, items, k):
    docs = [(d, Counter(terms(t))) for d, t, *_ in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, rows, items, k):
    index = wavelet.index_shards(documents(spark, rows)).cache()
    df = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, term int")
    return sorted(map(tuple, wavelet.search(index, df, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    rows = list(ODD) + [(1000 - i, " ".join(word() for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(n)]
    rows += [(2000 + i, "tie here") for i in range(12)] + [(None, "tie here"), rows[-1], (3000, "Ünï w1 W1 w-1 é2")]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 30])))) for i in range(12)]
    return rows, [*items, (50, "TIE"), (51, ""), (52, None), (53, "nowhere"), (3, "word one"), (None, "ünï w1")]


@pytest.mark.parametrize(("seed", "k", "shard", "at_once"), [(1, 5, 1 << 22, 48), (2, 10, 3000, 2), (3, 50, 700, 5)])
def test_against_every_score(spark, monkeypatch, seed, k, shard, at_once):
    monkeypatch.setattr(wavelet, "SHARD_BYTES", shard)
    monkeypatch.setattr(wavelet, "AT_ONCE", at_once)
    rows, items = corpus(seed, 150)
    assert got(spark, rows, items, k) == plain(rows, items, k)


def test_blocks_of_items(spark, monkeypatch):
    rows, items = corpus(5, 60)
    whole = got(spark, rows, items, 7)
    monkeypatch.setattr(wavelet, "BLOCK_TERMS", 40)
    monkeypatch.setattr(wavelet, "BROADCAST_ROWS", 0)
    assert got(spark, rows, items, 7) == whole == plain(rows, items, 7)


def test_index_is_held_shard_by_shard(spark, monkeypatch):
    """Spark holds the rows of a row group at once, so each shard has its own, however many a file has."""
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(wavelet, "search", lambda index, items: index)
    index = wavelet.op12_ranked(spark, DATA)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert max(m.num_rows for m in files) > 5 and max(rows) == 1 and sum(rows) == index.count()
    monkeypatch.undo()
    monkeypatch.setattr(wavelet, "SHARD_BYTES", 700)
    made, items = corpus(8, 60)
    found = wavelet.search(wavelet.stored_index(documents(spark, made)), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain(made, items, 7)
    assert wavelet.stored_index(documents(spark, [])).count() == 0


def test_empty_tables(spark):
    rows, items = corpus(6, 5)
    assert got(spark, [], items, 5) == [] and got(spark, rows, [], 5) == []
    assert got(spark, [(1, None), (2, " .")], items, 5) == []


def test_tree_is_dual_sorted():
    """Each node's stretches hold its documents by falling impact, and the last level is in order of the documents."""
    rng = np.random.default_rng(3)
    docs = np.concatenate([rng.permutation(37)[:20], rng.permutation(37)[:30]]).astype(np.int32)
    impacts = np.concatenate([np.sort(rng.integers(1, 99, 20))[::-1], np.sort(rng.integers(1, 99, 30))[::-1]])
    tree = wavelet.Tree(docs, impacts, 37)
    for start, end, a in ((0, 20, 0), (20, 50, 20)):
        for doc in range(37):
            at = np.array([0]), np.array([start]), np.array([end])
            for level in range(tree.levels):
                inside = [i for d, i in zip(docs[a : a + end - start], impacts[a : a + end - start], strict=True) if d >> (tree.levels - level) == doc >> (tree.levels - level)]
                assert at[2][0] - at[1][0] == len(inside) and (not inside or tree.bounds(at[0], at[1])[0] == max(inside))
                at = (at[0] + 1, *tree.below(at[0], at[1], at[2], doc >> (tree.levels - 1 - level) & 1))
            assert (at[2] - at[1])[0] == (doc in docs[a : a + end - start])


def test_few_nodes_are_opened():
    """The proof stops a search: a rare term's documents decide, so most of the tree stays closed."""
    rng = np.random.default_rng(9)
    rows = [" ".join([f"c{x}" for x in rng.integers(0, 5, 20)] + (["rare"] * 9 if i % 700 == 3 else [])) for i in range(4096)]
    data = np.frombuffer(" ".join(rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])
    offsets[-1] -= 1
    hashes, before = wavelet.terms_of(data, offsets)
    doc = np.repeat(np.arange(len(rows)), np.diff(before)).astype(np.int32)
    pairs, tfs = np.unique(np.stack([hashes, doc.astype(np.uint64)]), axis=1, return_counts=True)
    names, counts = np.unique(pairs[0], return_counts=True)
    shard = {"ids": np.arange(len(rows)), "sizes": np.diff(before), "terms": names.view(np.int64), "counts": counts, "docs": pairs[1].astype(np.int32), "tfs": tfs}
    asked = [wavelet.terms_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0] for w in ("rare", "c1", "c2")]
    best = wavelet.Best(1, 5)
    opened = wavelet.search_shard(shard, (np.zeros(3, np.int64), np.array(asked), np.array([6000, 30, 30])), len(rows), int(before[-1]), best)
    assert len(best.rows[0]) == 5 and all(i % 700 == 3 for i in best.rows[2]) and opened < 400
