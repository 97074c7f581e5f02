"""What the Jaccard join moves at once: index entries go slice by slice, and differences around stars without their sets' columns."""

import random

import numpy as np
import pytest

from tabulon.llm import jaccard
from tabulon.llm.common import Scratch


@pytest.fixture
def moved(spark, monkeypatch):
    """MB of shuffle that each cut table of a Scratch wrote."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    out, cut = {}, Scratch.cut

    def total():
        bus.waitUntilEmpty()
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) / 1e6

    def measured(self, name, df):
        before = total()
        made = cut(self, name, df)
        out[name] = total() - before
        return made

    monkeypatch.setattr(Scratch, "cut", measured)
    return out


def test_entries_move_in_slices(spark, moved):
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(300))) for i in range(400)]
    rows += [(1000 + i, t + " x") for i, t in rows[:40]]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, i % 1000) for i, _ in rows)
    n = sum(len(e) for _, t in rows for s in [next(jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 4))] for _, e, _ in jaccard.index_entries(s, 85, 2))
    # An entry is 8 bytes that don't compress, so all of them at once are more than this.
    assert 0 < max(v for k, v in moved.items() if k.startswith("met")) < 8e-6 * n


def test_slices_hold_every_entry_once():
    own = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for _, entries, exact in jaccard.index_entries(own, 80, 2):
        parts = list(jaccard.sliced(entries, exact))
        assert len({k for k, _, _ in parts}) == len(parts) and sum(n for _, _, n in parts) == exact
        assert sorted(x for _, e, n in parts for x in e[:n].tolist()) == sorted(entries[:exact].tolist())
        assert sorted(x for _, e, n in parts for x in e[n:].tolist()) == sorted(entries[exact:].tolist())
    assert not list(jaccard.sliced(np.zeros(0, np.uint64), 0))


def test_differences_around_stars_move_slim(spark, moved):
    """Sets that aren't linked with their star, two and two alike: those pairs are found, and items that nobody shares move once."""
    rng = np.random.default_rng(2)
    some = lambda n: rng.integers(-(1 << 62), 1 << 62, n).tolist()
    twins = [some(720) for _ in range(60)]
    rows = [(7, 100 + i, 4500, 4500, twins[i // 2] + some(480), False) for i in range(120)]
    work = Scratch(spark)
    near = work.cut("near", spark.createDataFrame(rows, "star long, node long, n_star int, n int, items array<long>, linked boolean"))
    labels = work.cut("own", spark.createDataFrame([(100 + i, 100 + i) for i in range(120)] + [(7, 7)], "node long, label long"))
    got = {tuple(r) for r in jaccard._apart(near, labels, 80, work).collect()}
    assert got == {(101 + i, 100 + i) for i in range(0, 120, 2)}
    assert moved["shared_items"] < 9e-6 * 120 * 1200
