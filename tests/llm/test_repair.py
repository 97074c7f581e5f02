"""Conversation repair against every possible edit, over ranges that cut conversations, and on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabulon.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """(audit, cost, repaired) of rows (role, text, fault) by trying the cheapest edits, ASCII-least."""
    best = {}

    def go(at, state, cost, audit, lines):
        key = (at, state)
        if key in best and best[key][:2] <= (cost, audit) or cost > 2 * len(rows):
            return
        best[key] = (cost, audit, lines)
        role, after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}[state]
        go(at, after, cost + 5, audit + "I", [*lines, f"{role}:"])
        if at == len(rows):
            return
        own, text, fault = rows[at]
        go(at + 1, state, cost + 2, audit + "D", lines)
        if fault in ("", "truncated"):
            more = 5 * (fault == "truncated")
            if own[:1] == role[0]:
                go(at + 1, after, cost + more, audit + "K", [*lines, f"{own}:{text}"])
            if own[:1] == "s" and state == 0:
                go(at + 1, 1, cost + more, audit + "K", [*lines, f"{own}:{text}"])
            go(at + 1, after, cost + more + 1, audit + "R", [*lines, f"{role}:{text}"])

    # All paths in order of (cost, audit) can't be pruned by state while audits of one length class differ, so prune by equal state only.
    go(0, 0, 0, "", [])
    return min(v for (at, state), v in best.items() if at == len(rows) and state in (0, 3))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def ordered(rows):
    tie = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return sorted(filled, key=lambda r: (r[1] is not None, r[1] or 0, tie(r)))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = ordered([r for r in rows if r[0] == conv])
        marked = faults([(r[2], r[3]) for r in own])
        cost, audit, lines = plain(marked)
        turns = [r[1] for r in own if r[1] is not None]
        first = [r[0][:1] for r in marked]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(r[2] == f for r in marked) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def summary(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.repair_summary(df).collect()}


def conversations(rng, n, most):
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", "a\nb. ", "é.", None]
    return [(None if c == 0 else c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "sys"]), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_edit(spark, seed):
    rows = conversations(random.Random(seed), 40, 9)
    got, want = summary(spark.createDataFrame(rows, SCHEMA)), expected(rows)
    assert got == want


def test_ranges_cut_a_conversation(spark):
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No.", "cut", ""]) + (f" {t}." if rng.random() < 0.7 else "")) for t in range(700)] + conversations(rng, 5, 6)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        parts = df.repartitionByRange("conv_id", "turn").select(F.spark_partition_id().alias("p"), "conv_id").filter("conv_id = 5").distinct().count()
        assert parts > 2
        many = summary(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = summary(df.coalesce(1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
    assert many == one
    # The costs of the scan and the edits of the trace agree.
    price = lambda audit: sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit)
    own = faults([(r[2], r[3]) for r in ordered([r for r in rows if r[0] == 5])])
    audit = many[5][6]
    kept = [f for (_, _, f), e in zip(own, [c for c in audit if c != "I"], strict=True) if e != "D"]
    assert many[5][5] == price(audit) + 5 * kept.count("truncated")


def test_repaired_turns_digest_to_the_summary(spark):
    rows = [*conversations(random.Random(3), 12, 8), (99, 1, "user", "Same."), (99, 1, "user", "Same."), (99, 2, "assistant", "Long. " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, edit int, tie string")
    turns = {}
    for r in repair.repaired_turns(df).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.edit, f"{r.role}:{r.text}"))
    sums = summary(df)
    for conv, s in sums.items():
        own = sorted(turns.get(conv, []))
        assert [p for p, _, _ in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(x for _, _, x in own).encode()).hexdigest() == s[7]
        assert "".join(e for _, e, _ in own) == s[6].replace("D", "")
    assert sums[99][1:4] == (0, 1, 0) and sums[99][6] in ("KDK",)


def test_empty_table_and_lost_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_summary(none).count() == 0 and repair.repaired_turns(none).count() == 0


def test_damaged_rows(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. Yes!") for c in range(60) for t in range(2)] + [(None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    import zlib

    what = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, r, x in rows:
        w, r, x = what(c, t), r or " ", x or " "
        row = (c, t, "user" if w == 4 else r, "" if w == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if w == 2 else x)
        want += [row] * (0 if w == 0 else 2 if w == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    full = queries.QUERIES["op13_repair"](spark, str(tmp_path)).collect()
    assert len(full) == 61
    gone = [r for r in full if all(what(r.conv_id, t) == 0 for t in ((0, 1) if r.conv_id is not None else (None,)))]
    assert all(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256().hexdigest() for r in gone)
