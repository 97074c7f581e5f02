"""Packing and batches by one pass, table functions from SQL, and files ordered in blocks."""

import random

from pyspark.sql import functions as F

from tabulon.functions import sql
from tabulon.operators import chunk, merge
from tabulon.sources import files, tables


def test_a_giant_text_is_packed_in_one_pass(spark):
    text = "\n".join(f"paragraph {i} with some words" for i in range(120_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = chunk.chunks(df, "id", chunk.paragraphs(F.col("t")), 300, 40, 1).orderBy("chunk_number").collect()
    assert {r.id for r in got} == {1} and len(got) > 10_000
    assert all(a.text[-40:] == b.text[:40] for a, b in zip(got, got[1:]))
    assert got[0].text.startswith("paragraph 0") and got[-1].text.endswith("paragraph 119999 with some words")


def test_pack_edges():
    assert chunk.pack([], 5, 2, "-") == [] and chunk.pack(["abcdefgh"], 5, 2, "-") == ["abcdefgh"]
    assert chunk.pack(["abc", "de", "fgh"], 5, 2, "-") == ["abc-de", "de-fgh"]
    assert chunk.pack(["abc", "defg"], 5, 0, "-") == ["abc", "-defg"]


def test_long_sentences_are_cut_at_words(spark):
    words = [f"w{i}" for i in range(100)]
    got = chunk.pack_sentences([" ".join(words), "short one."], 50, 30, 10, 2)
    assert all(len(x) <= 30 + 10 + 1 + 30 for x in got)
    seen = [w for x in got for w in x.split(" ")]
    assert [w for i, w in enumerate(dict.fromkeys(seen)) if w in words] == words and got[-1].endswith("short one.")
    assert chunk.pack_sentences(["x" * 99], 50, 30, 10, 2) == ["x" * 99]
    df = spark.createDataFrame([(" ".join(words),), (None,)], "t string")
    assert df.select(chunk.packed_sentences(chunk.sentences(F.col("t")), 50, 30, 10, 2).alias("c")).first().c == chunk.pack_sentences([" ".join(words)], 50, 30, 10, 2)


def plain_batches(costs, budget):
    out, total, batch = [], 0.0, 0
    for c in costs:
        if total > 0 and total + c > budget:
            total, batch = 0.0, batch + 1
        total += c
        out.append(batch)
    return out


def test_batches_of_a_large_group_and_from_sql(spark):
    rng = random.Random(4)
    rows = [(1, i, float(rng.randrange(0, 40))) for i in range(20_000)] + [(None, i, 30.0) for i in range(5)] + [(2, 0, None), (2, 1, 200.0), (2, 2, 1.0)]
    df = spark.createDataFrame(rows, "g long, o long, c double").repartition(5)
    got = sorted(((r.g is not None, r.g or 0), r.o, r.batch) for r in merge.running_batches(df, "g", "o", "c", 100.0).collect())
    want = []
    for g in (1, None, 2):
        own = [r for r in rows if r[0] == g]
        want += [((g is not None, g or 0), r[1], b) for r, b in zip(own, plain_batches([r[2] or 0 for r in own], 100.0))]
    assert got == sorted(want)
    sql.register(spark)
    found = spark.sql("SELECT * FROM greedy_batches(TABLE(SELECT g, o, c FROM {df} WHERE g = 2) PARTITION BY (g) ORDER BY (o), 100.0D)", df=df).collect()
    assert sorted((r.ordinal, r.batch) for r in found) == [(0, 0), (1, 0), (2, 1)]
    found = spark.sql("SELECT number, chunk FROM text_chunks('one\n\ntwo  three\nfour', 9, 2)").collect()
    assert [tuple(r) for r in found] == [(0, "one"), (1, "ne\ntwo three"), (2, "ee\nfour")]


def test_one_file_of_many_splits(spark, tmp_path):
    blocks = [f"ex:V{i}\n  a ex:Variable ;\n" + "  ex:note 1 ;\n" * (i % 7) + f"  ex:hasConcept ex:C{i} ;\n  ex:hasConcept ex:later .\n" for i in range(400)]
    (tmp_path / "a.ttl").write_text("".join(blocks))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        found = files.first_concepts(spark, str(tmp_path), "ex")
        assert {(r.variable, r.concept) for r in found.collect()} == {(f"V{i}", f"C{i}") for i in range(400)}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(path" in plan and "start" in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_sections_over_blocks(spark, monkeypatch):
    rng = random.Random(6)
    lines = [(p, i, rng.choice(["# main", "## sub", "text", "more"]) + f" {p} {i}") for p in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(lines, "path string, ordinal long, line string")
    head, sub = F.col("line").startswith("# "), F.col("line").startswith("## ")
    run = lambda: sorted(map(repr, files.nested_sections(df, head, sub).collect()))
    whole, parts = run(), sorted(map(repr, tables.headings_to_sections(df, head).collect()))
    monkeypatch.setattr(files.running_counts, "__defaults__", ("ordinal", "path", 16))
    assert run() == whole and sorted(map(repr, tables.headings_to_sections(df, head).collect())) == parts
    want = []
    for p in ("a", "b", None):
        main = part = None
        for _, _, line in [x for x in lines if x[0] == p]:
            if line.startswith("# "):
                main, part = line, None
                want.append([p, main, None, []])
            elif main and line.startswith("## "):
                want.append([p, main, line, []])
            elif main:
                want[-1][3].append(line)
    got = sorted(((r.path or "", r.main, r.sub or "", r.body) for r in files.nested_sections(df, head, sub).collect()))
    assert got == sorted((p or "", m, s or "", "\n".join(b)) for p, m, s, b in want)
