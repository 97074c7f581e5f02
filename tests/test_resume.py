"""Batches that are stopped between any two steps, versions, and contents that are computed once."""

import pytest
from pyspark.sql import functions as F

from tabulon.streaming import events as E
from tabulon.streaming import resume

SCHEMA = "k long, v string, at int"


def rows(table):
    return sorted(map(tuple, table.rows().select("k", "v", "at").collect()), key=repr)


def test_upserts_versions_and_compaction(spark, tmp_path):
    df = lambda data: spark.createDataFrame(data, SCHEMA)
    empty = resume.open_table(spark, f"{tmp_path}/t", "k", SCHEMA)
    assert empty.version == 0 and rows(empty) == []
    one = resume.upsert(empty, df([(1, "a", 1), (2, "b", 1), (1, "c", 2), (None, "n", 1)]), "s", 0, F.col("at"))
    two = resume.upsert(one, df([(2, "B", 2), (3, "x", 2), (None, "N", 2)]), "s", 1)
    assert rows(two) == sorted([(1, "c", 2), (2, "B", 2), (3, "x", 2), (None, "N", 2)], key=repr)
    assert resume.upsert(two, df([(9, "late", 9)]), "s", 1) is two  # a batch that comes again
    three = resume.upsert(two, df([(9, "other", 9)]), "t", 0)
    four = resume.compact(three)
    assert rows(four) == rows(three) and len(four.segments) == 1
    assert rows(resume.open_table(spark, f"{tmp_path}/t", "k", SCHEMA, 1)) == rows(one)
    with pytest.raises(Exception, match="exist"):
        resume.upsert(two, df([(7, "lost race", 1)]), "u", 0)
    assert rows(resume.open_table(spark, f"{tmp_path}/t", "k", SCHEMA)) == rows(four)


@pytest.mark.parametrize("step", ["before data", "before manifest", "after manifest"])
def test_a_stopped_stream_goes_on(spark, tmp_path, monkeypatch, step):
    source = f"{tmp_path}/in"
    spark.range(600).select(F.col("id").alias("k"), F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("v"), F.lit(1).alias("at")).repartition(6).write.parquet(source)
    stream = lambda: E.event_stream(spark, source, 2).withColumn("k", F.col("k") % 400)
    names = {"before data": "_written", "before manifest": "_publish", "after manifest": "_publish"}
    real, calls = getattr(resume, names[step]), []

    def fails(*args):
        calls.append(1)
        if len(calls) == 2:
            if step == "after manifest":
                real(*args)
            raise RuntimeError("stopped")
        return real(*args)

    monkeypatch.setattr(resume, names[step], fails)
    with pytest.raises(Exception, match="stopped"):
        resume.upsert_stream(stream(), f"{tmp_path}/t", "k", f"{tmp_path}/c", order=F.col("v")).awaitTermination()
    monkeypatch.setattr(resume, names[step], real)
    resume.upsert_stream(stream(), f"{tmp_path}/t", "k", f"{tmp_path}/c", order=F.col("v")).awaitTermination()
    resume.upsert_stream(stream(), f"{tmp_path}/t1", "k", f"{tmp_path}/c1", order=F.col("v")).awaitTermination()
    stopped, single = (resume.open_table(spark, f"{tmp_path}/{t}", "k", "k long, v string, at int") for t in ("t", "t1"))
    assert rows(stopped) == rows(single) and len(rows(single)) == 400
    assert stopped.ledger == single.ledger == {"stream": 2} and len(stopped.segments) == 3


def test_contents_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def upper(s):
        seen.add(1)
        return None if s is None else s.upper()

    compute = lambda df: df.select("_content", F.udf(upper, "string")("t").alias("up"))
    run = lambda data, params="p1": resume.computed_once(spark.createDataFrame(data, "id int, t string"), ["t"], params, compute, f"{tmp_path}/s", "up string")
    data = [(i, f"text {i % 10}") for i in range(100)] + [(200, None), (201, "")]
    out, n = run(data)
    assert n == 12 and seen.value == 12 and {(r.t, r.up) for r in out.collect()} == {(t, None if t is None else t.upper()) for _, t in data} and out.count() == 102
    out, n = run(data)
    assert n == 0 and seen.value == 12 and out.count() == 102
    out, n = run([*data, (300, "new")])
    assert n == 1 and seen.value == 13 and {r.up for r in out.filter("id = 300").collect()} == {"NEW"}
    assert run(data, "p2")[1] == 12
