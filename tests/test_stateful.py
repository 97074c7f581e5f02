"""Streams in several triggers give what their batch forms give; late rows and time-outs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulon.streaming import events as E
from tabulon.streaming import stateful
from tests.conftest import DATA

SCHEMA = "user_id long, event_id long, ts timestamp, value double"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def ran(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER_SETTING, None)
    spark.conf.set(stateful.PROVIDER_SETTING, stateful.PROVIDER)
    yield
    spark.conf.unset(stateful.PROVIDER_SETTING) if before is None else spark.conf.set(stateful.PROVIDER_SETTING, before)


def test_first_events_are_corrected_and_closed(spark, tmp_path, rocks):
    source = f"{tmp_path}/in"
    put(spark, source, [(1, 10, at(5), 1.0), (2, 11, at(6), 2.0)])
    put(spark, source, [(1, 12, at(4), 3.0), (2, 13, at(7), 4.0)])
    put(spark, source, [(3, 14, at(400), 5.0)])
    put(spark, source, [(3, 15, at(401), 6.0)])
    found = ran(stateful.first_events(E.event_stream(spark, source, 1), late="2 hours", idle_ms=3_600_000), "firsts", "update").collect()
    rows = {(r.user_id, r.event_id, r.times, r.kind) for r in found}
    assert {(1, 10, 1, "first"), (1, 12, 2, "corrected"), (2, 11, 1, "first"), (3, 14, 1, "first")} <= rows
    assert {r for r in rows if r[3] == "closed"} >= {(1, 12, 2, "closed"), (2, 11, 1, "closed")}


def test_first_events_equal_the_batch_form(spark, tmp_path, rocks):
    source = f"{tmp_path}/in"
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.repartition(4).write.parquet(source)
    found = ran(stateful.first_events(E.event_stream(spark, source, 1), late="4000 days"), "all_firsts", "update")
    last = found.groupBy("user_id").agg(F.max_by("event_id", "times").alias("event_id")).collect()
    assert {tuple(r) for r in last} == {(r.user_id, r.event_id) for r in E.earliest(rows, "user_id").collect()}


def test_followed_events_as_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.repartition(3).write.parquet(source)
    found = ran(stateful.followed(E.event_stream(spark, source, 1), "view", "purchase", "30 days", "4000 days"), "pairs", "append")
    want = {tuple(r) for r in stateful.followed(rows, "view", "purchase", "30 days").collect()}
    assert {tuple(r) for r in found.collect()} == want and want


def test_sessions_as_a_stream_with_late_rows(spark, tmp_path):
    source = f"{tmp_path}/in"
    put(spark, source, [(1, 1, at(0), 1.0), (1, 2, at(0.2), 1.0)])
    put(spark, source, [(2, 3, at(48), 1.0)])
    put(spark, source, [(2, 8, at(48.05), 1.0)])  # late rows are told by the watermark of the trigger before
    put(spark, source, [(1, 4, at(0.1), 1.0), (2, 5, at(48.1), 1.0)])  # the first is later than the watermark allows
    put(spark, source, [(3, 6, at(96), 1.0)])
    put(spark, source, [(3, 7, at(97), 1.0)])
    found = ran(E.sessions(E.event_stream(spark, source, 1), late="1 hour"), "sessions", "append").collect()
    assert {(r.user_id, r.n) for r in found} == {(1, 2), (2, 3)}


def test_document_frequencies_as_changes(spark, tmp_path):
    source = f"{tmp_path}/in"
    for text in ("a b a", "b c", "c"):
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("append").parquet(source)
    changes = ran(E.token_counts(E.event_stream(spark, source, 1), "text"), "frequencies", "update")
    last = {r.token: r.df for r in changes.groupBy("token").agg(F.max("df").alias("df")).collect()}
    assert last == {"a": 1, "b": 2, "c": 2} and changes.count() == 5
