"""Streams give what their batch forms give."""

from tabulon.streaming import events as E
from tests.conftest import DATA


def test_tumbling_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.orderBy("ts").coalesce(1).write.parquet(str(source))
    stream = E.tumbling(E.event_stream(spark, str(source)), late="60 days")
    query = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    shown = lambda df: {(str(r.window_start), r.event_type, r.n) for r in df.collect()}
    assert shown(spark.table("tumbled")) == shown(E.tumbling(rows))


def test_first_of_key_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id").limit(50)
    rows.unionByName(rows).coalesce(1).write.parquet(str(source))
    query = E.to_table(E.first_of_key(E.event_stream(spark, str(source)), "event_id", "400 days"), str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50
