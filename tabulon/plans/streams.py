"""Queries: the batch forms of the streaming operators over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as T
from tabulon.sources import sinks
from tabulon.sources.tables import table
from tabulon.streaming import events as E
from tabulon.streaming import resume, stateful


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"))


def events_session(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events"))


def events_first_per_user(spark: SparkSession, d: str) -> DataFrame:
    return E.first_of_key(table(spark, d, "events").select("user_id"), "user_id")


def stream_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.token_counts(table(spark, d, "benchmark"), "text").filter(F.col("df") > 1)


def events_followed(spark: SparkSession, d: str) -> DataFrame:
    """Each view with the purchases of the same user within 30 days."""
    return stateful.followed(table(spark, d, "events"), "view", "purchase", "30 days")


def upsert_batches(spark: SparkSession, d: str) -> DataFrame:
    """All events upserted by user in three batches, the second one twice, then compacted: of a user's events the last batch's last one stays."""
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    own = resume.open_table(spark, sinks.scratch(spark), "user_id", "user_id long, event_id long, ts timestamp, event_type string")
    for batch in (0, 1, 1, 2):
        own = resume.upsert(own, events.filter(F.col("event_id") % 3 == batch), "events", batch, F.struct("ts", "event_id"))
    return resume.compact(own).rows().select("user_id", "event_id", "event_type")


def contents_once(spark: SparkSession, d: str) -> DataFrame:
    """The words of every document, computed once for each distinct text: the second run finds all of them."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), sinks.scratch(spark)
    count = lambda df: df.select("_content", F.size(T.tokens(F.col("text"))).cast("long").alias("n_words"))
    _, first = resume.computed_once(docs, ["text"], "words/1", count, path, "n_words long")
    again, second = resume.computed_once(docs, ["text"], "words/1", count, path, "n_words long")
    return again.select("doc_id", "n_words", F.lit(first).cast("long").alias("computed_first"), F.lit(second).cast("long").alias("computed_again"))


QUERIES = {f.__name__: f for f in (events_tumbling, events_session, events_first_per_user, stream_token_counts, events_followed, upsert_batches, contents_once)}
ORACLE_SQL = {
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_session": "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k",
    "events_first_per_user": "SELECT DISTINCT user_id FROM events",
    "stream_token_counts": "SELECT token, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS token FROM benchmark) GROUP BY token HAVING count(*) > 1",
    "events_followed": "SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 DAY WHERE a.event_type = 'view' AND b.event_type = 'purchase'",
    "upsert_batches": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "contents_once": "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::BIGINT AS n_words, (SELECT count(DISTINCT text) FROM documents) AS computed_first, 0::BIGINT AS computed_again FROM documents",
}
