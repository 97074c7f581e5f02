"""Structured Streaming over event rows: windows, sessions, first-of-key and incremental token counts.

Every function takes a streaming or a static DataFrame with a timestamp column; on static input it is its batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.text import tokens


def event_stream(spark: SparkSession, directory: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the parquet files of a directory."""
    schema = spark.read.parquet(directory).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events under a watermark; a stream's event time must be a timestamp with the session's time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum of value per window and event type; rows later than `late` are dropped once their window is closed."""
    grouped = _timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: begin, end of the last event's gap, events."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_key(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of key within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def earliest(events: DataFrame, key: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The whole first event of each key by order, with map-side partials; a null key is a key."""
    first = events.groupBy(key).agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("e"))
    return first.select("e.*")


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """Running document frequency of every token, for an index that grows with the stream."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream as parquet until its input is used up; a restart goes on from checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
