"""Writers: phrase files, routed records, links per variable, run tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or in local mode, where both are one process, a temporary one that goes with it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/sinks/{uuid.uuid4().hex}"
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="sinks-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def write_phrases(phrases: DataFrame, path: str, phrase: str = "phrase") -> None:
    """Distinct phrases, one a line, in order over all files."""
    phrases.select(phrase).distinct().orderBy(phrase).write.mode("overwrite").text(path)


def write_routed(rows: DataFrame, route: Column, path: str) -> None:
    """rows as JSON in one folder for each route."""
    rows.withColumn("route", route).write.mode("overwrite").partitionBy("route").json(path)


def write_links(links: DataFrame, path: str, variable: str = "variable", concept: str = "concept", weight: str = "weight") -> None:
    """One Turtle line per variable: its concepts by falling weight, then name."""
    each = F.struct((-F.col(weight)).alias("w"), F.col(concept).alias("c"))
    lines = links.groupBy(variable).agg(F.array_sort(F.collect_list(each)).alias("x"))
    text = F.concat(F.lit("ex:"), F.col(variable), F.lit(" ex:hasConcept "), F.array_join(F.transform("x", lambda s: F.concat(F.lit("ex:"), s["c"])), " , "), F.lit(" ."))
    lines.select(text.alias("value")).write.mode("overwrite").text(path)


def upsert_runs(spark: SparkSession, runs: DataFrame, path: str, new_path: str, key: str = "run_name") -> DataFrame:
    """The runs at path with `runs` in place of those of the same key, written to new_path (a table can't replace what it reads)."""
    old = spark.read.parquet(path)
    old.join(runs, key, "left_anti").unionByName(runs).write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)
