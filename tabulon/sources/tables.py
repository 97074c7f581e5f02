"""Readers of the driver's parquet tables and adapters of the catalog's file shapes to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

VARIABLE = "struct<label:string,concept:string,predicateType:string,`group`:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literals(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small dimension, with an `ordinal` from 0, as a local relation."""
    kinds = [c.split() for c in names.split(",")]
    row = lambda i, r: F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).cast(k).alias(n) for (n, k), v in zip(kinds, r, strict=True)], F.lit(i).alias("ordinal"))
    return spark.range(1).select(F.inline(F.array(*[row(i, r) for i, r in enumerate(rows)])))


def catalog_from_json(spark: SparkSession, path: str, survey: str = "acs5") -> DataFrame:
    """variable_id, label, concept, predicate_type, group, survey, ordinal of a JSON document `{"variables": {id: {...}}}` or a bare `{id: {...}}`."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json(F.get_json_object("value", "$.variables"), f"map<string,{VARIABLE}>")
    bare = F.from_json("value", f"map<string,{VARIABLE}>")
    return _exploded(text.select(F.coalesce(wrapped, bare).alias("m")), survey)


def catalog_from_records(spark: SparkSession, path: str, survey: str = "acs5") -> DataFrame:
    """The same of a JSON array of records with `variable_id` or `name`."""
    read = spark.read.json(path, multiLine=True, schema="variable_id string, name string, label string, concept string, predicateType string, `group` string")
    file = W.Window.partitionBy("path").orderBy("position")
    rows = read.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("position")).withColumn("ordinal", (F.row_number().over(file) - 1).cast("long"))
    named = rows.withColumn("variable_id", F.coalesce("variable_id", "name")).filter(F.col("variable_id").isNotNull())
    return named.select("variable_id", "label", "concept", F.col("predicateType").alias("predicate_type"), "group", F.lit(survey).alias("survey"), "ordinal")


def _exploded(maps: DataFrame, survey: str) -> DataFrame:
    entries = maps.select(F.posexplode(F.map_entries("m")).alias("ordinal", "e"))
    return entries.select(F.col("e.key").alias("variable_id"), "e.value.label", "e.value.concept", F.col("e.value.predicateType").alias("predicate_type"), "e.value.group", F.lit(survey).alias("survey"), F.col("ordinal").cast("long"))


def surveys(*catalogs: DataFrame) -> DataFrame:
    """Several surveys' catalogs as one."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def last_row_wins(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Of rows of one key, the last by ordinal."""
    order = W.Window.partitionBy(key).orderBy(F.col(ordinal).desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def csv_catalog(spark: SparkSession, path: str, schema: str, key: str = "variable_id") -> DataFrame:
    """A CSV with header; of repeated keys the last row wins, as by a dict."""
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE").withColumn("ordinal", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("position")))
    return last_row_wins(rows, key)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, file_sha1, ext, category (second part of the path below the root) of files; dot paths are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    below = F.regexp_replace(F.substring_index("path", ":", -1), "^/+", "/")
    root = path.rstrip("/")
    inner = F.regexp_replace(below, f"^{root}/", "")
    return files.filter(~F.concat(F.lit("/"), inner).contains("/.")).select("path", F.col("length").alias("bytes"), F.sha1("content").alias("file_sha1"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), F.split(inner, "/")[0].alias("category"))


def text_sections(spark: SparkSession, path: str) -> DataFrame:
    """label, body, ordinal of a text file's sections, which blank lines part; the first line is the label."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.posexplode(F.split("value", r"\n[ \t]*\n")).alias("ordinal", "part")).withColumn("part", F.trim(F.regexp_replace("part", r"^\s+|\s+$", "")))
    return parts.filter(F.col("part") != "").select(F.split("part", "\n")[0].alias("label"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"), "ordinal")


def concept_blocks(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """id, label, definition of a Turtle file's concept blocks; blocks with neither label nor definition are dropped."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.posexplode(F.split("value", f"\n{prefix}:")).alias("ordinal", "block"))
    said = lambda p: F.nullif(F.regexp_extract("block", rf'{p}\s+"+((?s:.*?))"+(?:@\w+)?\s*[;.]', 1), F.lit(""))
    found = blocks.select(F.regexp_extract("block", r"^([A-Za-z0-9_-]+)", 1).alias("id"), said("prefLabel").alias("label"), said("definition").alias("definition"), "ordinal")
    return found.filter(F.col("label").isNotNull() | F.col("definition").isNotNull())


def headings_to_sections(lines: DataFrame, is_heading: Column, order: str = "ordinal") -> DataFrame:
    """heading, body: lines grouped under the heading before them, per `path`; a path of any length is ordered in blocks."""
    from tabulon.sources.files import running_counts

    grouped = running_counts(lines, {"_s": is_heading}, order).filter("_s > 0").groupBy("path", "_s")
    parts = grouped.agg(F.array_sort(F.collect_list(F.struct(order, "line"))).getField("line").alias("x"))
    return parts.select("path", F.trim(F.col("x")[0]).alias("heading"), F.trim(F.array_join(F.slice("x", 2, 1 << 30), "\n")).alias("body"))
