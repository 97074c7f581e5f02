"""Readers of the catalog's other file shapes: ids, enriched records, concept files in three tiers, graphs, definitions, and files as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions import text as T

CONCEPTS = "concepts array<struct<id:string,label:string,definition:string,census_tables:array<string>>>"
FILE = "_metadata.file_name"
#: A definition: a capitalised label on a line of its own, text, an empty line.
DEFINITION = r"(?ms)^([A-Z][A-Za-z ,;/&()-]{3,60})\s*\n(.*?)\n{2,}"


def read_order() -> Column:
    """The place of a row in its file, as the reader sees it: split, then position; nothing of how files are dealt over tasks."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("position"))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """key, item, ordinal of JSON files: an object's entries, an array's items (without key), either of them below `variables` if there is such a key.

    ordinal is the path and the place in the file. A file is one row, so at most 2 GB.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.coalesce(F.get_json_object("value", "$.variables"), F.col("value")).alias("v"))
    array = F.ltrim("v").startswith("[")
    items = F.transform(F.from_json("v", "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("item")))
    pairs = F.transform(F.map_entries(F.from_json("v", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item")))
    rows = whole.select("path", F.posexplode(F.when(array, items).otherwise(pairs)).alias("place", "e"))
    return rows.select("e.key", "e.item", F.struct("path", "place").alias("ordinal"))


def variable_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct variable_id of a CSV (column `variable_id`, else `name`; neither: none) or of JSON: keys of an object, strings of an array, `variable_id` of its records. Nulls are left out."""
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True)
        named = [c for c in ("variable_id", "name") if c in rows.columns]
        ids = rows.select((F.col(named[0]) if named else F.lit(None).cast("string")).alias("variable_id"))
    else:
        record = F.when(F.ltrim("item").startswith("{"), F.get_json_object("item", "$.variable_id")).otherwise(F.col("item"))
        ids = _entries(spark, path).select(F.coalesce("key", record).alias("variable_id"))
    return ids.filter("variable_id IS NOT NULL").distinct()


def enriched_records(spark: SparkSession, path: str) -> DataFrame:
    """variable_id, record (JSON) of an enriched universe: an array of records, `{"variables": object or array}` or a bare object. Of one id's records the last stays, by path and then by place in the file; records without id are left out."""
    rows = _entries(spark, path).select(F.coalesce("key", F.get_json_object("item", "$.variable_id")).alias("variable_id"), "item", "ordinal")
    return rows.filter("variable_id IS NOT NULL").groupBy("variable_id").agg(F.max_by("item", "ordinal").alias("record"))


def _concepts(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(CONCEPTS).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.select(F.regexp_replace(FILE, r"\.json$", "").alias("category"), F.posexplode("concepts").alias("ordinal", "c"))


def concept_tables(spark: SparkSession, folder: str) -> DataFrame:
    """category, table_id: the distinct tables that each concept file names."""
    return _concepts(spark, folder).select("category", F.explode("c.census_tables").alias("table_id")).distinct()


def table_categories(spark: SparkSession, folder: str, categories: Sequence[str]) -> DataFrame:
    """table_id, category: of the files that name a table, the last in the order of `categories` gives it; other files don't count."""
    at = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    return concept_tables(spark, folder).filter(at > 0).groupBy("table_id").agg(F.max_by("category", at).alias("category"))


def concept_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """category, confidence_level, label, definition of all categories' files in a folder: `X.json` (high), `X_review.txt` (medium: parts between empty lines, first line the label), `X_low_confidence.csv` (low: label, definition). A tier without files adds nothing."""
    high = _concepts(spark, folder).select("category", F.lit("high").alias("confidence_level"), "c.label", "c.definition")
    text = spark.read.option("pathGlobFilter", "*_review.txt").text(folder, wholetext=True)
    parts = text.select(F.regexp_replace(FILE, r"_review\.txt$", "").alias("category"), F.explode(F.split("value", r"\n[ \t]*\n")).alias("part")).withColumn("part", F.regexp_replace("part", r"^\s+|\s+$", ""))
    medium = parts.filter("part <> ''").select("category", F.lit("medium").alias("confidence_level"), F.split("part", "\n")[0].alias("label"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("definition"))
    rows = spark.read.schema("label string, definition string").option("header", True).option("pathGlobFilter", "*_low_confidence.csv").csv(folder)
    low = rows.select(F.regexp_replace(FILE, r"_low_confidence\.csv$", "").alias("category"), F.lit("low").alias("confidence_level"), "label", "definition")
    return high.unionByName(medium).unionByName(low)


def shell_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Distinct phrases in the distinct cells of every column of a tab-separated file with header."""
    rows = spark.read.csv(path, sep="\t", header=True)
    cells = rows.select(F.explode(F.array(*[F.col(f"`{c}`") for c in rows.columns])).alias("cell")).filter("cell IS NOT NULL").distinct()
    return cells.select(F.explode(T.phrases(F.col("cell"))).alias("phrase")).distinct()


def triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object of N-Triples lines; other lines are left out."""
    part = lambda n: F.regexp_extract("value", r"^\s*<([^>]*)>\s+<([^>]*)>\s+(.*?)\s*\.\s*$", n)
    return spark.read.text(path).select(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object")).filter("subject <> ''")


def concept_subjects(graph: DataFrame) -> DataFrame:
    """id (what follows the last #), uri of subjects that hold "concept" in any case, or whose predicate holds "Concept"; of one id's uris the least."""
    hit = F.col("predicate").contains("Concept") | F.lower("subject").contains("concept")
    return graph.filter(hit).groupBy(F.substring_index("subject", "#", -1).alias("id")).agg(F.min("subject").alias("uri"))


def first_concepts(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """variable, concept: a line that holds a subject only, with the first hasConcept below it; if a subject comes twice, its last pair."""
    lines = spark.read.text(path).select(read_order().alias("o"), "value").withColumns(
        {"variable": F.nullif(F.regexp_extract("value", rf"^\s*{prefix}:(\w+)\s*$", 1), F.lit("")), "concept": F.nullif(F.regexp_extract("value", rf"{prefix}:hasConcept\s+{prefix}:(\w+)", 1), F.lit(""))})
    told = lines.filter("variable IS NOT NULL OR concept IS NOT NULL").withColumns({"path": F.col("o.path"), "start": F.col("o.start")})
    # A split of a file is ordered in its task; what its first line follows is the last line told by the split before it.
    own = W.Window.partitionBy("path", "start").orderBy("o")
    splits = told.groupBy("path", "start").agg(F.max_by(F.struct("variable"), "o").alias("last"))
    splits = splits.select("path", "start", F.lag("last").over(W.Window.partitionBy("path").orderBy("start")).alias("carried"))
    placed = told.select("o", "path", "start", "concept", "variable", F.lag(F.struct("variable")).over(own).alias("inner")).join(splits, ["path", "start"])
    before = placed.select("o", "concept", F.coalesce("inner", "carried")["variable"].alias("variable"), F.col("variable").isNull().alias("says"))
    return before.filter("says AND variable IS NOT NULL").groupBy("variable").agg(F.max_by("concept", "o").alias("concept"))


def definitions(pages: DataFrame) -> DataFrame:
    """label, definition, page of pages (page, text): definitions of more than 20 characters; the last page that has a label gives it."""
    found = pages.select("page", F.posexplode(F.regexp_extract_all("text", F.lit(DEFINITION), F.lit(0))).alias("at", "m"))
    read = found.select("page", "at", F.trim(F.regexp_extract("m", DEFINITION, 1)).alias("label"), F.trim(F.regexp_replace(F.regexp_extract("m", DEFINITION, 2), r"\s+", " ")).alias("definition"))
    kept = read.filter((F.length("definition") > 20) & ~F.col("label").rlike("^(Page|Figure|Table) "))
    return kept.groupBy("label").agg(F.max_by("definition", F.struct("page", "at")).alias("definition"), F.max("page").alias("page"))


def contents_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with concept_name and page_number where a line is an entry of a table of contents: capitals of more than 3 characters, then a page number; underscores count as blanks."""
    clean = F.regexp_replace(F.trim(F.col(line)), "_+", " ")
    read = lines.withColumns({"concept_name": F.trim(F.regexp_extract(clean, r"(.+?)\s+(\d+)$", 1)), "page_number": F.try_to_number(F.regexp_extract(clean, r"(.+?)\s+(\d+)$", 2), F.lit("999999999")).cast("int")})
    name = F.col("concept_name")
    return read.filter((F.length(name) > 3) & (F.upper(name) == name) & ~name.startswith("TABLE OF") & ~name.startswith("AMERICAN COMMUNITY"))


#: Lines of a file that are ordered in one task.
BLOCK_LINES = 65_536


def running_counts(lines: DataFrame, counts: dict[str, Column], order: str = "ordinal", path: str = "path", block_lines: int = BLOCK_LINES) -> DataFrame:
    """lines with running sums over each path in the order of a whole number: blocks of lines are summed apart, and the few sums of blocks are added up.

    So a file of any length is ordered by many tasks. Null paths are one path.
    """
    dealt = lines.withColumn("_block", F.floor(F.col(order) / block_lines))
    own = W.Window.partitionBy(path, "_block").orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    earlier = W.Window.partitionBy("_p").orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col(path).alias("_p"), F.col("_block").alias("_b")).agg(*[F.sum(c.cast("long")).alias(f"_{n}") for n, c in counts.items()])
    sums = sums.select("_p", "_b", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in counts])
    inner = dealt.withColumns({n: F.sum(c.cast("long")).over(own) for n, c in counts.items()})
    met = inner.join(sums, inner[path].eqNullSafe(sums["_p"]) & inner["_block"].eqNullSafe(sums["_b"]))
    return met.withColumns({n: F.col(n) + F.col(f"_{n}") for n in counts}).drop("_p", "_b", "_block", *[f"_{n}" for n in counts])


def nested_sections(lines: DataFrame, is_main: Column, is_sub: Column, order: str = "ordinal") -> DataFrame:
    """path, main, sub, body of lines (path, ordinal, line): each main heading's parts, the one before its first sub heading with a null sub; lines before the first main heading are left out."""
    marked = running_counts(lines.withColumns({"_m": is_main, "_s": is_sub & ~is_main}), {"_main": F.col("_m"), "_part": F.col("_s")}, order).filter("_main > 0")
    heads = marked.filter("_m").select(F.col("path").alias("_p"), F.col("_main").alias("_n"), F.col("line").alias("main"))
    parted = marked.join(heads, marked["path"].eqNullSafe(heads["_p"]) & (marked["_main"] == heads["_n"])).drop("_p", "_n")
    rows = parted.groupBy("path", "_main", "_part").agg(F.first("main").alias("main"), F.max(F.when(F.col("_s"), F.col("line"))).alias("sub"), F.array_sort(F.collect_list(F.when(~F.col("_m") & ~F.col("_s"), F.struct(order, "line")))).getField("line").alias("x"))
    return rows.select("path", "main", "sub", F.array_join("x", "\n").alias("body"))


def json_as_text(spark: SparkSession, path: str, most: int = 8000) -> DataFrame:
    """path, text: the first `most` characters of each valid JSON file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.filter(F.try_parse_json("value").isNotNull()).select("path", F.substring("value", 1, most).alias("text"))


def csv_as_text(spark: SparkSession, path: str, rows: int = 100) -> DataFrame:
    """path, text: name, header and first `rows` rows of each CSV file; files are cut in their tasks before rows move."""
    lines = spark.read.text(path).select(read_order().alias("o"), F.col(FILE).alias("name"), "value")
    first = lines.withColumn("n", F.row_number().over(W.Window.partitionBy("o.path").orderBy("o"))).filter(F.col("n") <= rows + 1)
    whole = first.groupBy("o.path", "name").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).getField("value").alias("x"))
    return whole.select("path", F.concat(F.lit("CSV: "), "name", F.lit("\nColumns: "), F.array_join("x", "\n")).alias("text"))
