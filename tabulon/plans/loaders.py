"""Queries: files of the catalog's shapes, written from the tables first and read back; first events, broken JSON, region sums, related concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as T
from tabulon.sources import files, sinks
from tabulon.sources.tables import table
from tabulon.streaming import events as E

#: Catalog rows in one written JSON file.
ROWS_A_FILE = 1000


def _lines(spark: SparkSession, rows: DataFrame, value: Column) -> str:
    """The path of a new folder of text files that hold value of each row."""
    path = f"{sinks.scratch(spark)}/lines"
    rows.select(value.alias("value")).write.text(path)
    return path


def _documents(spark: SparkSession, rows: DataFrame, value: Column, key: str = "p_partkey") -> str:
    """The path of a new folder with a file for every ROWS_A_FILE keys, which holds value (an aggregate over its rows)."""
    path = f"{sinks.scratch(spark)}/documents"
    rows.groupBy(F.floor(F.col(key) / ROWS_A_FILE).alias("file")).agg(value.alias("value")).write.partitionBy("file").text(path)
    return path


def _variable(prefix: str = "V") -> Column:
    return F.concat(F.lit(prefix), F.col("p_partkey").cast("string"))


def load_variable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of JSON arrays of records, arrays of strings and objects, and of a CSV that has `name` only."""
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 4
    records = F.to_json(F.collect_list(F.struct(_variable().alias("variable_id"), F.col("p_name").alias("label"))))
    names = F.to_json(F.array_append(F.collect_list(_variable()), F.lit("shared")))
    entries = F.to_json(F.map_from_entries(F.collect_list(F.struct(_variable().alias("k"), F.struct(F.col("p_brand").alias("label")).alias("v")))))
    paths = [_documents(spark, p.filter(kind == i), v) for i, v in enumerate((records, names, entries))]
    csv = f"{sinks.scratch(spark)}/ids.csv"
    p.filter(kind == 3).select(F.col("p_name").alias("label"), _variable().alias("name")).write.csv(csv, header=True)
    found = [files.variable_ids(spark, x) for x in (*paths, csv)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).distinct()


def load_enriched_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of an array in which ids come twice (the last stays), of an array and of an object below `variables`, and of a bare object."""
    p = table(spark, d, "part")
    kind = F.col("p_partkey") % 4
    pair = lambda v: F.struct(_variable().alias("k"), F.struct(v.alias("label")).alias("v"))
    record = lambda v: F.struct(_variable().alias("variable_id"), v.alias("label"))
    twice = F.to_json(F.concat(F.collect_list(record(F.lit("old"))), F.collect_list(record(F.col("p_brand")))))
    below = F.to_json(F.struct(F.collect_list(record(F.col("p_brand"))).alias("variables")))
    entries = F.map_from_entries(F.collect_list(pair(F.col("p_brand"))))
    shapes = (twice, below, F.to_json(F.struct(entries.alias("variables"))), F.to_json(entries))
    found = [files.enriched_records(spark, _documents(spark, p.filter(kind == i), v)) for i, v in enumerate(shapes)]
    rows = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    return rows.select("variable_id", F.get_json_object("record", "$.label").alias("label"))


def load_shell_phrases(spark: SparkSession, d: str) -> DataFrame:
    path = f"{sinks.scratch(spark)}/shells.tsv"
    cells = table(spark, d, "part").select(F.concat("p_name", F.lit("; of "), "p_brand").alias("a"), F.concat("p_type", F.lit(": x / "), "p_name").alias("b"))
    cells.write.csv(path, sep="\t", header=True)
    return files.shell_phrases(spark, path)


def load_concept_subjects(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_partkey") % 3
    line = F.format_string("<http://x.test/%s#%s> <http://x.test/%s> \"%s\" .", F.when(kind == 0, "concepts").otherwise("v"), _variable(), F.when(kind == 1, "hasConcept").otherwise("says"), "p_name")
    return files.concept_subjects(files.triples(spark, _lines(spark, table(spark, d, "part"), line)))


def load_first_concepts(spark: SparkSession, d: str) -> DataFrame:
    block = F.format_string("ex:%s\n  a ex:Variable ;\n  ex:hasConcept ex:%s ;\n  ex:hasConcept ex:later .\n", _variable(), F.replace("p_brand", F.lit("#"), F.lit("_")))
    return files.first_concepts(spark, _lines(spark, table(spark, d, "part"), block), "ex")


def concept_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions on pages that also hold a page label and a text too short to define anything."""
    text = F.concat(F.lit("Page header\nnumbers and names of this volume\n\n"), F.initcap("p_name"), F.lit(" \ngoods of the   kind\n"), "p_type", F.lit("\nby "), "p_brand", F.lit("\n\nShort one\ntoo short\n\n"))
    return files.definitions(table(spark, d, "part").select(F.col("p_partkey").alias("page"), text.alias("text")))


def contents_entries(spark: SparkSession, d: str) -> DataFrame:
    p, kind = table(spark, d, "part"), F.col("p_partkey") % 4
    title = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.col("p_name")).when(kind == 2, F.concat(F.lit("TABLE OF "), F.upper("p_name"))).otherwise(F.upper(F.substring("p_name", 1, 3)))
    lines = p.select("p_partkey", F.concat(F.lit("  "), title, F.lit("______"), F.col("p_size").cast("string")).alias("line"))
    return files.contents_entries(lines).select("p_partkey", "concept_name", "page_number")


def nested_sections(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as lines: every fourth turn heads a section, other turns of an even number head parts."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("ordinal"), F.md5(F.concat(F.col("turn").cast("string"), F.lit(":"), F.coalesce("text", F.lit("")))).alias("line"))
    return files.nested_sections(c, F.col("ordinal") % 4 == 0, F.col("ordinal") % 2 == 0)


def load_csv_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each written CSV's text, and its characters behind the name."""
    path = f"{sinks.scratch(spark)}/rows.csv"
    table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.csv(path, header=True)
    return files.csv_as_text(spark, path, 10).select(F.size(F.split("text", "\n")).alias("lines"), F.length(F.substring_index("text", "Columns: ", -1)).alias("characters"))


def load_json_as_text(spark: SparkSession, d: str) -> DataFrame:
    path = _documents(spark, table(spark, d, "events").select("event_id", "props"), F.array_join(F.array_sort(F.collect_list("props")), " "), "event_id")
    whole = _documents(spark, table(spark, d, "events"), F.to_json(F.array_sort(F.collect_list(F.col("event_id").cast("string")))), "event_id")
    return files.json_as_text(spark, path).unionByName(files.json_as_text(spark, whole)).select("text")


def markdown_to_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    page = F.format_string("# %s\n\n> **%s** and *%s*\n\n- one [%s](http://x.test/a)\n1. `two`\n\n---\n![picture](a.png)\n```sql\nSELECT &lt; 1\n```\n", "p_name", "p_brand", "p_type", "p_name")
    return p.select("p_partkey", T.markdown_text(page).alias("text"))


def first_events(spark: SparkSession, d: str) -> DataFrame:
    return E.earliest(table(spark, d, "events"), "user_id").select("user_id", "event_id", "event_type", "value")


def json_repairs(spark: SparkSession, d: str) -> DataFrame:
    """k of answers that hold JSON as it is, fenced, amid words, with a trailing comma, in single quotes, or cut."""
    plain, kind = F.col("props"), F.col("event_id") % 6
    inner = F.substring_index("props", "}", 1)
    broken = (
        F.when(kind == 0, plain).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), plain, F.lit(" fits.")))
        .when(kind == 3, F.concat(inner, F.lit(", }"))).when(kind == 4, F.replace("props", F.lit('"'), F.lit("'"))).otherwise(inner)
    )
    k = F.coalesce(F.get_json_object(T.repaired_json(broken), "$.k"), F.nullif(F.regexp_extract(broken, r'"k"\s*:\s*([0-9]+)', 1), F.lit(""))).cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), T.repaired_json(broken).isNotNull().alias("repaired"))


def region_sums(spark: SparkSession, d: str) -> DataFrame:
    """Cents of customers summed over a region's nations, its count of nations, and its mean weighted by customers."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    each = c.groupBy("c_nationkey").agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey).join(each, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy("r_name").agg(F.count("*").alias("nations"), F.sum("cents").alias("cents"), F.sum("n").alias("customers"), F.round(F.sum("cents") / F.sum("n"), 4).alias("mean_cents"))


def related_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Links from event types to users whose stated confidence is 0.85 or more, as the most confident one states it."""
    rows = table(spark, d, "events").select("event_type", "user_id", (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"))
    return rows.filter("confidence >= 0.85").groupBy("event_type", "user_id").agg(F.max("confidence").alias("confidence"))


def available_variables(spark: SparkSession, d: str) -> DataFrame:
    """Core names and the catalog's labels; the catalog's overwrite."""
    p = table(spark, d, "part")
    core = p.filter("p_size < 20").select(_variable().alias("variable_id"), F.lit("core").alias("core_label"))
    index = p.filter("p_size >= 10").select(_variable().alias("variable_id"), F.col("p_name").alias("index_label"))
    return core.join(index, "variable_id", "full_outer").select("variable_id", F.coalesce("index_label", "core_label").alias("label"))


def variable_context(spark: SparkSession, d: str) -> DataFrame:
    """Each variable with the longest page of its brand's documents, or its static label alone."""
    p = table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 100).alias("slot"))
    best = table(spark, d, "documents").filter("n_chars >= 200").groupBy((F.col("doc_id") % 100).alias("slot")).agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))
    return p.join(best, "slot", "left").select("p_partkey", F.col("p_name").alias("label"), "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def sink_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents appended one batch after the other, counted as read back."""
    path = f"{sinks.scratch(spark)}/documents"
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    for batch in (rows, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")):
        sinks.append_results(batch, path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.length("text")).alias("characters"))


QUERIES = {
    f.__name__: f
    for f in (
        load_variable_ids, load_enriched_records, load_shell_phrases, load_concept_subjects, load_first_concepts, concept_definitions, contents_entries, nested_sections, load_csv_as_text, load_json_as_text,
        markdown_to_text, first_events, json_repairs, region_sums, related_concepts, available_variables, variable_context, sink_documents,
    )
}
_V = "'V' || p_partkey::VARCHAR"
ORACLE_SQL = {
    "load_variable_ids": f"SELECT {_V} AS variable_id FROM part UNION SELECT 'shared' FROM part",
    "load_enriched_records": f"SELECT {_V} AS variable_id, p_brand AS label FROM part",
    "load_shell_phrases": "WITH c AS (SELECT p_name || '; of ' || p_brand AS c FROM part UNION SELECT p_type || ': x / ' || p_name FROM part) SELECT DISTINCT trim(x) AS phrase FROM (SELECT unnest(regexp_split_to_array(c, '[:;/]+')) AS x FROM c) WHERE trim(x) <> ''",
    "load_concept_subjects": f"SELECT {_V} AS id, 'http://x.test/' || CASE WHEN p_partkey % 3 = 0 THEN 'concepts' ELSE 'v' END || '#' || {_V} AS uri FROM part WHERE p_partkey % 3 < 2",
    "load_first_concepts": f"SELECT {_V} AS variable, replace(p_brand, '#', '_') AS concept FROM part",
    "concept_definitions": "WITH x AS (SELECT p_partkey AS page, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, 'goods of the kind ' || p_type || ' by ' || p_brand AS definition FROM part) SELECT label, arg_max(definition, page) AS definition, max(page) AS page FROM x GROUP BY label",
    "contents_entries": "SELECT p_partkey, upper(p_name) AS concept_name, p_size AS page_number FROM part WHERE p_partkey % 4 = 0",
    "nested_sections": """WITH c AS (SELECT conv_id AS path, turn, md5(turn::VARCHAR || ':' || coalesce(text, '')) AS line, turn % 4 = 0 AS m, turn % 2 = 0 AND turn % 4 <> 0 AS s FROM conversations),
a AS (SELECT *, sum(m::INT) OVER (PARTITION BY path ORDER BY turn) AS k FROM c), b AS (SELECT *, sum(s::INT) OVER (PARTITION BY path, k ORDER BY turn) AS j, first_value(line) OVER (PARTITION BY path, k ORDER BY turn) AS head FROM a WHERE k > 0)
SELECT path, any_value(head) AS main, max(CASE WHEN s THEN line END) AS sub, coalesce(string_agg(CASE WHEN NOT m AND NOT s THEN line END, chr(10) ORDER BY turn), '') AS body FROM b GROUP BY path, k, j""",
    "load_csv_as_text": "SELECT 2 + count(*) AS lines, length('n_nationkey,n_name') + sum(1 + length(n_nationkey::VARCHAR || ',' || n_name))::INT AS characters FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)",
    "markdown_to_text": "SELECT p_partkey, p_name || ' ' || p_brand || ' and ' || p_type || ' one ' || p_name || ' two SELECT < 1' AS text FROM part",
    "first_events": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "json_repairs": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 6 < 5 AS repaired FROM events",
    "region_sums": "WITH e AS (SELECT c_nationkey, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM customer GROUP BY 1) SELECT r_name, count(*) AS nations, sum(cents)::BIGINT AS cents, sum(n)::BIGINT AS customers, round(sum(cents)::DOUBLE / sum(n)::DOUBLE, 4) AS mean_cents FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN e ON n_nationkey = c_nationkey GROUP BY r_name",
    "related_concepts": "WITH r AS (SELECT event_type, user_id, json_extract_string(props, '$.k')::DOUBLE / 100 AS c FROM events) SELECT event_type, user_id, max(c) AS confidence FROM r WHERE c >= 0.85::DOUBLE GROUP BY 1, 2",
    "available_variables": f"SELECT {_V} AS variable_id, CASE WHEN p_size >= 10 THEN p_name ELSE 'core' END AS label FROM part WHERE p_size < 20 OR p_size >= 10",
    "variable_context": "WITH b AS (SELECT doc_id % 100 AS slot, arg_max(doc_id, n_chars * 1000000000 + doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE n_chars >= 200 GROUP BY 1) SELECT p_partkey, p_name AS label, doc_id, coalesce(n_chars, 0) AS n_chars FROM part LEFT JOIN b ON p_partkey % 100 = slot",
    "sink_documents": "WITH a AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents) SELECT count(*) AS n, sum(id)::BIGINT AS ids, sum(length(text))::BIGINT AS characters FROM a",
}
