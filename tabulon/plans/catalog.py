"""Queries: classification and enrichment of a catalog, with parts as its variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import catalog as C
from tabulon.functions import text as T
from tabulon.operators import lexical, merge
from tabulon.sources.tables import literals, table


def variables(spark: SparkSession, d: str) -> DataFrame:
    """Parts as variables: id like B00017_001, the type as label, the name as concept."""
    p = table(spark, d, "part")
    vid = F.concat(F.lit("B"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("_"), F.lpad((F.col("p_size") % 1000).cast("string"), 3, "0"))
    return p.select(vid.alias("variable_id"), F.col("p_type").alias("label"), F.col("p_name").alias("concept"), F.col("p_brand").alias("group"), F.col("p_partkey").alias("ordinal"))


_V = "v AS (SELECT 'B' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || '_' || lpad((p_size % 1000)::VARCHAR, 3, '0') AS variable_id, p_type AS label, p_name AS concept, p_brand AS \"group\", p_partkey AS ordinal FROM part)"
#: Texts that touch every rule, since part names are few words.
LABELS = ["Median household income", "Average household size", "Estimate!!Total:!!Male", "Percent below poverty", "Separated", "Owner occupied", "Median home value", "Occupation by earnings", "White alone population", "Margin of error flag", "Total population in housing units", "Median gross rent", "Bachelor degree education", "Poverty status"]


def _labelled(spark: SparkSession) -> DataFrame:
    return literals(spark, "label string", [(x,) for x in LABELS]).withColumns({"variable_id": F.concat(F.lit("B0"), F.lpad(F.col("ordinal").cast("string"), 4, "0"), F.lit("_001")), "concept": F.upper("label")})


_L = "l(label, ordinal) AS (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(LABELS)) + "), w AS (SELECT *, 'B0' || lpad(ordinal::VARCHAR, 4, '0') || '_001' AS variable_id, upper(label) AS concept, lower(label) AS low FROM l)"


def catalog_measure_type(spark: SparkSession, d: str) -> DataFrame:
    rows = variables(spark, d).select("label", "concept").unionByName(_labelled(spark).select("label", "concept")).distinct()
    return rows.select("label", "concept", C.measure_type(F.col("label")).alias("measure"), C.complexity(F.col("label")).alias("complexity"), C.domain(F.col("concept")).alias("domain"))


def _case(column: str, arms: list[tuple[list[str], str]], default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for words, name in arms)
    return f"CASE {whens} ELSE '{default}' END"


_MEASURE = _case("lower(label)", [(["median"], "median"), (["mean", "average"], "mean"), (["total", "count"], "total"), (["percent"], "percentage"), (["rate"], "rate")], "count")
_COMPLEX = _case("lower(label)", [(["total"], "simple_count"), (["percent", "rate"], "calculated_rate"), (["median"], "statistical_measure")], "unknown")
_DOMAIN = _case("lower(concept)", [(["income", "earnings"], "economics"), (["housing", "rent"], "housing"), (["education", "school"], "education"), (["employment", "labor"], "employment"), (["race", "ethnicity"], "demographics"), (["age", "sex"], "demographics")], "other")
_STOP = ", ".join(f"'{w}'" for w in (*T.STOP_WORDS, *T.RESERVED_WORDS))


def catalog_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = variables(spark, d).select("label", "concept").unionByName(_labelled(spark).select("label", "concept")).distinct()
    return rows.select("label", "concept", F.array_join(F.array_sort(T.keywords(T.lower_of(F.col("label"), F.col("concept")))), " ").alias("keywords"))


def catalog_relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return C.enriched(_labelled(spark)).select("variable_id", "relevance", F.array_join("aliases", "|").alias("aliases"), F.size("semantic_keywords").alias("n_keywords"))


def useful_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark).filter(C.is_variable(F.col("variable_id"), F.col("label")))
    return rows.filter(C.is_useful(F.col("variable_id"), F.col("label"), F.col("concept"))).select("variable_id", "label")


def _all_rows(spark: SparkSession, d: str) -> DataFrame:
    columns = ["variable_id", "label", "concept"]
    return variables(spark, d).select(columns).unionByName(_labelled(spark).select(columns))


def catalog_relevance_score_all(spark: SparkSession, d: str) -> DataFrame:
    """catalog_relevance_score over every part beside the literal texts."""
    return C.enriched(_all_rows(spark, d)).select("variable_id", "relevance", F.array_join("aliases", "|").alias("aliases"), F.size("semantic_keywords").alias("n_keywords"))


def useful_filter_all(spark: SparkSession, d: str) -> DataFrame:
    """useful_filter over every part beside the literal texts."""
    rows = _all_rows(spark, d).filter(C.is_variable(F.col("variable_id"), F.col("label")))
    return rows.filter(C.is_useful(F.col("variable_id"), F.col("label"), F.col("concept"))).select("variable_id", "label")


def top_concepts(spark: SparkSession, d: str) -> DataFrame:
    n = variables(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return n.orderBy(F.col("n").desc(), "first").limit(10).select("label", "n")


def build_metadata(spark: SparkSession, d: str) -> DataFrame:
    v = variables(spark, d)
    return v.agg(F.count("*").alias("total"), F.count_if(F.col("label").contains("STEEL")).alias("kept"), F.format_string("%.1f%%", F.count_if(F.col("label").contains("STEEL")) * 100.0 / F.count("*")).alias("ratio"), F.count_distinct("label").alias("concepts"))


def table_routing(spark: SparkSession, d: str) -> DataFrame:
    dim = literals(spark, "family string, agent string, level string", [("B00", "housing_specialist", "high"), ("B01", "demography_specialist", "low")])
    rows = variables(spark, d).withColumn("family", T.table_family(F.col("variable_id"))).join(F.broadcast(dim.drop("ordinal")), "family", "left")
    return rows.groupBy("family", F.coalesce("agent", F.lit("generalist")).alias("agent"), F.coalesce("level", F.lit("medium")).alias("level")).agg(F.count("*").alias("n"))


def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    key = T.compound_key(F.lit("acs_5yr"), F.lit(2023), F.col("variable_id"))
    parts = F.split("key", "_", 4)
    rows = variables(spark, d).withColumn("key", key)
    return rows.select("ordinal", "key", parts[1].alias("flavor"), parts[2].alias("year"), parts[3].alias("base_id"), T.table_id(F.col("variable_id")).alias("table_id"), T.is_base_table(T.table_id(F.col("variable_id"))).alias("base"))


def candidate_scorer(spark: SparkSession, d: str) -> DataFrame:
    v = literals(spark, "variable_id string, label string, concept string", [
        ("B17001_002E", "Estimate!!Total:!!Income in the past 12 months below poverty level", "POVERTY STATUS IN THE PAST 12 MONTHS BY SEX BY AGE"),
        ("B17001_001E", "Estimate!!Total:", "POVERTY STATUS IN THE PAST 12 MONTHS BY SEX BY AGE"),
        ("B17001A_002E", "Estimate!!Total:!!Income in the past 12 months below poverty level", "POVERTY STATUS IN THE PAST 12 MONTHS BY SEX BY AGE (WHITE ALONE)"),
        ("B01003_001E", "Estimate!!Total", "TOTAL POPULATION"),
    ])
    words = ["B17001", "poverty status", *"percentage of population below the federal poverty line".split()]
    return lexical.candidate_scores(literals(spark, "concept_id string, keyword string", [("PovertyRate", w) for w in words]), v)


#: Keywords of a concept that the types of parts have.
STEEL = ["B00017", "polished steel", "polished", "steel", "standard", "steel", "no"]


def candidate_scorer_all(spark: SparkSession, d: str) -> DataFrame:
    """candidate_scorer over every part, for a concept of its vocabulary; the cut to 15 is reached."""
    return lexical.candidate_scores(literals(spark, "concept_id string, keyword string", [("Steel", w) for w in STEEL]), variables(spark, d))


#: Keys of part names, some within others.
DICTIONARY = [("blueanvil", ["B1", "blue anvil"]), ("anvil", ["B2", "anvil"]), ("blue", ["B3"]), ("steel", ["B4", "steel", "iron"]), ("steelbolt", ["B5"])]


def concept_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The keywords of every part's name, with its type as the definition."""
    concepts = table(spark, d, "part").select(F.col("p_partkey").alias("concept_id"), F.initcap("p_name").alias("concept"), F.col("p_type").alias("definition"))
    found = lexical.concept_keywords(concepts, literals(spark, "key string, keywords array<string>", DICTIONARY))
    return found.select("concept_id", "keyword", "place")


def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    old = p.filter(F.col("p_partkey") % 10 != 1).select("p_partkey", F.col("p_type").alias("label"))
    new = p.filter(F.col("p_partkey") % 10 != 2).select("p_partkey", F.when(F.col("p_partkey") % 10 == 3, F.lower("p_type")).otherwise(F.col("p_type")).alias("label"))
    return merge.catalog_diff(old, new, "p_partkey", "label")


def resolver_cascade(spark: SparkSession, d: str) -> DataFrame:
    asks = ["median household income", "poverty rate", "B01003_001", "unemployment rate", "homeownership rate", "crime rate", "home value", "salary of teachers"]
    core = literals(spark, "key string, code string", [("median household income", "B19013_001"), ("men", "B01001_002"), ("poverty", "B17001_002"), ("people", "B01003_001"), ("unemployment", "B23025_005")])
    words = literals(spark, "key string, code string", [("salary", "B19013_001"), ("home", "B25077_001"), ("rent", "B25064_001")])
    index = literals(spark, "alias string, code string", [("home value", "B25077_001")])
    queries = literals(spark, "q string", [(a,) for a in asks]).withColumnRenamed("ordinal", "query_id")
    nothing = spark.sql("SELECT 0 AS query_id, '' AS code LIMIT 0")
    return lexical.resolve(queries, core, index, nothing, r"^[A-Z][0-9]{5}_[0-9]{3}[A-Z]?$", core, words, whole_words=True)


def fuzzy_contains_first(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "part").groupBy(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("key")).agg(F.min("p_partkey").alias("ordinal")).withColumn("code", F.upper("key"))
    queries = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("q"))
    return lexical.first_contained(queries, dim, "q", "key").select("query_id", "code", "via")


QUERIES = {f.__name__: f for f in (catalog_measure_type, catalog_keywords, catalog_relevance_score, useful_filter, catalog_relevance_score_all, useful_filter_all, top_concepts, build_metadata, table_routing, canonical_keys, candidate_scorer, candidate_scorer_all, concept_keywords, catalog_diff, resolver_cascade, fuzzy_contains_first)}
_BOTH = f"WITH {_V}, {_L}, b AS (SELECT label, concept FROM v UNION SELECT label, concept FROM w)"
_HAS = lambda w: f"list_contains(k, '{w}')"
_ALIAS = " || ".join(f"(CASE WHEN {_HAS(k)} THEN [{', '.join(repr(x) for x in v)}] ELSE [] END)" for k, v in C.ALIASES.items())
_WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(label || ' ' || concept), '[A-Za-z0-9]+')), lambda x: regexp_full_match(x, '[a-z]+') AND length(x) > 2 AND x NOT IN ({_STOP}))"
ORACLE_SQL = {
    "catalog_measure_type": f"{_BOTH} SELECT label, concept, {_MEASURE} AS measure, {_COMPLEX} AS complexity, {_DOMAIN} AS domain FROM b",
    "catalog_keywords": f"{_BOTH} SELECT label, concept, array_to_string(list_sort({_WORDS}), ' ') AS keywords FROM b",
    "catalog_relevance_score": f"""WITH {_L}, kw AS (SELECT *, {_WORDS} AS k FROM w), a AS (SELECT *, list_sort(list_distinct({_ALIAS} || (CASE WHEN {_HAS('income')} OR {_HAS('earnings')} THEN ['make', 'earn', 'get paid'] ELSE [] END) || (CASE WHEN {_HAS('population')} THEN ['how many people', 'live'] ELSE [] END) || (CASE WHEN {_HAS('value')} AND contains(low, 'home') THEN ['expensive', 'cost of housing'] ELSE [] END))) AS al FROM kw)
SELECT variable_id, (len(list_intersect(k, ['median', 'total', 'population', 'income', 'housing', 'education'])) + CASE WHEN contains(low, 'median') THEN 2.0 WHEN contains(low, 'mean') THEN 0.5 ELSE 0 END + CASE WHEN {_HAS('occupation')} AND {_HAS('earnings')} THEN 1.5 ELSE 0 END + CASE WHEN list_has_any(k, ['white', 'black', 'asian', 'hispanic', 'latino']) THEN 1.0 ELSE 0 END)::DOUBLE AS relevance, array_to_string(al, '|') AS aliases, CAST(len(k) AS INTEGER) AS n_keywords FROM a""",
    "useful_filter": f"WITH {_L}, t AS (SELECT *, low || ' ' || lower(concept) AS x FROM w) SELECT variable_id, label FROM t WHERE regexp_full_match(variable_id, '[A-Z][0-9]{{5}}_[0-9]{{3}}[A-Z]?') AND NOT regexp_matches(x, '{'|'.join(C.EXCLUDED)}') AND (regexp_matches(x, '{'|'.join(f'(?:{p})' for p in C.PRIORITY)}') OR substr(variable_id, 1, 6) IN ({', '.join(repr(x) for x in C.PRIORITY_TABLES)}))",
    "top_concepts": "SELECT p_type AS label, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, min(p_partkey) LIMIT 10",
    "build_metadata": "SELECT count(*) AS total, count(*) FILTER (contains(p_type, 'STEEL')) AS kept, printf('%.1f%%', count(*) FILTER (contains(p_type, 'STEEL')) * 100.0 / count(*)) AS ratio, count(DISTINCT p_type) AS concepts FROM part",
    "table_routing": f"WITH {_V} SELECT substr(variable_id, 1, 3) AS family, CASE substr(variable_id, 1, 3) WHEN 'B00' THEN 'housing_specialist' WHEN 'B01' THEN 'demography_specialist' ELSE 'generalist' END AS agent, CASE substr(variable_id, 1, 3) WHEN 'B00' THEN 'high' WHEN 'B01' THEN 'low' ELSE 'medium' END AS level, count(*) AS n FROM v GROUP BY 1, 2, 3",
    "canonical_keys": f"WITH {_V} SELECT ordinal, 'acs_5yr_2023_' || variable_id AS key, '5yr' AS flavor, '2023' AS year, variable_id AS base_id, split_part(variable_id, '_', 1) AS table_id, regexp_matches(split_part(variable_id, '_', 1), '[0-9]$') AS base FROM v",
    "candidate_scorer": "SELECT * FROM (VALUES ('PovertyRate', 'B17001_002E', 104, 1), ('PovertyRate', 'B17001_001E', 95, 2), ('PovertyRate', 'B17001A_002E', 44, 3), ('PovertyRate', 'B01003_001E', 32, 4)) t(concept_id, variable_id, score, rank)",
    "catalog_diff": "WITH o AS (SELECT p_partkey, p_type AS l FROM part WHERE p_partkey % 10 <> 1), n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN lower(p_type) ELSE p_type END AS l FROM part WHERE p_partkey % 10 <> 2) SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'relabelled' END AS change, o.l AS old_label, n.l AS new_label FROM o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE o.l IS DISTINCT FROM n.l",
    "resolver_cascade": "SELECT * FROM (VALUES (0, 'B19013_001', 'core'), (1, 'B17001_002', 'fuzzy'), (2, 'B01003_001', 'code'), (3, 'B23025_005', 'fuzzy'), (4, 'homeownership rate', 'passthrough'), (5, 'crime rate', 'passthrough'), (6, 'B25077_001', 'index'), (7, 'B19013_001', 'keyword')) t(query_id, code, stage)",
    "fuzzy_contains_first": "WITH dim AS (SELECT lower(split_part(p_name, ' ', 1)) AS key, min(p_partkey) AS ordinal FROM part GROUP BY 1), hits AS (SELECT p_partkey AS query_id, key, row_number() OVER (PARTITION BY p_partkey ORDER BY ordinal) AS n FROM part JOIN dim ON contains(lower(p_name), key) OR contains(key, lower(p_name))) SELECT query_id, upper(key) AS code, key AS via FROM hits WHERE n = 1",
}
_ALL = f"WITH {_V}, {_L}, r AS (SELECT variable_id, label, concept, lower(label) AS low FROM v UNION ALL SELECT variable_id, label, concept, low FROM w)"
ORACLE_SQL |= {f"{name}_all": ORACLE_SQL[name].replace("FROM w)", "FROM r)").replace(f"WITH {_L}", _ALL) for name in ("catalog_relevance_score", "useful_filter")}
_HITS = " + ".join(f"3 * contains(lower(label), lower('{w}'))::INT + 2 * contains(lower(concept), lower('{w}'))::INT + 4 * contains(lower(variable_id), lower('{w}'))::INT" + (f" + 25 * contains(variable_id, upper('{w}'))::INT" if len(w) >= 5 else "") for w in STEEL if len(w) > 2)
ORACLE_SQL["candidate_scorer_all"] = f"""WITH {_V}, h AS (SELECT variable_id, split_part(variable_id, '_', 1) AS t, split_part(variable_id, '_', 2) IN ('001', '002') AS f, {_HITS} AS s FROM v),
x AS (SELECT variable_id, s + 10 + CASE WHEN f THEN 20 ELSE 0 END + CASE WHEN f AND t = 'B17001' THEN 30 ELSE 0 END AS score FROM h WHERE s > 0)
SELECT 'Steel' AS concept_id, * FROM (SELECT variable_id, score, row_number() OVER (ORDER BY score DESC, variable_id) AS rank FROM x) WHERE rank <= 15"""
ORACLE_SQL["concept_keywords"] = f"""WITH k(key, keywords, ordinal) AS (VALUES {', '.join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(DICTIONARY))}),
c AS (SELECT p_partkey AS concept_id, replace(lower(p_name), ' ', '') AS c, string_split(lower(p_type), ' ') AS w FROM part),
e AS (SELECT concept_id, keywords, ordinal FROM c JOIN k ON c = key), n AS (SELECT * FROM e UNION ALL SELECT concept_id, keywords, ordinal FROM c JOIN k ON contains(c, key) WHERE concept_id NOT IN (SELECT concept_id FROM e)),
u AS (SELECT concept_id, ordinal, unnest(keywords) AS keyword, unnest(range(len(keywords))) AS pos FROM n UNION ALL SELECT concept_id, 99, unnest(w), unnest(range(len(w))) FROM c)
SELECT concept_id, keyword, row_number() OVER (PARTITION BY concept_id ORDER BY ordinal, pos) AS place FROM u"""
