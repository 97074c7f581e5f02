"""Queries: small rules over whole tables, official labels, syntheses, mixed samples and category splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import rules as R
from tabulon.functions import text as T
from tabulon.functions.stats import topology_quality
from tabulon.operators import cluster, enrich, evaluate, geo, sample, textindex, vector
from tabulon.plans import estimates
from tabulon.plans.catalog import _STOP, _V, variables
from tabulon.plans.enrichment import _KNOWN, DOMAINS
from tabulon.plans.estimates import _geo_tables
from tabulon.plans.search import _C, _index, _pairs
from tabulon.plans.texts import _ENT
from tabulon.sources.tables import table

PAGES = {"ECONOMY": 3, "PROMO": 4, "STANDARD": 6}


def catalog_filters(spark: SparkSession, d: str) -> DataFrame:
    """Every variable with the filters that it passes, the page of its label and the flavor of its survey."""
    v = variables(spark, d)
    survey = F.when(F.col("ordinal") % 3 == 0, "acs5").when(F.col("ordinal") % 3 == 1, "acs1").otherwise("cps")
    return v.select(
        "ordinal", R.in_family(F.col("variable_id")).alias("family"), R.is_base_table(F.col("variable_id")).alias("base"), R.is_described(F.col("concept")).alias("described"),
        R.needs_category(F.when(F.col("ordinal") % 4 == 0, "other").when(F.col("ordinal") % 4 == 1, F.col("label"))).alias("uncategorised"), R.page_of(F.col("label"), PAGES).alias("page"), R.flavor(survey).alias("flavor"), R.flavor_text(survey).alias("flavor_text"),
    )


def concept_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a concept: approved without review, sent to an arbiter, with its uncertainty and its strategy."""
    e = table(spark, d, "events")
    agreement = (F.col("event_id") % 11) / 10
    level = F.when(F.col("event_id") % 5 == 0, "high").when(F.col("event_id") % 5 == 1, "low")
    auto = R.review_decision(level)
    curated = e.filter("event_type = 'signup'").select("user_id").distinct().withColumn("_curated", F.lit(True))
    both = e.join(curated, "user_id", "left")
    agents = F.when(F.col("_curated"), F.array(F.lit("census_specialist"), F.concat(F.col("event_type"), F.lit("_expert")))).otherwise(F.array(F.lit("census_specialist")))
    return both.select("event_id", auto["decision"].alias("decision"), auto["confidence"].alias("confidence"), R.arbitration(agreement).alias("arbitrate"), F.round(R.uncertainty(agreement), 6).alias("uncertainty"), F.when(F.col("_curated"), "multi_agent").otherwise("single").alias("strategy"), F.array_join(agents, ",").alias("agents"))


def official_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every variable's embedding text from the official label of its type, where there is one, else from its own."""
    v = variables(spark, d)
    official = table(spark, d, "part").filter("p_size % 2 = 0").groupBy("p_type").agg(F.min("p_name").alias("o"))
    met = v.join(official, v.label == official.p_type, "left")
    chosen = F.when(F.col("o").isNotNull(), F.struct(F.concat(F.lit("Official "), "o").alias("label"), F.upper("o").alias("concept"), F.lit("acs1").alias("survey")))
    text = R.official_text(F.col("variable_id"), chosen, F.when(F.col("ordinal") % 7 == 0, "Unknown").otherwise(F.col("label")), F.when(F.col("ordinal") % 5 != 0, F.col("concept")), F.lit(None).cast("string"))
    return met.select("ordinal", text["text"].alias("text"), text["source"].alias("source"))


def agent_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """The turns of every conversation as agents' answers, in one text."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit("_agent")).alias("agent"), F.col("text").alias("response")))).alias("a"))
    answers = F.transform("a", lambda x: F.struct(x["agent"].alias("agent"), x["response"].alias("response")))
    return turns.select("conv_id", F.md5(R.synthesis(answers)).alias("mark"), F.md5(R.synthesis(F.slice(answers, 1, 1))).alias("single"))


def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every part's texts in one, blank ones left out, with its definition cleaned."""
    p = table(spark, d, "part")
    parts = [F.when(F.col("p_size") % 3 > 0, F.col("p_type")), F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.col("p_brand")), F.col("p_name")]
    clean = R.clean_definition(F.concat(F.col("p_name"), F.lit("  \n "), F.col("p_type"), F.lit(" "), F.col("p_size").cast("string")))
    return p.select("p_partkey", R.joined_parts(*parts).alias("text"), clean.alias("definition"))


def geography_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight of category 3 in every vector's weights: the linear one, else the log one; vectors with neither are left out."""
    weights = lambda log: vector.category_weights(_pairs(spark, d).withColumn("score", F.greatest("score", F.lit(0.0))), "vec_id", "concept", 0.15, log).groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("concept").cast("string").alias("k"), "weight"))).alias("w"))
    both = weights(False).join(weights(True).withColumnRenamed("w", "g"), "vec_id")
    return both.select("vec_id", F.round(R.geography_weight(F.when(F.col("vec_id") % 2 == 0, F.col("w")), F.col("g"), "3"), 6).alias("weight")).filter("weight IS NOT NULL")


def category_weights_clipped(spark: SparkSession, d: str) -> DataFrame:
    return vector.clipped_weights(_pairs(spark, d), "vec_id", "concept", 0.15).select("vec_id", "concept", F.round("weight", 6).alias("weight"))


def level_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Tables at each level: a document's language stands for a table, its source for a level."""
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("tables"), F.count("*").alias("rows"))


def category_texts(spark: SparkSession, d: str) -> DataFrame:
    """The names of every type's parts joined, by key, and their number; types without names have none."""
    each = table(spark, d, "part").filter(F.length("p_name") > 0).groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    return each.select("p_type", F.md5(F.array_join(F.transform("x", lambda s: s["p_name"]), " | ")).alias("mark"), F.size("x").alias("n"))


def mixed_strata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 4 == 0, None).otherwise((F.col("p_size") % 4).cast("string")).alias("complexity"))
    return sample.mixed_strata(rows, "p_partkey", "p_brand", "complexity", 100, 5).select("p_partkey", "stratum")


def category_split(spark: SparkSession, d: str) -> DataFrame:
    """Label 1 of the vectors in clusters that are named by words of a document of the same number."""
    rows = table(spark, d, "embeddings").join(table(spark, d, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.min("text").alias("text")), "vec_id", "left").withColumn("category", F.concat(F.lit("Label "), F.col("label").cast("string")))
    return cluster.split_category(rows, "vec_id", "embedding", "category", "text", "Label 1", 3, -1.0).select("vec_id", "category", "new_category", "original_category")


def derived_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every part's best description, short label, weights as text, id and Turtle literal."""
    p = table(spark, d, "part")
    some = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.col("p_brand"))
    weights = F.array(F.struct(F.col("p_type").alias("key"), (F.col("p_size") / 100).alias("value")), F.struct(F.col("p_brand").alias("key"), (F.col("p_size") / 50).alias("value")))
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit('the "'), "p_name", F.lit('"'))).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit("\n"), "p_type")).otherwise(F.col("p_name"))
    return p.select("p_partkey", T.first_filled(some, F.lit(None).cast("string"), F.col("p_name")).alias("described"), T.shortened(F.col("p_name"), 8).alias("short"), T.weight_summary(weights).alias("weights"), T.camel_id(F.concat_ws(" ", "p_name", "p_type", F.lit("a x"))).alias("id"), T.turtle_string(said).alias("literal"))


def html_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Every page with each tag as a blank."""
    return table(spark, d, "pages").select("page_id", F.md5(T.html_stripped(F.col("html"))).alias("mark"))


def reasoning_chains(spark: SparkSession, d: str) -> DataFrame:
    """The first five lines of every turn and every document that hold a word of reasoning."""
    texts = table(spark, d, "conversations").select(F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("id"), "text").unionByName(table(spark, d, "documents").select(F.concat_ws("/", F.lit("d"), "doc_id").alias("id"), "text"))
    return texts.select("id", evaluate.reasoning_chain(F.col("text")).alias("chain")).filter("chain <> ''")


def clamped_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's similarity to the next one's, within 0 and 1; 0.5 without a next one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id", "left").select("vec_id", F.round(enrich.clamped_cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def topology_bands(spark: SparkSession, d: str) -> DataFrame:
    """The quality that each tax of a line item would have as a silhouette, with shares."""
    rows = table(spark, d, "lineitem").groupBy(topology_quality(F.col("l_tax") * 10).alias("quality")).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("_all")))).select("quality", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 4).alias("share"))  # one row


def weight_issues(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with every part's weights: some are negative, some don't sum to 1, some domains are unknown."""
    w, size = (F.col("p_size") % 11 / 10).cast("double"), F.col("p_size")
    weights = F.create_map(F.col("p_type"), w, F.col("p_brand"), F.when(size % 3 == 0, 1 - w).when(size % 3 == 1, -w).otherwise(F.lit(0.25)))
    return table(spark, d, "part").select("p_partkey", F.array_join(enrich.weight_issues(F.when(size % 13 > 0, weights), DOMAINS), "; ").alias("issues"))


def search_stats(spark: SparkSession, d: str) -> DataFrame:
    return textindex.index_stats(_index(spark, d))


def geo_advisor_hook(spark: SparkSession, d: str) -> DataFrame:
    """The advice of geo_advisor_status with margins from a resolver: those of the request's supplier, as a column."""
    asked, there, weights = _geo_tables(spark, d)
    return geo.advise(asked.withColumn("ratio", F.col("moe_ratio")).drop("moe_ratio"), there, weights, geo.levels(spark), lambda r: r["ratio"])


def keyword_averages(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of a variable on average, and the variables that have any, by measure."""
    v = variables(spark, d).select("label", "concept").distinct()
    words = F.size(T.keywords(T.lower_of(F.col("label"), F.col("concept"))))
    return v.agg(F.round(F.avg(words), 6).alias("mean_keywords"), F.count_if(words > 0).alias("with_keywords"), F.count("*").alias("variables"))


QUERIES = {f.__name__: f for f in (catalog_filters, concept_decisions, official_labels, agent_synthesis, joined_texts, geography_weights, category_weights_clipped, level_distribution, category_texts, mixed_strata, category_split, derived_texts, html_stripped, reasoning_chains, clamped_similarity, topology_bands, weight_issues, search_stats, geo_advisor_hook, keyword_averages)}
_md5_order = "md5('42|' || p_partkey::VARCHAR), p_partkey"
_shares = lambda raw: f"SELECT vec_id, concept, CASE WHEN any_ = 1 THEN share / sum(share) OVER (PARTITION BY vec_id) ELSE 1 END AS weight FROM (SELECT *, max((share >= 0.15)::INT) OVER (PARTITION BY vec_id) AS any_, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, concept) AS n FROM (SELECT vec_id, concept, {raw} / sum({raw}) OVER (PARTITION BY vec_id) AS share FROM (SELECT vec_id, concept, greatest(score, 0) AS score FROM s))) WHERE CASE WHEN any_ = 1 THEN share >= 0.15 ELSE n = 1 END"
_case = lambda column, pairs, default: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in pairs.items()) + f" ELSE {default} END"
ORACLE_SQL = {
    "catalog_filters": f"""WITH {_V}, s AS (SELECT *, CASE ordinal % 3 WHEN 0 THEN 'acs5' WHEN 1 THEN 'acs1' ELSE 'cps' END AS survey FROM v), f AS (SELECT *, {_case('survey', R.FLAVORS, 'survey')} AS flavor FROM s)
SELECT ordinal, regexp_matches(variable_id, '^(B|C|S|K|DP|CP|SP)') AS family, regexp_matches(variable_id, '^[BC]') AND contains(variable_id, '_') AS base, length(concept) > 10 AS described, (ordinal % 4 <> 1 OR label = 'other') AS uncategorised,
{_case('label', PAGES, '1')} AS page, flavor, {_case('flavor', R.FLAVOR_TEXTS, "'Unknown flavor: ' || flavor")} AS flavor_text FROM f""",
    "concept_decisions": """WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'approve' END AS decision, CASE WHEN event_id % 5 = 0 THEN 1.0::DOUBLE END AS confidence, (event_id % 11) / 10 < 0.4 AS arbitrate, round(1 - (event_id % 11) / 10, 6) AS uncertainty,
CASE WHEN c.user_id IS NULL THEN 'single' ELSE 'multi_agent' END AS strategy, 'census_specialist' || CASE WHEN c.user_id IS NULL THEN '' ELSE ',' || event_type || '_expert' END AS agents FROM events e LEFT JOIN c USING (user_id)""",
    "official_labels": f"""WITH {_V}, o AS (SELECT p_type, min(p_name) AS o FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT ordinal, 'V_ID_' || variable_id || ' ' || CASE WHEN o IS NOT NULL THEN 'Official ' || o || ' ' || upper(o) || ' acs1' ELSE CASE WHEN ordinal % 7 = 0 THEN 'Variable ' || variable_id ELSE label END || ' ' || CASE WHEN ordinal % 5 = 0 THEN 'Census Variable' ELSE concept END || ' acs5' END AS text,
CASE WHEN o IS NULL THEN 'FALLBACK' ELSE 'OFFICIAL' END AS source FROM v LEFT JOIN o ON label = p_type""",
    "agent_synthesis": r"""WITH t AS (SELECT conv_id, turn, role || '_agent' AS agent, upper(left(role, 1)) || substr(role, 2) || ' Agent' AS title, text FROM conversations)
SELECT conv_id, md5(CASE WHEN count(*) = 1 THEN min(text) ELSE 'Multi-specialist analysis from: ' || string_agg(agent, ', ' ORDER BY turn) || chr(10) || chr(10) || string_agg('**' || title || ' Analysis:**' || chr(10) || text || chr(10), chr(10) ORDER BY turn) END) AS mark, md5(arg_min(text, turn)) AS single FROM t GROUP BY conv_id""",
    "joined_texts": """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 3 > 0 THEN p_type END, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_brand END, p_name], lambda x: x IS NOT NULL), ' | ') AS text, trim(p_name || ' ' || p_type) AS definition FROM part""",
    "geography_weights": f"WITH {_C}, lin AS ({_shares('score')}), lg AS ({_shares('ln(1 + greatest(score, 1e-8))')}), k AS (SELECT DISTINCT vec_id FROM s) SELECT k.vec_id, round(CASE WHEN k.vec_id % 2 = 0 THEN coalesce(lin.weight, lg.weight) ELSE lg.weight END, 6) AS weight FROM k LEFT JOIN lin ON lin.vec_id = k.vec_id AND lin.concept = 3 LEFT JOIN lg ON lg.vec_id = k.vec_id AND lg.concept = 3 WHERE CASE WHEN k.vec_id % 2 = 0 THEN coalesce(lin.weight, lg.weight) ELSE lg.weight END IS NOT NULL",
    "category_weights_clipped": f"WITH {_C}, r AS (SELECT vec_id, concept, greatest(score, 0) AS raw FROM s), t AS (SELECT *, raw / (sum(raw) OVER (PARTITION BY vec_id) + 1e-8) AS share, row_number() OVER (PARTITION BY vec_id ORDER BY raw DESC, concept) AS n FROM r), a AS (SELECT *, max((share >= 0.15)::INT) OVER (PARTITION BY vec_id) AS any_ FROM t) SELECT vec_id, concept, round(CASE WHEN any_ = 1 THEN share / sum(share) OVER (PARTITION BY vec_id) ELSE 1 END, 6) AS weight FROM a WHERE CASE WHEN any_ = 1 THEN share >= 0.15 ELSE n = 1 END",
    "level_distribution": "SELECT source, count(DISTINCT lang) AS tables, count(*) AS rows FROM documents GROUP BY source",
    "category_texts": "SELECT p_type, md5(string_agg(p_name, ' | ' ORDER BY p_partkey)) AS mark, count(*)::INT AS n FROM part WHERE length(p_name) > 0 GROUP BY p_type",
    "mixed_strata": f"""WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS c FROM part), l AS (SELECT p_brand FROM r GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5),
a AS (SELECT p_partkey FROM r WHERE p_brand IN (SELECT p_brand FROM l) ORDER BY {_md5_order} LIMIT 40), b AS (SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_md5_order}) AS n FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM a)) WHERE n <= 7),
ab AS (SELECT p_partkey, 'family' AS stratum FROM a UNION ALL SELECT p_partkey, 'complexity' FROM b)
SELECT * FROM ab UNION ALL (SELECT p_partkey, 'random' FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM ab) ORDER BY {_md5_order} LIMIT (SELECT 100 - count(*) FROM ab))""",
    "derived_texts": r"""WITH p AS (SELECT *, CASE p_size % 4 WHEN 0 THEN 'the "' || p_name || '"' WHEN 1 THEN p_name || chr(10) || p_type ELSE p_name END AS said FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN p_brand ELSE p_name END AS described, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS short, format('{}: {:.2f}, {}: {:.2f}', p_type, p_size / 100, p_brand, p_size / 50) AS weights,
substr(array_to_string(list_transform(list_filter(regexp_extract_all(p_name || ' ' || p_type || ' a x', '[A-Za-z0-9]+'), lambda w: length(w) > 1), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ''), 1, 50) AS id,
CASE WHEN contains(said, '"') OR contains(said, chr(10)) THEN '\"\"\"' || replace(said, '"', '\"') || '\"\"\"' ELSE '"' || said || '"' END AS literal FROM p""".replace("'\\\"\\\"\\\"'", "'" + '"' * 3 + "'"),
    "html_stripped": "SELECT page_id, md5(" + _ENT("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ") AS mark FROM pages",
    "reasoning_chains": "WITH t AS (SELECT 'c/' || conv_id || '/' || turn AS id, text FROM conversations UNION ALL SELECT 'd/' || doc_id, text FROM documents), x AS (SELECT id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: regexp_matches(lower(l), '" + "|".join(evaluate.CHAIN) + "'))[1:5], ' | ') AS chain FROM t) SELECT id, chain FROM x WHERE chain <> ''",
    "clamped_similarity": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id, round(coalesce(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 0.5), 6) AS similarity FROM e a LEFT JOIN e b ON b.vec_id = a.vec_id + 1",
    "topology_bands": "SELECT CASE WHEN l_tax * 10 > 0.5 THEN 'excellent' WHEN l_tax * 10 > 0.3 THEN 'good' ELSE 'needs_tuning' END AS quality, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 4) AS share FROM lineitem GROUP BY 1",
    "weight_issues": f"""WITH p AS (SELECT *, (p_size % 11 / 10)::DOUBLE AS a FROM part), w AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 1 - a WHEN 1 THEN -a ELSE 0.25::DOUBLE END AS b, list_sort(list_filter([p_type, p_brand], lambda x: x NOT IN ({_KNOWN}))) AS bad FROM p)
SELECT p_partkey, CASE WHEN p_size % 13 > 0 THEN concat_ws('; ', CASE WHEN len(bad) > 0 THEN 'unknown domains: ' || array_to_string(bad, ', ') END, CASE WHEN a < 0 OR b < 0 THEN 'negative weights' END, CASE WHEN abs(a + b - 1) >= 1e-6 THEN 'weights sum to ' || format('{{:.3f}}', a + b) END) END AS issues FROM w""",
    "search_stats": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS token FROM documents), p AS (SELECT DISTINCT doc_id, token FROM t) SELECT (SELECT count(DISTINCT doc_id) FROM t) AS documents, (SELECT count(*) FROM t) AS tokens, count(DISTINCT token) AS distinct_tokens, count(*) AS postings, 1 AS segments FROM p",
    "geo_advisor_hook": estimates.ORACLE_SQL["geo_advisor_status"],
    "keyword_averages": f"WITH {_V}, b AS (SELECT DISTINCT label, concept FROM v), k AS (SELECT len(list_distinct(list_filter(regexp_extract_all(lower(label || ' ' || concept), '[A-Za-z0-9]+'), lambda t: regexp_full_match(t, '[a-z]+') AND length(t) > 2 AND t NOT IN ({_STOP})))) AS n FROM b) SELECT round(avg(n), 6) AS mean_keywords, count(*) FILTER (n > 0) AS with_keywords, count(*) AS variables FROM k",
}
