"""Queries: the resolver over a catalog, direct phrases, several columns, answers, comparisons and cached answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import answer as A
from tabulon.operators import fulltext
from tabulon.plans.catalog import _V, variables
from tabulon.plans.estimates import nation_orders
from tabulon.plans.search import _index
from tabulon.sources.tables import literals, table

CORE = [("economy", "T1"), ("promo", "T2"), ("price of brand#5", "T5"), ("men", "T6")]
KEYWORDS = [("salary", "K1"), ("rent", "K2")]
CODE = r"^[A-Z][0-9]{5}_[0-9]{3}[A-Z]?$"


def resolver_cascade_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every part asks by its name, its name's words swapped, its id, a keyword, its type or its brand."""
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    forms = [F.col("p_name"), F.concat_ws(" ", F.get(words, F.lit(1)), words[0]), F.col("variable_id"), F.concat(F.lit("salary of "), "p_brand"), F.col("p_type"), F.col("p_brand")]
    ids = variables(spark, d).select(F.col("ordinal").alias("p_partkey"), "variable_id")
    form = F.pmod(F.col("p_partkey"), F.lit(len(forms)))
    pick = forms[-1]
    for i, c in enumerate(forms[:-1]):
        pick = F.when(form == i, c).otherwise(pick)
    asked = p.join(ids, "p_partkey").select("p_partkey", F.lower(pick).alias("q"))
    labels = p.groupBy(F.lower("p_name").alias("label")).agg(F.min("p_partkey").alias("ordinal")).withColumn("code", F.concat(F.lit("P"), F.col("ordinal").cast("string")))
    found = A.resolve_texts(asked, labels, literals(spark, "key string, code string", CORE), literals(spark, "key string, code string", KEYWORDS), CODE)
    return asked.join(found, "q").select("p_partkey", "q", "code", "stage")


PHRASES = [("handbook", 0), ("house guide", 5), ("the lost handbook", -7)]
ASKED = [(-1, " Handbook "), (-2, "house guide"), (-3, "The lost handbook"), (-4, "guide to the house")]


def keyword_search_direct(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    queries = table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("q")).unionByName(literals(spark, "query_id long, q string", ASKED).drop("ordinal"))
    phrases = literals(spark, "phrase string, doc_id long", PHRASES).drop("ordinal")
    found = A.direct_or_keyword(queries, phrases, docs, _index(spark, d), "doc_id", 10)
    return found.select("query_id", "doc_id", F.round("confidence", 6).alias("confidence"), "match_type", "rank")


TERMS = [(1, "widget", None), (1, "economy", None), (2, "large", "label"), (3, "large", "concept"), (3, "bolt", None), (4, "brand", "grp"), (4, "5", "grp"), (4, "rod", None), (5, "unheard", None), (6, "large", None), (6, "large", "label")]
FIELDS = ["variable_id", "label", "concept", "grp", "size", "price", "family", "number"]


def bm25_columns(spark: SparkSession, d: str) -> DataFrame:
    """Terms over eight columns of every part, some limited to one column."""
    more = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"), F.concat(F.lit("price "), F.floor("p_retailprice").cast("string")).alias("price"), F.col("p_partkey").cast("string").alias("number"))
    docs = variables(spark, d).withColumnRenamed("group", "grp").withColumn("family", F.substring("variable_id", 1, 3)).join(more, "ordinal")
    terms = literals(spark, "query_id int, token string, field string", TERMS).drop("ordinal")
    return A.search_columns(terms, docs, "ordinal", FIELDS, 3).select("query_id", "ordinal", "score", "rank")


#: Query strings of every form; the clauses that they stand for: (query, alternative, part, excluded, clause, field, words, prefix).
STRINGS = [
    (1, "large widget"), (2, "large OR rod"), (3, "steel NOT widget"), (4, '"economy"'), (5, "label:economy bolt"), (6, "eco* anv*"), (7, '"blue anvil" OR "rod"'), (8, "concept : blue NOT anvil NOT rod"),
    (9, "owner-occupied"), (10, "bachelor's"), (11, "65+"), (12, 'an "open quote'), (13, "rate: x"), (14, ""), (15, "price AND size NOT widget bolt"), (16, '"blue anv"*'), (17, "OR blue"), (18, None), (19, "unheard OR anvil AND promo"),
]
CLAUSES = [
    (1, 0, 0, False, 0, None, "large", False), (1, 0, 0, False, 1, None, "widget", False), (2, 0, 0, False, 0, None, "large", False), (2, 1, 1, False, 2, None, "rod", False),
    (3, 0, 0, False, 0, None, "steel", False), (3, 0, 1, True, 2, None, "widget", False), (4, 0, 0, False, 0, None, "economy", False), (5, 0, 0, False, 0, "label", "economy", False), (5, 0, 0, False, 1, None, "bolt", False),
    (6, 0, 0, False, 0, None, "eco", True), (6, 0, 0, False, 1, None, "anv", True), (7, 0, 0, False, 0, None, "blue anvil", False), (7, 1, 1, False, 2, None, "rod", False),
    (8, 0, 0, False, 0, "concept", "blue", False), (8, 0, 1, True, 2, None, "anvil", False), (8, 0, 2, True, 4, None, "rod", False),
    (15, 0, 0, False, 0, None, "price", False), (15, 0, 1, False, 2, None, "size", False), (15, 0, 2, True, 4, None, "widget", False), (15, 0, 2, True, 5, None, "bolt", False),
    (16, 0, 0, False, 0, None, "blue anv", True), (19, 0, 0, False, 0, None, "unheard", False), (19, 1, 1, False, 2, None, "anvil", False), (19, 1, 2, False, 4, None, "promo", False),
]


def _catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    more = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("size"), F.concat(F.lit("price "), F.floor("p_retailprice").cast("string")).alias("price"), F.col("p_partkey").cast("string").alias("number"))
    return variables(spark, d).withColumnRenamed("group", "grp").withColumn("family", F.substring("variable_id", 1, 3)).join(more, "ordinal")


def fts_query(spark: SparkSession, d: str) -> DataFrame:
    """Query strings of every form, and every name of a part as a phrase with its type as a prefix, over eight columns of every part."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("t"))
    asked = names.select((F.col("k") + 100).cast("long").alias("query_id"), F.concat(F.lit('"'), "p_name", F.lit('" label:'), F.substring("t", 1, 3), F.lit("*")).alias("q"))
    asked = asked.unionByName(literals(spark, "query_id long, q string", STRINGS).drop("ordinal"))
    return fulltext.match_search(asked, _catalog_columns(spark, d), "ordinal", FIELDS, 3).select("query_id", "ordinal", "score", "rank")


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    """level, name, code, estimate, moe of nations and of all together, for two variables."""
    rows = nation_orders(spark, d).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = rows.select(F.concat("n_name", F.lit(" city, "), "r_name").alias("name"), F.expr("stack(2, 'V_TOTAL', cast(o_totalprice AS double), 'V_BALANCE', cast(c_acctbal AS double)) AS (code, x)"))
    moe = F.lit(A.retrieval.stats.Z90) * F.stddev_samp("x") / F.sqrt(F.count("x"))
    grouped = both.groupingSets([[F.col("code"), F.col("name")], [F.col("code")]], F.col("code"), F.col("name")).agg(F.avg("x").alias("estimate"), moe.alias("moe"), F.grouping("name").alias("g"))
    return grouped.select(F.when(F.col("g") == 1, "us").otherwise("place").alias("level"), F.coalesce("name", F.lit("United States")).alias("name"), "code", "estimate", "moe")


LABELS = [("V_TOTAL", "Total price of orders"), ("V_BALANCE", "Customer account balance")]
VARIABLES = ["order value", "Account balance", "shoe size"]


def answer_path(spark: SparkSession, d: str) -> DataFrame:
    """Every nation, some unknown and national places, for three phrases: one by the core, one by text, one unknown."""
    n = table(spark, d, "nation")
    places = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit(" town"))).alias("location"))
    places = places.unionByName(literals(spark, "location string", [("USA",), (" Atlantis",), ("Maryland",)]).drop("ordinal"))
    requests = places.withColumn("variable", F.explode(F.array(*map(F.lit, VARIABLES)))).withColumn("request_id", F.concat_ws("/", "location", "variable"))
    labels = literals(spark, "code string, label string", LABELS)
    core = A.with_mapping(literals(spark, "key string, code string", [("order value", "V_OLD")]), "Order value", "V_TOTAL")
    asked = literals(spark, "variable string", [(v,) for v in VARIABLES]).select("variable", F.lower(F.trim("variable")).alias("q"))
    found = A.resolve_texts(asked, labels, core, literals(spark, "key string, code string", KEYWORDS), CODE)
    out = A.answer(requests, asked.join(found, "q").select("variable", "code"), _estimates(spark, d))
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("request_id", "code", "geography", "name", r("estimate"), r("moe"), r("moe_pct"), "shown", "error")


def compare_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every nation of the table, with or without orders, and an unknown one by three variables."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = both.select(F.concat("n_name", F.lit(" city, "), "r_name").alias("name")).unionByName(literals(spark, "name string", [("Atlantis",)]).drop("ordinal"))
    out = A.compare(places, ["V_TOTAL", "V_BALANCE", "V_NONE"], _estimates(spark, d))
    r = lambda c: F.round(c, 4).alias(c)
    return out.select("name", "code", r("estimate"), r("moe"), r("cv_pct"), "reliability", "cell")


def semantic_cache(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows divisible by 50; a cached answer is another row's, of cosine 0.5 or more (few are nearer)."""
    rows = table(spark, d, "embeddings")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return A.cached_answers(queries, "query_id", "q", rows, "vec_id", "embedding", 0.5, others=True).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def semantic_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Queries that are rows with every component bent a little, or with half of them gone: the first are answered from the cache at 0.95."""
    rows = table(spark, d, "embeddings")
    bent = F.transform("embedding", lambda x, i: x.cast("double") * F.when((F.col("vec_id") % 100 != 0) | (i < 32), 1 + ((F.col("vec_id") + i) % 7) / 50).otherwise(F.lit(0.0)))
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), bent.alias("q"))
    return A.cached_answers(queries, "query_id", "q", rows, "vec_id", "embedding").select("query_id", "vec_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (resolver_cascade_parts, keyword_search_direct, bm25_columns, fts_query, answer_path, compare_matrix, semantic_cache, semantic_cache_hits)}

_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_values = lambda rows: ", ".join(f"({', '.join(map(_sql, r))})" for r in rows)
_tok = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_score = "round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6)"
_dim = lambda name, rows: f"{name}(key, code, ordinal) AS (VALUES {_values([(*r, i) for i, r in enumerate(rows)])})"
_est = """b AS (SELECT n_name || ' city, ' || r_name AS name, unnest([{'code': 'V_TOTAL', 'x': o_totalprice::DOUBLE}, {'code': 'V_BALANCE', 'x': c_acctbal::DOUBLE}], recursive := true) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT 'place' AS level, name, code, avg(x) AS estimate, 1.645 * stddev_samp(x) / sqrt(count(x)) AS moe FROM b GROUP BY name, code UNION ALL SELECT 'us', 'United States', code, avg(x), 1.645 * stddev_samp(x) / sqrt(count(x)) FROM b GROUP BY code)"""
_shown = "format('{:,} (±{:,}, {:.1f}%)', CAST(round(estimate) AS BIGINT), CAST(round(moe) AS BIGINT), CASE WHEN estimate > 0 THEN moe / estimate * 100 ELSE 0 END)"
_cell = f"CASE WHEN moe IS NULL THEN format('{{:,}}', CAST(round(estimate) AS BIGINT)) ELSE {_shown} END"
ORACLE_SQL = {
    "resolver_cascade_parts": f"""WITH {_V}, {_dim('core', CORE)}, {_dim('kw', KEYWORDS)},
a AS (SELECT p_partkey, lower(CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN variable_id WHEN 3 THEN 'salary of ' || p_brand WHEN 4 THEN p_type ELSE p_brand END) AS q FROM part JOIN v ON p_partkey = ordinal),
u AS (SELECT DISTINCT q FROM a), l AS (SELECT lower(p_name) AS label, min(p_partkey) AS id FROM part GROUP BY 1),
tok AS (SELECT id, unnest({_tok.format('label')}) AS token FROM l), p AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT id, count(*) AS dl FROM tok GROUP BY 1), w AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
t AS (SELECT q, unnest(list_distinct({_tok.format('q')})) AS token FROM u), x AS (SELECT q, id, {_score} AS score, count(*) AS met FROM t JOIN p USING (token) JOIN df USING (token) JOIN dl USING (id), w GROUP BY 1, 2),
best AS (SELECT q, 'P' || id AS code FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS n FROM x WHERE met = len(list_distinct({_tok.format('q')}))) WHERE n = 1),
fz AS (SELECT q, arg_min(code, ordinal) AS code FROM u JOIN core ON contains(' ' || q || ' ', ' ' || key || ' ') OR contains(' ' || key || ' ', ' ' || q || ' ') GROUP BY q), ks AS (SELECT q, arg_min(code, ordinal) AS code FROM u JOIN kw ON contains(' ' || q || ' ', ' ' || key || ' ') GROUP BY q),
r AS (SELECT u.q, core.code AS c1, 'P' || l.id AS c2, best.code AS c3, CASE WHEN regexp_full_match(upper(u.q), '[A-Z][0-9]{{5}}_[0-9]{{3}}[A-Z]?') THEN upper(u.q) END AS c4, fz.code AS c5, ks.code AS c6 FROM u LEFT JOIN core ON u.q = core.key LEFT JOIN l ON u.q = l.label LEFT JOIN best ON u.q = best.q LEFT JOIN fz ON u.q = fz.q LEFT JOIN ks ON u.q = ks.q)
SELECT p_partkey, q, coalesce(c1, c2, c3, c4, c5, c6, q) AS code, CASE WHEN c1 IS NOT NULL THEN 'core' WHEN c2 IS NOT NULL THEN 'index' WHEN c3 IS NOT NULL THEN 'text' WHEN c4 IS NOT NULL THEN 'code' WHEN c5 IS NOT NULL THEN 'fuzzy' WHEN c6 IS NOT NULL THEN 'keyword' ELSE 'passthrough' END AS stage FROM a JOIN r USING (q)""",
    "keyword_search_direct": f"""WITH q AS (SELECT item_id::BIGINT AS query_id, text AS q FROM benchmark UNION ALL SELECT * FROM (VALUES {_values(ASKED)})), f(phrase, doc_id) AS (VALUES {_values(PHRASES)}),
r AS (SELECT query_id, doc_id FROM q JOIN f ON lower(trim(q)) = phrase WHERE doc_id IN (SELECT doc_id FROM documents)), toks AS (SELECT doc_id, unnest({_tok.format('text')}) AS token FROM documents), p AS (SELECT DISTINCT doc_id, token FROM toks),
a AS (SELECT query_id, len({_tok.format('q')}) AS n, unnest({_tok.format('q')}) AS token FROM q WHERE query_id NOT IN (SELECT query_id FROM r)), h AS (SELECT query_id, n, doc_id, count(*) AS matches FROM a JOIN p USING (token) GROUP BY 1, 2, 3)
SELECT query_id, doc_id, 1.0::DOUBLE AS confidence, 'direct' AS match_type, 1 AS rank FROM r UNION ALL
SELECT query_id, doc_id, round(least(matches / n, 1.0), 6), 'keyword', rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank FROM h) WHERE rank <= 10""",
    "bm25_columns": f"""WITH {_V}, q(query_id, token, field) AS (VALUES {_values(TERMS)}),
c AS (SELECT ordinal, unnest([{{'field': 'variable_id', 'body': variable_id}}, {{'field': 'label', 'body': label}}, {{'field': 'concept', 'body': concept}}, {{'field': 'grp', 'body': "group"}}, {{'field': 'size', 'body': 'size ' || p_size}}, {{'field': 'price', 'body': 'price ' || floor(p_retailprice)::BIGINT}}, {{'field': 'family', 'body': substr(variable_id, 1, 3)}}, {{'field': 'number', 'body': p_partkey::VARCHAR}}], recursive := true) FROM v JOIN part ON p_partkey = ordinal),
t AS (SELECT ordinal, field AS f, unnest({_tok.format('body')}) AS token FROM c), dl AS (SELECT ordinal, count(*) AS dl FROM t GROUP BY 1), w AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
m AS (SELECT token, coalesce(field, '') AS want, ordinal, count(*) AS tf FROM t JOIN (SELECT DISTINCT token, field FROM q) USING (token) WHERE field IS NULL OR field = f GROUP BY 1, 2, 3), df AS (SELECT token, want, count(*) AS df FROM m GROUP BY 1, 2),
n AS (SELECT query_id, count(*) AS needed FROM q GROUP BY 1), x AS (SELECT query_id, ordinal, {_score} AS score, count(*) AS met FROM (SELECT query_id, token, coalesce(field, '') AS want FROM q) JOIN m USING (token, want) JOIN df USING (token, want) JOIN dl USING (ordinal), w GROUP BY 1, 2)
SELECT query_id, ordinal, score, rank FROM (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM x JOIN n USING (query_id) WHERE met = needed) WHERE rank <= 3""",
    "fts_query": f"""WITH {_V}, lit(query_id, alternative, part, excluded, clause, field, words, prefix) AS (VALUES {_values(CLAUSES)}),
nm AS (SELECT p_name, min(p_partkey) + 100 AS query_id, lower(substr(min(p_type), 1, 3)) AS t FROM part GROUP BY p_name),
q AS (SELECT * FROM lit UNION ALL SELECT query_id, 0, 0, FALSE, 0, NULL, p_name, FALSE FROM nm UNION ALL SELECT query_id, 0, 0, FALSE, 1, 'label', t, TRUE FROM nm),
c AS (SELECT ordinal, unnest([{{'field': 'variable_id', 'body': variable_id}}, {{'field': 'label', 'body': label}}, {{'field': 'concept', 'body': concept}}, {{'field': 'grp', 'body': "group"}}, {{'field': 'size', 'body': 'size ' || p_size}}, {{'field': 'price', 'body': 'price ' || floor(p_retailprice)::BIGINT}}, {{'field': 'family', 'body': substr(variable_id, 1, 3)}}, {{'field': 'number', 'body': p_partkey::VARCHAR}}], recursive := true) FROM v JOIN part ON p_partkey = ordinal),
g AS (SELECT ordinal, field AS f, {_tok.format('body')} AS w FROM c), dl AS (SELECT ordinal, sum(len(w)) AS dl FROM g GROUP BY 1 HAVING sum(len(w)) > 0), w AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
o AS (SELECT q.query_id, clause, alternative, part, excluded, ordinal, sum(len(list_filter(range(1, len(g.w) - len(string_split(words, ' ')) + 2), lambda i: CASE WHEN prefix THEN starts_with(array_to_string(g.w[i:i + len(string_split(words, ' ')) - 1], ' '), words) ELSE array_to_string(g.w[i:i + len(string_split(words, ' ')) - 1], ' ') = words END))) AS tf
  FROM q JOIN g ON field IS NULL OR field = f GROUP BY ALL HAVING tf > 0),
n AS (SELECT query_id, alternative, part, excluded, count(*) AS needed FROM q GROUP BY ALL), h AS (SELECT query_id, alternative, part, excluded, ordinal, count(*) AS met FROM o GROUP BY ALL),
pt AS (SELECT h.query_id, h.alternative, h.excluded, ordinal FROM h JOIN n ON h.query_id = n.query_id AND h.part = n.part AND met = needed), pos AS (SELECT query_id, alternative, count(*) AS parts FROM n WHERE NOT excluded GROUP BY ALL),
mt AS (SELECT DISTINCT query_id, ordinal FROM (SELECT query_id, alternative, ordinal, count(*) FILTER (NOT excluded) AS met, bool_or(excluded) AS gone FROM pt GROUP BY ALL) JOIN pos USING (query_id, alternative) WHERE met = parts AND NOT gone),
df AS (SELECT query_id, clause, count(*) AS df FROM o WHERE NOT excluded GROUP BY ALL), x AS (SELECT query_id, ordinal, {_score} AS score FROM o JOIN mt USING (query_id, ordinal) JOIN df USING (query_id, clause) JOIN dl USING (ordinal), w WHERE NOT excluded GROUP BY ALL)
SELECT query_id, ordinal, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM x) WHERE rank <= 3""",
    "answer_path": f"""WITH {_est}, pl(location) AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) || ' town' END FROM nation UNION ALL VALUES ('USA'), (' Atlantis'), ('Maryland')),
va(variable, code) AS (VALUES ('order value', 'V_TOTAL'), ('Account balance', 'V_BALANCE'), ('shoe size', 'shoe size')),
a AS (SELECT location || '/' || variable AS request_id, code, CASE WHEN location = 'USA' THEN 'us' WHEN location = 'Maryland' THEN 'state' ELSE 'place' END AS geography, CASE WHEN location IN ('USA', 'Maryland') THEN NULL WHEN contains(location, ' town') THEN location ELSE trim(location) || ' city' END AS place FROM pl, va),
m AS (SELECT place, name, CASE WHEN lower(name) = lower(place) THEN 1 WHEN starts_with(lower(name), lower(place) || ',') THEN 2 WHEN contains(lower(name), regexp_replace(lower(place), ' (city|town)$', '')) THEN 6 END AS rule FROM (SELECT DISTINCT place FROM a), (SELECT DISTINCT name FROM e WHERE level = 'place')),
f AS (SELECT place, name FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY rule, name) AS n FROM m WHERE rule IS NOT NULL) WHERE n = 1),
o AS (SELECT a.request_id, a.code, a.geography, e.name, e.estimate, e.moe FROM a LEFT JOIN f USING (place) LEFT JOIN e ON e.code = a.code AND e.name = coalesce(f.name, CASE WHEN geography = 'us' THEN 'United States' END))
SELECT request_id, code, geography, name, round(estimate, 4) AS estimate, round(moe, 4) AS moe, round(CASE WHEN estimate > 0 THEN moe / estimate * 100 WHEN moe IS NOT NULL THEN 0 END, 4) AS moe_pct, {_cell} AS shown, CASE WHEN estimate IS NULL THEN 'no data found' END AS error FROM o""",
    "compare_matrix": f"""WITH {_est}, pl(name) AS (SELECT n_name || ' city, ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL VALUES ('Atlantis')), va(code) AS (VALUES ('V_TOTAL'), ('V_BALANCE'), ('V_NONE')),
o AS (SELECT name, code, estimate, moe, CASE WHEN estimate > 0 THEN moe / 1.645 / estimate * 100 END AS cv FROM pl CROSS JOIN va LEFT JOIN e USING (name, code))
SELECT name, code, round(estimate, 4) AS estimate, round(moe, 4) AS moe, round(cv, 4) AS cv_pct, CASE WHEN cv < 15 THEN 'reliable' WHEN cv < 30 THEN 'caution' WHEN cv >= 30 THEN 'unreliable' END AS reliability, CASE WHEN estimate IS NULL THEN 'N/A' ELSE {_cell} END AS cell FROM o""",
    "semantic_cache": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS score FROM e, e q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM x) WHERE n = 1 AND score >= 0.5",
    "semantic_cache_hits": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, list_transform(v, lambda x, i: x * CASE WHEN vec_id % 100 <> 0 OR i <= 32 THEN 1 + ((vec_id + i - 1) % 7) / 50 ELSE 0.0 END) AS v FROM e WHERE vec_id % 50 = 0),
x AS (SELECT query_id, vec_id, list_cosine_similarity(e.v, q.v) AS score FROM e, q)
SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM x) WHERE n = 1 AND score >= 0.95""",
}
