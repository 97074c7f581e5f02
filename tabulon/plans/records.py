"""Queries: consolidation, lineage, sampling and set operations over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import sql, stats
from tabulon.functions import text as T
from tabulon.operators import merge
from tabulon.sources.tables import table


def priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of equal texts the one of the best source (by number), then the smallest id."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("mark"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("priority"))
    return merge.best_by(rows, ["mark"], "priority", "doc_id").select("mark", "doc_id", "source")


def exact_dup_by_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy(F.sha1("text").alias("mark")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return rows.filter("n > 1")


def anti_exclude_processed(spark: SparkSession, d: str) -> DataFrame:
    return merge.without(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


def semi_keep_listed(spark: SparkSession, d: str) -> DataFrame:
    return merge.only(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 1"), "doc_id").select("doc_id", "source")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "documents").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return merge.upsert(old, table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")


def prefix_expand(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    prefixes = part.filter("p_size <= 5").select(F.substring_index("p_type", " ", 1).alias("prefix")).distinct()
    return merge.prefix_expand(prefixes, part, "prefix", "p_type", " ").groupBy("prefix").agg(F.count("*").alias("n"))


def left_merge_fanout(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", T.compound_key(F.lit("acs_5yr"), F.lit(2023), F.col("o_orderkey").cast("string")).alias("key"))
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max(F.when(F.col("o_orderkey").isNotNull(), F.col("key"))).alias("last_key"))


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    quota = F.when(F.col("lang") == "en", 40).when(F.col("lang") == "de", 30).otherwise(15)
    return merge.quota_sample(table(spark, d, "documents"), "lang", quota, F.md5(F.col("doc_id").cast("string"))).select("doc_id", "lang", "place")


def consolidation_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return merge.consolidation_stats(rows, "lang", rows.select(F.md5("text").alias("m")).distinct())


def union_definitions(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(T.slug(F.col("r_name")).alias("id"), F.lit("subject").alias("kind"))
    n = table(spark, d, "nation").select(F.concat(F.lit("gq_"), T.slug(F.col("n_name"))).alias("id"), F.lit("group_quarters").alias("kind"))
    return r.unionByName(n)


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    n = lambda x, name: x.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "union").unionByName(n(a.intersect(b), "intersect")).unionByName(n(a.subtract(b), "except"))


def running_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).alias("cost"))
    return merge.running_batches(rows, "conv_id", "turn", "cost", 150.0).select("conv_id", "turn", "batch")


def running_batches_sql(spark: SparkSession, d: str) -> DataFrame:
    """The same by the table function, from SQL."""
    sql.register(spark)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.size(T.tokens(F.col("text"))).cast("double").alias("cost"))
    text = "SELECT key AS conv_id, ordinal AS turn, batch FROM greedy_batches(TABLE(SELECT * FROM {rows}) PARTITION BY (conv_id) ORDER BY (turn), 150.0D)"
    return spark.sql(text, rows=rows)


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    chars = F.length("text")
    n_in, n_out = F.sum(F.when(F.col("role") == "user", chars).otherwise(0)), F.sum(F.when(F.col("role") == "assistant", chars).otherwise(0))
    cost = stats.cost_tokens(n_in) * 3e-6 + stats.cost_tokens(n_out) * 15e-6
    return c.groupBy("conv_id").agg(F.round(cost, 8).alias("usd"), F.round(stats.plan_cost(F.count("*"), F.lit("hybrid")), 6).alias("plan_usd"))


def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").withColumn("c", F.col("o_totalprice") / 500000)
    return v.groupBy(stats.confidence_tier(F.col("c")).alias("tier")).agg(F.count("*").alias("n"))


def weight_histogram(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").withColumn("kind", stats.spatial_category(F.col("l_discount") * 5))
    return w.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.min("l_discount"), 6).alias("least"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.max("l_discount"), 6).alias("most"))


QUERIES = {f.__name__: f for f in (priority_dedup, exact_dup_by_hash, anti_exclude_processed, semi_keep_listed, upsert_merge, prefix_expand, left_merge_fanout, quota_sample, consolidation_stats, union_definitions, set_operations, running_batches, running_batches_sql, cost_estimate, confidence_tiers, weight_histogram)}
_SLUG = "trim(regexp_replace(regexp_replace(lower({}), '[^A-Za-z0-9_ ]', '', 'g'), '[_ ]+', '_', 'g'), '_')"
ORACLE_SQL = {
    "priority_dedup": "SELECT mark, doc_id, source FROM (SELECT md5(text) AS mark, doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY regexp_extract(source, '[0-9]+')::INT, doc_id) AS n FROM documents) WHERE n = 1",
    "exact_dup_by_hash": "SELECT sha1(text) AS mark, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "anti_exclude_processed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "semi_keep_listed": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "upsert_merge": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CAST(coalesce(l.quality, 0) AS INTEGER) AS quality, CAST(coalesce(l.toxic, 0) AS INTEGER) AS toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "prefix_expand": "WITH p AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS prefix FROM part WHERE p_size <= 5) SELECT prefix, count(*) AS n FROM p JOIN part ON split_part(p_type, ' ', 1) = prefix GROUP BY prefix",
    "left_merge_fanout": "SELECT c_custkey, count(o_orderkey) AS n, max('acs_5yr_2023_' || o_orderkey::VARCHAR) AS last_key FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "quota_sample": "SELECT doc_id, lang, place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS place FROM documents) WHERE place <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 30 ELSE 15 END",
    "consolidation_stats": "SELECT lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(DISTINCT md5(text)) FROM documents), 2) AS share FROM documents GROUP BY lang",
    "union_definitions": f"SELECT {_SLUG.format('r_name')} AS id, 'subject' AS kind FROM region UNION ALL SELECT 'gq_' || {_SLUG.format('n_name')}, 'group_quarters' FROM nation",
    "set_operations": "SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)",
    "running_batches": "WITH RECURSIVE c AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), f AS (SELECT conv_id, turn, i, cost AS s, 0 AS batch FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.turn, c.i, CASE WHEN f.s + c.cost > 150 AND f.s > 0 THEN c.cost ELSE f.s + c.cost END, f.batch + CASE WHEN f.s + c.cost > 150 AND f.s > 0 THEN 1 ELSE 0 END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1) SELECT conv_id, turn, batch FROM f",
    "cost_estimate": "SELECT conv_id, round(sum(CASE role WHEN 'user' THEN length(text) ELSE 0 END) / 4.0 * 3e-6 + sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) / 4.0 * 15e-6, 8) AS usd, round(floor(count(*) * 0.2) * 0.006 + (count(*) - floor(count(*) * 0.2)) * 0.001, 6) AS plan_usd FROM conversations GROUP BY conv_id",
    "confidence_tiers": "SELECT CASE WHEN o_totalprice / 500000 >= 0.9 THEN 'auto' WHEN o_totalprice / 500000 >= 0.75 THEN 'review' ELSE 'low' END AS tier, count(*) AS n FROM orders GROUP BY 1",
    "weight_histogram": "SELECT CASE WHEN l_discount * 5 < 0.30 THEN 'nationally_stable' WHEN l_discount * 5 < 0.38 THEN 'regionally_variable' ELSE 'locally_clustered' END AS kind, count(*) AS n, round(min(l_discount), 6) AS least, round(avg(l_discount), 6) AS mean, round(max(l_discount), 6) AS most FROM lineitem GROUP BY 1",
}
ORACLE_SQL["running_batches_sql"] = ORACLE_SQL["running_batches"]
