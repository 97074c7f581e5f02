"""Queries: lexical and vector search over documents, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.text import tokens
from tabulon.operators import cluster, lexical, nearest, textindex, vector
from tabulon.sources import sinks
from tabulon.sources.tables import literals, table


def _index(spark: SparkSession, d: str) -> textindex.TextIndex:
    """The stored index of the documents; the first query of a session builds it."""
    return textindex.index_of(table(spark, d, "documents"), "doc_id", "text", lambda: sinks.scratch(spark))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("words"))


def inverted_index_stats(spark: SparkSession, d: str) -> DataFrame:
    return textindex.token_stats(_index(spark, d))


def keyword_search_topk(spark: SparkSession, d: str) -> DataFrame:
    found = textindex.overlap_indexed(_index(spark, d), _asked(spark, d), 10)
    return found.select("query_id", F.col("id").alias("doc_id"), "matches", F.round("confidence", 6).alias("confidence"), "rank")


def keyword_search_domain_boost(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "labels").select("doc_id", (F.col("quality") * 0.5).alias("weight"))
    found = textindex.overlap_indexed(_index(spark, d), _asked(spark, d), 10, weights)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def suggestions_low_conf(spark: SparkSession, d: str) -> DataFrame:
    found = textindex.overlap_indexed(_index(spark, d), _asked(spark, d), 5).withColumnRenamed("id", "doc_id")
    return lexical.suggestions(found, table(spark, d, "documents"), "doc_id", "source", 0.9)


def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.postings(table(spark, d, "part"), "p_partkey", F.col("p_type"))
    synonyms = literals(spark, "synonym string, canonical string", [("metal", "steel"), ("metal", "brass"), ("cheap", "economy")]).drop("ordinal")
    return lexical.with_synonyms(index, synonyms, "p_partkey").groupBy("token").agg(F.count("*").alias("n"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return textindex.bm25_indexed(_index(spark, d), _asked(spark, d), 5).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def index_append(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over an index that was built in three loads, the second with documents that are there already, and over its merged version.

    All documents are in one of the loads, so both versions answer like one build over the whole table.
    """
    docs = table(spark, d, "documents")
    own = lambda *rest: docs.filter((F.col("doc_id") % 3).isin(*rest))
    text = F.col("text")
    first = textindex.build_index(own(0), "doc_id", text, sinks.scratch(spark))
    third = textindex.append_index(textindex.append_index(first, own(0, 1), "doc_id", text), own(2), "doc_id", text)
    merged = textindex.merge_index(third)
    found = lambda index: textindex.bm25_indexed(index, _asked(spark, d), 5).select(F.lit(index.version).alias("version"), "query_id", F.col("id").alias("doc_id"), "score", "rank")
    return found(textindex.open_index(spark, third.path, third.version)).unionByName(found(textindex.open_index(spark, merged.path)))


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold the second to fifth word of a benchmark item next to each other."""
    phrases = _asked(spark, d).select("query_id", F.slice("words", 2, 4).alias("words"))
    found = textindex.phrase_search(_index(spark, d), table(spark, d, "documents"), "doc_id", F.col("text"), phrases)
    return found.select("query_id", F.col("id").alias("doc_id"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    near = nearest.nearest_vectors(table(spark, d, "embeddings"), _queries(spark, d), "vec_id", "embedding", "query_id", "q", 5)
    return near.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_l2_threshold(spark: SparkSession, d: str) -> DataFrame:
    near = nearest.nearest_vectors(table(spark, d, "embeddings"), _queries(spark, d), "vec_id", "embedding", "query_id", "q", 5, "l2", 0.3)
    return near.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors against the centroids of their labels."""
    rows = table(spark, d, "embeddings")
    concepts = vector.centroids(rows, "label", "embedding").withColumnRenamed("label", "concept")
    return vector.scored_pairs(rows.select("vec_id", "label", "embedding"), concepts, vector.cosine(F.col("embedding"), F.col("centroid")))


def concept_links_normalised(spark: SparkSession, d: str) -> DataFrame:
    return vector.links(_pairs(spark, d), "vec_id", "concept").select("vec_id", "concept", F.round("score", 6).alias("similarity"), F.round("weight", 6).alias("weight"), "rank")


def _weights(spark: SparkSession, d: str, log: bool) -> DataFrame:
    pairs = _pairs(spark, d).withColumn("score", F.greatest("score", F.lit(0.0)))
    return vector.category_weights(pairs, "vec_id", "concept", 0.15, log).select("vec_id", "concept", F.round("weight", 6).alias("weight"))


def category_weights_linear(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, False)


def category_weights_log(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, True)


def max_over_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).filter("concept < 4").groupBy("vec_id").agg(F.round(F.max("score"), 4).alias("scalar"))


def similarity_summary(spark: SparkSession, d: str) -> DataFrame:
    own = _pairs(spark, d).filter("concept = label")
    r = lambda c, n: F.round(c, 6).alias(n)
    return own.groupBy("label").agg(r(F.min("score"), "least"), r(F.avg("score"), "mean"), r(F.max("score"), "most"), r(F.median("score"), "median"), r(F.stddev_pop("score"), "deviation"))


def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    return vector.pairwise_agreement(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "n", F.round("agreement", 6).alias("agreement"))


def weight_validate_top4(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).select("vec_id", F.concat(F.lit("d"), F.col("concept").cast("string")).alias("domain"), F.col("score").alias("w"))
    out = vector.checked_weights(rows, "vec_id", "domain", "w", [f"d{i}" for i in range(6)])
    return out.select("vec_id", "domain", F.round("w", 6).alias("w"))


def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return cluster.profile(rows, "lang", "source", 3)


def kmeans_silhouette(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.kmeans_by_silhouette(table(spark, d, "embeddings"), "embedding")
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.first("silhouette"), 4).alias("silhouette"))


QUERIES = {f.__name__: f for f in (inverted_index_stats, keyword_search_topk, keyword_search_domain_boost, suggestions_low_conf, synonym_expansion, bm25_topk, index_append, phrase_matches, vector_topk_cosine, vector_topk_l2_threshold, concept_links_normalised, category_weights_linear, category_weights_log, max_over_concepts, similarity_summary, pairwise_agreement, weight_validate_top4, cluster_profile, kmeans_silhouette)}

_TOK = "regexp_extract_all(lower({}), '[A-Za-z0-9]+')"
_P = f"toks AS (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents), p AS (SELECT token, doc_id, count(*) AS tf FROM toks GROUP BY 1, 2)"
_Q = f"q AS (SELECT item_id AS query_id, {_TOK.format('text')} AS words FROM benchmark), a AS (SELECT query_id, len(words) AS n, unnest(words) AS token FROM q)"
_HITS = "h AS (SELECT query_id, n, doc_id, count(*) AS matches FROM a JOIN p USING (token) GROUP BY 1, 2, 3)"
_D = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_C = f"{_D}, m AS (SELECT label AS concept, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY 1, 2), c AS (SELECT concept, list(m ORDER BY i) AS v FROM m GROUP BY 1), s AS (SELECT e.vec_id, e.label, c.concept, list_cosine_similarity(e.v, c.v) AS score FROM e, c)"
_SHARES = lambda raw: f"r AS (SELECT vec_id, concept, {raw} AS raw FROM (SELECT vec_id, concept, greatest(score, 0) AS score FROM s)), t AS (SELECT *, raw / sum(raw) OVER (PARTITION BY vec_id) AS share FROM r), f AS (SELECT *, max((share >= 0.15)::INT) OVER (PARTITION BY vec_id) AS any_, row_number() OVER (PARTITION BY vec_id ORDER BY share DESC, concept) AS n FROM t) SELECT vec_id, concept, round(CASE WHEN any_ = 1 THEN share / sum(share) OVER (PARTITION BY vec_id) ELSE 1 END, 6) AS weight FROM f WHERE CASE WHEN any_ = 1 THEN share >= 0.15 ELSE n = 1 END"
ORACLE_SQL = {
    "inverted_index_stats": f"WITH {_P} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY token",
    "keyword_search_topk": f"WITH {_P}, {_Q}, {_HITS} SELECT query_id, doc_id, matches, round(least(matches / n, 1.0), 6) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank FROM h) WHERE rank <= 10",
    "keyword_search_domain_boost": f"WITH {_P}, {_Q}, {_HITS}, b AS (SELECT query_id, doc_id, matches * (1 + quality * 0.5) AS score FROM h JOIN labels USING (doc_id) WHERE quality * 0.5 > 0.3) SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10",
    "suggestions_low_conf": f"WITH {_P}, {_Q}, {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank, max(matches / n) OVER (PARTITION BY query_id) AS best FROM h) SELECT query_id, rank, doc_id::VARCHAR || ' - ' || substr(source, 1, 60) || '...' AS suggestion FROM k JOIN documents USING (doc_id) WHERE rank <= 3 AND best < 0.9",
    "synonym_expansion": f"WITH t AS (SELECT DISTINCT p_partkey, unnest({_TOK.format('p_type')}) AS token FROM part), s(synonym, canonical) AS (VALUES ('metal', 'steel'), ('metal', 'brass'), ('cheap', 'economy')), u AS (SELECT token, p_partkey FROM t UNION SELECT synonym, p_partkey FROM t JOIN s ON token = canonical) SELECT token, count(*) AS n FROM u GROUP BY token",
    "bm25_topk": f"""WITH {_P}, q AS (SELECT item_id AS query_id, list_distinct({_TOK.format('text')}) AS words FROM benchmark), a AS (SELECT query_id, unnest(words) AS token FROM q), dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), w AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS met FROM a JOIN p USING (token) JOIN df USING (token) JOIN dl USING (doc_id), w GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x JOIN q USING (query_id) WHERE met = len(words)) WHERE rank <= 5""",
    "index_append": f"""WITH {_P}, q AS (SELECT item_id AS query_id, list_distinct({_TOK.format('text')}) AS words FROM benchmark), a AS (SELECT query_id, unnest(words) AS token FROM q), dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), w AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
x AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS met FROM a JOIN p USING (token) JOIN df USING (token) JOIN dl USING (doc_id), w GROUP BY 1, 2)
SELECT version, query_id, doc_id, score, rank FROM (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x JOIN q USING (query_id) WHERE met = len(words)), (VALUES (3), (4)) v(version) WHERE rank <= 5""",
    "phrase_matches": f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS t FROM documents), q AS (SELECT item_id AS query_id, array_to_string({_TOK.format('text')}[2:5], ' ') AS p FROM benchmark)
SELECT DISTINCT query_id, doc_id FROM q JOIN d ON contains(t, ' ' || p || ' ') WHERE p <> ''""",
    "vector_topk_cosine": f"WITH {_D}, x AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS score FROM e, e q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x) WHERE rank <= 5",
    "vector_topk_l2_threshold": f"WITH {_D}, x AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_distance(e.v, q.v) ** 2 AS score FROM e, e q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x) WHERE rank <= 5 AND score >= 0.3",
    "concept_links_normalised": f"WITH {_C}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, concept) AS rank FROM s WHERE score >= 0.2) SELECT vec_id, concept, round(score, 6) AS similarity, round(score / sum(score) OVER (PARTITION BY vec_id), 6) AS weight, rank FROM k WHERE rank <= 5",
    "category_weights_linear": f"WITH {_C}, {_SHARES('score')}",
    "category_weights_log": f"WITH {_C}, {_SHARES('ln(1 + greatest(score, 1e-8))')}",
    "max_over_concepts": f"WITH {_C} SELECT vec_id, round(max(score), 4) AS scalar FROM s WHERE concept < 4 GROUP BY vec_id",
    "similarity_summary": f"WITH {_C} SELECT label, round(min(score), 6) AS least, round(avg(score), 6) AS mean, round(max(score), 6) AS most, round(median(score), 6) AS median, round(stddev_pop(score), 6) AS deviation FROM s WHERE concept = label GROUP BY label",
    "pairwise_agreement": f"WITH {_D} SELECT a.label, max(n) AS n, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS agreement FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM e GROUP BY 1) z ON z.label = a.label GROUP BY a.label",
    "weight_validate_top4": f"WITH {_C}, v AS (SELECT vec_id, 'd' || concept::VARCHAR AS domain, score AS w FROM s WHERE concept < 6), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, domain) AS n, max((w >= 0.05)::INT) OVER (PARTITION BY vec_id) AS ok FROM v) SELECT vec_id, domain, round(CASE WHEN ok = 1 THEN w / sum(w) OVER (PARTITION BY vec_id) ELSE 1 END, 6) AS w FROM n WHERE CASE WHEN ok = 1 THEN w >= 0.05 AND n <= 4 ELSE n = 1 END",
    "cluster_profile": "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank, sum(n) OVER (PARTITION BY lang) AS a FROM c) SELECT lang, source, n, rank, round(n / a, 6) AS share FROM k WHERE rank <= 3",
}
