"""Queries: text cleaning, phrases, chunks, JSON salvage, answer rubrics and evaluation rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as T
from tabulon.operators import chunk, evaluate, phrases
from tabulon.sources.tables import table

GEO_KEYS = ["the", "ation", "stat"]


def html_to_text_len(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(T.html_text(F.col("html"))).alias("n"), F.md5(T.html_text(F.col("html"))).alias("mark"))


def counted_phrases(spark: SparkSession, d: str, lengths: tuple[int, ...]) -> DataFrame:
    """(phrase, n): phrases of so many words of the whole texts, seen twice or more."""
    return phrases.counted(table(spark, d, "documents"), F.col("text"), lengths).filter("n >= 2")


def _grams(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two and three words."""
    return counted_phrases(spark, d, (2, 3))


def ngram_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _grams(spark, d)


def geo_phrase_class(spark: SparkSession, d: str) -> DataFrame:
    geo = F.col("phrase").rlike("|".join(GEO_KEYS))
    return _grams(spark, d).groupBy(F.when(geo, "geo").otherwise("topical").alias("kind")).agg(F.count("*").alias("n"), F.sum("n").alias("uses"))


def chunk_fold(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(table(spark, d, "documents"), "doc_id", chunk.paragraphs(F.col("text"))).select("doc_id", "chunk_number", "chunk_id", F.length("text").alias("n"))


def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk.chunks(table(spark, d, "documents"), "doc_id", chunk.sentences(F.col("text")), 800, 200, 1, " ")
    return rows.select("doc_id", "chunk_number", "chunk_id", F.length("text").alias("n"))


def chunk_long_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences towards 400 characters, those beyond 60 cut at words with an overlap of 5 words: the long rule is met often."""
    texts = chunk.packed_sentences(chunk.sentences(F.col("text")), 400, 60, 50, 5)
    return chunk.numbered_chunks(table(spark, d, "documents"), "doc_id", texts, 1).select("doc_id", "chunk_number", F.length("text").alias("n"), F.md5("text").alias("mark"))


def json_field_salvage(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object(T.repaired_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))), "$.k"), F.regexp_extract("props", r'"k": *([0-9]+)', 1)).cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"))


def eval_category_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumns({"a": F.col("quality").cast("double"), "b": 1 - F.col("toxic").cast("double")})
    return evaluate.rollup_by(rows, "lang", F.col("quality") == 1, ["a", "b"])


def eval_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    run = lambda keep: rows.filter(keep).groupBy("lang").agg(F.avg("quality").alias("score"))
    return evaluate.compare_runs(run(F.col("doc_id") % 2 == 0), run(F.col("doc_id") % 2 == 1), "lang", "score").select("lang", F.round("base_score", 6).alias("base_score"), F.round("new_score", 6).alias("new_score"), "improvement")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("variable", "limitation", "disambiguation", "caveat", "other")])
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    return rows.withColumns({"kind": F.element_at(kinds, (F.col("conv_id") % 5 + 1).cast("int")), "truth": F.array(F.lit("the"), F.lit("zz9")), "id": F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))})


def response_rubric(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.rubric(_answers(spark, d), "text", "kind", "truth")
    return out.select("id", "kind", *[F.round(c, 6).alias(c) for c in ("correctness", "plan_quality", "coordination", "adaptation", "clarity")], "passed")


def smoke_grade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark")
    expect, avoid = F.array(F.lit("the"), F.lit("and"), F.lit("ion"), F.lit("zz")), F.array(F.lit("zq"), F.lit("her"))
    return rows.select("item_id", evaluate.smoke_grade(F.col("text"), expect, avoid).alias("grade"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    return rows.agg(F.count("*").alias("total"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("passed"), F.round(F.sum("quality") / F.count("*"), 6).alias("score"), F.round(F.avg("toxic"), 6).alias("toxic"))


def failing_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").filter("quality = 0").select("doc_id", "toxic").orderBy("toxic", "doc_id")


QUERIES = {f.__name__: f for f in (html_to_text_len, ngram_phrases, geo_phrase_class, chunk_fold, chunk_sentences, chunk_long_sentences, json_field_salvage, eval_category_rollup, eval_compare_runs, response_rubric, smoke_grade, run_summary, failing_rows)}
_SQZ = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
_ENT = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_HTML = _SQZ.format(_ENT("regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"))
_SW = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_GRAMS = f"w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[a-z]+') AND x NOT IN ({_SW})) AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) || list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM w), n AS (SELECT phrase, count(*) AS n FROM g GROUP BY phrase HAVING count(*) >= 2)"
_N = lambda t, words: "(" + " + ".join(f"contains({t}, '{w}')::INT" for w in words) + ")"
_PACK = lambda parts, most, overlap, glue: f"""WITH RECURSIVE p AS ({parts}), x AS (SELECT doc_id, list_filter(parts, lambda q: q <> '') AS parts FROM p), f AS (
  SELECT doc_id, parts, 1 AS i, parts[1] AS now, NULL::VARCHAR AS done, 0 AS k FROM x WHERE len(parts) > 0
  UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN i >= len(parts) THEN NULL WHEN length(now) + length(parts[i + 1]) > {most} THEN substr(now, greatest(1, length(now) - {overlap} + 1), {overlap}) || {glue} || parts[i + 1] ELSE now || {glue} || parts[i + 1] END,
    CASE WHEN i >= len(parts) OR length(now) + length(parts[i + 1]) > {most} THEN now END, k + CASE WHEN done IS NOT NULL THEN 1 ELSE 0 END FROM f WHERE i <= len(parts))
SELECT doc_id, CAST(k AS INTEGER) AS chunk_number, doc_id::VARCHAR || '_' || k::VARCHAR || '_' || substr(md5(done), 1, 8) AS chunk_id, CAST(length(done) AS INTEGER) AS n FROM f WHERE done IS NOT NULL"""  # noqa: E731
ORACLE_SQL = {
    "html_to_text_len": f"SELECT page_id, CAST(length({_HTML}) AS INTEGER) AS n, md5({_HTML}) AS mark FROM pages",
    "ngram_phrases": f"WITH {_GRAMS} SELECT phrase, n FROM n",
    "geo_phrase_class": f"WITH {_GRAMS} SELECT CASE WHEN regexp_matches(phrase, '{'|'.join(GEO_KEYS)}') THEN 'geo' ELSE 'topical' END AS kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS uses FROM n GROUP BY 1",
    "chunk_fold": _PACK(f"SELECT doc_id, list_transform(regexp_split_to_array(text, '\\n+'), lambda q: {_SQZ.format('q')}) AS parts FROM documents", 1000, 200, "chr(10)") + " AND length(done) >= 100",
    "chunk_sentences": _PACK(f"SELECT doc_id, string_split(regexp_replace({_SQZ.format('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents", 800, 200, "' '"),
    "json_field_salvage": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "eval_category_rollup": "SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS passed, round(count(*) FILTER (quality = 1) / count(*), 6) AS pass_rate, round(avg((quality + 1 - toxic) / 2.0), 6) AS mean_score FROM labels JOIN documents USING (doc_id) GROUP BY lang",
    "eval_compare_runs": "WITH s AS (SELECT lang, avg(quality) FILTER (doc_id % 2 = 0) AS b, avg(quality) FILTER (doc_id % 2 = 1) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, round(b, 6) AS base_score, round(n, 6) AS new_score, round(n - b, 6) AS improvement FROM s WHERE b IS NOT NULL AND n IS NOT NULL",
    "response_rubric": f"""WITH a AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, text AS t, lower(text) AS low, ['variable', 'limitation', 'disambiguation', 'caveat', 'other'][(conv_id % 5 + 1)::INT] AS kind FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, {_N('t', evaluate.TOOLS)} AS tools, CASE kind WHEN 'variable' THEN contains(low, 'the')::INT / 2.0 WHEN 'limitation' THEN ({_N('low', evaluate.WORDS['limitation'])} > 0)::INT WHEN 'disambiguation' THEN ({_N('low', evaluate.WORDS['disambiguation'])} > 0)::INT WHEN 'caveat' THEN ({_N('low', evaluate.WORDS['caveat'])} > 0)::INT ELSE CASE WHEN length(t) > 100 THEN 0.8 ELSE 0.3 END END::DOUBLE AS correctness FROM a),
c AS (SELECT *, CASE WHEN kind = 'variable' THEN CASE WHEN contains(t, '{evaluate.TOOLS[0]}') OR contains(t, '{evaluate.TOOLS[1]}') THEN 0.9 WHEN contains(t, '{evaluate.TOOLS[2]}') THEN 0.7 ELSE 0.3 END WHEN kind IN ('limitation', 'caveat') THEN CASE WHEN contains(t, '{evaluate.TOOLS[2]}') THEN 0.9 WHEN length(t) > 200 THEN 0.7 ELSE 0.4 END ELSE CASE WHEN length(t) > 150 THEN 0.8 ELSE 0.5 END END::DOUBLE AS plan_quality FROM b)
SELECT id, kind, round(correctness, 6) AS correctness, round(plan_quality, 6) AS plan_quality, (CASE WHEN tools = 0 THEN 0.0 WHEN tools = 1 THEN 0.8 ELSE 0.9 END)::DOUBLE AS coordination, round(least({_N('low', evaluate.ADAPTIVE)} / 3.0, 1.0), 6)::DOUBLE AS adaptation, round(CASE WHEN length(t) > 200 THEN 0.3 ELSE 0.1 END + least({_N('low', evaluate.REASONING)} / 5.0, 0.7), 6)::DOUBLE AS clarity, correctness >= 0.7 AND plan_quality >= 0.6 AS passed FROM c""",
    "smoke_grade": "WITH h AS (SELECT item_id, lower(substr(text, 1, 200)) AS h FROM benchmark), n AS (SELECT item_id, contains(h, 'the')::INT + contains(h, 'and')::INT + contains(h, 'ion')::INT + contains(h, 'zz')::INT AS e, contains(h, 'zq')::INT + contains(h, 'her')::INT AS a FROM h) SELECT item_id, (CASE WHEN e >= 2 AND a = 0 THEN 1.0 WHEN e > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS grade FROM n",
    "run_summary": "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS passed, round(sum(quality) / count(*), 6) AS score, round(avg(toxic), 6) AS toxic FROM labels",
    "failing_rows": "SELECT doc_id, toxic FROM labels WHERE quality = 0",
}
