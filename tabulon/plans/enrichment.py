"""Queries: enrichment agreement, domain weights, validation, summaries, samples, phrase kinds and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions import text as T
from tabulon.operators import enrich, sample
from tabulon.plans.texts import counted_phrases
from tabulon.sources import sinks
from tabulon.sources.tables import literals, table

# Word-boundary patterns of geographic phrases, and the keys of geographic n-grams.
GEO_PATTERNS = [
    r"\bstate(?:s)?\b", r"\bcounty(?:ies)?\b", r"\btracts?\b", r"\bblock groups?\b", r"\bmsa\b", r"\bcbsa\b", r"\bpuma\b", r"\burban\b", r"\brural\b",
    r"\bmetropolitan\b", r"\bmicropolitan\b", r"\bresidence\b", r"\bworkplace\b", r"\bhousehold\b",
]
GEO_KEYS = ["tract", "block", "county", "state", "msa", "cbsa", "puma", "zip", "zcta", "urban", "rural", "metro", "micropolitan", "place", "geography", "geographies", "region", "division", "csa", "town", "city", "township"]
#: Common words that are no key terms; fixed values.
GENERIC = ["the", "and", "for", "with", "this", "that", "from", "they", "have", "been", "their"]
DOMAINS = ["ECONOMY", "STANDARD", "PROMO", "Brand#1", "Brand#2", "Brand#3"]
QUOTAS = [("Brand#1", 15), ("Brand#2", 15), ("Brand#3", 10), ("Brand#4", 6)]
PREFIXES = [(0, "cold", "food"), (1, "small widget", "tools"), (2, "sm", "little"), (3, "co", "other co"), (4, "b", "big"), (5, "bl", "never")]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two analyses of each event: texts, confidences, similarities of two fields."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    a, b = (F.col("event_id") % 11) / 10, (F.col("user_id") % 11) / 10
    sims = F.array(F.when(k % 2 == 0, k / 100), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 100) / 100))
    second = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")))
    return e.select("event_id", "event_type", "value", k.alias("k"), a.alias("a"), b.alias("b"), second.alias("second"), enrich.agreement(sims, a, b).alias("score"))


_P = """e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, (event_id % 11) / 10.0::DOUBLE AS a, (user_id % 11) / 10.0::DOUBLE AS b,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE 'u' || (user_id % 5)::VARCHAR END AS second FROM events),
p AS (SELECT *, (coalesce(CASE WHEN k % 2 = 0 THEN k / 100.0::DOUBLE END, 0) + coalesce(CASE WHEN event_id % 3 > 0 THEN (event_id % 100) / 100.0::DOUBLE END, 0) + (1 - abs(a - b)))
  / ((k % 2 = 0)::INT + (event_id % 3 > 0)::INT + 1) AS score FROM e),
m AS (SELECT *, CASE WHEN score > 0.8 THEN 'high_agreement_merge' WHEN score > 0.5 THEN 'collaborative_resolution' ELSE 'arbitration_required' END AS method FROM p)"""
_CONFIDENCE = "CASE WHEN score > 0.8 THEN (a + b) / 2 WHEN score > 0.5 THEN greatest(a, b) * 0.9 ELSE 0.3 END"


def agreement_merge(spark: SparkSession, d: str) -> DataFrame:
    x, s = _pairs(spark, d), F.col("score")
    text = enrich.merged_field(s, F.col("event_type"), F.col("second"), F.col("a"), F.col("b"))
    return x.select("event_id", F.round("score", 6).alias("score"), enrich.agreement_method(s).alias("method"), text.alias("text"), F.round(enrich.merged_confidence(s, F.col("a"), F.col("b")), 6).alias("confidence"))


def enrichment_summary(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d)
    count = lambda c: F.count_if(c)
    return x.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("agreement"), F.round(F.avg(enrich.merged_confidence(F.col("score"), F.col("a"), F.col("b"))), 6).alias("confidence"),
        count(F.col("score") > 0.8).alias("high"), count((F.col("score") > 0.5) & (F.col("score") <= 0.8)).alias("medium"), count(F.col("score") <= 0.5).alias("low"), count(F.col("event_type") == "error").alias("errors"),
    )


def enrichment_methods(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy(enrich.agreement_method(F.col("score")).alias("method")).agg(F.count("*").alias("n"))


def cost_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d).groupBy(F.col("event_type").alias("strategy"))
    return x.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("cost"), F.round(F.avg((F.col("score") <= 0.5).cast("int")), 6).alias("arbitration_rate"))


def mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    """Successes by difficulty, with the time they took; a mapping succeeds with a confidence above 0 and is sure from 0.85."""
    won = F.col("a") > 0
    took = F.when(won, F.col("value"))
    x = _pairs(spark, d).groupBy(F.col("event_type").alias("difficulty"))
    return x.agg(F.count("*").alias("n"), F.count_if(won).alias("successes"), F.count_if(F.col("a") >= 0.85).alias("sure"), F.round(F.avg(took), 4).alias("mean_s"), F.min(took).alias("least_s"), F.max(took).alias("most_s"), F.round(F.sum(took), 2).alias("sum_s"))


def review_counters(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("a") >= 0.9, "approve").when(F.col("a") >= 0.5, "revise").otherwise("reject")
    level = F.when(F.col("k") % 3 == 0, "simple").when(F.col("k") % 3 == 1, "moderate").otherwise("complex")
    return _pairs(spark, d).groupBy(decision.alias("decision"), level.alias("complexity")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).select("event_id", (F.col("k") / 100).alias("confidence"))
    return sample.review_buckets(rows, "event_id", "confidence")


def alternating_reviewer(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.numbered(table(spark, d, "events").select("event_id"), "event_id")
    return rows.select("event_id", F.when(F.col("number") % 2 == 0, "first").otherwise("second").alias("reviewer"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """Domain weights of each part: its type and its brand."""
    w = F.col("p_size") % 11 / 10
    kept = F.map_filter(F.create_map(F.col("p_type"), w.cast("double"), F.col("p_brand"), (1 - w).cast("double")), lambda _, v: v > 0)
    return table(spark, d, "part").select("p_partkey", kept.alias("weights"))


_W = "w AS (SELECT p_partkey, x.d AS d, x.w::DOUBLE AS w, x.i AS i FROM (SELECT p_partkey, unnest([{'d': p_type, 'w': p_size % 11 / 10.0, 'i': 1}, {'d': p_brand, 'w': 1 - p_size % 11 / 10.0, 'i': 2}]) AS x FROM part) WHERE x.w > 0)"
_KNOWN = ", ".join(f"'{x}'" for x in DOMAINS)


def domain_weights_check(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("weights")
    bad = F.array_join(F.array_sort(enrich.unknown_domains(w, DOMAINS)), ",")
    return _weights(spark, d).select("p_partkey", enrich.weights_accepted(w, DOMAINS).alias("accepted"), bad.alias("unknown"), enrich.primary_domain(w).alias("primary"))


def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    x = _weights(spark, d)
    total = x.agg(F.count("*").alias("total"))
    by = x.select(F.explode("weights").alias("domain", "w")).groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_weight"), F.count_if(F.col("w") >= 0.5).alias("primary"))
    return by.crossJoin(F.broadcast(total)).select("domain", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("share"), "mean_weight", "primary")


def multi_domain(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).agg(F.count("*").alias("n"), F.count_if(F.size("weights") > 1).alias("multi"))


def concept_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Records that fail validation, with what is wrong."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*[F.lit(s) for s in ("auto", "reviewed", "rejected", "draft")]), (F.col("user_id") % 4 + 1).cast("int"))
    label, confidence = F.when(F.col("event_id") % 7 > 0, F.col("event_type")), F.when(F.col("event_id") % 5 > 0, k / 90)
    rows = table(spark, d, "events").select("event_id", F.array_join(enrich.concept_errors(label, confidence, status), "; ").alias("errors"))
    return rows.filter(F.col("errors") != "")


def category_prefix(spark: SparkSession, d: str) -> DataFrame:
    dim = literals(spark, "place int, p_name string, category string", PREFIXES).select(F.col("place").alias("ordinal"), "p_name", "category")
    return enrich.category_by_prefix(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", dim).select("p_partkey", "category")


def two_hop_weights(spark: SparkSession, d: str) -> DataFrame:
    """Customer to nation to region weight; customers of other nations stay without."""
    nation = table(spark, d, "nation").filter("n_nationkey % 3 > 0").select("n_nationkey", "n_regionkey")
    weight = table(spark, d, "region").filter("r_regionkey < 3").select("r_regionkey", (F.col("r_regionkey") / 10).alias("weight"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(nation, c.c_nationkey == nation.n_nationkey, "left").join(weight, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_regionkey", "weight")


def key_terms(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's five commonest words those that say something: five first, then the generic ones go."""
    words = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word")).filter(F.col("word").rlike("^[a-z]{3,}$"))
    n = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    top = n.withColumn("place", F.row_number().over(W.Window.partitionBy("source").orderBy(F.col("n").desc(), "word"))).filter("place <= 5")
    return top.filter(~F.col("word").isin(GENERIC)).select("source", "word", "n", "place")


def definition_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    by = lambda c: rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "value", "n")
    return by("source").unionByName(by("lang"))


def sample_diversity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(F.count("*").alias("n"), F.count_distinct(F.substring("p_brand", 1, 7)).alias("families"), F.count_distinct("p_name").alias("concepts"), F.round(F.count_distinct("p_name") / F.count("*"), 6).alias("ratio"))


def family_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.substring("p_brand", 1, 7).alias("family")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "family")


def concept_families(spark: SparkSession, d: str) -> DataFrame:
    """Per normalised concept: its first variable, how many, and over how many types it splits."""
    key = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    return table(spark, d, "part").groupBy(key.alias("concept")).agg(F.min_by("p_brand", "p_partkey").alias("representative"), F.count("*").alias("n"), F.count_distinct("p_type").alias("splits"))


def quota_fill_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.substring("p_brand", 1, 7).alias("family"))
    return sample.quota_fill(rows, "p_partkey", "family", QUOTAS, 40).select("p_partkey", "family")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25)


def first_per_prefix(spark: SparkSession, d: str) -> DataFrame:
    return sample.first_per_prefix(table(spark, d, "part").select("p_name"), "p_name", ["cold", "sm", "b", "bl", "zz"])


def phrase_union(spark: SparkSession, d: str) -> DataFrame:
    """Words of the names of each brand, merged and in order."""
    words = table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"), F.count("*").alias("n"))


def token_intersection(spark: SparkSession, d: str) -> DataFrame:
    shared = F.array_intersect(F.split("p_name", " "), F.array(F.lit("small"), F.lit("widget"), F.lit("cold")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(shared), " ").alias("shared"))


def enrichment_text(spark: SparkSession, d: str) -> DataFrame:
    record = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("summary"), F.lit("  ").alias("description")))).when(
        F.col("event_id") % 3 == 1, F.to_json(F.struct(F.struct(F.col("event_type").alias("concept"), F.lit("few").alias("limitations")).alias("analysis")))
    )
    return table(spark, d, "events").select("event_id", enrich.enrichment_text(F.coalesce(record, F.lit("{}"))).alias("text"))


def phrase_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of pages' text and of place words, by the word-boundary patterns."""
    names = literals(spark, "phrase string", [(f"{a} {b}",) for a in ("Urban", "total", "Block Group", "estates") for b in ("share", "by state", "in counties", "MSA: x/Household; rent")]).select(F.col("phrase").alias("text"))
    cells = table(spark, d, "benchmark").select("text").unionByName(names)
    phrase = cells.select(F.explode(T.phrases(F.col("text"))).alias("phrase")).distinct()
    return phrase.select(F.md5("phrase").alias("mark"), F.when(F.col("phrase").rlike("(?i)" + "|".join(GEO_PATTERNS)), "geo").otherwise("topical").alias("kind"))


def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of two, three and four words in whole texts, seen twice or more, and whether a geographic key is in them."""
    return counted_phrases(spark, d, (2, 3, 4)).select("phrase", "n", F.col("phrase").rlike("|".join(GEO_KEYS)).alias("geo"))


def sink_phrases(spark: SparkSession, d: str) -> DataFrame:
    path = f"{sinks.scratch(spark)}/phrases"
    sinks.write_phrases(table(spark, d, "part").select(F.col("p_name").alias("phrase")), path)
    return spark.read.text(path).select(F.col("value").alias("phrase"))


def sink_routed(spark: SparkSession, d: str) -> DataFrame:
    path = f"{sinks.scratch(spark)}/routed"
    rows = _pairs(spark, d).select("event_id", "a")
    sinks.write_routed(rows, F.when(F.col("a") >= 0.9, "auto").when(F.col("a") >= 0.5, "review").otherwise("rejected"), path)
    return spark.read.schema("event_id long, a double, route string").json(path).groupBy("route").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def sink_links(spark: SparkSession, d: str) -> DataFrame:
    path = f"{sinks.scratch(spark)}/links"
    links = _weights(spark, d).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("variable"), F.explode("weights").alias("concept", "weight"))
    sinks.write_links(links, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def sink_runs(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.scratch(spark)
    runs = table(spark, d, "labels").groupBy(F.concat(F.lit("run"), (F.col("doc_id") % 5).cast("string")).alias("run_name")).agg(F.sum("quality").cast("long").alias("passed"))
    sinks.append_results(runs.filter("run_name < 'run2'"), f"{path}/runs")
    sinks.append_results(runs.filter("run_name >= 'run2'"), f"{path}/runs")
    return sinks.upsert_runs(spark, runs.filter("run_name = 'run3'").withColumn("passed", F.lit(-1).cast("long")), f"{path}/runs", f"{path}/new")


QUERIES = {
    f.__name__: f
    for f in (
        agreement_merge, enrichment_summary, enrichment_methods, cost_by_strategy, mapping_summary, review_counters, review_queue, alternating_reviewer, domain_weights_check, category_distribution, multi_domain,
        concept_quarantine, category_prefix, two_hop_weights, key_terms, definition_counts, sample_diversity, family_histogram, concept_families, quota_fill_sample, seeded_sample, first_per_prefix, phrase_union,
        token_intersection, enrichment_text, phrase_kinds, phrase_counts, sink_phrases, sink_routed, sink_links, sink_runs,
    )
}

_SEED = lambda key: f"md5('42|' || {key}::VARCHAR), {key}"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_GRAM = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
ORACLE_SQL = {
    "agreement_merge": f"""WITH {_P} SELECT event_id, round(score, 6) AS score, method, CASE WHEN score > 0.8 THEN CASE WHEN second <> '' THEN 'A: ' || event_type || ' | B: ' || second ELSE event_type END
  WHEN score > 0.5 THEN CASE WHEN a > b THEN 'PRIMARY: ' || event_type || ' | SECONDARY: ' || second ELSE 'PRIMARY: ' || second || ' | SECONDARY: ' || event_type END
  ELSE 'DISAGREEMENT - A: ' || event_type || ' | B: ' || second END AS text, round({_CONFIDENCE}, 6)::DOUBLE AS confidence FROM m""",
    "enrichment_summary": f"WITH {_P} SELECT count(*) AS n, round(avg(score), 6) AS agreement, round(avg({_CONFIDENCE}), 6) AS confidence, count(*) FILTER (score > 0.8) AS high, count(*) FILTER (score > 0.5 AND score <= 0.8) AS medium, count(*) FILTER (score <= 0.5) AS low, count(*) FILTER (event_type = 'error') AS errors FROM m",
    "enrichment_methods": f"WITH {_P} SELECT method, count(*) AS n FROM m GROUP BY method",
    "cost_by_strategy": f"WITH {_P} SELECT event_type AS strategy, count(*) AS n, round(avg(value), 4) AS cost, round(avg((score <= 0.5)::INT), 6) AS arbitration_rate FROM m GROUP BY event_type",
    "mapping_summary": f"WITH {_P} SELECT event_type AS difficulty, count(*) AS n, count(*) FILTER (a > 0) AS successes, count(*) FILTER (a >= 0.85) AS sure, round(avg(value) FILTER (a > 0), 4) AS mean_s, min(value) FILTER (a > 0) AS least_s, max(value) FILTER (a > 0) AS most_s, round(sum(value) FILTER (a > 0), 2) AS sum_s FROM m GROUP BY event_type",
    "review_counters": f"WITH {_P} SELECT CASE WHEN a >= 0.9 THEN 'approve' WHEN a >= 0.5 THEN 'revise' ELSE 'reject' END AS decision, CASE k % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'complex' END AS complexity, count(*) AS n, min(event_id) AS first FROM m GROUP BY 1, 2",
    "review_queue": f"WITH {_P}, c AS (SELECT event_id, k / 100.0::DOUBLE AS confidence, CASE WHEN k >= 90 THEN 'auto' WHEN k >= 75 THEN 'review' ELSE 'low' END AS bucket FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY confidence DESC, event_id) AS place FROM c) SELECT event_id, confidence, bucket FROM r WHERE bucket <> 'review' OR place <= 50",
    "alternating_reviewer": "SELECT event_id, CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 2 = 0 THEN 'first' ELSE 'second' END AS reviewer FROM events",
    "domain_weights_check": f"WITH {_W} SELECT p_partkey, bool_and(d IN ({_KNOWN})) AS accepted, coalesce(string_agg(d, ',' ORDER BY d) FILTER (d NOT IN ({_KNOWN})), '') AS \"unknown\", first(d ORDER BY w DESC, i) AS \"primary\" FROM w GROUP BY p_partkey",
    "category_distribution": f"WITH {_W} SELECT d AS domain, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM part), 4) AS share, round(avg(w), 6) AS mean_weight, count(*) FILTER (w >= 0.5) AS \"primary\" FROM w GROUP BY d",
    "multi_domain": f"WITH {_W} SELECT (SELECT count(*) FROM part) AS n, count(*) AS multi FROM (SELECT p_partkey FROM w GROUP BY p_partkey HAVING count(*) > 1)",
    "concept_quarantine": """WITH e AS (SELECT event_id, event_id % 7 > 0 AS label, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS INT) / 90.0::DOUBLE END AS c, user_id % 4 < 3 AS known FROM events),
x AS (SELECT event_id, concat_ws('; ', CASE WHEN NOT label THEN 'missing label' END, CASE WHEN c IS NULL THEN 'missing confidence' WHEN c < 0 OR c > 1 THEN 'confidence must be between 0 and 1' END, CASE WHEN NOT known THEN 'unknown status' END) AS errors FROM e)
SELECT event_id, errors FROM x WHERE errors <> ''""",
    "category_prefix": "WITH d(o, k, c) AS (VALUES " + ", ".join(f"({o}, '{k}', '{c}')" for o, k, c in PREFIXES) + ") SELECT p_partkey, coalesce((SELECT first(c ORDER BY k <> p_name, o) FROM d WHERE starts_with(p_name, k)), 'uncategorized') AS category FROM part",
    "two_hop_weights": "SELECT c_custkey, n_regionkey, r_regionkey / 10.0::DOUBLE AS weight FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey",
    "key_terms": "WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents), n AS (SELECT source, word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{3,}') GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS INT) AS place FROM n) SELECT source, word, n, place FROM r WHERE place <= 5 AND word NOT IN (" + ", ".join(f"'{w}'" for w in GENERIC) + ")",
    "definition_counts": "SELECT 'source' AS kind, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang",
    "sample_diversity": "SELECT count(*) AS n, count(DISTINCT p_brand[:7]) AS families, count(DISTINCT p_name) AS concepts, round(count(DISTINCT p_name) / count(*), 6) AS ratio FROM part",
    "family_histogram": "SELECT p_brand[:7] AS family, count(*) AS n FROM part GROUP BY 1",
    "concept_families": "SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS concept, arg_min(p_brand, p_partkey) AS representative, count(*) AS n, count(DISTINCT p_type) AS splits FROM part GROUP BY 1",
    "quota_fill_sample": "WITH q(i, f, k) AS (VALUES " + ", ".join(f"({i}, '{f}', {k})" for i, (f, k) in enumerate(QUOTAS)) + f"""), p AS (SELECT p_partkey, p_brand[:7] AS family FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_SEED('p_partkey')}) AS place FROM p),
s AS (SELECT i, f, least(k, n) AS t FROM q JOIN (SELECT family, count(*) AS n FROM p GROUP BY family) ON f = family), u AS (SELECT f, greatest(0, least(t, 40 - coalesce(sum(t) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM s),
o AS (SELECT p_partkey, family, row_number() OVER (ORDER BY {_SEED('p_partkey')}) AS place FROM p WHERE family NOT IN (SELECT f FROM q))
SELECT p_partkey, family FROM r JOIN u ON family = f WHERE place <= take UNION ALL SELECT p_partkey, family FROM o WHERE place <= 40 - (SELECT coalesce(sum(take), 0) FROM u)""",
    "seeded_sample": f"SELECT doc_id, lang FROM documents ORDER BY {_SEED('doc_id')} LIMIT 25",
    "first_per_prefix": "SELECT prefix, min(p_name) AS p_name FROM (VALUES ('cold'), ('sm'), ('b'), ('bl'), ('zz')) AS x(prefix) JOIN part ON starts_with(p_name, prefix) GROUP BY prefix",
    "phrase_union": "SELECT p_brand, string_agg(word, ' ' ORDER BY word) AS words, count(*) AS n FROM (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY p_brand",
    "token_intersection": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: w IN ('small', 'widget', 'cold')))), ' ') AS shared FROM part",
    "enrichment_text": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'concept: ' || event_type || ' | limitations: few' ELSE 'No enrichment available' END AS text FROM events",
    "phrase_kinds": "WITH c AS (SELECT text FROM benchmark UNION ALL SELECT a || ' ' || b FROM (VALUES ('Urban'), ('total'), ('Block Group'), ('estates')) AS x(a), (VALUES ('share'), ('by state'), ('in counties'), ('MSA: x/Household; rent')) AS y(b)), p AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(text, '[:;/\\n]+'))) AS phrase FROM c) SELECT md5(phrase) AS mark, CASE WHEN regexp_matches(phrase, '(?i)" + "|".join(GEO_PATTERNS) + "') THEN 'geo' ELSE 'topical' END AS kind FROM p WHERE phrase <> ''",
    "phrase_counts": f"WITH w AS (SELECT list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[a-z]+') AND x NOT IN ({_STOPS})) AS w FROM documents), g AS (SELECT unnest({_GRAM(2)} || {_GRAM(3)} || {_GRAM(4)}) AS phrase FROM w) SELECT phrase, count(*) AS n, regexp_matches(phrase, '{'|'.join(GEO_KEYS)}') AS geo FROM g GROUP BY phrase HAVING count(*) >= 2",
    "sink_phrases": "SELECT DISTINCT p_name AS phrase FROM part",
    "sink_routed": f"WITH {_P} SELECT CASE WHEN a >= 0.9 THEN 'auto' WHEN a >= 0.5 THEN 'review' ELSE 'rejected' END AS route, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM m GROUP BY 1",
    "sink_links": f"WITH {_W} SELECT 'ex:P' || p_partkey::VARCHAR || ' ex:hasConcept ' || string_agg('ex:' || d, ' , ' ORDER BY w DESC, d) || ' .' AS line FROM w GROUP BY p_partkey",
    "sink_runs": "SELECT 'run' || (doc_id % 5)::VARCHAR AS run_name, CAST(CASE WHEN doc_id % 5 = 3 THEN -1 ELSE sum(quality) END AS BIGINT) AS passed FROM labels GROUP BY doc_id % 5",
}
