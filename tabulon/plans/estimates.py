"""Queries: estimates with margins of error, rollups and geography advice over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import stats
from tabulon.operators import geo, retrieval
from tabulon.sources.tables import literals, table


def nation_orders(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)


def _nation_estimates(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return retrieval.sample_estimates(nation_orders(spark, d), ["n_name", *more], F.col("o_totalprice"))


BASE = "SELECT n_name, avg(o_totalprice) AS estimate, 1.645 * stddev_samp(o_totalprice) / sqrt(count(o_totalprice)) AS moe FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


def compare_locations_cv(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 4).alias(c)
    return retrieval.compared(_nation_estimates(spark, d)).select("n_name", r("estimate"), r("moe"), r("cv_pct"), "reliability")


def demographic_answer_moe_pct(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nation").select("n_name").unionByName(spark.sql("SELECT 'ATLANTIS' AS n_name"))
    out = retrieval.answers(asked, _nation_estimates(spark, d), ["n_name"], "estimate")
    return out.select("n_name", F.round("estimate", 4).alias("estimate"), F.round("moe", 4).alias("moe"), F.round(F.coalesce("moe_pct", F.lit(0.0)), 4).alias("moe_pct"), "error")


def moe_reliability_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("estimate"), (F.lit(stats.Z90) * F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("moe"))
    band = stats.moe_ratio_band(F.col("moe") / F.col("estimate"))
    return rows.withColumn("band", band).groupBy("band").agg(F.count("*").alias("n"))


def aggregate_sum_moe(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    parts = _nation_estimates(spark, d).join(nation, "n_name").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return retrieval.summed(parts, ["r_name"]).select("r_name", F.round("estimate", 3).alias("estimate"), F.round("moe", 3).alias("moe"))


def rate_num_den(spark: SparkSession, d: str) -> DataFrame:
    g = nation_orders(spark, d).groupBy("n_name").agg(F.count_if(F.col("o_orderstatus") == "F").alias("num"), F.count("*").alias("den"))
    num, den = F.col("num").cast("double"), F.col("den").cast("double")
    moe = stats.ratio_moe(num, den, F.sqrt(num) * stats.Z90, F.sqrt(den) * stats.Z90)
    return g.select("n_name", F.round(num / den, 6).alias("rate"), F.round(moe, 6).alias("rate_moe"))


def significance_pairs(spark: SparkSession, d: str) -> DataFrame:
    est = _nation_estimates(spark, d).join(table(spark, d, "nation").select("n_name", "n_regionkey"), "n_name")
    return retrieval.significant_pairs(est, "n_regionkey", "n_name").select("n_regionkey", "n_name", "n_name_b", "differs")


def temporal_change(spark: SparkSession, d: str) -> DataFrame:
    rows = nation_orders(spark, d).withColumn("year", F.year("o_orderdate"))
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))  # whole numbers add up alike in any order
    est = rows.groupBy("n_name", "year").agg((cents.cast("double") / 100.0 / F.count("*")).alias("estimate"))
    return retrieval.changes(est, ["n_name"], "year").select("n_name", "year", F.round("estimate", 4).alias("estimate"), F.round("change", 4).alias("change"))


def geo_rollup_levels(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def grouping_sets_profile(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.groupingSets([[F.col("p_brand")], [F.col("p_type")], [F.col("p_size")]], "p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))


def _geo_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, availability and weights made from suppliers: the level and the table follow from their keys."""
    s = table(spark, d, "supplier")
    names = F.array(*[F.lit(x) for x in geo.LEVELS])
    level = lambda c: F.element_at(names, (c % 6 + 1).cast("int"))
    asked = s.select(F.col("s_suppkey").alias("request_id"), F.concat(F.lit("V"), (F.col("s_suppkey") % 10).cast("string")).alias("variable_id"), F.col("s_nationkey").cast("string").alias("table_id"), level(F.col("s_suppkey")).alias("level"), F.round(F.abs("s_acctbal") / 20000, 4).alias("moe_ratio"))
    there = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("table_id"), F.explode(F.slice(names, 1, 6)).alias("level"), "n_nationkey").withColumn("at", F.array_position(names, F.col("level"))).filter((F.col("n_nationkey") + F.col("at")) % 3 != 0)
    weights = spark.range(10).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("variable_id"), (0.25 + F.col("id") / 50.0).alias("weight"))
    return asked, there.select("table_id", "level"), weights


def geo_advisor_status(spark: SparkSession, d: str) -> DataFrame:
    asked, there, weights = _geo_tables(spark, d)
    return geo.advise(asked, there, weights, geo.levels(spark))


def coarser_levels_range_join(spark: SparkSession, d: str) -> DataFrame:
    asked, there, _ = _geo_tables(spark, d)
    return geo.coarser_levels(asked, there, geo.levels(spark)).select("request_id", F.array_join("coarser", ",").alias("coarser"))


_GEO = """
WITH dim(level, rank) AS (VALUES ('us', 0), ('state', 1), ('county', 2), ('place', 3), ('tract', 4), ('block_group', 5)),
asked AS (SELECT s_suppkey AS request_id, 'V' || (s_suppkey % 10)::VARCHAR AS variable_id, s_nationkey::VARCHAR AS table_id, dim.level, round(abs(s_acctbal) / 20000, 4) AS moe_ratio, dim.rank AS own_rank FROM supplier JOIN dim ON dim.rank = s_suppkey % 6),
there AS (SELECT n_nationkey::VARCHAR AS table_id, level, rank FROM nation, dim WHERE (n_nationkey + rank + 1) % 3 <> 0),
coarser AS (SELECT a.request_id, string_agg(t.level, ',' ORDER BY t.rank) AS coarser, min_by(t.level, t.rank) AS top FROM asked a JOIN there t ON a.table_id = t.table_id AND t.rank < a.own_rank GROUP BY a.request_id)
"""

LOCATIONS = ["United States", "Baltimore", "Baltimore, MD", "Baltimore County, MD", "Maryland", "Washington", "Washington, WA", "Springfield", "Austin, Texas", "nyc", "Ocean City, md", "puerto rico"]
PARSED = [
    ("us", None, None, None), ("place", "MD", None, "Baltimore city"), ("place", "MD", None, "Baltimore city"), ("county", "MD", "Baltimore", None), ("state", "MD", None, None), ("place", "DC", None, "Washington city"),
    ("place", "WA", None, "Washington city"), ("place", None, None, "Springfield city"), ("place", "TX", None, "Austin city"), ("place", "NY", None, "New York city"), ("place", "MD", None, "Ocean City"), ("state", "PR", None, None),
]


def location_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = geo.parse_location(literals(spark, "location string", [(x,) for x in LOCATIONS]))
    return rows.select("location", "geography", "state", "county", "place", geo.location_confidence(F.col("location")).alias("confidence"))


def place_match_cascade(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nation").select(F.col("n_name").alias("place"))
    names = table(spark, d, "nation").select(F.concat("n_name", F.lit(" city, "), F.col("n_regionkey").cast("string")).alias("name"))
    return geo.match_places(asked, names).select("place", "name", "rule")


def region_aggregation(spark: SparkSession, d: str) -> DataFrame:
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.avg("s_acctbal").alias("v"))
    return rows.select("r_name", F.round("v", 4).alias("mean_balance"), F.when(F.col("v") < 4000, "low").when(F.col("v") < 5000, "middle").otherwise("high").alias("band"))


def rendered_answers(spark: SparkSession, d: str) -> DataFrame:
    return _nation_estimates(spark, d).select("n_name", retrieval.rendered(F.col("estimate"), F.col("moe")).alias("shown"))


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


_CONFIDENCE = {"Baltimore": "high", "nyc": "medium"}
QUERIES = {f.__name__: f for f in (compare_locations_cv, demographic_answer_moe_pct, moe_reliability_bands, aggregate_sum_moe, rate_num_den, significance_pairs, temporal_change, geo_rollup_levels, grouping_sets_profile, geo_advisor_status, coarser_levels_range_join, location_parse, place_match_cascade, region_aggregation, rendered_answers)}
ORACLE_SQL = {
    "compare_locations_cv": f"WITH e AS ({BASE}), c AS (SELECT *, CASE WHEN estimate > 0 THEN moe / 1.645 / estimate * 100 END AS cv FROM e) SELECT n_name, round(estimate, 4) AS estimate, round(moe, 4) AS moe, round(cv, 4) AS cv_pct, CASE WHEN cv < 15 THEN 'reliable' WHEN cv < 30 THEN 'caution' WHEN cv >= 30 THEN 'unreliable' END AS reliability FROM c",
    "demographic_answer_moe_pct": f"WITH e AS ({BASE}), a AS (SELECT n_name FROM nation UNION ALL SELECT 'ATLANTIS') SELECT a.n_name, round(estimate, 4) AS estimate, round(moe, 4) AS moe, round(CASE WHEN estimate > 0 THEN round(moe / estimate * 100, 6) ELSE 0 END, 4) AS moe_pct, CASE WHEN estimate IS NULL THEN 'no data found' END AS error FROM a LEFT JOIN e ON a.n_name = e.n_name",
    "moe_reliability_bands": "WITH s AS (SELECT l_suppkey, 1.645 * stddev_samp(l_quantity) / sqrt(count(*)) / avg(l_quantity) AS r FROM lineitem GROUP BY l_suppkey) SELECT CASE WHEN r < 0.10 THEN 'high' WHEN r < 0.30 THEN 'medium' WHEN r >= 0.30 THEN 'low' END AS band, count(*) AS n FROM s GROUP BY 1",
    "aggregate_sum_moe": f"WITH e AS ({BASE}) SELECT r_name, round(sum(estimate), 3) AS estimate, round(sqrt(sum(moe * moe)), 3) AS moe FROM e JOIN nation USING (n_name) JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "rate_num_den": "WITH g AS (SELECT n_name, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS num, count(*)::DOUBLE AS den FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name) SELECT n_name, round(num / den, 6) AS rate, round(sqrt(num * 1.645 * 1.645 + (num / den) ** 2 * den * 1.645 * 1.645) / den, 6) AS rate_moe FROM g",
    "significance_pairs": f"WITH e AS (SELECT x.*, n_regionkey FROM ({BASE}) x JOIN nation USING (n_name)) SELECT a.n_regionkey, a.n_name, b.n_name AS n_name_b, abs(a.estimate - b.estimate) > a.moe + b.moe AS differs FROM e a JOIN e b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    "temporal_change": "WITH e AS (SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 / count(*) AS estimate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_name, year, round(estimate, 4) AS estimate, round(estimate - lag(estimate) OVER (PARTITION BY n_name ORDER BY year), 4) AS change FROM e",
    "geo_rollup_levels": "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "grouping_sets_profile": "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_size))",
    "geo_advisor_status": _GEO
    + """, j AS (SELECT a.*, t.level IS NULL AS blocked, c.coarser, c.top, 0.25 + (a.request_id % 10) / 50.0 AS weight FROM asked a LEFT JOIN there t ON a.table_id = t.table_id AND a.level = t.level LEFT JOIN coarser c USING (request_id)),
k AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN moe_ratio >= 0.30 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN weight < 0.30 THEN 'nationally_stable' WHEN weight < 0.38 THEN 'regionally_variable' ELSE 'locally_clustered' END AS kind FROM j)
SELECT request_id, status, CASE status WHEN 'blocked' THEN 'not_published' WHEN 'warning' THEN 'high_moe' END AS reason, CASE status WHEN 'blocked' THEN replace(coarser, ',', ', ') WHEN 'warning' THEN coalesce(top, 'coarser geography') END AS suggestion,
  CASE WHEN status = 'ok' AND ((kind = 'locally_clustered' AND level IN ('county', 'state')) OR (kind = 'nationally_stable' AND level IN ('tract', 'block_group'))) THEN kind END AS note FROM k""",
    "coarser_levels_range_join": _GEO + "SELECT request_id, coarser FROM coarser",
    "location_parse": "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(x)}, {', '.join(map(_quoted, p))}, {_quoted(_CONFIDENCE.get(x, 'low' if any(w in x.lower() for w in ('springfield', 'washington', 'baltimore')) else 'medium'))})" for x, p in zip(LOCATIONS, PARSED, strict=True)) + ") t(location, geography, state, county, place, confidence)",
    "place_match_cascade": "WITH m AS (SELECT a.n_name AS place, b.n_name || ' city, ' || b.n_regionkey::VARCHAR AS name, lower(a.n_name) AS p, lower(b.n_name || ' city, ' || b.n_regionkey::VARCHAR) AS n FROM nation a, nation b), r AS (SELECT place, name, CASE WHEN n = p THEN 1 WHEN starts_with(n, p || ',') THEN 2 WHEN contains(n, p || ' city,') THEN 3 WHEN contains(n, p || ' town,') THEN 4 WHEN contains(n, p || ' village,') THEN 5 WHEN contains(n, p) THEN 6 END AS rule FROM m) SELECT place, name, rule FROM (SELECT *, min(rule) OVER (PARTITION BY place) AS best FROM r WHERE rule IS NOT NULL) WHERE rule = best",
    "region_aggregation": "WITH v AS (SELECT r_name, avg(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT r_name, round(v, 4) AS mean_balance, CASE WHEN v < 4000 THEN 'low' WHEN v < 5000 THEN 'middle' ELSE 'high' END AS band FROM v",
    "rendered_answers": f"WITH e AS ({BASE}) SELECT n_name, format('{{:,}} (±{{:,}}, {{:.1f}}%)', CAST(round(estimate) AS BIGINT), CAST(round(moe) AS BIGINT), moe / estimate * 100) AS shown FROM e",
}
