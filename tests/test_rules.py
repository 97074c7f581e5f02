"""Category splits, mixed samples and small rules on odd rows."""

from pyspark.sql import functions as F

from tabulon.functions import rules as R
from tabulon.operators import cluster, sample, vector


def test_a_category_is_split_and_named(spark):
    near = lambda x, i: [x + i * 0.01, 1.0 - i * 0.01]
    rows = [(i, near(0.0, i), "Jobs", "wage labor the wage") for i in range(6)] + [(10 + i, near(9.0, i), "jobs", "travel commute the") for i in range(6)]
    rows += [(30, None, "Jobs", "no vector"), (31, [1.0, 1.0], "Other", "x"), (32, [1.0, 1.0], None, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, category string, t string")
    got = {r.id: (r.new_category, r.original_category) for r in cluster.split_category(df, "id", "v", "category", "t", "Jobs", 4, 0.1, ["the"]).collect()}
    assert len(got) == 15 and len({got[i] for i in range(6)}) == 1 and len({got[10 + i] for i in range(6)}) == 1 and got[0] != got[10]
    assert got[0][0].endswith("wage_labor") and got[10][0].endswith("commute_travel") and got[0][1] == "Jobs" and got[10][1] == "jobs"
    assert got[30] == ("Jobs", None) and got[31] == ("Other", None) and got[32] == (None, None)
    whole = cluster.split_category(df.filter("id < 2"), "id", "v", "category", "t", "Jobs").collect()
    assert {(r.new_category, r.original_category) for r in whole} == {("Jobs", None)}


def test_mixed_strata_fill_up(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"f{i % 3}", None if i % 5 == 0 else "c") for i in range(60)], "id long, family string, complexity string")
    got = sample.mixed_strata(rows, "id", "family", "complexity", 40, 1)
    n = {r.stratum: r.n for r in got.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert got.select("id").distinct().count() == got.count() == 40 and n == {"family": 16, "complexity": 6, "random": 18}
    assert {r.family for r in got.filter("stratum = 'family'").collect()} == {None}
    assert sample.mixed_strata(rows, "id", "family", "complexity", 500, 1).count() == 60
    assert sample.mixed_strata(rows.limit(0), "id", "family", "complexity", 10).count() == 0


def test_clipped_weights(spark):
    rows = spark.createDataFrame([(1, "a", -0.5), (1, "b", 0.6), (1, "c", 0.02), (2, "a", -1.0), (2, "b", -1.0)], "id int, c string, score double")
    got = {(r.id, r.c): round(r.weight, 6) for r in vector.clipped_weights(rows, "id", "c", 0.05).collect()}
    assert got == {(1, "b"): 1.0, (2, "a"): 1.0}


def test_rules_on_nulls(spark):
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    row = spark.range(1).select(
        R.in_family(none).alias("a"), R.is_base_table(text("B01_1")).alias("b"), R.is_described(none).alias("c"), R.needs_category(none).alias("d"), R.flavor_text(none).alias("e"), R.flavor_text(text("acs5")).alias("f"),
        R.embedding_dimension(text("all-MiniLM-L6-v2")).alias("g"), R.embedding_dimension(none).alias("h"), R.joined_parts(none, text(" "), text("x"), text("y")).alias("i"), R.clean_definition(text(" a \n b  12")).alias("j"),
        R.geography_weight(F.create_map(text("geography"), F.lit(0.0)), F.create_map(text("geography"), F.lit(0.7))).alias("k"), R.review_decision(none).isNull().alias("l"), R.arbitration(F.lit(None).cast("double")).alias("m"), R.page_of(text("x"), {"x": 4}).alias("n"),
        R.synthesis(F.array().cast("array<struct<agent:string,response:string>>")).alias("o"), R.official_text(text("V"), F.lit(None).cast("struct<label:string,concept:string,survey:string>"), none, text("Unknown"), none).alias("p"),
    ).first()
    assert tuple(row)[:5] == (False, True, False, True, "Unknown flavor: None") and row.f.startswith("5-year") and (row.g, row.h) == (384, 768)
    assert (row.i, row.j, row.k, row.l, row.m, row.n, row.o) == ("x | y", "a b", 0.0, True, False, 4, None)
    assert tuple(row.p) == ("V_ID_V Variable V Census Variable acs5", "FALLBACK")
