"""Operators on small fixtures with known results."""

from pyspark.sql import functions as F

from tabulon.functions import catalog, stats, text
from tabulon.operators import chunk, cluster, geo, lexical, merge, vector
from tabulon.sources import tables
from tabulon.sources.tables import literals


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_reliability(spark):
    rows = literals(spark, "e double, m double", [(59623.0, 1145.0), (967862.0, 373.0), (100.0, 30.0), (100.0, 60.0), (0.0, 5.0)])
    cv = stats.cv_percent(F.col("e"), F.col("m"))
    got = values(rows.select(F.round(cv, 4).alias("cv"), stats.cv_band(cv).alias("band"), F.round(stats.moe_percent(F.col("e"), F.col("m")), 4).alias("p")), "cv", "band", "p")
    assert got == [(1.1674, "reliable", 1.9204), (0.0234, "reliable", 0.0385), (18.2371, "caution", 30.0), (36.4742, "unreliable", 60.0), (None, None, 0.0)]


def test_bands(spark):
    row = spark.range(1).select(*[stats.spatial_category(F.lit(x)).alias(f"a{i}") for i, x in enumerate((0.29, 0.30, 0.38))], *[stats.moe_ratio_band(F.lit(x)).alias(f"b{i}") for i, x in enumerate((0.09, 0.10, 0.30))], stats.confidence_tier(F.lit(0.9)).alias("c"), stats.topology_quality(F.lit(0.4)).alias("d")).first()
    assert tuple(row) == ("nationally_stable", "regionally_variable", "locally_clustered", "high", "medium", "low", "auto", "good")


def test_weights(spark):
    rows = literals(spark, "id int, c string, score double", [(1, "housing", 0.8), (1, "economics", 0.6), (1, "education", 0.1)])
    linear = dict(values(vector.category_weights(rows, "id", "c", 0.09).withColumn("weight", F.round("weight", 6)), "c", "weight"))
    assert linear == {"housing": 0.571429, "economics": 0.428571}
    logs = dict(values(vector.category_weights(rows, "id", "c", 0.09, log=True).withColumn("weight", F.round("weight", 6)), "c", "weight"))
    assert logs == {"housing": 0.555674, "economics": 0.444326}
    even = literals(spark, "id int, c string, score double", [(1, "a", 0.5), (1, "b", 0.5)])
    assert values(vector.category_weights(even, "id", "c", 0.6), "c", "weight") == [("a", 1.0)]


def test_links(spark):
    rows = literals(spark, "v int, c int, score double", [(1, 1, 0.5), (1, 2, 0.3), (1, 3, 0.2), (1, 4, 0.19)])
    assert sorted(values(vector.links(rows, "v", "c").withColumn("weight", F.round("weight", 6)), "c", "weight")) == [(1, 0.5), (2, 0.3), (3, 0.2)]


def test_nearest_of_many_queries(spark):
    n = lexical.SMALL_DIM + 300
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v")).filter("vec_id < 3 or vec_id >= 2500")
    queries = spark.range(n).select(F.col("id").alias("query_id"), F.array((F.col("id") % 2).cast("double")).alias("q"))
    got = vector.nearest(rows, queries, 1 - vector.squared_l2(F.col("v"), F.col("q")), "query_id", "vec_id", 2, 0.5)
    # A query at 0 has row 0 (its second, row 1, is below the threshold), one at 1 has row 1.
    assert sorted(values(got, "query_id", "vec_id", "score", "rank")) == [(i, i % 2, 1.0, 1) for i in range(n)]


def test_checked_weights(spark):
    rows = literals(spark, "id int, d string, w double", [(1, "x", 0.5), (2, "a", 0.01), (2, "b", 0.02), (3, "a", 0.4), (3, "b", 0.4), (3, "x", 0.9)])
    got = sorted(values(vector.checked_weights(rows, "id", "d", "w", ["a", "b"]), "id", "d", "w"))
    assert got == [(1, "core_demographics", 1.0), (2, "b", 1.0), (3, "a", 0.5), (3, "b", 0.5)]


def test_priority_dedup(spark):
    rows = literals(spark, "id int, source string", [(1, "bulk"), (1, "coos"), (1, "early"), (2, "bulk")])
    order = F.when(F.col("source") == "coos", 1).when(F.col("source") == "early", 2).otherwise(3)
    assert sorted(values(merge.best_by(rows, ["id"], order, "ordinal"), "id", "source")) == [(1, "coos"), (2, "bulk")]


def test_measure_types(spark):
    labels = ["Median household income", "Average household size", "Estimate!!Total:!!Male", "Percent below poverty", "Separated", "Owner occupied"]
    rows = literals(spark, "l string", [(x,) for x in labels]).select(catalog.measure_type(F.col("l")).alias("m"))
    assert [r.m for r in rows.collect()] == ["median", "mean", "total", "percentage", "rate", "count"]


def test_fuzzy_word_boundaries(spark):
    core = literals(spark, "key string, code string", [("men", "B01001_002"), ("unemployment", "B23025_005")])
    query = literals(spark, "q string", [("unemployment rate",)]).withColumnRenamed("ordinal", "query_id")
    assert values(lexical.first_contained(query, core, "q", "key"), "code") == [("B01001_002",)]
    assert values(lexical.first_contained(query, core, "q", "key", whole_words=True), "code") == [("B23025_005",)]


def test_large_dimensions_are_exact(spark, monkeypatch):
    dim = literals(spark, "key string, code string", [("zz", "A"), ("men", "B"), ("women", "C"), ("me", "D"), ("two words", "E")])
    queries = literals(spark, "q string", [("women at work",), ("me",), ("nothing",), ("words",), ("zz men",)]).withColumnRenamed("ordinal", "query_id")
    words = literals(spark, "concept_id string, keyword string", [("x", w) for w in ("total", "total", "income", "poverty", "sex")] + [("y", "income"), ("y", "in")])
    v = literals(spark, "variable_id string, label string, concept string", [("B1_001", "Total", "SEX"), ("B1_001", "Total", "SEX"), ("B1_009", "Income", "POVERTY"), ("B1A_1", "none", None)])
    first = lambda: sorted(values(lexical.first_contained(queries, dim, "q", "key"), "query_id", "code", "via"))
    scores = lambda: sorted(values(lexical.candidate_scores(words, v), "concept_id", "variable_id", "score", "rank"))
    want, want_scores = first(), scores()
    assert want == [(0, "B", "men"), (1, "B", "men"), (3, "E", "two words"), (4, "A", "zz")]
    assert want_scores == [("x", "B1_001", 38, 1), ("x", "B1_001", 38, 2), ("x", "B1_009", 15, 3), ("y", "B1_009", 13, 1)]
    monkeypatch.setattr(lexical, "SMALL_DIM", 2)
    assert first() == want and scores() == want_scores


def test_locations_keep_other_columns(spark):
    rows = literals(spark, "location string, note string", [("Baltimore County, MD", "a"), ("nowhere, ZZ", "b")])
    got = values(geo.parse_location(rows), "geography", "state", "county", "note")
    assert got == [("county", "MD", "Baltimore", "a"), ("place", None, None, "b")]


def test_texts(spark):
    row = spark.range(1).select(
        text.repaired_json(F.lit("said: {'a': 1,}")).alias("a"), text.repaired_json(F.lit("none")).alias("b"), text.slug(F.lit(" Group  Quarters (2020)! ")).alias("c"), text.turtle_string(F.lit('say "x"')).alias("d"),
        text.phrases(F.lit("a: b;; c/d\n e")).alias("e"), text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("f"), text.ngrams(F.array(F.lit("a")), 2).alias("g"), text.camel_id(F.lit("median household income a")).alias("h"),
    ).first()
    assert row.a == '{"a": 1}' and row.b is None and row.c == "group_quarters_2020" and row.d == '"""say \\"x\\""""'
    assert list(row.e) == ["a", "b", "c", "d", "e"] and list(row.f) == ["a b", "b c"] and list(row.g) == [] and row.h == "MedianHouseholdIncome"


def test_chunks(spark):
    rows = literals(spark, "id int, t string", [(1, "aaaa\nbbbb\n\ncccc"), (2, ""), (3, None)])
    got = values(chunk.chunks(rows, "id", chunk.paragraphs(F.col("t")), 9, 2, 1), "id", "chunk_number", "text")
    assert got == [(1, 0, "aaaa\nbbbb"), (1, 1, "bb\ncccc")]


def test_kmeans(spark):
    rows = literals(spark, "id int, v array<double>", [(i, [0.0 + i / 100, 0.0]) for i in range(5)] + [(10 + i, [9.0, 9.0 + i / 100]) for i in range(5)])
    got = values(cluster.kmeans_by_silhouette(rows, "v"), "id", "cluster", "silhouette")
    assert len({c for i, c, _ in got if i < 10}) == 1 and len({c for _, c, _ in got}) == 2 and got[0][2] > 0.9
    assert values(cluster.kmeans_by_silhouette(rows.limit(1), "v"), "cluster") == [(-1,)]


def test_upsert_and_diff(spark):
    old, new = literals(spark, "id int, a string", [(1, "x"), (2, "y")]).drop("ordinal"), literals(spark, "id int, a string", [(2, "z"), (3, "w")]).drop("ordinal")
    assert sorted(values(merge.upsert(old, new, "id"), "id", "a")) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(values(merge.catalog_diff(old, new, "id", "a"), "id", "change")) == [(1, "removed"), (2, "relabelled"), (3, "added")]


def test_sources(spark, tmp_path):
    (tmp_path / "wrapped.json").write_text('{"variables": {"B01001_001E": {"label": "Total", "concept": "SEX"}, "NAME": {"label": "n"}}}')
    (tmp_path / "bare.json").write_text('{"B01001_001E": {"label": "Total", "concept": "SEX"}}')
    (tmp_path / "rows.json").write_text('[{"name": "B01001_001E", "label": "Total"}, {"label": "lost"}]')
    (tmp_path / "rows.csv").write_text("variable_id,label\nA,one\nB,two\nA,three\n")
    (tmp_path / "sections.txt").write_text("Age\nhow old\n\nSex\nmale or\nfemale\n")
    (tmp_path / "x.ttl").write_text('@prefix c: <http://x/> .\n\nc:Age a skos:Concept ;\n  skos:prefLabel "Age"@en ;\n  skos:definition "How old." .\n\nc:None a skos:Concept .\n')
    wrapped = tables.catalog_from_json(spark, str(tmp_path / "wrapped.json"))
    assert sorted(values(wrapped, "variable_id", "label")) == [("B01001_001E", "Total"), ("NAME", "n")]
    bare = tables.catalog_from_json(spark, str(tmp_path / "bare.json"), "acs1")
    assert values(tables.surveys(wrapped, bare).groupBy("survey").count().orderBy("survey"), "survey", "count") == [("acs1", 1), ("acs5", 2)]
    assert values(tables.catalog_from_records(spark, str(tmp_path / "rows.json")), "variable_id") == [("B01001_001E",)]
    assert sorted(values(tables.csv_catalog(spark, str(tmp_path / "rows.csv"), "variable_id string, label string"), "variable_id", "label")) == [("A", "three"), ("B", "two")]
    assert values(tables.text_sections(spark, str(tmp_path / "sections.txt")).orderBy("ordinal"), "label", "body") == [("Age", "how old"), ("Sex", "male or\nfemale")]
    assert values(tables.concept_blocks(spark, str(tmp_path / "x.ttl"), "c"), "id", "label", "definition") == [("Age", "Age", "How old.")]
    assert tables.manifest(spark, str(tmp_path), "*.json").count() == 3


def test_sections(spark):
    rows = literals(spark, "path string, line string", [("p", "lead"), ("p", "AGE"), ("p", "how"), ("p", "old"), ("p", "SEX"), ("p", "x")])
    got = values(tables.headings_to_sections(rows, F.col("line").rlike("^[A-Z]+$")), "heading", "body")
    assert sorted(got) == [("AGE", "how\nold"), ("SEX", "x")]
