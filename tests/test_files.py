"""Readers of file shapes on small files, odd ones included."""

import json

from tabulon.functions import text as T
from tabulon.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(path, name, text):
    (path / name).write_text(text)
    return str(path / name)


def test_variable_ids(spark, tmp_path):
    assert rows(files.variable_ids(spark, put(tmp_path, "a.json", json.dumps([{"variable_id": "A"}, "B", "B", {"x": 1}])))) == [("A",), ("B",)]
    assert rows(files.variable_ids(spark, put(tmp_path, "b.json", json.dumps({"A": {"y": [1]}, "C": None})))) == [("A",), ("C",)]
    assert rows(files.variable_ids(spark, put(tmp_path, "c.csv", "name,variable_id\nx,A\ny,\n"))) == [("A",)]
    assert rows(files.variable_ids(spark, put(tmp_path, "d.csv", "other\nx\n"))) == []
    assert rows(files.variable_ids(spark, put(tmp_path, "e.json", ""))) == []


def test_enriched_records(spark, tmp_path):
    read = lambda name, value: rows(files.enriched_records(spark, put(tmp_path, name, json.dumps(value))))
    assert read("a.json", [{"variable_id": "A", "w": 1}, {"w": 2}, {"variable_id": "A", "w": 3}]) == [("A", '{"variable_id":"A","w":3}')]
    assert read("b.json", {"variables": {"A": {"w": 1}}}) == read("c.json", {"A": {"w": 1}}) == [("A", '{"w":1}')]


def test_concept_files(spark, tmp_path):
    put(tmp_path, "zinc.json", json.dumps({"concepts": [{"id": "a", "label": "A", "definition": "d", "census_tables": ["T1", "T2", "T1"]}, {"id": "b", "label": "B"}]}))
    put(tmp_path, "econ.json", json.dumps({"concepts": [{"label": "C", "census_tables": ["T2", "T3"]}]}))
    put(tmp_path, "econ_review.txt", "\n\nD\nits text\nand more\n  \nE\n\n")
    folder = str(tmp_path)
    tiers = [("econ", "high", "C", None), ("econ", "medium", "D", "its text\nand more"), ("econ", "medium", "E", ""), ("zinc", "high", "A", "d"), ("zinc", "high", "B", None)]
    key = lambda r: tuple(x or "" for x in r)
    assert sorted((tuple(r) for r in files.concept_tiers(spark, folder).collect()), key=key) == tiers
    put(tmp_path, "zinc_low_confidence.csv", 'label,definition\n"F, G",h\n')
    assert ("zinc", "low", "F, G", "h") in [tuple(r) for r in files.concept_tiers(spark, folder).collect()]
    assert rows(files.concept_tables(spark, folder)) == [("econ", "T2"), ("econ", "T3"), ("zinc", "T1"), ("zinc", "T2")]
    assert rows(files.table_categories(spark, folder, ["zinc", "econ"])) == [("T1", "zinc"), ("T2", "econ"), ("T3", "econ")]
    assert rows(files.table_categories(spark, folder, ["econ", "zinc"]))[1] == ("T2", "zinc")


def test_first_concepts(spark, tmp_path):
    text = "ex:hasConcept ex:none\nex:A\nex:B\n ex:hasConcept ex:c1\n ex:hasConcept ex:c2\nex:A\nother\n ex:hasConcept ex:c3\nex:B\n ex:hasConcept ex:c4\nex:Z\n"
    assert rows(files.first_concepts(spark, put(tmp_path, "a.ttl", text), "ex")) == [("A", "c3"), ("B", "c4")]


def test_files_as_text(spark, tmp_path):
    path = put(tmp_path, "a.csv", "x,y\n" + "".join(f"{i},{i}\n" for i in range(150)))
    text = files.csv_as_text(spark, path).collect()[0].text.split("\n")
    assert text[:3] == ["CSV: a.csv", "Columns: x,y", "0,0"] and text[-1] == "99,99"
    assert files.json_as_text(spark, put(tmp_path, "a.json", json.dumps(["x" * 9000]))).collect()[0].text == '["' + "x" * 7998
    assert files.json_as_text(spark, put(tmp_path, "b.json", "{cut")).collect() == []


def test_odd_texts(spark):
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([(1, None), (2, ""), (3, "___")], "page int, text string")
    assert files.definitions(odd).collect() == [] and files.contents_entries(odd, "text").collect() == []
    assert [r[0] for r in odd.select(T.markdown_text(F.col("text"))).collect()] == [None, "", ""]
