"""Plans that stay bounded: what grows with a table is not broadcast, and no key's rows are one task's."""

import re

import pytest

from tabulon.operators import fulltext, lexical


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_candidate_scores_join_no_variables(spark):
    """Keywords are broadcast and variables stay where they are: no join has them on both sides, at any number."""
    words = spark.sql("SELECT * FROM VALUES ('S', 'steel'), ('S', 'plate') AS t(concept_id, keyword)")
    ids = lambda n: spark.range(n).selectExpr("concat('V', id, '_001') AS variable_id", "concat('steel plate ', id) AS label", "concat('Name ', id) AS concept")
    plan = planned(lexical.candidate_scores(words, ids(10**9)))
    assert plan.count("BroadcastHashJoin") >= 6 and "SortMergeJoin" not in plan
    found = lexical.candidate_scores(words, ids(100)).orderBy("rank").limit(2).collect()
    assert [(r.variable_id, r.score) for r in found] == [("V0_001", 36), ("V10_001", 36)]


def test_query_strings_move_documents_once(spark):
    """Clauses are broadcast: rows of documents are shuffled by document alone, never by a word or a clause that many have."""
    docs = lambda n: spark.range(n).selectExpr("id", "concat('red ', id % 3) AS name", "'blue' AS kind")
    asked = spark.sql("SELECT * FROM VALUES (1, 'red 2'), (2, 'blu*'), (3, 'blue NOT 1') AS t(query_id, q)")
    found = fulltext.match_search(asked, docs(1000), "id", ["name", "kind"], 2)
    assert [(r.query_id, r.id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 2), (1, 5), (2, 0), (2, 1), (3, 0), (3, 2)]
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", planned(found))
    assert joins and all(re.search(r"(^|, )id#", keys) for keys in joins)


@pytest.mark.parametrize("few", [True, False])
def test_clauses_too_many_to_broadcast(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(fulltext, "SMALL_TOKENS", 0)
    monkeypatch.setattr(fulltext, "DOCS_PER_TASK", 7)
    df = spark.createDataFrame([(i, f"red {i % 3} rod", "blue bolt" if i % 2 else None) for i in range(40)] + [(3, "green", "x")], "id long, name string, kind string")
    asked = spark.createDataFrame([(1, '"red 1"'), (2, "bl* NOT 0"), (3, "green OR kind:bolt"), (4, "re* AND rod")], "query_id int, q string")
    got = {}
    for r in fulltext.match_search(asked, df, "id", ["name", "kind"], 100).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {1: {i for i in range(40) if i % 3 == 1}, 2: {i for i in range(40) if i % 2 and i % 3}, 3: {i for i in range(40) if i % 2}, 4: set(range(40))}
