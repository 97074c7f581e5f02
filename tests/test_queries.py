"""Every query against its SQL on the smallest tables."""

import pytest

from tabulon.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        same(got, duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_catalog_queries_cover_the_table(spark, duck):
    n = duck.sql("SELECT count(*) FROM part").fetchall()[0][0]
    assert QUERIES["catalog_relevance_score_all"](spark, DATA).count() == n + 14
    assert QUERIES["useful_filter_all"](spark, DATA).count() >= QUERIES["useful_filter"](spark, DATA).count() > 0


def test_candidate_scorer_reads_the_table(spark, duck):
    ids = {r[0] for r in duck.sql("SELECT 'B' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || '_' || lpad((p_size % 1000)::VARCHAR, 3, '0') FROM part").fetchall()}
    got = [r.variable_id for r in QUERIES["candidate_scorer_all"](spark, DATA).collect()]
    assert len(got) == 15 and set(got) <= ids
