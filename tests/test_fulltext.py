"""Query strings against a plain reading of their form, position by position."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabulon.operators import fulltext

COLUMNS = ["name", "kind"]


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def matches(q, doc):
    """Whether a document (dict of columns) matches a valid query string, by parts and alternatives."""
    items = re.findall(r'(?:(?:name|kind)\s*:\s*)?"[^"]*"\*?|(?:(?:name|kind)\s*:\s*)?\w+\*?', q)

    def met(item):
        named = re.match(r"(name|kind)\s*:\s*", item)
        body = item[named.end() :] if named else item
        want, prefix = words(body), body.endswith("*")
        for c in [named[1]] if named else COLUMNS:
            own = words(doc[c])
            for i in range(len(own) - len(want) + 1):
                here = own[i : i + len(want)]
                if here == want or (prefix and here[:-1] == want[:-1] and here[-1].startswith(want[-1])):
                    return True
        return False

    alternatives, kind = [[("AND", [])]], "AND"
    for item in items:
        if item == "OR":
            alternatives.append([("AND", [])])
        elif item in ("AND", "NOT"):
            alternatives[-1].append((item, []))
        else:
            alternatives[-1][-1][1].append(item)
    del kind
    return any(all(all(map(met, own)) != (op == "NOT") for op, own in alt) for alt in alternatives)


def test_against_a_plain_reading(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["red", "reed", "blue", "bolt", "b", "rod"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 6))), rng.choice([None, "Red-bolt", "blue rod", "b"]), 1.0) for i in range(60)]

    def term():
        t = rng.choice([word(), f'"{word()} {word()}"', f"{word()[:2]}*", f'"{word()} {word()[:1]}"*'])
        return rng.choice(["", "", "name:", "kind: "]) + t

    strings = []
    for i in range(60):
        q = term()
        for _ in range(rng.randrange(4)):
            q += rng.choice([" ", " ", " OR ", " NOT ", " AND "]) + term()
        strings.append((i, q))
    df = spark.createDataFrame(docs, "id long, name string, kind string, score double")
    got = {}
    for r in fulltext.match_search(spark.createDataFrame(strings, "query_id int, q string"), df, "id", COLUMNS, 100).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    for i, q in strings:
        assert got.get(i, set()) == {d for d, n, k, _ in docs if matches(q, {"name": n, "kind": k})}, q


@pytest.mark.parametrize("q", ["a-b", "it's", "65+", 'open "quote', "", "  ", "rate: x", "OR red", "red OR", "NOT red", "red AND OR blue", "name:", "(red)", "red:blue", None])
def test_other_forms_match_nothing(spark, q):
    df = spark.createDataFrame([(1, q)], "query_id int, q string")
    assert fulltext.clauses(df, COLUMNS).count() == 0


def test_scores_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "red red", "x"), (2, "red", "x"), (3, None, None), (4, "red", "x")], "id long, name string, kind string")
    asked = spark.createDataFrame([(1, "red"), (1, "red"), (2, "name:red*")], "query_id int, q string").distinct()
    got = fulltext.match_search(asked, df, "id", COLUMNS, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 4)] and got[1].score == got[2].score
    assert fulltext.match_search(asked, df.limit(0), "id", COLUMNS).count() == 0
    assert fulltext.match_search(asked.limit(0), df, "id", COLUMNS).filter(F.lit(True)).count() == 0
