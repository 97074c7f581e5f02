"""Full-text matches of query strings over several columns: required and excluded terms, alternatives, phrases, prefixes, one column.

A query string is split by column functions into clauses, rows of words; a clause is met where its words follow each other,
so single terms, phrases and prefixes are one join on positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import tokens
from tabulon.operators.lexical import B, K1, LEAST_IDF, SMALL_TOKENS, top

#: Documents of a task, and the parts over which rows of a clause are dealt if there are too many clauses to broadcast.
DOCS_PER_TASK, DEALT = 10_000, 64

# Fixed forms: a bare word, a quoted phrase, a column before either; the words between terms.
_WORD, _QUOTED = r"(?!(?:AND|OR|NOT)(?:\s|$))[A-Za-z0-9_\x{80}-\x{10FFFF}]+", r'"[^"]*"'
_BETWEEN = r"(?:\s+(?:AND|OR|NOT))?"


def _term(columns: list[str]) -> str:
    return rf"(?:(?:{'|'.join(columns)})\s*:\s*)?(?:{_QUOTED}|{_WORD})\*?"


def valid(q: Column, columns: list[str]) -> Column:
    """Whether a query string has a form that clauses reads."""
    return q.rlike(rf"^\s*{_term(columns)}(?:{_BETWEEN}\s+{_term(columns)})*\s*$")


def clauses(queries: DataFrame, columns: list[str]) -> DataFrame:
    """query_id, alternative, part, excluded, clause, field, words, prefix of queries (query_id, q): a row for each term.

    Terms are words, "phrases", either with * for a prefix at the end and with a column and a colon before it. Terms next to
    each other are one part, all of which is needed; AND and NOT begin a part, NOT one that mustn't be there as a whole, OR an
    alternative. A string of any other form (an apostrophe, a plus, an open quote, `a-b`, an unknown column, nothing) matches
    nothing, so it has no rows. Terms without letters and digits are left out, but they don't save a string from its form.
    """
    items = F.regexp_extract_all("q", F.lit(rf"(?:^|(?<=\s))(?:(?:AND|OR|NOT)(?=\s)|{_term(columns)})"), F.lit(0))
    split = queries.filter(valid(F.col("q"), columns)).select("query_id", items.alias("items")).select("query_id", "items", F.posexplode("items").alias("at", "item"))
    words = ["AND", "OR", "NOT"]
    so_far = F.slice("items", F.lit(1), F.col("at") + 1)
    count = lambda *of: F.size(F.filter(so_far, lambda x: x.isin(*of)))
    began = F.element_at(F.concat(F.array(F.lit("AND")), F.filter(so_far, lambda x: x.isin(*words))), -1)
    rows = split.select("query_id", count("OR").alias("alternative"), count(*words).alias("part"), (began == "NOT").alias("excluded"), F.col("at").alias("clause"), "item").filter(~F.col("item").isin(*words))
    named = F.regexp_extract("item", rf"^({'|'.join(columns)})\s*:", 1)
    body = F.regexp_replace("item", rf"^(?:{'|'.join(columns)})\s*:\s*", "")
    out = rows.select("query_id", "alternative", "part", "excluded", "clause", F.nullif(named, F.lit("")).alias("field"), tokens(body).alias("words"), F.col("item").endswith("*").alias("prefix"))
    return out.filter(F.size("words") > 0)


def _positions(docs: DataFrame, id_: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, field, token, at) of every word, and (id, dl)."""
    words = lambda c: F.transform(tokens(F.col(c).cast("string")), lambda t, i: F.struct(F.lit(c).alias("field"), t.alias("token"), i.alias("at")))
    all_words = docs.select(F.col(id_).alias("id"), F.flatten(F.array(*map(words, columns))).alias("w")).filter(F.size("w") > 0)
    return all_words.select("id", F.explode("w").alias("w")).select("id", "w.*"), all_words.groupBy("id").agg(F.sum(F.size("w")).alias("dl"))


def _meet(rows: DataFrame, asked: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows of documents (id) with what asked says of their keys. Any share of the documents may have one key: rows stay where
    they are if asked is of few rows, else a key's rows are dealt by document over DEALT parts."""
    if few:
        return rows.join(F.broadcast(asked), keys)
    parts = F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(DEALT).cast("long")))
    return dealt.join(asked.withColumn("_part", F.explode(parts)), [*keys, "_part"]).drop("_part")


def occurrences(asked: DataFrame, words: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, clause, id, tf): how often each clause is met in a document.

    asked: rows of clauses, and whether they are few; words: (id, field, token, at). Words are joined by token, and the starts
    of prefixes by the head of the token, before rows move; a clause is met at a place where all its words are, one after the other.
    """
    each = asked.select("query_id", "clause", "field", F.size("words").alias("n"), "prefix", F.posexplode("words").alias("i", "word"))
    each = each.withColumn("open", F.col("prefix") & (F.col("i") == F.col("n") - 1))
    lengths = sorted(r[0] for r in each.filter("open").select(F.length("word")).distinct().collect())  # no more than the longest word has letters
    exact = F.array(F.struct(F.col("token").alias("word"), F.lit(False).alias("open")))
    heads = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("token")), lambda n: F.struct(F.substring(F.col("token"), F.lit(1), n).alias("word"), F.lit(True).alias("open")))
    kept = words.select("id", F.col("field").alias("in_field"), "at", F.explode(F.concat(exact, heads)).alias("k")).select("id", "in_field", "at", "k.*")
    if not few:
        keys = each.select("word", "open").distinct()
        kept = kept.join(F.broadcast(keys) if keys.limit(SMALL_TOKENS + 1).count() <= SMALL_TOKENS else keys, ["word", "open"], "left_semi")
    met = _meet(kept, each, ["word", "open"], few).filter("field IS NULL OR field = in_field")
    starts = met.groupBy("query_id", "clause", "id", "in_field", "n", (F.col("at") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("met")).filter("met = n")
    return starts.groupBy("query_id", "clause", "id").agg(F.count("*").alias("tf"))


def match_search(queries: DataFrame, docs: DataFrame, id_: str, columns: list[str], k: int = 1) -> DataFrame:
    """query_id, id, score, rank: the k best documents that match each query string, by BM25 over all columns.

    queries (query_id, q) may be any number. A clause's frequency is summed over its columns and a document's length over
    all; excluded clauses don't score. Ties go to the smaller id. Strings of no valid form have no answers, nor have null
    ones; null columns are empty. Rows of one id are one document. Empty in, empty out.
    Documents are dealt once, DOCS_PER_TASK to a task, which finds and counts the clauses of its own.
    """
    asked = clauses(queries.filter("q IS NOT NULL"), columns)
    few = (asked.agg(F.sum(F.size("words"))).first()[0] or 0) <= SMALL_TOKENS
    own = docs.select(*dict.fromkeys([id_, *columns]))
    words, lengths = _positions(own.repartition(max(1, -(-own.count() // DOCS_PER_TASK)), id_), id_, columns)
    whole = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    met = _meet(occurrences(asked, words, few), asked.select("query_id", "clause", "alternative", "part", "excluded"), ["query_id", "clause"], few)
    part = ["query_id", "alternative", "part", "excluded"]
    needed = asked.groupBy(*part).agg(F.count("*").alias("needed"))
    parts = _meet(met.groupBy(*part, "id").agg(F.count("*").alias("met")), needed, part, few).filter("met = needed")
    positive = asked.filter("NOT excluded").groupBy("query_id", "alternative").agg(F.count_distinct("part").alias("parts"))
    matched = parts.groupBy("query_id", "alternative", "id").agg(F.count_if(~F.col("excluded")).alias("met"), F.max("excluded").alias("out"))
    matched = _meet(matched, positive, ["query_id", "alternative"], few).filter("met = parts AND NOT out").select("query_id", "id").distinct()
    scoring = met.filter("NOT excluded")
    df = scoring.groupBy("query_id", "clause").agg(F.count("*").alias("df"))
    # Both grow with the documents, so they are never broadcast.
    hits = _meet(scoring.join(matched.hint("merge"), ["query_id", "id"]), df, ["query_id", "clause"], few).join(lengths.hint("merge"), "id").crossJoin(F.broadcast(whole))  # one row
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    sums = hits.groupBy("query_id", "id").agg(F.round(F.sum(score), 6).alias("score"))
    return top(sums, "query_id", k, F.col("score").desc(), "id").withColumnRenamed("id", id_)
