"""Lexical search: inverted index, token overlap, BM25, substring matches, the layered resolver and candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions.text import tokens
from tabulon.operators.patterns import contained, holding

#: A query dimension of at most so many rows is broadcast; a larger one is dealt into blocks of about so many.
SMALL_DIM = 10_000
#: At most so many distinct asked tokens are broadcast; more are met by a shuffle.
SMALL_TOKENS = 100_000
# BM25's usual constants and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, id_: str, text: Column, queries: DataFrame | None = None) -> DataFrame:
    """(token, id, tf) of every text; with queries (words), of the tokens that they ask for, which are kept before rows move."""
    rows = docs.select(id_, F.explode(tokens(text)).alias("token"))
    if queries is not None:
        asked = queries.select(F.explode("words").alias("token")).distinct()
        rows = rows.join(F.broadcast(asked) if asked.count() <= SMALL_TOKENS else asked, "token", "left_semi")
    return rows.groupBy("token", id_).agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_: str, text: Column) -> DataFrame:
    """(id, dl): tokens of every text that has any."""
    return docs.groupBy(id_).agg(F.sum(F.coalesce(F.size(tokens(text)), F.lit(0))).alias("dl")).filter("dl > 0")


def with_synonyms(index: DataFrame, synonyms: DataFrame, id_: str) -> DataFrame:
    """The index where a synonym also has its canonical token's entries (one hop)."""
    more = index.join(synonyms, index.token == synonyms.canonical).select(F.col("synonym").alias("token"), id_, "tf")
    return index.select("token", id_, "tf").union(more).groupBy("token", id_).agg(F.max("tf").alias("tf"))


def top(rows: DataFrame, by: str, k: int, *order: Column | str) -> DataFrame:
    """The k best rows of each key, with `rank`; order must be total."""
    return rows.withColumn("rank", F.row_number().over(W.Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def keyword_search(queries: DataFrame, index: DataFrame, id_: str, k: int = 10, weights: DataFrame | None = None) -> DataFrame:
    """query_id, id, matches, score, confidence, rank by token overlap; repeated query tokens count again.

    weights (id, weight): only ids of weight over 0.3, scores times 1 + weight. queries has query_id and words (array).
    """
    asked = queries.select("query_id", F.size("words").alias("n"), F.explode("words").alias("token"))
    hits = asked.join(index, "token").groupBy("query_id", "n", id_).agg(F.count("*").alias("matches"))
    scored = hits.withColumn("score", F.col("matches").cast("double"))
    if weights is not None:
        scored = scored.join(weights, id_).filter("weight > 0.3").withColumn("score", F.col("score") * (1 + F.col("weight")))
    best = top(scored, "query_id", k, F.col("score").desc(), F.col(id_))
    return best.withColumn("confidence", F.least(F.col("score") / F.col("n"), F.lit(1.0))).drop("n")


def suggestions(found: DataFrame, labels: DataFrame, id_: str, label: str, threshold: float = 0.6) -> DataFrame:
    """Up to three `id - label...` lines of the queries whose best confidence is below threshold."""
    low = found.groupBy("query_id").agg(F.max("confidence").alias("best")).filter(F.col("best") < threshold).select("query_id")
    rows = found.filter("rank <= 3").join(low, "query_id", "left_semi").join(labels.select(id_, F.col(label).alias("_l")), id_)
    return rows.select("query_id", "rank", F.concat(F.col(id_).cast("string"), F.lit(" - "), F.substring("_l", 1, 60), F.lit("...")).alias("suggestion"))


def bm25(queries: DataFrame, index: DataFrame, id_: str, k: int = 1, lengths: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: documents with all of a query's tokens, by BM25 (higher is better, ties by id).

    As all tokens are required, only the documents of a query's rarest token are looked at. lengths (id, dl) of all
    documents must be given where index holds asked tokens only.
    """
    lengths = index.groupBy(id_).agg(F.sum("tf").alias("dl")) if lengths is None else lengths
    whole = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("token"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    known = asked.join(df, "token")
    rarest = known.groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    candidates = rarest.join(index, "token").select("query_id", id_)
    hits = candidates.join(known, "query_id").join(index, ["token", id_]).join(lengths, id_).crossJoin(F.broadcast(whole))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", id_).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("met"))
    return top(scored.join(needed, "query_id").filter("met = needed").drop("met", "needed"), "query_id", k, F.col("score").desc(), F.col(id_))


def crossed(rows: DataFrame, dim: DataFrame, hit: Column) -> DataFrame:
    """rows joined with every row of dim for which hit holds.

    A dim of at most SMALL_DIM rows is broadcast. A larger one is dealt into blocks of about so many rows, which meet all
    rows by a shuffle, so its size has no bound.
    """
    n = dim.count()
    if n <= SMALL_DIM:
        return rows.join(F.broadcast(dim), hit)
    blocks = -(-n // SMALL_DIM)
    row_blocks = max(1, -(-rows.count() // SMALL_DIM))
    deal = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")
    repeat = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("_of_rows", deal(rows, row_blocks)).withColumn("_of_dim", repeat(blocks)).repartition(min(2 * blocks * row_blocks, 4_096), "_of_rows", "_of_dim")
    right = dim.withColumn("_of_dim", deal(dim, blocks)).withColumn("_of_rows", repeat(row_blocks))
    return left.join(right.hint("shuffle_hash"), ["_of_rows", "_of_dim"]).filter(hit).drop("_of_rows", "_of_dim")


def first_contained(queries: DataFrame, dim: DataFrame, text: str, key: str, both_ways: bool = True, whole_words: bool = False) -> DataFrame:
    """query_id with the code of the first dim row (by ordinal) whose key is a substring of the text, or the reverse.

    Both sides may have any size: distinct texts and keys meet by anchors (see patterns). whole_words asks for matches at
    word boundaries. Null texts and keys match nothing; of equal keys the first by ordinal counts.
    """
    edge = F.lit(" ") if whole_words else F.lit("")
    asked = queries.select("query_id", F.concat(edge, F.col(text), edge).alias("_t"))
    keys = dim.filter(F.col(key).isNotNull()).groupBy(F.concat(edge, F.col(key), edge).alias("_k")).agg(F.min(F.struct("ordinal", "code", F.col(key).alias("via"))).alias("first"))
    met = contained(asked, "_t", keys, "_k")
    if both_ways:
        met = met.unionByName(contained(keys, "_k", asked, "_t")).distinct()
    best = met.join(keys, "_k").groupBy("_t").agg(F.min("first").alias("first"))
    return asked.join(best, "_t").groupBy("query_id").agg(F.min("first").alias("first")).select("query_id", "first.code", "first.via")


def resolve(queries: DataFrame, core: DataFrame, index: DataFrame, bm25_top: DataFrame, code_pattern: str, fuzzy: DataFrame, keywords: DataFrame, whole_words: bool = True) -> DataFrame:
    """query_id, code, stage: the first stage that answers: core, index, text, code, fuzzy, keyword, passthrough.

    queries (query_id, q); core, fuzzy and keywords (key, code, ordinal); index (alias, code, ordinal); bm25_top
    (query_id, code).
    """
    exact = queries.join(F.broadcast(core), F.col("q") == F.col("key")).groupBy("query_id").agg(F.min_by("code", "ordinal").alias("c_core"))
    alias = queries.join(index, F.col("q") == F.col("alias")).groupBy("query_id").agg(F.min_by("code", "ordinal").alias("c_index"))
    loose = first_contained(queries, fuzzy, "q", "key", True, whole_words).select("query_id", F.col("code").alias("c_fuzzy"))
    word = first_contained(queries, keywords, "q", "key", False, whole_words).select("query_id", F.col("code").alias("c_keyword"))
    text = bm25_top.select("query_id", F.col("code").alias("c_text"))
    out = queries
    for part in (exact, alias, text, loose, word):
        out = out.join(part, "query_id", "left")
    code = F.when(F.upper("q").rlike(code_pattern), F.upper("q"))
    stages = [("core", F.col("c_core")), ("index", F.col("c_index")), ("text", F.col("c_text")), ("code", code), ("fuzzy", F.col("c_fuzzy")), ("keyword", F.col("c_keyword")), ("passthrough", F.col("q"))]
    stage = F.lit(None).cast("string")
    for name, c in reversed(stages):
        stage = F.when(c.isNotNull(), name).otherwise(stage)
    return out.select("query_id", F.coalesce(*[c for _, c in stages]).alias("code"), stage.alias("stage"))


def concept_keywords(concepts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """concept_id, keyword, place of concepts (concept_id, concept, definition): what the scorer looks for.

    dictionary (key, keywords, ordinal). The keywords of the key that the concept, in lower case and without blanks, is; if
    it is none, those of all keys that it contains, in their order; then the words of the definition. Repeats stay. Concepts
    of one id are taken apart by their text; null concepts match no key, null definitions have no words.
    """
    asked = concepts.select("concept_id", F.replace(F.lower("concept"), F.lit(" "), F.lit("")).alias("_c"), F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("definition", F.lit(""))), r"\s+", " ")), " ").alias("_words"))
    keys = dictionary.select(F.col("key").alias("_k"), "keywords", "ordinal")
    exact = asked.join(keys, F.col("_c") == F.col("_k")).select("concept_id", "_c", "keywords", "ordinal")
    other = asked.join(exact.select("_c").distinct(), "_c", "left_anti")
    partial = other.join(contained(other, "_c", keys, "_k"), "_c").join(keys, "_k").select("concept_id", "_c", "keywords", "ordinal")
    named = exact.unionByName(partial).distinct().select("concept_id", "_c", "ordinal", F.posexplode("keywords").alias("at", "keyword"))
    words = asked.select("concept_id", "_c", F.lit(None).cast("int").alias("ordinal"), F.posexplode(F.filter("_words", lambda w: w != "")).alias("at", "keyword"))
    order = W.Window.partitionBy("concept_id", "_c").orderBy(F.col("ordinal").asc_nulls_last(), "at")
    return named.unionByName(words).withColumn("place", F.row_number().over(order)).select("concept_id", "keyword", "place")


def candidate_scores(concepts: DataFrame, variables: DataFrame, k: int = 15) -> DataFrame:
    """concept_id, variable_id, score, rank: variables by keyword hits in label (3), concept (2) and id (4, 25 for long ids).

    concepts (concept_id, keyword) rows, repeats count; variables (variable_id, label, concept). Base tables gain 10, their
    first two variables 20 more, those of the poverty table 30 more. Texts and keywords meet by anchors (see patterns), so
    neither side has a bound; of variables nothing is broadcast. Keywords of two characters or fewer and null ones count for nothing; a repeated variable is
    ranked again.
    """
    words = concepts.filter(F.length("keyword") > 2).groupBy("concept_id", "keyword").agg(F.count("*").alias("_times"))
    words = words.select("concept_id", "_times", F.lower("keyword").alias("_low"), F.when(F.length("keyword") >= 5, F.upper("keyword")).alias("_up"))
    v = variables.groupBy("variable_id", F.lower(F.coalesce("label", F.lit(""))).alias("l"), F.lower(F.coalesce("concept", F.lit(""))).alias("c")).agg(F.count("*").alias("_copies"))
    # A variable's texts with what a hit in them counts: label, concept, id; long keywords again in the id as it is written.
    fields = F.array(*[F.struct(c.alias("_t"), F.lit(gain).alias("_gain")) for c, gain in ((F.col("l"), 3), (F.col("c"), 2), (F.lower("variable_id"), 4))])
    key = ["variable_id", "l", "c", "_copies"]
    own = v.select(*key, F.explode(fields).alias("f")).select(*key, "f.*")
    near = F.broadcast(words) if words.limit(SMALL_DIM + 1).count() <= SMALL_DIM else words.hint("merge")
    small = holding(own, "_t", words, "_low").join(near, "_low").select("concept_id", *key, (F.col("_gain") * F.col("_times")).alias("s"))
    ids = holding(v.select(*key), "variable_id", words, "_up").join(near, "_up").select("concept_id", *key, (25 * F.col("_times")).alias("s"))
    scored = small.unionByName(ids).groupBy("concept_id", *key).agg(F.sum("s").cast("int").alias("s"))
    scored = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    parts = F.split("variable_id", "_")
    first = F.replace(parts[1], F.lit("E"), F.lit("")).isin("001", "002")
    base = (F.size(parts) == 2) & parts[0].rlike("[0-9]$")
    boost = F.when(base, 10 + F.when(first, 20).otherwise(0) + F.when(first & (parts[0] == "B17001"), 30).otherwise(0)).otherwise(0)
    return top(scored.select("concept_id", "variable_id", (F.col("s") + boost).alias("score")), "concept_id", k, F.col("score").desc(), "variable_id")
