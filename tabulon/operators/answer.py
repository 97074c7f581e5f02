"""One answer path: phrases to codes, places to names, estimates with their margins, comparisons and document search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import tokens
from tabulon.operators import geo, lexical, retrieval, textindex
from tabulon.operators.nearest import nearest_vectors

NO_DATA = "no data found"


def with_mapping(mappings: DataFrame, key: str, code: str) -> DataFrame:
    """The phrases (key, code, ordinal) with one more, which comes before all others of its key."""
    first = mappings.agg((F.coalesce(F.min("ordinal"), F.lit(0)) - 1).alias("ordinal")).select(F.lit(key.lower().strip()).alias("key"), F.lit(code).alias("code"), "ordinal")
    return mappings.select("key", "code", "ordinal").unionByName(first)


def direct_or_keyword(queries: DataFrame, phrases: DataFrame, catalog: DataFrame, index: textindex.TextIndex, id_: str, k: int = 10) -> DataFrame:
    """query_id, id, confidence, match_type, rank of queries (query_id, q).

    A query that is a phrase (phrase, id) of a catalog row is that row, with confidence 1; every other one is a search by
    token overlap in the stored index of the catalog's texts. A phrase whose row isn't in the catalog counts as none.
    """
    asked = queries.withColumn("phrase", F.lower(F.trim("q")))
    direct = asked.join(phrases, "phrase").join(catalog.select(id_).distinct(), id_, "left_semi")
    direct = direct.groupBy("query_id").agg(F.min(id_).alias(id_)).select("query_id", id_, F.lit(1.0).alias("confidence"), F.lit("direct").alias("match_type"), F.lit(1).alias("rank"))
    others = asked.join(direct, "query_id", "left_anti").select("query_id", tokens(F.col("q")).alias("words"))
    found = textindex.overlap_indexed(index, others, k)
    return direct.unionByName(found.select("query_id", F.col("id").alias(id_), "confidence", F.lit("keyword").alias("match_type"), "rank"))


def resolve_texts(texts: DataFrame, labels: DataFrame, core: DataFrame, keywords: DataFrame, code_pattern: str) -> DataFrame:
    """q, code, stage of every distinct q of texts: the resolver with all its stages.

    labels (code, label, ordinal) is the catalog, one row for each label: whole labels are its aliases, and its words
    feed the text stage. core and keywords are small dimensions (key, code, ordinal).
    """
    asked = texts.select("q").distinct().withColumn("query_id", F.col("q"))
    words = asked.select("query_id", tokens(F.col("q")).alias("words"))
    met = lexical.postings(labels, "ordinal", F.col("label"), words)
    best = lexical.bm25(words, met, "ordinal", 1, lexical.lengths(labels, "ordinal", F.col("label")))
    text = best.join(labels.select("ordinal", "code"), "ordinal").select("query_id", "code")
    index = labels.select(F.lower("label").alias("alias"), "code", "ordinal")
    return lexical.resolve(asked, core, index, text, code_pattern, core, keywords).withColumnRenamed("query_id", "q")


def answer(requests: DataFrame, codes: DataFrame, estimates: DataFrame) -> DataFrame:
    """requests (request_id, location, variable) with code, geography, name, estimate, moe, moe_pct, shown, error, confidence and candidates.

    codes (variable, code) has one row a variable; estimates (level, name, code, estimate, moe). The nation takes the row of
    level us, a state that of level state, a county the county of its state, and a place the first name that matches by the
    best rule within its state, if the location names one (`Springfield, MO` never takes a row of Illinois). confidence tells
    how sure the location's reading is, candidates how many names match a place by its best rule. What has no row gets an
    error text; null locations and variables have none. Of several rows of one name and code the least counts.
    """
    asked = geo.parse_location(requests.join(codes, "variable", "left"))
    text = lambda *parts: F.concat_ws(":", *parts)
    spot = F.when(F.col("geography") == "us", "us").when(F.col("geography") == "state", text(F.lit("state"), "state"))
    spot = spot.when(F.col("geography") == "county", text(F.lit("county"), "state", F.lower("county"))).otherwise(text(F.lit("place"), F.coalesce("state", F.lit("-")), "place"))
    value = F.struct("name", "estimate", "moe")
    first = lambda rows, by: rows.groupBy("_spot", "code").agg(F.min_by(value, by).alias("found"), F.count_distinct("name").alias("candidates"))
    by_level = lambda level, key: first(estimates.filter(F.col("level") == level).withColumn("_spot", key), value)
    county = F.lower(F.regexp_replace(F.substring_index("name", ",", 1), " [Cc]ounty$", ""))
    whole = [by_level("us", F.lit("us")), by_level("state", text(F.lit("state"), geo.state_code(F.col("name")))), by_level("county", text(F.lit("county"), geo.name_state(F.col("name")), county))]
    local = estimates.filter("level = 'place'")
    places = asked.filter("geography = 'place' AND place IS NOT NULL").select("place", "state").distinct()
    names = geo.match_places(places, local.select("name").distinct(), state="state")
    known = first(names.join(local, "name").withColumn("_spot", text(F.lit("place"), F.coalesce("state", F.lit("-")), "place")), F.struct("rule", value))
    for part in whole:
        known = known.unionByName(part)
    out = asked.withColumn("_spot", spot).join(known, ["_spot", "code"], "left")
    out = out.select("request_id", "location", "variable", "code", "geography", "found.*", geo.location_confidence(F.col("location")).alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    e, m = F.col("estimate"), F.col("moe")
    return out.withColumns({"moe_pct": F.when(e.isNotNull() & m.isNotNull(), retrieval.stats.moe_percent(e, m)), "shown": retrieval.rendered(e, m), "error": F.when(e.isNull(), NO_DATA)})


def compare(locations: DataFrame, codes: list[str], estimates: DataFrame, location: str = "name") -> DataFrame:
    """A row for every location and code: estimate, moe, cv_pct, reliability and the text of its cell, `N/A` without data."""
    cells = locations.select(location).distinct().withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    rows = cells.join(estimates.select(location, "code", "estimate", "moe"), [location, "code"], "left")
    return retrieval.compared(rows).withColumn("cell", F.coalesce(retrieval.rendered(F.col("estimate"), F.col("moe")), F.lit("N/A")))


def search_columns(queries: DataFrame, docs: DataFrame, id_: str, columns: list[str], k: int = 1) -> DataFrame:
    """query_id, id, score, rank: BM25 over several columns of rows that have all of a query's terms.

    queries (query_id, token, field) holds a term a row; a field limits a term to that column, null means any. A term's
    frequency is summed over its columns, a row's length over all. Terms are kept before rows move.
    """
    words = lambda c: F.transform(tokens(F.col(c).cast("string")), lambda t: F.struct(F.lit(c).alias("field"), t.alias("token")))
    all_words = docs.select(id_, F.flatten(F.array(*map(words, columns))).alias("w"))
    sizes = all_words.groupBy(id_).agg(F.sum(F.size("w")).alias("dl")).filter("dl > 0")
    whole = sizes.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", "token", F.coalesce("field", F.lit("")).alias("want")).distinct()
    terms = asked.select("token", "want").distinct()
    small = terms.limit(lexical.SMALL_TOKENS + 1).count() <= lexical.SMALL_TOKENS
    rows = all_words.select(id_, F.explode("w").alias("w")).select(id_, "w.*")
    met = rows.join(F.broadcast(terms) if small else terms, "token").filter("want = '' OR want = field").groupBy("token", "want", id_).agg(F.count("*").alias("tf"))
    df = met.groupBy("token", "want").agg(F.count("*").alias("df"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    hits = asked.join(met, ["token", "want"]).join(df, ["token", "want"]).join(sizes, id_).crossJoin(F.broadcast(whole))
    idf = F.greatest(F.lit(lexical.LEAST_IDF), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (lexical.K1 + 1) / (F.col("tf") + lexical.K1 * (1 - lexical.B + lexical.B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", id_).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("met")).join(needed, "query_id").filter("met = needed")
    return lexical.top(scored.select("query_id", id_, "score"), "query_id", k, F.col("score").desc(), F.col(id_))


def cached_answers(queries: DataFrame, query: str, query_vector: str, cache: DataFrame, id_: str, vector: str, least: float = 0.95, others: bool = False) -> DataFrame:
    """query, id, score: the cached row nearest to each query by cosine, if its score is at least `least`.

    others leaves out the cached row with the query's id. Exact, by pivots (see nearest); vectors without a direction take no part.
    """
    found = nearest_vectors(cache, queries, id_, vector, query, query_vector, 1, "cosine", least, others)
    return found.select(query, id_, "score")
