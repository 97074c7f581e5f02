"""A stored full-text index: segments of posting blocks with bounds, appended and merged under versions, and searches that skip blocks.

Documents are dealt into slices by length and then by a hash of their id. A block holds a token's postings in one slice: ids,
frequencies and lengths, never more than a slice has documents, with the largest frequency and the least length. From these
alone a slice's best possible score for a query is known. A search scores each query's most promising slices first, then
only those that can still reach its k-th score.

Texts move once, to their slice, whose task makes its blocks; a search brings the asked blocks of a slice together and
meets them with all queries at once, by products of small matrices (see kernels).

On disk, `postings/segment=S` holds the blocks in folders by a hash of the token, sorted by it; `lengths/S` the
documents, `slices/S` their slices; `manifest/version=N` what a version consists of. Segments are never changed: an append writes a new one, a merge
writes one in place of all, and both become visible with the version's manifest, which is written last. A job that is lost
before that leaves files that no version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.functions.text import tokens
from tabulon.operators import kernels
from tabulon.operators.lexical import B, K1, LEAST_IDF, SMALL_TOKENS, top

#: Documents in a slice (about), classes of length, folders of tokens.
SLICE_DOCS, LENGTH_CLASSES, BUCKETS = 1_024, 8, 16
#: Slices of each query that are scored before the others are judged.
FIRST_SLICES = 2
#: Up to so many asked tokens are part of the scan's filter, so that other folders aren't read.
LISTED_TOKENS = 200
#: Queries that meet a slice together (about), and the most (query, token) rows that are broadcast.
QUERY_BLOCK, SMALL_ASKED = 512, 1_000_000
#: Scores are rounded to six places, bounds aren't.
SLACK = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """A version of an index at a path. buckets is fixed when the index is made."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[str, ...]
    n_docs: int
    n_tokens: int
    buckets: int

    def blocks(self) -> DataFrame:
        """(token, slice, n, max_tf, min_dl, ids, tfs, dls, bucket, segment) of all segments."""
        base = f"{self.path}/postings"
        return self.spark.read.schema(f"{BLOCK}, segment string").option("basePath", base).parquet(*[f"{base}/segment={s}" for s in self.segments])

    def lengths(self) -> DataFrame:
        """(id, dl) of all documents that have tokens."""
        return self.spark.read.schema("id long, dl long").parquet(*[f"{self.path}/lengths/{s}" for s in self.segments])

    def slices(self) -> DataFrame:
        """(id, dl, slice) of the same."""
        return self.spark.read.schema("id long, dl long, slice long").parquet(*[f"{self.path}/slices/{s}" for s in self.segments])


MADE = "token string, slice long, n int, max_tf int, min_dl long, ids array<long>, tfs array<int>, dls array<long>"
BLOCK = f"{MADE}, bucket int"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _publish(spark: SparkSession, path: str, version: int, segments: tuple[str, ...], buckets: int) -> TextIndex:
    seen = TextIndex(spark, path, version, segments, 0, 0, buckets)
    sums = seen.lengths().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    row = {"segments": list(segments), "n_docs": sums.n, "n_tokens": sums.t, "buckets": buckets}
    spark.range(1).select(F.lit(json.dumps(row)).alias("value")).coalesce(1).write.text(f"{path}/manifest/version={version}")
    return TextIndex(spark, path, version, segments, sums.n, sums.t, buckets)


def _by_folder(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks with their bucket: small folders share a task and large ones are split over several, by their measured size."""
    return blocks.withColumn("bucket", bucket_of(F.col("token"), buckets)).hint("rebalance", "bucket")


def _write_blocks(rows: DataFrame, where: str) -> None:
    rows.sortWithinPartitions("bucket", "token", "slice").write.partitionBy("bucket").parquet(where)


def _slice_of(sums, number: int, parts: int, dl: Column, key: Column) -> Column:
    """The slice of documents of length dl: by classes of length, then by a hash of key; numbers that no other segment has."""
    by_length = F.size(F.filter(F.lit(sums.cuts or []).cast("array<double>"), lambda c: c < dl))
    return F.lit(number << 32) + by_length * F.lit(parts) + F.pmod(F.xxhash64(key), F.lit(parts))


def _shares(dl: str) -> Column:
    return F.percentile_approx(dl, F.lit([i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)])).alias("cuts")


def _few(rows: DataFrame) -> DataFrame:
    """rows, as a broadcast if they were measured to be few."""
    return F.broadcast(rows) if rows.limit(SMALL_TOKENS + 1).count() <= SMALL_TOKENS else rows


def _add_segment(docs: DataFrame, id_: str, text: Column, path: str, number: int, buckets: int) -> str:
    name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    spark = docs.sparkSession
    words = docs.filter(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), tokens(text).alias("w")).filter(F.size("w") > 0)
    words.groupBy("id").agg(F.sum(F.size("w")).alias("dl"), F.count("*").alias("rows")).write.parquet(f"{path}/lengths/{name}")
    lengths = spark.read.parquet(f"{path}/lengths/{name}")
    sums = lengths.agg(F.count("*").alias("n"), _shares("dl")).first()
    parts = max(1, -(-sums.n // (SLICE_DOCS * LENGTH_CLASSES)))
    slice_ = _slice_of(sums, number, parts, F.col("dl"), F.col("id"))
    lengths.select("id", "dl", slice_.alias("slice")).write.parquet(f"{path}/slices/{name}")
    # A row's own length is its document's, but for ids of several rows.
    several = lengths.filter("rows > 1").select("id", F.col("dl").alias("_whole"))
    own = words.select("id", F.array_join("w", " ").alias("words"), F.size("w").cast("long").alias("_own")).join(_few(several), "id", "left")
    rows = own.select("id", F.coalesce("_whole", "_own").alias("dl"), "words").withColumn("slice", slice_).select("slice", "id", "dl", "words")
    blocks = rows.repartition("slice").sortWithinPartitions("slice").mapInArrow(kernels.slice_blocks, MADE)
    _write_blocks(_by_folder(blocks, buckets), f"{path}/postings/segment={name}")
    return name


def build_index(docs: DataFrame, id_: str, text: Column, path: str, buckets: int = BUCKETS) -> TextIndex:
    """Version 1 of a new index at path, over the tokens of every text.

    Rows of one id are one document; rows without id or tokens aren't indexed. Other columns are ignored. path is a folder
    that driver and executors share; it mustn't hold an index.
    """
    name = _add_segment(docs, id_, text, path, 1, buckets)
    return _publish(docs.sparkSession, path, 1, (name,), buckets)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> TextIndex:
    """The newest version of an index, or one of its earlier ones."""
    rows = spark.read.text(f"{path}/manifest")
    row = (rows if version is None else rows.filter(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if row is None:
        raise ValueError(f"no version {version} at {path}")
    kept = json.loads(row["value"])
    return TextIndex(spark, path, int(row["version"]), tuple(kept["segments"]), kept["n_docs"], kept["n_tokens"], kept["buckets"])


def append_index(index: TextIndex, docs: DataFrame, id_: str, text: Column) -> TextIndex:
    """The next version, with the documents whose ids aren't in the index yet; a document that is there stays as it is."""
    fresh = docs.join(index.lengths().select(F.col("id").alias(id_)), id_, "left_anti")
    name = _add_segment(fresh, id_, text, index.path, index.version + 1, index.buckets)
    return _publish(index.spark, index.path, index.version + 1, (*index.segments, name), index.buckets)


def merge_index(index: TextIndex) -> TextIndex:
    """The next version, with one segment in place of all. Texts aren't read again; older versions can still be read.

    Slices that are at least half full stay as they are; smaller ones are dealt into new ones as wholes, by their mean length
    and a hash of their number, and only their blocks are joined.
    """
    number = index.version + 1
    name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    index.lengths().write.parquet(f"{index.path}/lengths/{name}")
    sizes = index.slices().groupBy("slice").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    small = F.col("n") < SLICE_DOCS / 2
    sums = sizes.filter(small).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), _shares("mean")).first()
    parts = max(1, -(-sums.n // (SLICE_DOCS * LENGTH_CLASSES)))
    new = sizes.select("slice", small.alias("_small"), F.when(small, _slice_of(sums, number, parts, F.col("mean"), F.col("slice"))).otherwise(F.col("slice")).alias("_new"))
    new = _few(new)
    index.slices().join(new, "slice").select("id", "dl", F.col("_new").alias("slice")).write.parquet(f"{index.path}/slices/{name}")
    names = ["token", "slice", "n", "max_tf", "min_dl", "ids", "tfs", "dls"]
    old = index.blocks().join(new, "slice")
    stay = old.filter("NOT _small").select(*names, "bucket")  # they are read by folder, so they needn't move
    lists = F.collect_list(F.struct("ids", "tfs", "dls")).alias("x")
    joined = old.filter("_small").groupBy("token", F.col("_new").alias("slice")).agg(F.sum("n").cast("int").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"), lists)
    joined = joined.select("token", "slice", "n", "max_tf", "min_dl", *[F.flatten(F.col("x")[c]).alias(c) for c in ("ids", "tfs", "dls")])
    _write_blocks(stay.unionByName(_by_folder(joined, index.buckets)), f"{index.path}/postings/segment={name}")
    return _publish(index.spark, index.path, number, (name,), index.buckets)


def postings(index: TextIndex, asked: DataFrame | None = None) -> DataFrame:
    """(token, id, tf, dl) of the index, or of the asked tokens (token) alone."""
    rows = index.blocks() if asked is None else _asked_blocks(index, asked)
    return rows.select("token", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("token", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))


def token_stats(index: TextIndex) -> DataFrame:
    """(token, df, tf) of every token; only df is known without reading blocks' lists."""
    tf = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    return index.blocks().groupBy("token").agg(F.sum("n").alias("df"), F.sum(tf).alias("tf"))


def index_stats(index: TextIndex) -> DataFrame:
    """One row: documents, tokens, distinct tokens, postings and segments of an index's version; lists aren't read."""
    sums = index.blocks().agg(F.count_distinct("token").alias("distinct_tokens"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("postings"))
    return sums.select(F.lit(index.n_docs).cast("long").alias("documents"), F.lit(index.n_tokens).cast("long").alias("tokens"), "distinct_tokens", "postings", F.lit(len(index.segments)).alias("segments"))


def _asked_blocks(index: TextIndex, asked: DataFrame) -> DataFrame:
    """The blocks of the asked tokens. Few tokens filter the scan; more are broadcast up to SMALL_TOKENS, else shuffled."""
    asked = asked.select("token").distinct()
    n = asked.limit(SMALL_TOKENS + 1).count()
    blocks = index.blocks()
    if n <= LISTED_TOKENS:
        rows = asked.select("token", bucket_of(F.col("token"), index.buckets).alias("bucket")).collect()
        return blocks.filter(F.col("bucket").isin(sorted({r.bucket for r in rows})) & F.col("token").isin([r.token for r in rows]))
    return blocks.join(F.broadcast(asked) if n <= SMALL_TOKENS else asked, "token", "left_semi")


def _tf_part(tf: Column, dl: Column, mean: float) -> Column:
    """BM25's share of a token: rises with tf, falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def _numbered(asked: DataFrame) -> DataFrame:
    """query_id with its block and its place in the block, for asked rows (query_id): blocks of about QUERY_BLOCK queries."""
    queries = asked.select("query_id").distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    return dealt.withColumn("_place", F.row_number().over(W.Window.partitionBy("_block").orderBy("query_id")) - 1)


def _met(blocks: DataFrame, asked: DataFrame, numbered: DataFrame, more: DataFrame | None, kernel, schema: str) -> DataFrame:
    """What the kernel makes of each slice and block of queries, with query_id for its place.

    asked (query_id, token, needed, weight). The asked blocks of a slice come together with, for each, the places of the
    queries that ask for its token. more (_block, slice, ids, weights): other rows for the slices, without places.
    """
    each = F.collect_list(F.struct("_place", "needed", "weight"))
    lists = asked.join(numbered, "query_id").groupBy("_block", "token").agg(each.alias("x"))
    lists = lists.select("_block", "token", *[F.col("x")[c].alias(n) for c, n in (("_place", "places"), ("needed", "needed"), ("weight", "weights"))])
    few = asked.limit(SMALL_ASKED + 1).count() <= SMALL_ASKED
    rows = blocks.select("token", "slice", "ids", "tfs", "dls").join(F.broadcast(lists) if few else lists, "token")
    rows = rows.select("_block", "slice", "ids", "tfs", "dls", "places", "needed", "weights")
    if more is not None:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.repartition("_block", "slice").sortWithinPartitions("_block", "slice")
    return rows.mapInArrow(kernel, schema)


def _named(met: DataFrame, numbered: DataFrame) -> DataFrame:
    return met.join(_few(numbered), ["_block", "_place"]).drop("_block", "_place")


def _searched(units: DataFrame, asked: DataFrame, k: int, scored, bound_first: Column) -> tuple[DataFrame, DataFrame]:
    """(best rows, units that were scored). units (query_id, slice, bound); scored(units) gives (query_id, id, score).

    A slice whose bound is below a query's k-th score among the first slices can't change its k best, as ties need that score.
    """
    order = W.Window.partitionBy("query_id").orderBy(bound_first, "slice")
    placed = units.withColumn("_place", F.row_number().over(order))
    first = placed.filter(F.col("_place") <= FIRST_SLICES)
    early = top(scored(first), "query_id", k, F.col("score").desc(), "id")
    floor = early.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    late = placed.filter(F.col("_place") > FIRST_SLICES).join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") + SLACK >= F.col("floor")))
    late = late.select("query_id", "slice", "bound")
    both = early.select("query_id", "id", "score").unionByName(scored(late))
    return top(both, "query_id", k, F.col("score").desc(), "id"), first.select("query_id", "slice", "bound").unionByName(late)


def bm25_indexed(index: TextIndex, queries: DataFrame, k: int = 1, counted: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k best documents that have all of a query's tokens, by BM25; ties go to the smaller id.

    queries (query_id, words); repeated words count once, a query without words or with an unknown word has no answers.
    counted: instead the slices of each query: query_id, slices that hold all its words, and those that were scored.
    """
    mean = index.n_tokens / max(1, index.n_docs)
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("token"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    blocks = _asked_blocks(index, asked)
    heads = blocks.select("token", "slice", "n", "max_tf", "min_dl")  # no lists are read for these
    df = heads.groupBy("token").agg(F.sum("n").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    known = asked.join(df.select("token", idf.alias("idf")), "token")
    bound = F.sum(F.col("idf") * _tf_part(F.col("max_tf"), F.col("min_dl"), mean))
    units = known.join(heads, "token").groupBy("query_id", "slice").agg(bound.alias("bound"), F.count("*").alias("met")).join(needed, "query_id").filter("met = needed").select("query_id", "slice", "bound")

    numbered = _numbered(known)
    weighed = known.join(needed, "query_id").select("query_id", "token", F.col("needed").cast("int").alias("needed"), F.col("idf").alias("weight"))

    def scored(some: DataFrame) -> DataFrame:
        # The wanted queries of a slice go with its blocks; slices that no query wants don't move.
        wanted = some.select("query_id", "slice").join(numbered, "query_id").groupBy("_block", "slice").agg(F.collect_list(F.col("_place").cast("long")).alias("ids"))
        near = blocks.join(some.select("slice").distinct(), "slice", "left_semi")
        met = _met(near, weighed, numbered, wanted, kernels.all_met(mean, K1, B), "_block int, _place int, id long, score double")
        return _named(met, numbered).select("query_id", "id", F.round("score", 6).alias("score"))

    best, used = _searched(units, known, k, scored, F.col("bound").desc())
    if counted:
        return units.groupBy("query_id").agg(F.count("*").alias("slices")).join(used.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id")
    return best


def overlap_indexed(index: TextIndex, queries: DataFrame, k: int = 10, weights: DataFrame | None = None) -> DataFrame:
    """query_id, id, matches, score, confidence, rank by token overlap; repeated query words count again.

    weights (id, weight): only ids of weight over 0.3, scores times 1 + weight; an id of several weights is ranked for each.
    A slice gives its k best documents of each query.
    """
    sized = queries.select("query_id", F.size("words").alias("n"), F.explode("words").alias("token"))
    asked = sized.groupBy("query_id", "token").agg(F.count("*").cast("double").alias("weight")).withColumn("needed", F.lit(0))
    numbered = _numbered(asked)
    more = None
    if weights is not None:
        # Of equal rows no more than k can be among the k best.
        own = weights.toDF("id", "weight").filter("weight > 0.3").groupBy("id", "weight").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_copies"))
        own = own.join(index.slices(), "id").groupBy("slice").agg(F.collect_list(F.struct("id", F.col("weight").cast("double").alias("weight"), "_copies")).alias("x"))
        own = own.select("slice", F.col("x.id").alias("ids"), F.col("x.weight").alias("weights"), F.col("x._copies").alias("tfs"))
        more = own.join(F.broadcast(numbered.select("_block").distinct()))
    met = _met(_asked_blocks(index, asked), asked, numbered, more, kernels.best_overlaps(k, weights is not None), "_block int, _place int, id long, matches long, score double")
    best = top(_named(met, numbered), "query_id", k, F.col("score").desc(), "id")
    out = best.join(sized.select("query_id", "n").distinct(), "query_id")
    return out.select("query_id", "id", "matches", "score", F.least(F.col("score") / F.col("n"), F.lit(1.0)).alias("confidence"), "rank")


def phrase_search(index: TextIndex, docs: DataFrame, id_: str, text: Column, phrases: DataFrame) -> DataFrame:
    """query_id, id: documents that hold all words of a phrase next to each other, in order.

    phrases (query_id, words). The index gives the documents that hold all the words; only their texts are read again.
    A phrase without words has no answers. Repeated phrases of one query are asked as one.
    """
    asked = phrases.filter(F.size("words") > 0).select("query_id", "words").dropDuplicates(["query_id", "words"]).withColumn("_p", F.array_join("words", " "))
    each = asked.select("query_id", "_p", F.explode(F.array_distinct("words")).alias("token"))
    needed = each.groupBy("query_id", "_p").agg(F.count("*").alias("needed"))
    asked_of = each.join(needed, ["query_id", "_p"]).select(F.struct("query_id", "_p").alias("query_id"), "token", F.col("needed").cast("int").alias("needed"), F.lit(1.0).alias("weight"))
    numbered = _numbered(asked_of)
    near = _met(_asked_blocks(index, each), asked_of, numbered, None, kernels.all_met(None, K1, B), "_block int, _place int, id long, score double")
    # Texts meet the places of their phrases in one row for each block of queries.
    own = near.groupBy("id", "_block").agg(F.collect_list("_place").alias("_places"))
    lines = docs.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), text.alias("_text"))
    met = lines.join(own, "id").select("id", "_block", "_places", F.concat(F.lit(" "), F.array_join(tokens(F.col("_text")), " "), F.lit(" ")).alias("_t"))
    sought = numbered.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_place", F.concat(F.lit(" "), F.col("query_id._p"), F.lit(" "))))).alias("_of"))
    met = met.join(_few(sought), "_block").select("id", "_block", F.explode(F.filter("_places", lambda i: F.contains(F.col("_t"), F.try_element_at("_of", i)))).alias("_place"))
    return _named(met, numbered).select("query_id.query_id", "id").distinct()


_OPEN: dict[tuple[str, str, str], TextIndex] = {}


def index_of(docs: DataFrame, id_: str, text: str, folder) -> TextIndex:
    """The index of a table's texts, built when a session first asks for it and again when the table's files have changed.

    folder() names a new folder that driver and executors share.
    """
    spark = docs.sparkSession
    files = docs.select(F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").cast("string").alias("f")).distinct()
    mark = files.agg(F.md5(F.array_join(F.array_sort(F.collect_list("f")), "|"))).first()[0]
    key = (spark.sparkContext.applicationId, f"{id_}/{text}", mark)
    if key not in _OPEN:
        _OPEN[key] = build_index(docs, id_, F.col(text), folder())
    return _OPEN[key]
