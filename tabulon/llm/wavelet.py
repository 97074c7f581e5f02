"""Ranked lexical search by dual-sorted wavelet trees, exact.

Documents are indexed where they lie: each few megabytes of text are a shard, a row of a table that holds its documents by
ascending id and its postings by term. For a search, the postings of the asked terms of a shard become one sequence of
documents, each term's stretch of it by falling impact, and a wavelet tree over that sequence. Its nodes are ranges of
documents, in order of their ids; in a node each term is a stretch again, still by falling impact, so the first posting of
the stretch is the most that the term can add to any document below. Nodes are opened best first by the sum of these
bounds, for all queries of a shard at once, and a node whose bound can't reach a query's k-th score is closed unopened. A
leaf is a document and its bound is its score.

Shards are answered apart, each with the k-th scores that its task has seen so far, and a window merges their answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, lowered, span_hashes, table, utf8_parts, word_spans

#: Bytes of text in a shard, unless one text is longer.
SHARD_BYTES = 4 << 20
#: Rows of (item, term) in a block of queries, unless one item has more. Every block meets every shard.
BLOCK_TERMS = 1 << 18
#: Nodes of a query that are opened at a time.
AT_ONCE = 48
#: Stands for a document without an id, which comes last.
NO_ID = np.iinfo(np.int64).max

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of rows of UTF-8 bytes, and the number of terms before each row and the end."""
    low = lowered(data)
    starts, ends, before = word_spans(low, offsets, _TERM)
    return span_hashes(low, starts, ends), before


INDEX = "n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<long>, counts array<int>, docs array<int>, tfs array<int>"


def index_shards(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: a row per shard with its documents that have terms (ids ascending, null last; sizes) and its postings.

    terms are the distinct term hashes, ascending; counts the postings of each; docs and tfs the postings, by term and then
    by document, a document being its place in ids. Null texts and texts without terms aren't indexed. Empty in, empty out.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = lambda x, kind: pa.array([x], pa.list_(kind))
        for batch in batches:
            ids = batch.column("__tb_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at, to, data, offsets in utf8_parts(batch.column("__tb_text"), SHARD_BYTES):
                hashes, before = terms_of(data, offsets)
                sizes = np.diff(before)
                order = np.argsort(ids[at:to], kind="stable")
                order = order[sizes[order] > 0]
                if not len(order):
                    continue
                place = np.zeros(to - at, np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                doc = place[np.repeat(np.arange(to - at), sizes)]
                by = np.lexsort((doc, hashes))
                hashes, doc = hashes[by], doc[by]
                first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
                terms, docs_, tfs = hashes[first], doc[first], np.diff(first, append=len(doc))
                heads = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
                own = ids[at:to][order]
                arrays = [pa.array([len(order)], pa.int64()), pa.array([len(doc)], pa.int64()), one(pa.array(own, mask=own == NO_ID), pa.int64()), one(sizes[order], pa.int64()), one(terms[heads].view(np.int64), pa.int64())]
                arrays += [one(np.diff(heads, append=len(terms)).astype(np.int32), pa.int32()), one(docs_, pa.int32()), one(tfs.astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in INDEX.split(", ")])

    return docs.select(F.col(id_).cast("long").alias("__tb_id"), F.col(text).alias("__tb_text")).mapInArrow(run, INDEX)


def stored_index(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """index_shards as a table. A task makes and reads it shard by shard, however many of them its file holds.

    Texts come in batches of one shard, with an eighth left for the last text of a batch.
    """
    return Scratch(docs.sparkSession).cut("index", index_shards(docs, id_, text), SHARD_BYTES * 7 // 8, group_rows=1)


def item_terms(items: DataFrame, id_: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item. Rows of one item_id, or of none, are one item."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in utf8_parts(batch.column("__tb_text")):
                hashes, before = terms_of(data, offsets)
                rows = np.repeat(np.arange(at, to), np.diff(before))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(hashes.view(np.int64))], ["item_id", "term"])

    own = items.select(F.col(id_).alias("item_id"), F.col(text).alias("__tb_text"))
    return own.mapInArrow(run, f"item_id {dict(own.dtypes)['item_id']}, term long").distinct()


class Tree:
    """The wavelet tree of a shard's asked postings. Level l holds, at l * (n + 1) + place, the postings before that place
    whose document has a 0 at bit l, and at l * n + place the impact; the last level is in order of the documents."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.n, self.levels = len(docs), max(1, int(n_docs - 1).bit_length())
        self.zeros_before = np.zeros((self.levels, self.n + 1), np.int32)
        self.impacts = np.empty((self.levels + 1, self.n), np.int64)
        self.zeros = np.empty(self.levels, np.int64)
        for level in range(self.levels):
            self.impacts[level] = impacts
            zero = (docs >> (self.levels - 1 - level)) & 1 == 0
            np.cumsum(zero, out=self.zeros_before[level, 1:])
            self.zeros[level] = self.zeros_before[level, -1]
            docs, impacts = np.concatenate([docs[zero], docs[~zero]]), np.concatenate([impacts[zero], impacts[~zero]])
        self.impacts[self.levels] = impacts
        self.zeros_before, self.impacts = self.zeros_before.ravel(), self.impacts.ravel()

    def bounds(self, level: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The impact of the first posting of stretches."""
        return self.impacts[level * self.n + start]

    def below(self, level: np.ndarray, start: np.ndarray, end: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of a child node."""
        at = level * (self.n + 1)
        a, b = self.zeros_before[at + start], self.zeros_before[at + end]
        return (a, b) if bit == 0 else (self.zeros[level] + start - a, self.zeros[level] + end - b)


class Nodes:
    """Open nodes: query, level, first document, bound, and their stretches (weight, start, end), one after the other."""

    def __init__(self, query, level, low, bound, length, weight, start, end):
        self.query, self.level, self.low, self.bound, self.length, self.weight, self.start, self.end = query, level, low, bound, length, weight, start, end

    def take(self, mask: np.ndarray) -> Nodes:
        wide = np.repeat(mask, self.length)
        return Nodes(self.query[mask], self.level[mask], self.low[mask], self.bound[mask], self.length[mask], self.weight[wide], self.start[wide], self.end[wide])

    def __add__(self, other: Nodes) -> Nodes:
        return Nodes(*[np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("query", "level", "low", "bound", "length", "weight", "start", "end")])


class Best:
    """Each query's k best (score, id) so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full(queries, 0, np.int64), np.full(queries, np.iinfo(np.int64).min)
        self.rows = (np.zeros(0, np.int64),) * 3

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        query, score, id_ = (np.concatenate([a, b]) for a, b in zip(self.rows, (query, score, id_), strict=True))
        order = np.lexsort((id_, -score, query))
        query, score, id_ = query[order], score[order], id_[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        kept, last = place < self.k, place == self.k - 1
        self.score[query[last]], self.id[query[last]] = score[last], id_[last]
        self.rows = query[kept], score[kept], id_[kept]

    def open(self, query: np.ndarray, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        """Whether documents with scores up to bound and ids from first_id on can be among the k best."""
        return (bound > self.score[query]) | ((bound == self.score[query]) & (first_id < self.id[query]))


def search_shard(shard: dict[str, np.ndarray], asked: tuple[np.ndarray, np.ndarray, np.ndarray], n_docs: int, n_terms: int, best: Best) -> int:
    """Adds the shard's documents that can be among the best. asked: (query, term, weight) by query. The nodes opened."""
    query, term, weight = asked
    ids, terms = shard["ids"], shard["terms"].view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(shard["counts"], dtype=np.int64)])
    wanted = np.unique(term.view(np.uint64))
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    here = terms[at] == wanted
    wanted, at = wanted[here], at[here]
    if not len(at):
        return 0
    sizes = ends[at + 1] - ends[at]
    lists = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(ends[at] - lists[:-1], sizes) + np.arange(lists[-1])
    docs, tfs = shard["docs"][rows], shard["tfs"][rows].astype(np.int64)
    length = 100 - 50 + (50 * shard["sizes"] * n_docs) // n_terms
    impacts = (1_000_000_000 * tfs) // (1000 * tfs + 20 * length[docs])
    order = np.lexsort((-impacts, np.repeat(np.arange(len(at)), sizes)))
    tree = Tree(docs[order], impacts[order], len(ids))
    slot = np.minimum(np.searchsorted(wanted, term.view(np.uint64)), len(wanted) - 1)
    there = (wanted[slot] == term.view(np.uint64)) & (weight > 0)
    query, weight, slot = query[there], weight[there], slot[there]
    if not len(query):
        return 0
    heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    start, end = lists[slot], lists[slot + 1]
    bound = np.add.reduceat(weight * tree.bounds(np.zeros(len(start), np.int64), start), heads)
    zero = np.zeros(len(heads), np.int64)
    nodes, opened = Nodes(query[heads], zero, zero, bound, np.diff(heads, append=len(query)), weight, start, end), 0
    while len(nodes.query):
        nodes = nodes.take(best.open(nodes.query, nodes.bound, ids[nodes.low]))
        if not len(nodes.query):
            break
        by = np.lexsort((-nodes.bound, nodes.query))
        ranked = nodes.query[by]
        now = np.zeros(len(by), bool)
        now[by] = np.arange(len(by)) - np.searchsorted(ranked, ranked, "left") < AT_ONCE
        top, nodes = nodes.take(now), nodes.take(~now)
        opened += len(top.query)
        level = np.repeat(top.level, top.length)
        owner = np.repeat(np.arange(len(top.query)), top.length)
        for bit in (0, 1):
            start, end = tree.below(level, top.start, top.end, bit)
            full = end > start
            if not full.any():
                continue
            start, end, weight, own = start[full], end[full], top.weight[full], owner[full]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            bound = np.add.reduceat(weight * tree.bounds(level[full] + 1, start), heads)
            own = own[heads]
            low = top.low[own] + (bit << (tree.levels - 1 - top.level[own]))
            child = Nodes(top.query[own], top.level[own] + 1, low, bound, np.diff(heads, append=len(start)), weight, start, end)
            leaf = child.level == tree.levels
            near = leaf & best.open(child.query, child.bound, ids[child.low])
            if near.any():
                best.add(child.query[near], child.bound[near], ids[child.low[near]])
            nodes = nodes + child.take(~leaf & best.open(child.query, child.bound, ids[child.low]))
    return opened


def _answers(index: DataFrame, asked: list, n_docs: int, n_terms: int, k: int, kind: str) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of each item. asked: rows (item_id, term, w)."""
    items = sorted({r.item_id for r in asked}, key=lambda x: (x is None, x))
    number = {x: i for i, x in enumerate(items)}
    rows = sorted((number[r.item_id], r.term, r.w) for r in asked)
    columns = tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = Best(len(items), k)
        for batch in batches:
            for i in range(batch.num_rows if len(columns[0]) else 0):
                shard = {c: batch.column(c)[i].values for c in ("ids", "sizes", "terms", "counts", "docs", "tfs")}
                shard = {c: (v.fill_null(NO_ID) if c == "ids" else v).to_numpy(zero_copy_only=False) for c, v in shard.items()}
                search_shard(shard, columns, n_docs, n_terms, best)
        query, score, id_ = best.rows
        yield pa.RecordBatch.from_arrays([pa.array([items[q] for q in query.tolist()], batch_kind), pa.array(id_, mask=id_ == NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])

    import pyarrow as pa

    batch_kind = pa.string() if kind == "string" else pa.int64()
    return index.mapInArrow(run, f"item_id {'string' if kind == 'string' else 'long'}, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents of an index (see stored_index).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case, told apart by
    64-bit hashes. Of N documents with terms and L terms, a term in df documents weighs w = floor(1000 ln((2N+2)/(2df+1))), a
    document of n terms has m = 50 + 50 n N div L, and scores the sum of w (10^9 tf div (1000 tf + 20 m)) over the item's
    distinct terms. Scores of 0 are left out; ties go to the smaller id, a missing one last. Rows of one item_id, or of none,
    are one item; items without terms have no rows. Repeated documents are documents of their own. Empty in, empty out.
    Items are dealt into blocks of about BLOCK_TERMS terms, and each block meets every shard.
    """
    spark, work = index.sparkSession, Scratch(index.sparkSession)
    kind = dict(items.dtypes)["item_id"]
    own = work.cut("terms", item_terms(items))
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total.n or 0, total.l or 1
    n_rows = own.count()
    distinct = own.select("term").distinct()
    near = F.broadcast(distinct) if n_rows <= BROADCAST_ROWS and 16 * n_rows <= BROADCAST_BYTES else distinct
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    df = df.join(near, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    blocks = max(1, -(-n_rows // BLOCK_TERMS))
    weighed = work.cut("weighed", own.join(df, "term").select("item_id", "term", weight.alias("w"), F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")))
    found = None
    for block in range(blocks):
        asked = weighed.filter((F.col("block") == block) & (F.col("w") > 0)).select("item_id", "term", "w").collect()  # about BLOCK_TERMS rows
        part = _answers(index, asked, n_docs, n_terms, k, kind)
        found = part if found is None else found.union(part)
    best = W.Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return work.cut("ranked", ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"), SHARD_BYTES)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(stored_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH tokens AS (
  SELECT row_, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS row_ FROM documents)),
tf AS (SELECT row_, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM tokens GROUP BY row_, term),
size_ AS (SELECT row_, count(*) AS n FROM tokens GROUP BY row_),
all_ AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size_),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM asked JOIN df USING (term), all_),
scored AS (
  SELECT item_id, row_, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (term) JOIN size_ USING (row_), all_ GROUP BY item_id, row_)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
