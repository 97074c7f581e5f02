"""Exact top-k inner products from an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks by a hash. A block is indexed once and every query is brought to it. Its index holds, per
dimension and quantised level, the posting segment of the vectors at that level. A query adds segments by descending quantised impact (its own component
times the segment's best value) and keeps, per vector, an upper bound of the score. It stops only when the bound proves
that few vectors can still be members; those are rescored exactly. Blocks answer apart; a window merges their answers. The few vectors whose components are so
large that sums of products might leave 62 bits stand beside the index: doubles bound their scores, whole numbers of any
size decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.common import table

#: Most vectors in a block; smaller tables have as many blocks as SPREAD, if each has FEW vectors. Levels of a dimension.
BLOCK_ROWS, SPREAD, FEW, LEVELS = 65_536, 24, 8_192, 32
#: Impacts, as shares of the query's largest, at which the proof is tried before all segments are added.
STOPS = (0.35, 0.2)
#: Rounding of the bounds, which are sums of doubles, as a share of the largest impact in each dimension.
SLACK = 1e-12


class Block:
    """The index of one block: whole-number vectors (n x d), and per dimension the rows by descending level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, d = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (vectors - low) // step
        order = np.argsort(level, axis=0, kind="stable").T
        sorted_levels = np.take_along_axis(level, order.T, axis=0)
        self.rows = order.astype(np.int32).ravel()  # of all dimensions, one after the other
        at, dims, lows, highs, ends = [], [], [], [], []
        self.codes = np.empty((d, n), np.uint8)  # the segment of a row in each dimension
        self.starts = [0]
        for j in range(d):
            first = np.flatnonzero(np.diff(sorted_levels[:, j], prepend=-1))
            own = np.take(vectors[:, j], order[j])
            self.codes[j, order[j]] = np.repeat(np.arange(len(first)), np.diff(first, append=n))
            self.starts.append(self.starts[-1] + len(first))
            at.append(j * n + first)
            ends.append(j * n + np.append(first[1:], n))
            dims.append(np.full(len(first), j))
            lows.append(np.minimum.reduceat(own, first))
            highs.append(np.maximum.reduceat(own, first))
        self.at, self.ends, self.dims, self.lows, self.highs = (np.concatenate(x) for x in (at, ends, dims, lows, highs))

    def _members(self, query: np.ndarray, own_id: int, k: int, bound: np.ndarray, more: float) -> np.ndarray:
        """Rows whose bound, with what they can gain, reaches a floor for the k-th score: exact scores of those that look best."""
        some = min(len(bound), 4 * k + 1)
        look = np.argpartition(-bound, some - 1)[:some]
        exact = np.sort((self.vectors[look] @ query)[self.ids[look] != own_id])[::-1]
        return np.flatnonzero(bound + more >= exact[k - 1]) if len(exact) >= k else np.arange(len(bound))

    def top(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of own_id; by score, then smaller id."""
        own = query[self.dims]
        impact = np.where(own >= 0, own * self.highs, own * self.lows).astype(float)
        order = np.argsort(-impact, kind="stable")
        falling = impact[order]
        bound = np.zeros(len(self.ids))
        slack = SLACK * len(query) * float(np.abs(impact).max())
        most, done = float(max(falling[0], 0)), 0
        for stop in STOPS:
            to = int(np.searchsorted(-falling, -stop * most, "left"))
            chosen = order[done:to]
            if len(chosen):
                sizes = self.ends[chosen] - self.at[chosen]
                upto = np.cumsum(sizes)
                rows = self.rows[np.repeat(self.at[chosen] - upto + sizes, sizes) + np.arange(upto[-1])]
                bound += np.bincount(rows, weights=np.repeat(impact[chosen], sizes), minlength=len(bound))
            done = max(done, to)
            # What a row can still gain: the next impact of every dimension.
            rest = np.zeros(len(query))
            rest[self.dims[order[done:]][::-1]] = falling[done:][::-1]  # the first of each dimension is written last
            members = self._members(query, own_id, k, bound, np.maximum(rest, 0).sum() + slack)
            if len(members) <= max(64, len(bound) // 50):
                break
        else:  # the segments that are left, down to the most negative impact: bounds are off by the width of the levels alone
            bound, part = np.zeros(len(self.ids)), np.empty(len(self.ids))
            for j, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
                bound += np.take(impact[a:b], self.codes[j], out=part, mode="clip")
            members = self._members(query, own_id, k, bound, slack)
        members = members[self.ids[members] != own_id]
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members][best], scores[best]


class Wide:
    """Vectors of any whole numbers, asked by bounds in doubles and exact whole numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.doubles = ids, vectors, vectors.astype(float)

    def top(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        others = np.flatnonzero(self.ids != own_id)
        if not len(others):
            return []
        near, own = self.doubles[others], query.astype(float)
        about, off = near @ own, (len(query) + 4) * 2.0**-51 * (np.abs(near) @ np.abs(own))
        kth = np.sort(about - off)[-min(k, len(others))]
        members = others[about + off >= kth]
        scores = (self.vectors[members].astype(object) * query.astype(object)).sum(axis=1).tolist()
        return sorted(zip(scores, self.ids[members].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]


class Shelf:
    """A block: the index over its ordinary vectors, and its wide ones."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.width = vectors.shape[1]
        self.limit = int((2**62 / self.width) ** 0.5)
        wide = (np.abs(vectors.astype(float)) >= self.limit).any(axis=1)
        self.index = Block(ids[~wide], vectors[~wide]) if not wide.all() else None
        self.wide = Wide(ids[wide], vectors[wide])
        self.whole, self.all = None, (ids, vectors)

    def top(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but those of own_id; by score, then smaller id."""
        query = np.pad(query, (0, max(0, self.width - len(query))))[: self.width]
        if (np.abs(query.astype(float)) >= self.limit).any():
            self.whole = self.whole or Wide(*self.all)
            return self.whole.top(query, own_id, k)
        best = []
        if self.index is not None:
            ids, scores = self.index.top(query, own_id, k)
            best = list(zip(scores.tolist(), ids.tolist(), strict=True))
        if len(self.wide.ids):
            best = sorted(best + self.wide.top(query, own_id, k), key=lambda x: (-x[0], x[1]))[:k]
        return best


def whole_vectors(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v) with floor(256 x) of each component; without vectors that are null or hold null or non-finite components.

    Nor do those take part of which a component isn't below 2**63 after scaling, as it is no long.
    """
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * 256 < 2.0**63))
    return vectors.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull()).filter(fine).select(F.col(id_).cast("long").alias("vec_id"), scaled.alias("v"))


def _lists(column) -> list[np.ndarray]:
    ends, flat = np.asarray(column.offsets), np.asarray(column.values)
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _square(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(1, *map(len, rows))), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of whole-number vectors over all other rows.

    Rows with the query's id are its own. Ties go to the smaller id. Null ids take no part; missing trailing components
    count as 0, so an empty vector scores 0. Repeated rows are separate candidates; a repeated query id is asked once, by
    its smallest vector. Other columns are ignored. Empty in, empty out. Scores are exact; one among a query's k best that
    is no long raises an error. Every query meets every block of BLOCK_ROWS rows; rows move once.
    """
    rows = whole_vectors(vectors, id_, vector)
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows = rows.count()
    blocks = max(1, -(-n_rows // BLOCK_ROWS), min(SPREAD, n_rows // FEW))
    # A hot id would fill one block; rows are dealt by id and vector.
    left = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")

    def answers(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, shelf, ids, held = None, None, [], []
        for batch in batches:
            block, asks = np.asarray(batch.column("block")), np.asarray(batch.column("asks"))
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(block)], strict=True):
                if block[a] != at:
                    at, shelf, ids, held = block[a], None, [], []
                own = batch.slice(a, b - a)
                if not asks[a]:
                    ids.append(np.asarray(own.column("vec_id")))
                    held.append(own.column("v"))
                    continue
                if shelf is None and ids:
                    shelf = Shelf(np.concatenate(ids), _square([v for c in held for v in _lists(c)]))
                    ids, held = [], []
                out = [(q, i, s) for q, v in zip(own.column("vec_id").to_pylist(), _lists(own.column("v")), strict=True) for s, i in (shelf.top(v, q, k) if shelf else [])]
                if any(s >= 2**63 for _, _, s in out):
                    raise ValueError("the score of a query and one of its best vectors is no long")
                scores = [s if s >= -(2**63) else None for _, _, s in out]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    dealt = left.union(right).repartition(2 * blocks, "block").sortWithinPartitions("block", "asks")
    near = dealt.mapInArrow(answers, "query_id long, vec_id long, score long")
    best = W.Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    score = F.coalesce("score", F.raise_error(F.lit("the score of a query and one of its best vectors is no long")).cast("long"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
