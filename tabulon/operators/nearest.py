"""Exact nearest vectors by pivots: cells of rows around pivots, visited by the triangle inequality, scored in blocks.

Rows belong to the cell of their nearest pivot and lie in it by their distance from it. For a query at distance a of a pivot,
no row at distance r of it can be nearer than |a - r|. A query first meets its own cell, which gives it a k-th distance, then
only the cells that can hold a nearer row, and in these only the rows between a - d and a + d. Distances are angles for cosine
and lengths of differences for L2, both metrics. Cells of many rows are cut into blocks by distance, so no block grows with
the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.lexical import top

#: Rows of a block at most (about), rows of a cell on average where there are fewer pivots than MOST_PIVOTS.
BLOCK_ROWS, CELL_ROWS, MOST_PIVOTS = 32_768, 4_096, 256
#: Scores are compared to so many places, so equal vectors tie however their products were summed.
PLACES = 12
#: Rounding of distances.
SLACK = 4e-6


def _matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of equal length as rows of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), width)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of every row of x from every row of y: angles of unit vectors, or L2."""
    dots = x @ y.T
    if metric == "cosine":
        return np.arccos(np.clip(dots, -1, 1))
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * dots))


def scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Of rows for one query: the cosine, or 1 - the squared L2."""
    found = x @ q if metric == "cosine" else 1 - ((x - q) ** 2).sum(axis=1)
    return np.round(found, PLACES)


def _whole(rows: DataFrame, id_: str, vector: str, width: int, metric: str) -> DataFrame:
    """(id, v) of the rows whose vector has all its finite components and, for cosine, a length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = (F.size(vector) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    fine &= F.exists(v, lambda x: F.abs(x) > 1e-150) if metric == "cosine" else F.lit(True)
    return rows.filter(F.col(id_).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_).cast("long").alias("id"), v.alias("v"))


def _with_pivots(rows: DataFrame, pivots: np.ndarray, metric: str, all_: bool) -> DataFrame:
    """rows with cell (the nearest pivot) and r (its distance), or with the distances of all pivots."""
    width = pivots.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column("v"), width)
            away = distances(_units(x) if metric == "cosine" else x, pivots, metric)
            near = away.argmin(axis=1)
            more = pa.FixedSizeListArray.from_arrays(pa.array(away.ravel()), len(pivots)).cast(pa.list_(pa.float64())) if all_ else pa.array(away[np.arange(len(x)), near])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32)), more], ["id", "v", "cell", "away" if all_ else "r"])

    return rows.mapInArrow(run, f"id long, v array<double>, cell int, {'away array<double>' if all_ else 'r double'}")


def _scored(blocks: DataFrame, asks: DataFrame, n_blocks: int, width: int, k: int, metric: str, others: bool) -> DataFrame:
    """(query, id, score, pairs) of the k best rows of each block for the queries that ask it; pairs (on a query's first row, or alone) counts the rows that were scored.

    blocks: block, id, v, r; asks: block, query, v, a (distance of the pivot), floor (distance that a row may have).
    """
    left = blocks.select("block", F.lit(0).alias("asks"), F.col("id"), "v", F.col("r").alias("a"), F.lit(None).cast("double").alias("floor"))
    right = asks.select("block", F.lit(1).alias("asks"), F.col("query").alias("id"), "v", "a", "floor")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, held, x, ids, r = None, [], None, None, None
        for batch in batches:
            block, kind = np.asarray(batch.column("block")), np.asarray(batch.column("asks"))
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(block)], strict=True):
                own = batch.slice(lo, hi - lo)
                if block[lo] != at:
                    at, held, x = block[lo], [], None
                if not kind[lo]:
                    held.append((np.asarray(own.column("id")), _matrix(own.column("v"), width), np.asarray(own.column("a"))))
                    continue
                if x is None:
                    if not held:
                        continue
                    ids, x, r = (np.concatenate(c) for c in zip(*held, strict=True))
                    x = _units(x) if metric == "cosine" else x
                q = _matrix(own.column("v"), width)
                q = _units(q) if metric == "cosine" else q
                floors = own.column("floor").to_pylist()
                for i, (name, a) in enumerate(zip(own.column("id").to_pylist(), own.column("a").to_pylist(), strict=True)):
                    within = (0, len(r)) if floors[i] is None else (np.searchsorted(r, a - floors[i] - SLACK, "left"), np.searchsorted(r, a + floors[i] + SLACK, "right"))
                    some = slice(*within)
                    found, names = scores(x[some], q[i], metric), ids[some]
                    if others:
                        found, names = found[names != name], names[names != name]
                    best = np.lexsort((names, -found))[:k] if len(found) <= 4 * k else None
                    if best is None:
                        least = np.partition(found, len(found) - k)[len(found) - k]
                        near = np.flatnonzero(found >= least)
                        best = near[np.lexsort((names[near], -found[near]))[:k]]
                    out.append((name, None, None, int(within[1] - within[0])))
                    out += [(name, int(names[j]), float(found[j]), None) for j in best]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query", "id", "score", "pairs"])

    dealt = left.union(right).repartition(min(2 * n_blocks, 4_096), "block").sortWithinPartitions("block", "asks", "a")
    return dealt.mapInArrow(run, "query long, id long, score double, pairs long")


def _asks(near: DataFrame, spans: list, home: bool) -> DataFrame:
    """(block, query, v, a, floor): the blocks that a query meets, those of its own cell or those of other cells that can hold a row within its floor."""
    block, cell, lo, hi = (np.array([s[c] for s in spans]) for c in ("block", "cell", "lo", "hi"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own, floor = np.asarray(batch.column("cell")), batch.column("floor").fill_null(np.inf).to_numpy(zero_copy_only=False)
            away = _matrix(batch.column("away"), len(batch.column("away")[0]) if len(batch) else 1)[:, cell]
            mine = own[:, None] == cell[None, :]
            least = np.maximum(away - hi, lo - away)
            query, at = np.nonzero(mine if home else ~mine & (least <= floor[:, None] + SLACK))
            rows = pa.array(query)
            yield pa.RecordBatch.from_arrays([pa.array(block[at]), batch.column("id").take(rows), batch.column("v").take(rows), pa.array(away[query, at]), batch.column("floor").take(rows)], ["block", "query", "v", "a", "floor"])

    return near.select("id", "v", "cell", "away", "floor").mapInArrow(run, "block long, query long, v array<double>, a double, floor double")


def nearest_vectors(rows: DataFrame, queries: DataFrame, id_: str, vector: str, query: str, query_vector: str, k: int, metric: str = "cosine", threshold: float | None = None, others: bool = False, counted: bool = False) -> DataFrame:
    """query, id, score, rank of the k best rows of each query, exact; by score (cosine, or 1 - squared L2), then id.

    The threshold applies after the cut to k. others leaves out the row with the query's id. Vectors that are null, of another
    length than the table's first, without length (cosine), or with null or non-finite components take no part, on either
    side; ids and query ids are longs, null ones take no part. Repeated rows are rows of their own; of queries with one id the
    first by its vector counts. Empty in, empty out. counted: instead (pairs, all): scored and possible pairs of the search.
    """
    spark = rows.sparkSession
    first = rows.filter(F.size(vector) > 0).select(F.size(vector)).first()
    width = first[0] if first else 1
    whole = _whole(rows, id_, vector, width, metric)
    asked = _whole(queries, query, query_vector, width, metric).groupBy("id").agg(F.min("v").alias("v"))
    n_rows = whole.count()
    n_pivots = max(1, min(MOST_PIVOTS, n_rows // CELL_ROWS))
    seeds = whole.orderBy(F.xxhash64("id", "v"), "id").limit(n_pivots).collect()  # at most MOST_PIVOTS vectors
    if not seeds:
        none = spark.range(0)
        return none.selectExpr("id AS pairs", "id AS all") if counted else none.selectExpr(f"id AS {query}", f"id AS {id_}", "0.0D AS score", "0 AS rank")
    pivots = np.array([s.v for s in seeds], dtype=np.float64)
    pivots = _units(pivots) if metric == "cosine" else pivots
    placed = _with_pivots(whole, pivots, metric, False)
    # Cells are cut by distance into blocks of about BLOCK_ROWS rows; cells and cuts are few.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("r", F.lit([i / 64 for i in range(1, 64)])).alias("cuts")).collect()
    cuts = {s.cell: sorted({s.cuts[min(62, 64 * j // p)] for p in [-(-s.n // BLOCK_ROWS)] for j in range(1, p)}) for s in sizes}
    bounds = F.element_at(F.create_map(*[x for c, v in cuts.items() for x in (F.lit(c), F.lit(v).cast("array<double>"))]), F.col("cell"))
    split = F.size(F.filter(bounds, lambda b: b < F.col("r")))
    # Blocks beyond what 64 cuts tell apart (rows at one distance) are dealt by a hash.
    most = max(-(-s.n // BLOCK_ROWS) for s in sizes)
    piece = F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-most // 64)))).cast("int")
    blocks = placed.withColumn("block", (F.col("cell") * F.lit(64 * max(1, -(-most // 64))) + split * F.lit(max(1, -(-most // 64))) + piece).cast("long"))
    spans = blocks.groupBy("block", "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()  # a row for each block
    near = _with_pivots(asked, pivots, metric, True)
    early = _scored(blocks, _asks(near.withColumn("floor", F.lit(None).cast("double")), spans, True), len(spans), width, k, metric, others)
    kth = top(early.filter("id IS NOT NULL"), "query", k, F.col("score").desc(), "id").groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    away = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "kth"))) if metric == "cosine" else F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("kth")))
    # A query without k rows yet has no floor (least and greatest skip nulls, so its null is kept apart).
    floored = near.join(kth.select(F.col("query").alias("id"), F.when(F.col("kth").isNotNull(), away).alias("floor")), "id", "left")
    both = early.unionByName(_scored(blocks, _asks(floored, spans, False), len(spans), width, k, metric, others)) if n_pivots > 1 else early
    if counted:
        return both.agg(F.sum("pairs").alias("pairs")).withColumn("all", F.lit(n_rows * asked.count()))
    best = top(both.filter("id IS NOT NULL").select("query", "id", "score"), "query", k, F.col("score").desc(), "id")
    best = best if threshold is None else best.filter(F.col("score") >= threshold)
    return best.select(F.col("query").alias(query), F.col("id").alias(id_), "score", "rank")
