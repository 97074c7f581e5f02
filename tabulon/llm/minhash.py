"""Near duplicates by b-bit MinHash, every link confirmed on full sets.

Of each set of word shingles HASHES minima are taken. Bands of ROWS minima are index entries, so sets that agree in one
band meet; a link of 0.85 is missed by all BANDS bands once in 10**10 times. Of each minimum only the BITS low bits are
kept, packed into longs: the number of equal groups of bits in two signatures, counted in the exclusive or and corrected
for groups that agree by chance, estimates the similarity, and pairs whose estimate is far below the limit never have
their sets compared. What is left is confirmed on the full sets.

As in the n-gram Jaccard join, sets that share an entry are compared with a star of the entry, and with each other only
where components are left apart around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, mixed, skew_join, table, utf8_parts
from tabulon.llm.jaccard import hot_entries, linked_sets, set_mark, shared_entries, shingle_sets

#: Minima, in bands of so many rows, and the low bits that are kept of each.
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: An estimate counts as far below the limit from so many of its standard deviations on.
DEVIATIONS = 6.5
_FACTORS = np.random.default_rng(20240311).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets) x HASHES) minima of sets that aren't empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    for j, factor in enumerate(_FACTORS):
        out[:, j] = np.minimum.reduceat(flat * factor, starts)
    return mixed(out)


def band_entries(own: np.ndarray) -> np.ndarray:
    """The index entries of rows of minima, one for each band."""
    entry = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(own), axis=0)
    for r in range(ROWS):
        entry = mixed(entry * np.uint64(0x9E3779B97F4A7C15) + own[:, r::ROWS])
    return entry.view(np.int64)


def packed(own: np.ndarray) -> np.ndarray:
    """The low bits of rows of minima, 64 // BITS to a long."""
    per = 64 // BITS
    low = (own & np.uint64((1 << BITS) - 1)).reshape(len(own), HASHES // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=2).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """The similarity of two sets from their packed signatures: the share of equal groups, less those that agree by chance."""
    mask = int("".join(["0" * (BITS - 1) + "1"] * (64 // BITS)), 2)
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        any_ = x
        for k in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(any_.bitwiseAND(F.lit(mask)))
    by_chance = 2.0**-BITS
    return ((HASHES - differ) / HASHES - by_chance) / (1 - by_chance)


def least_estimate(percent: int) -> float:
    """A link's estimate is below this once in about 10**10 times."""
    by_chance = 2.0**-BITS
    equal = by_chance + (1 - by_chance) * percent / 100
    return percent / 100 - DEVIATIONS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - by_chance)


SIGNED = "text_hash long, n_shingles long, node long, entries array<long>, bits array<long>"


def signed_table(docs: DataFrame, words: int, id_: str = "doc_id") -> DataFrame:
    """Per row: id, text_hash, n_shingles, node (its set's mark), index entries and packed signature. Of equal sets that come close together one row has the last two."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(rows: np.ndarray, at: list[int], n: int):
            ends = np.zeros(n + 1, np.int32)
            ends[np.array(at, np.int64) + 1] = rows.shape[1]
            return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(rows.ravel()))

        for batch in batches:
            for at, to, data, offsets in utf8_parts(batch.column("__tb_text"), 1 << 20):
                sizes, marks, kept, where, seen = [], [], [], [], set()
                for i, own in enumerate(shingle_sets(data, offsets, words)):
                    sizes.append(len(own))
                    marks.append(set_mark(own))
                    if len(own) and marks[-1] not in seen:
                        seen.add(marks[-1])
                        kept.append(own)
                        where.append(i)
                low = minima(kept) if kept else np.zeros((0, HASHES), np.uint64)
                arrays = [batch.column(id_)[at:to], batch.column("text_hash")[at:to], pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, lists(band_entries(low), where, to - at), lists(packed(low), where, to - at)], [id_, *[x.split()[0] for x in SIGNED.split(", ")]])

    return docs.select(id_, F.xxhash64("text").alias("text_hash"), F.col("text").alias("__tb_text")).mapInArrow(run, f"{id_} {dict(docs.dtypes)[id_]}, {SIGNED}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included) and kept of every row.

    Two texts link when 100 * shared >= percent * union of their distinct shingles of so many words (white space apart,
    A-Z in lower case). Texts without words link with nothing. Null ids get their component's smallest id, or null. kept:
    the row's id is its component's; so it is for rows without words, and for all rows of a component without ids.
    Repeated rows are repeated. Other columns are ignored. Empty in, empty out.
    """
    docs = docs.select("doc_id", "text")
    work = Scratch(docs.sparkSession)
    signed = work.cut("signed", signed_table(docs, words))
    nodes = work.cut("nodes", signed.select("doc_id", "text_hash", "n_shingles", "node"))
    bits = work.cut("bits", signed.filter(F.size("bits") > 0).groupBy("node").agg(F.first("bits").alias("bits")))
    rows = signed.select("node", F.explode("entries").alias("entry"), F.lit(0).cast("short").alias("kind"))
    kept = work.cut("kept", shared_entries(rows, work.cut("hot", hot_entries(rows))).select("entry", "node"))
    work.free("signed", "hot")

    def likely(pairs: DataFrame, a: str, b: str) -> DataFrame:
        own = work.cut(f"pairs_{a}", pairs)
        left = skew_join(own, bits.select(F.col("node").alias(a), F.col("bits").alias("bits_a")), a)
        both = skew_join(left, bits.select(F.col("node").alias(b), F.col("bits").alias("bits_b")), b, counts=own.groupBy(b).agg(F.count("*").alias("n")))
        return both.filter(estimate(F.col("bits_a"), F.col("bits_b")) >= least_estimate(percent)).select(a, b)

    placed = linked_sets(docs, nodes, kept, words, percent, work, likely)
    work.free("bits", "pairs_a", "pairs_node")
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = work.cut("components", skew_join(placed, least, "label").select("node", "component_id"))
    full = skew_join(nodes, named, "node", how="left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM words),
sized AS (SELECT doc_id, list_sort(g) AS s, len(g) AS n FROM grams),
marks AS (SELECT min(doc_id) AS node, s, n FROM sized WHERE n > 0 GROUP BY s, n),
items AS (SELECT node, n, unnest(s) AS item FROM marks),
shared AS (
  SELECT a.node AS x, b.node AS y FROM items a JOIN items b ON a.item = b.item AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM shared UNION ALL SELECT y, x FROM shared),
reach AS (SELECT node, node AS r FROM marks UNION SELECT e.x, reach.r FROM reach JOIN edges e ON e.y = reach.node AND reach.r < e.x),
least_ AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
found AS (SELECT z.doc_id, z.n, CASE WHEN z.n = 0 THEN z.doc_id ELSE l.component_id END AS component_id
  FROM sized z LEFT JOIN marks m ON z.s = m.s LEFT JOIN least_ l ON l.node = m.node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found
"""
