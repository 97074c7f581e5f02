"""Sharding by a k-d tree over metadata, split at distributed weighted medians. DataFrame operations only.

A node is split along its widest dimension at the point that halves its bytes. The point is found by histograms: each
round is one aggregation into a fixed number of bins per node, and the bin that holds the median is the next round's
range. Rows never move to find it. The tree is a table: nodes meet their rows by a broadcast within
the measured bound, else by a join that deals large nodes over many tasks. Only counts come back to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.common import BROADCAST_ROWS, Scratch, skew_join, table, unsigned_crc32

#: Bins of one histogram round, and the share of a node's bytes below which a bin is not split further.
BINS, CLOSE = 4096, 1e-4
#: Equal texts are one point, or several if they hold more than this share of a leaf.
GROUP_SHARE = 1 / 64
#: About so many rows are numbered in one group.
SLOT_ROWS = 50_000
#: Points are written with their nodes after every so many levels of the tree; between these their place is a few lookups.
WRITE_LEVELS = 4


def text_axis(value: Column) -> Column:
    """A number that orders strings by their first six bytes; null and empty first."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def number_axis(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def _at_nodes(points: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """points with the columns of their nodes, which are at most so many; points of other nodes are left out."""
    return points.join(F.broadcast(nodes), "node") if most <= BROADCAST_ROWS else skew_join(points, nodes, "node")


def _crossing(points: DataFrame, open_: DataFrame, axes: list[str], most: int) -> DataFrame:
    """Per node, the bin of its present range where the needed bytes are reached: (node, least, most, got, before)."""
    picked = F.coalesce(*[F.when(F.col("axis") == i, F.col(a)) for i, a in enumerate(axes)])
    value = F.when(F.col("tying"), F.col("tie")).otherwise(picked)
    width = F.col("hi") - F.col("lo")
    place = F.when(width <= 0, F.lit(0)).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("value") - F.col("lo")) / width * BINS)))
    inside = _at_nodes(points, open_, most).withColumn("value", value).filter((~F.col("tying") | (picked == F.col("v"))) & F.col("value").between(F.col("lo"), F.col("hi")))
    bins = inside.groupBy("node", place.cast("int").alias("bin")).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.sum("size").alias("got"), F.first("need").alias("need"))
    order = W.Window.partitionBy("node").orderBy("bin")
    run = bins.withColumn("upto", F.sum("got").over(order)).withColumn("last", F.lead("bin").over(order).isNull())
    here = (F.col("upto") >= F.col("need")) | F.col("last")
    return run.filter(here & (F.col("upto") - F.col("got") < F.greatest("need", F.lit(1)))).select("node", "least", "most", "got", (F.col("upto") - F.col("got")).alias("before"))


CUT = ["node", "axis", "at", "at_too", "tie_at", "tie_too"]


def _cuts(points: DataFrame, axes: list[str], open_: DataFrame, most: int, work: Scratch, name: str) -> DataFrame:
    """Where each open node is cut: below `at` along its axis rows go left (at_too: at `at` too; else there by the tie)."""
    done, turn = None, 0
    while True:
        found = _crossing(points, open_, axes, most).join(open_, "node")
        whole = F.col("least") == F.col("most")
        to_tie = whole & ~F.col("tying") & (F.col("got") > F.col("close"))
        need = F.col("need") - F.col("before")
        taken = 2 * need >= F.col("got")  # the bin goes to the nearer side
        limit = F.when(taken, F.col("most")).otherwise(F.col("least"))
        state = found.select(
            "node", "k", "axis", "close", need.alias("need"), (F.col("tying") | to_tie).alias("tying"), F.when(to_tie, F.col("least")).otherwise(F.col("v")).alias("v"),
            F.when(to_tie, F.lit(0.0)).otherwise(F.col("least")).alias("lo"), F.when(to_tie, F.lit(float(1 << 53))).otherwise(F.col("most")).alias("hi"),
            (~to_tie & (whole | (F.col("got") <= F.col("close")))).alias("done"),
            F.when(F.col("tying"), F.col("v")).otherwise(limit).alias("at"), (~F.col("tying") & taken).alias("at_too"),
            F.when(F.col("tying"), limit).alias("tie_at"), (F.col("tying") & taken).alias("tie_too"),
        )
        state = work.cut(f"{name}_{turn}", state)
        ready = state.filter("done").select(*CUT)
        done = ready if done is None else done.union(ready)
        open_ = state.filter(~F.col("done")).drop("done", "at", "at_too", "tie_at", "tie_too")
        if not open_.limit(1).count():
            return done
        turn += 1


def kd_shards(points: DataFrame, axes: list[str], leaves: int | None = None, leaf_bytes: int | None = None, work: Scratch | None = None) -> DataFrame:
    """points (size, tie and the axes as doubles) with the leaf number in `shard`.

    leaves, or as many as leaf_bytes asks for. A node of k leaves gives floor(k / 2) / k of its bytes to the left. The
    widest axis is that with the largest range, as a share of the whole table's range. Points with equal coordinates are
    parted by tie (a number below 2**52); points equal in both stay together, as no rule can part them repeatably. The
    cuts of every level are written, and the placed points after every WRITE_LEVELS levels. Empty in, empty out.
    """
    work = work or Scratch(points.sparkSession)
    ends = [f(a).alias(f"{k}{i}") for i, a in enumerate(axes) for k, f in (("lo", F.min), ("hi", F.max))]
    placed = points.withColumn("node", F.lit(0).cast("long"))
    root = placed.agg(F.sum("size").alias("bytes"), *ends).first()
    if root.bytes is None:
        return placed.withColumnRenamed("node", "shard")
    leaves = leaves or max(1, -(-int(root.bytes) // int(leaf_bytes or 1)))
    wide = [max(root[f"hi{i}"] - root[f"lo{i}"], 1e-300) for i in range(len(axes))]
    value = F.coalesce(*[F.when(F.col("axis") == i, F.col(a)) for i, a in enumerate(axes)])
    share = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / F.lit(wide[i]) for i in range(len(axes))]
    widest = F.array_position(F.array(*share), F.greatest(*share)).cast("int") - 1 if len(axes) > 1 else F.lit(0)
    sizes = None
    for level in range((leaves - 1).bit_length()):
        spans = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *ends)
        spans = spans.withColumn("k", F.lit(leaves)) if sizes is None else spans.join(sizes, "node")
        spans = work.cut(f"spans{level}", spans.withColumn("axis", widest))
        pick = lambda k: F.element_at(F.array(*[F.col(f"{k}{i}") for i in range(len(axes))]), F.col("axis") + 1)
        open_ = spans.filter("k > 1").select(
            "node", "k", "axis", F.greatest(F.lit(1), F.floor(F.col("bytes") * CLOSE)).cast("long").alias("close"), F.floor(F.col("bytes") * F.floor(F.col("k") / 2) / F.col("k")).cast("long").alias("need"),
            F.lit(False).alias("tying"), F.lit(0.0).alias("v"), pick("lo").alias("lo"), pick("hi").alias("hi"),
        )
        most = min(leaves, 1 << level)
        nodes = spans.select("node", "k").join(_cuts(placed, axes, open_, most, work, f"round{level}"), "node", "left")
        here = value == F.col("at")
        left = F.col("at").isNull() | (value < F.col("at")) | (here & F.col("at_too")) | (here & ((F.col("tie") < F.col("tie_at")) | ((F.col("tie") == F.col("tie_at")) & F.col("tie_too"))))
        moved = F.when(F.coalesce(left, F.lit(False)), F.col("node")).otherwise(F.col("node") + F.floor(F.col("k") / 2))
        nodes = work.cut(f"nodes{level}", nodes)
        placed = _at_nodes(placed, nodes, most).withColumn("node", moved).drop("axis", "at", "at_too", "tie_at", "tie_too", "k")
        if level % WRITE_LEVELS == WRITE_LEVELS - 1:
            placed = work.cut(f"placed{level}", placed)
            if level >= WRITE_LEVELS:
                work.free(f"placed{level - WRITE_LEVELS}")
        half = F.floor(F.col("k") / 2)
        halves = F.when(F.col("at").isNotNull(), F.array(F.struct(F.col("node").alias("node"), half.alias("k")), F.struct((F.col("node") + half).alias("node"), (F.col("k") - half).alias("k"))))
        sizes = nodes.select(F.explode(F.coalesce(halves, F.array(F.struct(F.col("node").alias("node"), F.col("k").cast("long").alias("k"))))).alias("x")).select("x.*")
    return placed.withColumn("shard", F.col("node").cast("int")).drop("node")


def slots(sharded: DataFrame, by: list[str], rows: int) -> DataFrame:
    """A row for each copy (n) of a row, with a gapless number from 0 within its shard. Groups of about SLOT_ROWS rows, dealt by a hash of by, are numbered apart and offset."""
    groups = 1 << max(8, math.ceil(math.log2(max(1, rows) / SLOT_ROWS)))
    dealt = sharded.withColumn("__tb_group", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int"))
    sums = dealt.groupBy("shard", "__tb_group").agg(F.sum("n").alias("count"))
    offsets = sums.withColumn("__tb_before", F.coalesce(F.sum("count").over(W.Window.partitionBy("shard").orderBy("__tb_group").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    upto = F.sum("n").over(W.Window.partitionBy("shard", "__tb_group").orderBy(*by).rowsBetween(W.Window.unboundedPreceding, 0))
    last = dealt.join(offsets, ["shard", "__tb_group"]).withColumn("__tb_last", F.col("__tb_before") + upto)
    return last.withColumn("slot", F.explode(F.sequence(F.col("__tb_last") - F.col("n"), F.col("__tb_last") - 1))).drop("__tb_group", "__tb_before", "__tb_last", "n")


def shard_documents(docs: DataFrame, leaves: int | None = None, leaf_bytes: int | None = None) -> DataFrame:
    """Every row of docs as (doc_id, size, text_crc32, shard, slot); size is UTF-8 bytes plus 1, shards are near equal in bytes.

    The axes are length in characters, source, language and id. Rows of equal text are one point, at the least of their
    metadata, and stay together, unless they hold more than GROUP_SHARE of a leaf: then near equal sizes ask for parts,
    dealt by id and metadata, and rows that are equal in these too by number. Null text is empty; null metadata come first
    on their axis. Repeated rows are one with a number until they get their slots. Columns other than doc_id, text, source
    and lang are ignored. An empty table gives an empty result.
    """
    work = Scratch(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), unsigned_crc32(text).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_mark"),
        number_axis(F.char_length(text)).alias("x_length"), text_axis(F.col("source")).alias("x_source"), text_axis(F.col("lang")).alias("x_lang"), number_axis(F.col("doc_id")).alias("x_id"),
    )
    axes = ["x_length", "x_source", "x_lang", "x_id"]
    group = ["text_mark", "text_crc32", "size"]
    rows = work.cut("rows", rows.groupBy("doc_id", *group, *axes).agg(F.count("*").alias("n")))
    total, count = rows.agg(F.sum(F.col("size") * F.col("n")), F.sum("n")).first()
    count = count or 0
    limit = max(1, int((leaf_bytes or (total or 0) / (leaves or 1)) * GROUP_SHARE))
    sums = rows.groupBy(*group).agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    large = work.cut("large", sums.withColumn("parts", F.ceil(F.col("n") * F.col("size") / limit).cast("int")).filter("parts > 1").select(*group, "parts"))
    dealt = rows.join(F.broadcast(large), group, "left") if large.count() <= BROADCAST_ROWS else skew_join(rows, large, group, "left")
    # Equal rows are dealt over the parts of their group by number, and over pieces that a task gives slots to.
    parts = F.coalesce("parts", F.lit(1))
    pieces = F.greatest(F.least(F.col("n"), parts), F.ceil(F.col("n") / SLOT_ROWS)).cast("long")
    dealt = dealt.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    part = F.pmod(F.xxhash64("doc_id", "x_source", "x_lang") + F.col("piece"), parts).cast("int")
    own = F.floor(F.col("n") / F.col("pieces")) + (F.col("piece") < F.col("n") % F.col("pieces")).cast("int")
    dealt = work.cut("dealt", dealt.withColumn("part", part).withColumn("n", own.cast("long")).drop("parts", "pieces"))
    tie = F.col("text_crc32").cast("double") * F.lit(float(1 << 20)) + F.pmod(F.xxhash64("part", "text_mark"), F.lit(1 << 20)).cast("double")
    points = dealt.groupBy(*group, "part").agg(F.sum(F.col("size") * F.col("n")).alias("weight"), *[F.min(a).alias(a) for a in axes]).withColumn("tie", tie)
    points = work.cut("points", points.withColumnsRenamed({"size": "own_size", "weight": "size"}))
    placed = kd_shards(points, axes, leaves, leaf_bytes, work).select("text_mark", "text_crc32", F.col("own_size").alias("size"), "part", "shard")
    # Parts are bounded shares of a leaf, so no key of this join is hot.
    sharded = dealt.select("doc_id", *group, "part", "piece", "n").join(placed, [*group, "part"])
    sharded = work.cut("sharded", sharded.select("doc_id", "size", "text_crc32", "shard", "piece", "n"))
    work.free("rows", "dealt", "points", "large")
    return slots(sharded, ["doc_id", "text_crc32", "size", "piece"], count).drop("piece")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), leaves=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
