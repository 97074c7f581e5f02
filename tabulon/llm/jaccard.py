"""N-gram Jaccard join by universe partitioning and the pigeonhole principle, exact.

A text is its set of distinct word shingles. Sizes fall into bands so that linked sets lie in the same or in neighbouring
bands. For a band, the shingles' universe is hashed into segments; two linked sets differ in at most H shingles, so of
H + 1 + spare units of segments at least spare + 1 are untouched. A segment is indexed by its subset of the set (one
unit), or also by that subset's one-deletion neighbourhoods (two units); a cost model chooses how many of each a band
has. By corpus frequency each set then drops its `spare` commonest exact segments: the order is the same for both sets
of a pair, so the rarest untouched segment stays in both. Sets that share an index entry are verified exactly.

Only connected components are wanted, so pairs inside a component are never made: the first round verifies one star
edge per set, the next the stars of the entries that still hold two components. Where two components remain around a
star, an index over the sets' differences from the star finds the pairs that can still be linked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tabulon.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, HOT_KEYS, HOT_ROWS, Scratch, cut, give_back, lowered, mixed, skew_join, span_hashes, table, utf8_parts, word_spans
from tabulon.llm.components import components

#: Weight of an accidental meeting against an index entry in the cost model.
COLLISION = 80.0
#: At most so many segments of a band have deletion neighbourhoods, which cost an entry per shingle.
MOST_DELETIONS = 8
#: Slices of the index entries (a power of two), which are met one after the other: on disk is one slice's shuffle.
SLICES = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row of UTF-8 bytes. Fewer words than a shingle make one; none, none."""
    low = lowered(data)
    starts, ends, before = word_spans(low, offsets)
    hashes = span_hashes(low, starts, ends)
    n = len(hashes)
    grams = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(grams)]
    grams = mixed(grams)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for j in range(a, b):
                one = mixed(one * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def differences(x: int, percent: int) -> int:
    """The most shingles in which a set of at most x and a linked set that isn't smaller can differ."""
    top = x * 100 // percent
    return max((x + y - 2 * -(-percent * (x + y) // (100 + percent)) for y in range(max(x, top - 3), top + 1)), default=0)


_BANDS: dict[tuple[int, int], tuple[int, tuple]] = {}
_EDGES: dict[int, np.ndarray] = {}


def bands(percent: int, steps: int, most: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(first size, first size beyond, exact segments, deletion segments, spare) of each band up to size most at least."""
    known = _BANDS.get((percent, steps))
    if known is None or known[0] < most:
        known = _BANDS[percent, steps] = (most, _bands(percent, steps, most))
    return known[1]


def _bands(percent: int, steps: int, most: int) -> tuple[tuple[int, int, int, int, int], ...]:
    low = 1
    while differences(low, percent) == 0:
        low += 1
    out = []
    while low <= most:
        high = low + 1
        for _ in range(steps):
            high = max(high, (high if _ else low) * 100 // percent + 1)
        need = max(differences(x, percent) for x in range(max(low, high - 8), high)) + 1
        best = None
        spare = 1 if need < 6 else 2 + need // 20
        for _ in range(8):  # the spare covers the segments expected to be empty
            m = need + spare
            mean = m * math.exp(-low / m)
            spare = max(spare, math.ceil(mean + 2 * math.sqrt(mean))) if need >= 6 else spare
        units = need + spare
        for deletions in range(units // 2 + 1):
            exact = units - 2 * deletions
            if exact + deletions == 0 or deletions > MOST_DELETIONS:
                continue
            z = low / (exact + deletions)
            cost = exact + deletions + z * deletions + COLLISION * ((exact + deletions) * math.exp(-z) + deletions * z * math.exp(1 - z))
            if best is None or cost < best[0]:
                best = (cost, exact, deletions)
        out.append((low, high, best[1], best[2], min(spare, max(0, best[1]))))
        low = high
    return tuple(out)


def _edges(m: int) -> np.ndarray:
    """Where the segments of m begin in the universe of 64-bit hashes, but the first."""
    if m not in _EDGES:
        _EDGES[m] = np.array([-(-(j << 64) // m) for j in range(1, m)], np.uint64)
    return _EDGES[m]


def index_entries(own: np.ndarray, percent: int, steps: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, entries, number of exact ones first) of a sorted set, for its own band and the one below."""
    n = len(own)
    table_ = bands(percent, steps, 1 << max(6, n.bit_length()))
    at = int(np.searchsorted([b[0] for b in table_], n, "right")) - 1
    value = mixed(own + np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    for band in (at, at - 1):
        if band < 0 or (band < at and n * percent > (table_[band][1] - 1) * 100):
            continue
        _, _, exact, deletions, _ = table_[band]
        m = exact + deletions
        cuts = np.concatenate([[0], np.searchsorted(own, _edges(m), "left"), [n]])
        mark = mixed(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        whole = sums[cuts[1:]] - sums[cuts[:-1]]
        parts = [mixed(whole[deletions:] + mark[deletions:]), mixed(whole[:deletions] + mark[:deletions])]
        if deletions:
            segment = np.repeat(np.arange(deletions), np.diff(cuts[: deletions + 1]))
            parts.append(mixed(whole[segment] - value[: cuts[deletions]] + mark[segment]))
        yield band, np.concatenate(parts), exact


def sliced(entries: np.ndarray, exact: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(slice, entries, number of exact ones first) of what index_entries gives, of each slice that has any."""
    slice_ = (entries >> np.uint64(65 - SLICES.bit_length())).astype(np.int64) if SLICES > 1 else np.zeros(len(entries), np.int64)
    own = entries[np.argsort(slice_, kind="stable")]
    n, n_exact = np.bincount(slice_, minlength=SLICES).tolist(), np.bincount(slice_[:exact], minlength=SLICES).tolist()
    at = 0
    for k in range(SLICES):
        if n[k]:
            yield k, own[at : at + n[k]], n_exact[k]
            at += n[k]


def set_mark(own: np.ndarray) -> int:
    """64-bit identity of a set."""
    return int(mixed(np.array([mixed(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


CODED = "text_hash long, n_shingles long, node long, " + ", ".join(f"groups{k} array<struct<band:short,exact:int,entries:array<long>>>" for k in range(SLICES))


def coded_table(docs: DataFrame, words: int, percent: int, steps: int, id_: str = "doc_id") -> DataFrame:
    """Per row: id, text_hash, n_shingles, node (its set's mark) and the set's index entries, by slice and band, the exact ones first.

    Of equal sets that come close together one row has entries.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in utf8_parts(batch.column("__tb_text"), 1 << 20):
                sizes, marks, seen = [], [], set()
                ends, band, exact, entries = ([[] for _ in range(SLICES)] for _ in range(4))
                for own in shingle_sets(data, offsets, words):
                    sizes.append(len(own))
                    marks.append(set_mark(own))
                    if len(own) and marks[-1] not in seen:
                        seen.add(marks[-1])
                        for b, all_, first in index_entries(own, percent, steps):
                            for k, found, n in sliced(all_, first):
                                band[k].append(b)
                                exact[k].append(n)
                                entries[k].append(found)
                    for k in range(SLICES):
                        ends[k].append(len(band[k]))
                arrays = [batch.column(id_)[at:to], batch.column("text_hash")[at:to], pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())]
                for k in range(SLICES):
                    flat = np.concatenate(entries[k]).view(np.int64) if entries[k] else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, entries[k])]), pa.int32()), pa.array(flat))
                    inner = pa.StructArray.from_arrays([pa.array(band[k], pa.int16()), pa.array(exact[k], pa.int32()), lists], ["band", "exact", "entries"])
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, *ends[k]], pa.int32()), inner))
                yield pa.RecordBatch.from_arrays(arrays, [id_, *[x.split()[0] for x in CODED.split(", ")]])
        give_back()

    return docs.select(id_, F.xxhash64("text").alias("text_hash"), F.col("text").alias("__tb_text")).mapInArrow(run, f"{id_} {dict(docs.dtypes)[id_]}, {CODED}")


def entry_rows(coded: DataFrame, slices: Iterable[int] = range(SLICES)) -> DataFrame:
    """(entry, node, kind) of these slices: kind is twice the band, plus 1 for exact segments."""
    groups = coded.select("node", F.explode(F.concat(*[f"groups{k}" for k in slices])).alias("g"))
    rows = groups.select("node", F.col("g.band").alias("band"), F.col("g.exact").alias("exact"), F.posexplode("g.entries").alias("at", "entry"))
    return rows.select("entry", "node", (2 * F.col("band") + (F.col("at") < F.col("exact")).cast("int")).cast("short").alias("kind"))


def hot_entries(rows: DataFrame) -> DataFrame:
    """(entry, parts, low, high, n) of the entries that hold more than one in HOT_KEYS of all rows: at most HOT_KEYS rows."""
    total = rows.count()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    # Frequent items have no false negatives; their rows are then counted.
    likely = rows.stat.freqItems(["entry"], 1 / HOT_KEYS).select(F.explode("entry_freqItems").alias("entry"))
    counted = rows.join(F.broadcast(likely), "entry").groupBy("entry").agg(F.min("node").alias("low_"), F.max("node").alias("high_"), F.count("*").alias("n_"))
    return counted.filter(F.col("n_") > limit).withColumn("parts", F.ceil(F.col("n_") / limit).cast("int"))


def shared_entries(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(entry, node, kind, n) of the entries that two sets have; n counts the rows of the entry. hot: hot_entries of these rows, or of more."""
    dealt = rows.join(F.broadcast(hot), "entry", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)))
    own = W.Window.partitionBy("entry", "part")
    met = dealt.withColumns({"low": F.coalesce("low_", F.min("node").over(own)), "high": F.coalesce("high_", F.max("node").over(own)), "n": F.coalesce("n_", F.count("*").over(own))})
    return met.filter(F.col("low") != F.col("high")).select("entry", "node", "kind", "n").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int, repeats: bool) -> DataFrame:
    """(node, star, items) of the documents wanted (doc_id, text_hash, node, star): these are broadcast if few, else joined by shuffle.

    The hash of the text keeps rows apart that share an id or have none. repeats: whether several rows of docs can be one.
    """
    few = wanted.count()
    ids = wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "node", "star")
    near = docs.select("doc_id", F.col("text").alias("__tb_text")).join(F.broadcast(ids) if few <= BROADCAST_ROWS and 32 * few <= BROADCAST_BYTES else ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("__tb_text") == F.col("_hash")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, to, data, offsets in utf8_parts(batch.column("__tb_text"), 2 << 20):
                sets = list(shingle_sets(data, offsets, words))
                same = [i for i, (s, k) in enumerate(zip(sets, batch.column("node")[at:to].to_pylist(), strict=True)) if set_mark(s) == k]
                items = pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))
                own = pa.array(same, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("node")[at:to].take(own), batch.column("star")[at:to].take(own), items], ["node", "star", "items"])
        give_back()

    sets = near.select("__tb_text", "node", "star").mapInArrow(run, "node long, star long, items array<long>")
    return sets.dropDuplicates(["node"]) if repeats else sets


def _linked(percent: int) -> Column:
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return 100 * shared >= percent * (F.size("x") + F.size("y") - shared)


def _of_stars(sets: DataFrame, pairs: DataFrame, star: str) -> DataFrame:
    """(star, y) of the sets that are stars of pairs."""
    return sets.select(F.col("node").alias(star), F.col("items").alias("y")).join(pairs.select(star).distinct(), star, "left_semi")


def _first_links(sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of the sets with their stars. A star's rows are dealt over tasks by their number."""
    pairs = sets.filter(F.col("star").isNotNull()).select("star", "node", F.col("items").alias("x"))
    counts = pairs.groupBy("star").agg(F.count("*").alias("n"))
    both = skew_join(pairs, _of_stars(sets, pairs, "star"), "star", counts=counts)
    return both.filter(_linked(percent)).select(F.col("node").alias("a"), F.col("star").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    own = pairs.select("a", "b")
    left = skew_join(own, sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = skew_join(left, _of_stars(sets, own, "b"), "b", counts=own.groupBy("b").agg(F.count("*").alias("n")))
    return both.filter(_linked(percent)).select("a", "b")


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(star, node, n_star, n, items, linked): what each set and its star don't share, and whether they are linked."""
    left = pairs.join(sets.select("node", F.col("items").alias("x")), "node")
    both = skew_join(left, _of_stars(sets, pairs, "star"), "star", counts=pairs.groupBy("star").agg(F.count("*").alias("n")))
    own = both.select("star", "node", F.size("y").alias("n_star"), F.size("x").alias("n"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("items"))
    shared = (F.col("n") + F.col("n_star") - F.size("items")) / 2
    return own.withColumn("linked", 100 * shared >= percent * (F.col("n") + F.col("n_star") - shared))


def _apart(near: DataFrame, labels: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Pairs (a, b) of different components around one star that can still be linked.

    Sets x and y around a star differ in |Dx| + |Dy| - 2 |Dx and Dy| shingles, where D is a set's difference from the
    star. With k = (1 - t) / (1 + t), a link needs at most k (|x| + |y|); of two linked sets in different components one,
    x, isn't linked with the star: |Dx| > k (|x| + |star|). So Dx and Dy share more than
    (|Dy| + k (|star| - |y|)) / 2 items, and at least (|Dx| - k (|x| + |star|) + 1 - k) / 2, as |y| <= |star| + |Dy|: they
    meet within their rarest |D| - that + 1 items. Copies of one text with edits of their own share no rare items, so
    they don't meet. An item that is rarest for many unlinked sets of different components pairs all of them: this is
    what is left to compare, and it has no bound but that.
    """
    k = (100 - percent) / (100 + percent)
    heads = near.select("star", "node").join(labels, "node", "left").select("star", "node", F.coalesce("label", "node").alias("label"))
    heads = work.cut("heads", heads)
    own_label = labels.select(F.col("node").alias("star"), F.col("label").alias("star_label"))
    sums = heads.groupBy("star").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).join(own_label, "star", "left")
    star_label = F.coalesce("star_label", "star")
    open_ = work.cut("open_stars", sums.filter(F.least("low", star_label) != F.greatest("high", star_label)).select("star", "n"))
    own = skew_join(near, open_.select("star"), "star", counts=open_).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    size = F.size("items")
    as_other = F.floor((size + k * (F.col("n_star") - F.col("n"))) / 2 + 1e-9) + 1
    as_far = F.greatest(F.lit(1), F.ceil((size - k * (F.col("n") + F.col("n_star")) + 1 - k) / 2 - 1e-9))
    rows = work.cut("items", own.select("star", "node", "label", "n", "linked", size.alias("size"), (size + 1 - as_far).alias("far_prefix"), (size + 1 - as_other).alias("prefix"), F.explode("items").alias("item")))
    work.free("near")
    often = work.cut("often", rows.groupBy("item", "star").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    # Only shared items move, without what their set's one row says. They are the last of their set, whose others come first.
    met = skew_join(rows.select("item", "star", "node"), often.withColumnRenamed("n", "often"), ["item", "star"], counts=often)
    met = met.join(rows.drop("item").distinct(), ["star", "node"])
    place = F.col("size") + 1 - F.row_number().over(W.Window.partitionBy("star", "node").orderBy(F.col("often").desc(), F.col("item").desc()))
    shared = work.cut("shared_items", met.withColumn("place", place).filter(F.col("place") <= F.greatest("prefix", "far_prefix")))
    work.free("heads", "open_stars", "items", "often")
    far = shared.filter(~F.col("linked") & (F.col("place") <= F.col("far_prefix"))).select("star", "item", "node", "label", "n", "size", "place")
    other = shared.filter(F.col("place") <= F.col("prefix")).select("star", "item", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "size", "place")])
    fits = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    # At their first common item, enough items must be left in both.
    enough = 2 * (1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))) >= F.col("size") + F.col("size_b") - F.floor(k * (F.col("n") + F.col("n_b")) + 1e-9)
    pairs = skew_join(far, other, ["star", "item"]).filter((F.col("node") != F.col("node_b")) & (F.col("label") != F.col("label_b")) & fits & enough)
    return pairs.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct()


def _labelled(docs: DataFrame, words: int, percent: int, steps: int) -> tuple[DataFrame, DataFrame]:
    """The set of every row, and of every set with words: node, its smallest doc_id and its component's label."""
    docs = docs.select("doc_id", "text")
    work = Scratch(docs.sparkSession)
    coded = work.cut("coded", coded_table(docs, words, percent, steps))
    nodes = work.cut("nodes", coded.select("doc_id", "text_hash", "n_shingles", "node"))
    hot = work.cut("hot", hot_entries(entry_rows(coded)))
    slices = [work.cut(f"met{k}", shared_entries(entry_rows(coded, [k]), hot)) for k in range(SLICES)]
    met = reduce(DataFrame.union, slices)
    work.free("coded", "hot")
    # Each set drops its commonest exact segments, as many as its band spares.
    largest = nodes.agg(F.max("n_shingles")).first()[0] or 1
    spare = F.element_at(F.array(*[F.lit(b[4]) for b in bands(percent, steps, 2 * largest + 64)]), F.floor(F.col("kind") / 2).cast("int") + 1)
    common = W.Window.partitionBy("node", "kind").orderBy(F.col("n").desc(), "entry")
    kept = work.cut("kept", met.withColumn("place", F.row_number().over(common)).filter((F.col("kind") % 2 == 0) | (F.col("place") > spare)).select("entry", "node"))
    work.free(*[f"met{k}" for k in range(SLICES)])
    return nodes, linked_sets(docs, nodes, kept, words, percent, work)


def linked_sets(docs: DataFrame, nodes: DataFrame, kept: DataFrame, words: int, percent: int, work: Scratch, likely: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """(node, doc_id, label) of every set with words: its smallest doc_id and its component, from the index entries kept (entry, node).

    nodes: doc_id, text_hash, n_shingles, node of each row of docs. Both are tables of work; kept is freed. likely, if there is
    one, leaves out pairs of these two columns that are surely no links before their sets are compared.
    """
    shared = work.cut("shared", kept.groupBy("entry").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).filter(F.col("least") != F.col("most")).select("entry", "n"))
    # The star of an entry is its set with the most company over all entries: an original rather than one of its variants.
    known = skew_join(kept, shared, "entry", counts=shared)
    known = work.cut("known", known.select("entry", "node", F.sum("n").over(W.Window.partitionBy("node")).alias("company")))
    work.free("kept")
    star = known.groupBy("entry").agg(F.max(F.struct("company", "node")).alias("top")).select("entry", F.col("top.node").alias("star"), F.col("top.company").alias("star_company"))
    starred = work.cut("starred", skew_join(known, star, "entry", counts=shared).select("entry", "node", "star", "star_company"))
    work.free("known")
    ids = nodes.filter(F.col("n_shingles") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("text_hash"))
    ids = work.cut("ids", ids)
    first = starred.groupBy("node").agg(F.max(F.when(F.col("node") != F.col("star"), F.struct("star_company", "star"))).alias("top"))
    texts = work.cut("texts", first.join(ids, "node").select("doc_id", "text_hash", "node", F.col("top.star").alias("star")))
    if likely:
        near = likely(texts.filter(F.col("star").isNotNull()).select("node", "star"), "node", "star")
        texts = work.cut("likely", texts.drop("star").join(near, "node", "left").select("doc_id", "text_hash", "node", "star"))
    repeats = nodes.filter(F.col("n_shingles") > 0).groupBy("doc_id", "text_hash").count().filter(F.col("count") > 1).limit(1).count() > 0
    sets = work.cut("sets", _sets_of(docs, texts, words, repeats))
    links = work.cut("links1", _first_links(sets, percent))
    labels = components(links)
    # What the entries that still hold several components have around their stars.
    placed = work.cut("placed", starred.join(labels, "node", "left").select("entry", "node", "star", F.coalesce("label", "node").alias("label")))
    several = placed.groupBy("entry").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") != F.col("high")).select("entry")
    rest = work.cut("rest", skew_join(placed, several, "entry", counts=shared).filter(F.col("node") != F.col("star")).select("star", "node").distinct())
    work.free("starred", "shared", "placed", "texts")
    if rest.limit(1).count():
        near = work.cut("near", _differences(rest, sets, percent))
        links = work.cut("links2", links.union(near.filter("linked").select(F.col("node").alias("a"), F.col("star").alias("b"))))
        labels = components(links)
        apart = _apart(near, labels, percent, work)
        pairs = work.cut("pairs", likely(apart, "a", "b") if likely else apart)
        work.free("shared_items")
        final = work.cut("final", _verified(pairs, sets, percent))
        if final.limit(1).count():
            labels = components(links.union(final))
    work.free("sets", "rest", "pairs")
    named = work.cut("named", ids.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label")))
    work.free("links1", "links2", "final", "ids", "likely")
    return named


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, steps: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to, its own included) of every row.

    Two texts link when 100 * shared >= percent * union of their distinct shingles of so many words (white space apart,
    A-Z in lower case). Texts without words link with nothing, not even each other. Equal sets are one node from the
    start. Null ids get their component's smallest id, or null. Repeated rows are repeated. Empty in, empty out.
    Shingles and sets are told apart by 64-bit hashes.
    """
    nodes, placed = _labelled(docs, words, percent, steps)
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = cut(skew_join(placed, least, "label").select("node", "component_id"))
    # A set may have very many copies.
    full = skew_join(nodes, named, "node", how="left")
    return full.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near copies: of each component one row stays, rows without words all stay.

    It is the row of the smallest doc_id (nulls last), then of the smallest set mark and text hash, then the smallest by
    all columns. So ids may be null or repeat: texts that aren't near copies stay whatever their ids.
    """
    nodes, placed = _labelled(docs, words, percent, 2)
    rows = nodes.filter(F.col("n_shingles") > 0)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "text_hash")
    # Least of each set first: a set with very many copies is one row before it meets its label.
    least = rows.groupBy("node").agg(F.min(key).alias("key")).join(placed.select("node", "label"), "node").groupBy("label").agg(F.min("key").alias("key"))
    stays = least.select(F.col("key.doc_id").alias("__tb_id"), F.col("key.text_hash").alias("__tb_hash"))
    met = F.col("doc_id").eqNullSafe(F.col("__tb_id")) & (F.col("text_hash") == F.col("__tb_hash"))
    keys = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).join(stays.withColumn("stays", F.lit(True)), met, "left")
    keys = cut(keys.filter(F.col("stays").isNull() | (F.col("n") > 1)).select(F.col("doc_id").alias("__tb_id"), F.col("text_hash").alias("__tb_hash"), F.col("stays").isNotNull().alias("stays")))

    def lookup(side: DataFrame, few: int) -> DataFrame:
        side = side.drop("stays")
        return F.broadcast(side) if few <= BROADCAST_ROWS and 24 * few <= BROADCAST_BYTES else side

    gone, repeated = keys.filter(~F.col("stays")), keys.filter("stays")
    n_gone, n_repeated = gone.count(), repeated.count()
    met = F.col("doc_id").eqNullSafe(F.col("__tb_id")) & (F.xxhash64("text") == F.col("__tb_hash"))
    kept = docs.join(lookup(gone, n_gone), met, "left_anti")
    if not n_repeated:
        return kept
    repeated = lookup(repeated, n_repeated)
    one = kept.join(repeated, met, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(repeated, met, "left_anti").unionByName(one)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85, steps=2)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words),
sized AS (SELECT doc_id, g, len(g) AS n FROM grams),
sorted AS (SELECT doc_id, list_sort(g) AS s, len(g) AS n FROM grams WHERE len(g) > 0),
marks AS (SELECT min(doc_id) AS node, s, n FROM sorted GROUP BY s, n),
items AS (SELECT node, n, unnest(s) AS item FROM marks),
shared AS (
  SELECT a.node AS x, b.node AS y FROM items a JOIN items b ON a.item = b.item AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM shared UNION ALL SELECT y, x FROM shared),
reach AS (SELECT node, node AS r FROM marks UNION SELECT e.x, reach.r FROM reach JOIN edges e ON e.y = reach.node AND reach.r < e.x),
least_ AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CASE WHEN s.n = 0 THEN s.doc_id ELSE l.component_id END AS component_id
FROM sized s LEFT JOIN marks m ON list_sort(s.g) = m.s LEFT JOIN least_ l ON l.node = m.node
"""
