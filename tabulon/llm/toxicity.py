"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Groups of a bounded sample of labelled texts train apart, each with per-coordinate rates and L1 sparsity; their weights
are averaged per coordinate, and the few that are not zero are broadcast to score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import cut, give_back, hash_share, lowered, mixed, span_hashes, table, utf8_parts, word_spans

if TYPE_CHECKING:
    import pyarrow as pa

#: Features are hashed to so many bits; this bounds the model.
BITS = 20
#: At most about so many labelled rows are used, in groups of GROUP_ROWS and GROUP_BYTES of text that train apart.
MAX_TRAIN_ROWS, GROUP_ROWS, GROUP_BYTES = 32_768, 8_192, 64 << 20
#: Features of about so many bytes of text are held at once.
PART_BYTES = 1 << 18
#: A longer word also counts by its first so many bytes.
STEMS = (4, 6)
#: Rate, its smoothing, L1 and L2 strength, passes over a group's rows.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 9.0, 0.05, 4
#: Rows of the rarer label 1 count by the labels' ratio to this power, at most so much.
BALANCE, MOST_WEIGHT = 1.0, 4.0

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte letters U+00C0 to U+00DE."""
    out = lowered(data)
    if len(out) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[up] += 0x20
    return out


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, word stem, word pair and pair around one word, in rows of UTF-8 bytes; not distinct."""
    folded = _folded(data)
    starts, ends, before = word_spans(folded, offsets, _LETTER)
    words = span_hashes(folded, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    rows, found = [row], [mixed(words + np.uint64(1))]
    for length in STEMS:
        long = np.flatnonzero(ends - starts > length)
        rows.append(row[long])
        found.append(mixed(span_hashes(folded, starts[long], starts[long] + length) + np.uint64(length)))
    for gap in (1, 2):
        if len(words) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            found.append(mixed(words[:-gap] * np.uint64(2 * gap + 1) + np.uint64(gap) + mixed(words[gap:]))[same])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dense weights and bias from rows of distinct features (each of value 1) and 0/1 labels."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    base = (labels.sum() + 0.1) / (len(labels) + 1)
    bias, bias_n = float(np.log(base / (1 - base))), 1.0
    heavier = min(MOST_WEIGHT, max(1.0, (1 - base) / base) ** BALANCE)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            f = rows[i]
            zi, ni = z[f], n[f]
            w = weight(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - labels[i]) * (heavier if labels[i] else 1.0)
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[f] = ni + g * g
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    return weight(z, n), bias


def _train_group(group: pa.Table) -> pa.Table:
    """The weights that a group's rows (doc_id, label, text, mark) train, in the order of doc_id and mark; -1 has the bias.

    Texts stay the bytes that came, and only PART_BYTES of them are features of 64 bits at once.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rows: list[np.ndarray] = []
    for _, _, data, offsets in utf8_parts(group.column("text"), PART_BYTES):
        row, feature = text_features(data, offsets)
        pairs = np.unique(row << BITS | feature)
        own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        rows += np.split(own, np.searchsorted(pairs >> BITS, np.arange(1, len(offsets) - 1)))
    order = pc.sort_indices(group.select(["doc_id", "mark"]), sort_keys=[("doc_id", "ascending"), ("mark", "ascending")]).to_numpy()
    labels = group.column("label").to_numpy().astype(float)
    del group
    weights, bias = ftrl([rows[i] for i in order], labels[order])
    kept = np.flatnonzero(weights)
    give_back()
    return pa.table({"feature": pa.array(np.append(kept, -1), pa.int64()), "weight": pa.array(np.append(weights[kept], bias), pa.float64())})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict:
    """{features, weights, bias} from labels (doc_id, label) and the texts of docs.

    Repeated labels of a document count as their largest; null ids and labels are left out; equal texts count once.
    Beyond max_rows labels a sample by a hash of doc_id is used, and beyond max_rows texts (an id may hold many) one by a
    hash of the text, so no group that trains together grows with the tables. Without rows the model says 0.1 for every text.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.filter(hash_share(F.lit("train"), F.col("doc_id")) < max_rows / n)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most about max_rows ids and numbers
    n_texts = docs.select("doc_id").join(F.broadcast(known.select("doc_id")), "doc_id").count()
    if n_texts > max_rows:
        texts = texts.filter(hash_share(F.lit("text"), F.md5("text")) < max_rows / n_texts)
    texts = texts.groupBy(F.md5("text").alias("mark")).agg(F.min(F.struct("doc_id", "label", "text")).alias("x")).select("mark", "x.*")
    texts = cut(texts)
    size, n_texts = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    groups = max(1, -(-n_texts // GROUP_ROWS), -(-(size or 0) // GROUP_BYTES))
    parts = texts.withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(groups))).groupBy("part").applyInArrow(_train_group, "feature long, weight double")
    mean = parts.groupBy("feature").agg((F.sum("weight") / F.lit(float(groups))).alias("weight")).toPandas()  # at most 2**BITS rows
    bias = mean.loc[mean["feature"] == -1, "weight"]
    mean = mean[(mean["feature"] >= 0) & (mean["weight"].abs() > 1e-6)].sort_values("feature")
    return {"features": mean["feature"].to_numpy(np.int64), "weights": mean["weight"].to_numpy(np.float64), "bias": float(bias.iloc[0]) if len(bias) else float(np.log(0.1 / 0.9))}


def _scores(column, bias: float, dense: np.ndarray) -> np.ndarray:
    out = np.full(len(column), bias)
    for at, to, data, offsets in utf8_parts(column, PART_BYTES):
        row, feature = text_features(data, offsets)
        hit = dense[feature] != 0
        pairs = np.unique(row[hit] << BITS | feature[hit])
        out[at:to] += np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=to - at)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score_texts(df: DataFrame, model: dict, keep: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """The columns keep of df and a score from 0 to 1 of each whole text; null texts score as empty ones.

    A kept column of the score's name is replaced. Equal texts score alike; repeated rows are repeated. Empty in, empty out.
    """
    keep = [c for c in keep if c != score]
    held = df.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = held.value
        dense = np.zeros(1 << BITS)
        dense[own["features"]] = own["weights"]
        for batch in batches:
            scores = _scores(batch.column("__tb_text"), own["bias"], dense)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, score])
        give_back()

    kinds = dict(df.dtypes)
    inner = df.select(*keep, F.col(text).alias("__tb_text"))
    return inner.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{score} double"]))


def without_toxic(docs: DataFrame, model: dict, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose whole text scores below limit, as they were, with all their columns.

    Null and empty texts score as the model's bias says. Repeated rows stay or go together. Empty in, empty out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = held.value
        dense = np.zeros(1 << BITS)
        dense[own["features"]] = own["weights"]
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), own["bias"], dense) < limit))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, by CRC, never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return train(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, toxicity_model(spark, docs, sf_dir), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
