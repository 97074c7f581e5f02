"""A training-data pipeline over documents: each stage applies one operator to all that its predecessor kept.

Every stage takes null ids, texts, sources and lengths, empty texts, repeated rows and an empty table, which stays empty.
Columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import jaccard, mixing, pieces, secrets, toxicity
from tabulon.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5. Null texts score as empty ones, by the model's bias; repeated rows stay or go together."""
    return toxicity.without_toxic(docs.select(*COLUMNS), toxicity.toxicity_model(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are linked at 0.8: the smallest id, null last. Null texts and texts without words all stay."""
    return jaccard.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and n_chars put right. Null and empty texts stay."""
    return secrets.redact(docs.select(*COLUMNS), length="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it, at most three times. Null is a source of its own, the last; texts without words have size 0."""
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size"))
    return mixing.emit(mixing.mix_sources(sized)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each whole text: doc_id, source, n_tokens, ids. Null and empty texts have none."""
    coded = pieces.encode_documents(docs, keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("secret scans", redact_secrets), ("source mixing", mix), ("SentencePiece encoding", encode)]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.cut(str(k), stage(spark, docs, sf_dir))
        if k:
            work.free(str(k - 1))
    return docs
