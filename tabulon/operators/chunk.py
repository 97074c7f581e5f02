"""Chunks of documents: packing paragraphs, and sentences, with carry-over."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose chunks are Python strings at a time.
FOLDED = 256


def pack(parts: list[str], most: int, overlap: int, glue: str) -> list[str]:
    """Parts joined by glue into chunks of about `most` characters; each begins with the last `overlap` characters of the one before it."""
    now, out = "", []
    for part in parts:
        if now and len(now) + len(part) > most:
            out.append(now)
            now = (now[-overlap:] if overlap else "") + glue + part
        else:
            now = now + glue + part if now else part
    return [*out, now] if now else out


def pack_sentences(parts: list[str], target: int, most: int, overlap: int, words: int) -> list[str]:
    """Sentences packed towards `target` characters with an overlap of characters; a sentence beyond `most` is cut at words, each piece beginning with the last `words` words of the one before it."""
    fine: list[str] = []
    for part in parts:
        if len(part) <= most:
            fine.append(part)
            continue
        own: list[str] = []
        size = 0
        for word in part.split(" "):
            if own and size + 1 + len(word) > most:
                fine.append(" ".join(own))
                own = own[-words:] if words else []
                size = len(" ".join(own))
            size += len(word) + (1 if own else 0)
            own.append(word)
        fine.append(" ".join(own))
    return pack(fine, target, overlap, " ")


def _packer(parts: Column, fold) -> Column:
    """A fold over each row's parts; null parts give null. FOLDED rows at a time are Python strings, Arrow arrays before and after."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        done = []
        for a in range(0, len(rows), FOLDED):
            some = rows.slice(a, FOLDED)
            words, at, out = some.flatten().to_numpy(zero_copy_only=False).tolist(), 0, []
            for n in pc.list_value_length(some).to_pylist():
                out.append(None if n is None else fold(words[at : at + n]))
                at += n or 0
            done.append(pa.array(out, pa.list_(pa.string())))
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return run(parts)


def packed(parts: Column, most: int, overlap: int, glue: str) -> Column:
    """The chunks of each row's parts, as pack makes them: a chunk depends on all before it, so a text is folded in one pass, linear in its length."""
    return _packer(parts, partial(pack, most=most, overlap=overlap, glue=glue))


def packed_sentences(parts: Column, target: int = 800, most: int = 1200, overlap: int = 200, words: int = 20) -> Column:
    """The chunks of each row's sentences, as pack_sentences makes them."""
    return _packer(parts, partial(pack_sentences, target=target, most=most, overlap=overlap, words=words))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(F.regexp_replace(p, r"[ \t\r\n]+", " "))), lambda p: p != "")


def sentences(text: Column) -> Column:
    marked = F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), r"([.!?]) ", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda p: p != "")


def numbered_chunks(docs: DataFrame, id_: str, texts: Column, least: int = 100) -> DataFrame:
    """id, chunk_number (from 0), text, chunk_id of every chunk of at least `least` characters; rows without chunks have none."""
    rows = docs.select(id_, F.posexplode(texts).alias("chunk_number", "text"))
    key = F.concat_ws("_", F.col(id_).cast("string"), F.col("chunk_number").cast("string"), F.substring(F.md5("text"), 1, 8))
    return rows.filter(F.length("text") >= least).withColumn("chunk_id", key)


def chunks(docs: DataFrame, id_: str, parts: Column, most: int = 1000, overlap: int = 200, least: int = 100, glue: str = "\n") -> DataFrame:
    """The numbered chunks of packed parts."""
    return numbered_chunks(docs, id_, packed(parts, most, overlap, glue), least)
