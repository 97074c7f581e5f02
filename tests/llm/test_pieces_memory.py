"""What tasks of the encoding hold at once."""

import random

import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import common, pieces


def test_remembered_words_are_bounded_in_characters():
    rng, model = random.Random(5), pieces.Model(open(pieces.MODEL, "rb").read())
    for _ in range(64):  # few words, but long ones
        model.encode(["".join(rng.choices("abcdefgh", k=100_000))])
    assert sum(map(len, model.words)) < 5_000_000


def test_tasks_get_and_return_few_rows_at_once(spark):
    rows = ((f"{i}", i, np.arange(5_000)) for i in range(200))
    sizes = [b.num_rows for b in pieces._in_batches(rows, "mark string, no int, ids array<int>")]
    assert sum(sizes) == 200 and max(sizes) < 60

    def count(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    texts = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 16_384).alias("text"))
    sizes = [r.n for r in common.cut(texts.mapInArrow(count, "n long"), batch_bytes=4 << 20).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 520
    assert spark.conf.get(common.BATCH_BYTES, None) is None
