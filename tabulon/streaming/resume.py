"""Tables that batches write into and that survive a stop at any point: keyed upserts under versions, a ledger of batches, contents computed once.

A table is a list of segments, each a folder of rows that never changes. Its newest manifest says which segments count, in
their order, and which batch of each source was the last to be written. A batch writes its rows as a new segment and then the
next manifest, so it is there as a whole or not at all, and a batch that comes again is known by the ledger and skipped.
Readers see the last row of each key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyedTable:
    """A version of a table at a path. schema is that of its rows."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    version: int = 0
    segments: tuple[str, ...] = ()
    ledger: dict[str, int] = field(default_factory=dict)

    def segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")

    def rows(self) -> DataFrame:
        """The last row of each key, a null key being a key. A table of one segment is read as it is, without a shuffle."""
        if len(self.segments) < 2:
            return self.segment(self.segments[0]) if self.segments else self.spark.createDataFrame([], self.schema)
        parts = [self.segment(s).withColumn("_at", F.lit(i)) for i, s in enumerate(self.segments)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        last = F.max_by(F.struct(*[c for c in whole.columns if c != "_at"]), "_at").alias("row")
        return whole.groupBy(F.col(self.key).alias("_key")).agg(last).select("row.*")


def open_table(spark: SparkSession, path: str, key: str, schema: str, version: int | None = None) -> KeyedTable:
    """The newest version of the table at path, an earlier one, or version 0 without rows where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return KeyedTable(spark, path, key, schema)
    found = spark.read.text(f"{path}/manifest")
    row = (found if version is None else found.filter(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    kept = json.loads(row["value"])
    return KeyedTable(spark, path, key, schema, int(row["version"]), tuple(kept["segments"]), kept["ledger"])


def _publish(table: KeyedTable, segments: tuple[str, ...], ledger: dict[str, int]) -> KeyedTable:
    """Writes the next manifest; that fails if another writer has written it meanwhile."""
    text = json.dumps({"segments": list(segments), "ledger": ledger})
    table.spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("error").text(f"{table.path}/manifest/version={table.version + 1}")
    return KeyedTable(table.spark, table.path, table.key, table.schema, table.version + 1, segments, ledger)


def _written(table: KeyedTable, rows: DataFrame) -> str:
    name = f"{table.version + 1:06d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{table.path}/data/{name}")
    return name


def upsert(table: KeyedTable, rows: DataFrame, source: str, batch: int, order: Column | None = None) -> KeyedTable:
    """The next version, with rows in place of those of their keys; the same version if the source's batch is there already.

    Of several rows of one key the last by order counts, or the largest by all columns. The work is that of the batch.
    """
    if batch <= table.ledger.get(source, -1):
        return table
    columns = [c.split(":")[0].split()[0] for c in table.schema.split(",")] if "<" not in table.schema else rows.columns
    each = F.struct(*[F.col(c) for c in columns])
    one = rows.groupBy(F.col(table.key).alias("_key")).agg((F.max_by(each, F.struct(order, each)) if order is not None else F.max(each)).alias("row")).select("row.*")
    return _publish(table, (*table.segments, _written(table, one)), table.ledger | {source: batch})


def compact(table: KeyedTable) -> KeyedTable:
    """The next version, with the same rows in one segment; older versions stay readable."""
    return _publish(table, (_written(table, table.rows()),), table.ledger)


def upsert_stream(stream: DataFrame, path: str, key: str, checkpoint: str, source: str = "stream", order: Column | None = None):
    """Upserts a stream's batches until its input is used up. Stopped anywhere and started again, it goes on with what isn't in the table."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)

    def write(rows: DataFrame, batch: int) -> None:
        upsert(open_table(rows.sparkSession, path, key, schema.replace("`", "")), rows, source, batch, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def content_key(params: str, *columns: str) -> Column:
    """A hash of the columns' values and of what is computed from them; nulls differ from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", F.lit(params), *parts), 256)


def computed_once(rows: DataFrame, columns: list[str], params: str, compute: Callable[[DataFrame], DataFrame], path: str, schema: str) -> tuple[DataFrame, int]:
    """(rows with the computed columns, the number of contents that were computed now).

    compute gets `_content` and the columns of each distinct content that the store at path doesn't have under these params,
    and gives `_content` and the columns of schema. What it gives is written before it is read, so it is computed once, by
    this call or by none after it. Contents that it gives no row for have nulls, and are asked for again.
    """
    store = open_table(rows.sparkSession, path, "_content", f"_content string, {schema}")
    marked = rows.withColumn("_content", content_key(params, *columns))
    asked = marked.groupBy("_content").agg(*[F.first(c).alias(c) for c in columns])
    unseen = asked.join(store.rows().select("_content"), "_content", "left_anti")
    n = unseen.count()
    if n:
        store = upsert(store, compute(unseen), "contents", store.ledger.get("contents", -1) + 1)
    return marked.join(store.rows(), "_content", "left").drop("_content"), n
