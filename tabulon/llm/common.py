"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side of at most so many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
#: A key is hot if it holds more than one in HOT_KEYS of the rows (so there are fewer than HOT_KEYS), and HOT_ROWS at least.
HOT_KEYS, HOT_ROWS = 10_000, 128
#: Shuffle files are of no use once a cut table is written; Spark then frees them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python workers in batches of at most 10,000; this also bounds their bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The rows of a Parquet row group.
GROUP_ROWS = "parquet.block.row.count.limit"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster for cut lineage, as the session names it in spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, is a temporary folder used if it names none.
    """
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame, path: str | None = None, batch_bytes: int | None = None, group_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: executors may be lost after this without recomputing df.

    The files go when the driver's JVM ends, if not before. batch_bytes: Python workers get about so many bytes at once.
    group_rows: tasks hold so many rows of the table at most, for rows of megabytes. Spark's writer otherwise looks at the
    size of what it holds only after 100 rows, and its reader decodes up to 4,096 rows of a row group at once.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/tabulon/{uuid.uuid4().hex}"
    held = {FREE_SHUFFLES: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        (df.write.option(GROUP_ROWS, group_rows) if group_rows else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class Scratch:
    """Named cut tables of one job, which are freed once nothing is read from them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tabulon/{uuid.uuid4().hex}"

    def cut(self, name: str, df: DataFrame, batch_bytes: int | None = None, group_rows: int | None = None) -> DataFrame:
        return cut(df, f"{self.root}/{name}", batch_bytes, group_rows)

    def free(self, *names: str) -> None:
        for name in names:
            files, where = _files(self.spark, f"{self.root}/{name}")
            files.delete(where, True)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small DataFrame of driver-side numbers, as SQL literals (no Python worker reads it)."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))).limit(0)
    text = lambda v, k: "CAST(NULL AS %s)" % k if v is None else f"CAST('{v!r}' AS {k})"
    body = ", ".join("(" + ", ".join(text(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def lookup_join(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join of big with a lookup table (unique on key, nulls match nulls), safe against hot keys.

    The lookup side is measured: within BROADCAST_ROWS and BROADCAST_BYTES it is broadcast; beyond, hot keys are dealt
    over as many parts as their share asks for, so that no key lands whole in one task.
    """
    size = small.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length(F.col(key).cast("string")), F.lit(0)) + 8 * len(small.columns)).alias("b")).first()
    if size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES:
        own = small.withColumnRenamed(key, "__tb_key")
        return big.join(F.broadcast(own), big[key].eqNullSafe(own["__tb_key"]), "left").drop("__tb_key")
    plain = {"__tb_null": F.col(key).isNull(), "__tb_value": F.coalesce(F.col(key).cast("string"), F.lit(""))}
    return skew_join(big.withColumns(plain), small.withColumns(plain).drop(key), ["__tb_null", "__tb_value"], how="left").drop(*plain)


def hot_keys(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(keys, __tb_parts) of the hot keys of rows: fewer than HOT_KEYS rows, so they may be broadcast at any size of rows.

    counts: (keys, n) of all keys with several rows, if they are known.
    """
    total = rows.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    return counts.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("__tb_parts"))


def dealing(df: DataFrame) -> Column:
    """A hash of a whole row, to deal rows by."""
    plain = lambda k: not any(x in k.typeName() for x in ("map", "variant")) and "map<" not in k.simpleString()
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if plain(f.dataType)])


def skew_join(big: DataFrame, small: DataFrame, keys: str | list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Join of big with small on equal keys, where one key may hold any share of big's rows.

    Rows of a hot key are dealt over parts in proportion to its share, and small's rows of that key are repeated once
    per part. big is read three times, so it should be a table. counts as in hot_keys.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = F.broadcast(hot_keys(big, keys, counts))
    left = big.join(hot, keys, "left").withColumn("__tb_part", F.coalesce(F.pmod(dealing(big), F.col("__tb_parts")), F.lit(0)).cast("int"))
    right = small.join(hot, keys, "left").withColumn("__tb_part", F.explode(F.sequence(F.lit(0), F.coalesce("__tb_parts", F.lit(1)) - 1)))
    return left.drop("__tb_parts").join(right.drop("__tb_parts"), [*keys, "__tb_part"], how).drop("__tb_part")


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone; SQL engines with md5 agree on it."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def kept_in_process(key: str, make):
    """What make() gave when a task of this Python worker first asked for key. Functions travel by value, so each task has
    its own copy of a module's globals; a module of the interpreter outlives the task."""
    held = sys.modules.setdefault("_tabulon_kept", types.ModuleType("_tabulon_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Returns what this Python worker has freed to the system: it stays for later stages, whose memory it would take."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


# ---- texts inside tasks, as bytes of Arrow columns ----


def utf8_parts(column, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of an Arrow string column: (first row, end row, bytes, offsets of the rows and the end), in parts of at most
    most_bytes bytes or one row. Nulls are empty."""
    import pyarrow as pa

    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        if not n:
            continue
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1)
            yield at, min(to, n), raw[ends[at] : ends[min(to, n)]], ends[at : min(to, n) + 1] - ends[at]
            at = to


#: Odd multiplier of the rolling word hash, and its powers and inverse powers modulo 2**64, grown on demand.
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (murmur's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends), which don't overlap and come in order.

    Equal spans have equal hashes. Works through the bytes in windows, so memory stays bounded for long texts.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + window, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mixed(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


NOT_SPACE = ~_SPACE


def word_spans(data: np.ndarray, offsets: np.ndarray, members: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (longest runs of member bytes) of rows of UTF-8 bytes: starts, ends, and the number of words before each row and the end."""
    inner = members[data]
    edge = np.empty(len(data) + 1, bool)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge[0], edge[-1] = inner[0], inner[-1]
    np.not_equal(inner[1:], inner[:-1], out=edge[1:-1])
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    cuts = cuts[inner[cuts] & inner[cuts - 1]]  # a word ends where its row ends
    marks = np.flatnonzero(edge)
    starts, ends = np.sort(np.concatenate([marks[::2], np.unique(cuts)])), np.sort(np.concatenate([marks[1::2], np.unique(cuts)]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]
