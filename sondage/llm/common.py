"""Shared helpers: scratch tables in the cluster's shared folder, Arrow iteration, bounded caches and key filters."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Batches between the executor and its Python workers: both hold one or two of them for each task.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8m")}


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, where it has Spark's own values: 10,000 long texts make batches of hundreds of megabytes."""
    for key, (own, bound) in _BATCH.items():
        if spark.conf.get(key, own) == own:
            spark.conf.set(key, bound)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset a session on one machine takes a temporary folder; on a cluster, whose executors could not read it, this raises."""
    bound_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within it, a job's shuffle files go as soon as the job has written its table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, *partition_by: str, block_mb: int = 16) -> DataFrame:
    """Write ``df`` as a zstd Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", block_mb << 20)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffle_cleanup(spark):
        writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete scratch tables of ``materialize`` that nothing reads any more: what was derived from them is written."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


_HELD: list[tuple[Hashable, Any]] = []


def worker_cache(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``key`` in this Python worker. A worker holds one such thing at a time: Spark reuses workers for later stages, whose caches would add up."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        give_back()
        _HELD.append((key, make()))
    return _HELD[0][1]


def forget() -> None:
    """Drop what the worker holds, where filling it anew costs a task less than keeping it costs the executor: idle workers live on for a minute."""
    _HELD.clear()
    give_back()


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return memory that this worker has freed to the system: an idle worker keeps it otherwise, beside the executor's own."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: A key filter has at most so many 64-bit words: 2 million rows are broadcast, whatever the number of keys.
_MOST_WORDS = 1 << 21


def key_filter(rows: DataFrame, *key: Column) -> Callable[..., DataFrame]:
    """A blocked Bloom filter of the values ``key`` of ``rows``, as a function (table, *its key) that adds a boolean column ``_may_hold`` to the table.

    Each key sets four bits of one 64-bit word; there are four keys to a word, up to ``_MOST_WORDS`` words, which are broadcast as a table. With more keys than that, more rows are marked that have no such key; one that has it always is.
    """
    words = min(_MOST_WORDS, 1 << max(6, (rows.count() // 4).bit_length()))

    def split(*key: Column) -> dict[str, Column]:
        places = F.xxhash64(*key, F.lit("bits"))
        mask = F.lit(0).cast("long")
        for at in (0, 16, 32, 48):
            place = F.shiftrightunsigned(places, at).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
        return {"_word": F.xxhash64(*key).bitwiseAND(F.lit(words - 1)), "_mask": mask}

    table = materialize(rows.select(*(c.alias(n) for n, c in split(*key).items())).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")), "key-filter")

    def mark(df: DataFrame, *key: Column) -> DataFrame:
        found = df.withColumns(split(*key)).join(F.broadcast(table), "_word", "left")  # at most _MOST_WORDS rows
        may = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
        return found.withColumn("_may_hold", may).drop("_word", "_mask", "_bits")

    return mark


def pack(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most`` bytes of ``text``; one longer text is a run of its own."""
    for batch in batches:
        column = batch.column(text)
        sizes = [0 if x is None else x for x in pc.binary_length(column).to_pylist()]
        begin = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < batch.num_rows:
            yield batch.slice(begin)
    give_back()
