"""Sinks of streams that may be repeated: snapshots by version, and a ledger of batches.

A batch that fails half way is run again with the same number. Each batch writes a new folder of its own number, so a second run replaces what the first left; the ledger's row, written last, makes it count, and a batch that counts already does nothing. Readers take the newest snapshot in the ledger, so they never see half a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LEDGER = "batch_id long, n_rows long, table_version long"


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; of equal ones any, since they are one row written twice."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


class VersionedTable:
    """A Parquet table of snapshots: ``path/data/version=n`` and ``path/ledger/batch=n``."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def ledger(self) -> DataFrame:
        """batch_id, n_rows, table_version of the batches that count."""
        path = f"{self.path}/ledger"
        rows = self.spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(path) if self._exists(path) else self.spark.createDataFrame([], _LEDGER)
        return rows

    def version(self) -> int:
        return self.ledger().agg(F.max("table_version")).first()[0] or 0

    def read(self) -> DataFrame:
        """The newest snapshot."""
        n = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/version={n}") if n else self.spark.createDataFrame([], self.schema)

    def commit(self, batch_id: int, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Write what ``change`` makes of the newest snapshot as the next one, once for each batch; False where the batch counts already."""
        if not self.ledger().filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        n = self.version() + 1
        change(self.read()).write.mode("overwrite").parquet(f"{self.path}/data/version={n}")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/version={n}").count()
        self.spark.createDataFrame([(batch_id, rows, n)], _LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch_id}")
        return True


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``target`` with ``rows`` in the place of those of their keys; of several rows of a key that with the greatest ``order``."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(newest(rows, keys, order).select(*target.columns))


def upsert_sink(table: VersionedTable, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch's rows go into the table by key, once."""

    def write(rows: DataFrame, batch_id: int) -> None:
        table.commit(batch_id, lambda target: upsert(target, rows, keys, order))

    return write


def embed_sink(table: VersionedTable, model: str, dims: int, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over chunks (chunk_id, content_sha256, content): only chunks without a vector of this model, width and content are embedded (``embed`` gives chunk_id, vec), and their vectors replace older ones of the chunk."""

    def write(chunks: DataFrame, batch_id: int) -> None:
        def change(target: DataFrame) -> DataFrame:
            have = target.filter((F.col("model") == model) & (F.col("dims") == dims)).select("chunk_id", "content_sha256")
            missing = chunks.dropDuplicates(["chunk_id", "content_sha256"]).join(have, ["chunk_id", "content_sha256"], "left_anti")
            vectors = missing.select("chunk_id", "content_sha256").join(embed(missing.select("chunk_id", "content")), "chunk_id").withColumns({"model": F.lit(model), "dims": F.lit(dims), "batch": F.lit(batch_id).cast("long")})
            return upsert(target, vectors.select(*target.columns), ["chunk_id"], "batch")

        table.commit(batch_id, change)

    return write
