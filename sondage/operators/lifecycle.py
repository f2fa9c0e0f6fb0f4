"""Ingestion by content, upserts, deletion and corrections as new snapshots of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def dedup_by_content(new: DataFrame, existing: DataFrame, mode: str) -> DataFrame:
    """New documents (workspace_id, document_id, sha256) against existing ones (also version_no) of the same workspace and content.

    reuse: each new row with the document it stands for (the latest of equal ones). new_version: the version it gets, rows of one content in the order of their ids. reject: rows that exist already.
    """
    key = ["workspace_id", "sha256"]
    known = existing.groupBy(*key).agg(F.max(F.struct("version_no", F.col("document_id").alias("existing_id"))).alias("latest"))
    if mode == "reject":
        return new.join(known, key, "left_semi")
    rows = new.join(known, key, "left")
    if mode == "reuse":
        return rows.select(*key, "document_id", F.coalesce("latest.existing_id", "document_id").alias("used_id"))
    if mode == "new_version":
        # equal documents that arrive together get versions of their own
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("document_id"))
        return rows.select(*key, "document_id", (F.coalesce("latest.version_no", F.lit(0)) + nth).alias("version_no"))
    raise ValueError(mode)


def upsert(target: DataFrame, source: DataFrame, key: list[str], newest: str | None = None) -> DataFrame:
    """Target rows without those whose key the source has, and the source; of source rows with one key the one that is greatest by the column ``newest`` (any one, where it is not given)."""
    fresh = source.dropDuplicates(key) if newest is None else keep_first(source, key, [F.desc(newest)])
    return target.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def purge(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """New snapshots of the tables (name: table, its foreign key) without the rows of ``keys``, and deleted counts per table."""
    gone = keys.select(F.col(key).alias("_key")).distinct()
    kept, counts = {}, None
    for name, (rows, column) in tables.items():
        kept[name] = rows.join(gone, rows[column] == gone["_key"], "left_anti")
        n = rows.join(gone, rows[column] == gone["_key"], "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def apply_corrections(points: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Points (key, revision, ...) of corrected keys are replaced: confidence 1, revision one higher than the last."""
    last = points.groupBy(key).agg(F.max("revision").alias("_last"))
    fresh = corrections.join(last, key, "left").withColumns({"revision": F.coalesce("_last", F.lit(0)) + 1, "confidence": F.lit(1.0)}).drop("_last")
    return points.join(corrections.select(key).distinct(), key, "left_anti").unionByName(fresh)
