"""Ingestion and deletion over the shared documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import lifecycle
from sondage.sources.bindings import table

from .registry import query


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("document_id"), lifecycle.content_hash(F.col("text")).alias("sha256"), (F.col("doc_id") % 5 + 1).alias("version_no"))


_H = "h AS (SELECT lang AS workspace_id, doc_id AS document_id, sha256(text) AS sha256, doc_id % 5 + 1 AS version_no FROM documents)"


@query(f"WITH {_H} SELECT workspace_id, document_id, sha256 FROM h")
def s7_write_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).drop("version_no")


@query(f"""WITH {_H}, e AS (SELECT * FROM h WHERE document_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY workspace_id, sha256 ORDER BY version_no DESC, document_id DESC) = 1)
SELECT n.workspace_id, n.sha256, n.document_id, coalesce(e.document_id, n.document_id) AS used_id FROM h n LEFT JOIN e USING (workspace_id, sha256) WHERE n.document_id % 2 = 1""")
def s8_reuse_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids arrive, those with even ids exist."""
    rows = _hashed(spark, sf_dir)
    return lifecycle.dedup_by_content(rows.filter("document_id % 2 = 1").drop("version_no"), rows.filter("document_id % 2 = 0"), "reuse")


@query(f"WITH {_H} SELECT workspace_id, document_id, sha256 FROM h QUALIFY row_number() OVER (PARTITION BY workspace_id, sha256 ORDER BY document_id) = 1")
def d1_first_of_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.keep_first(_hashed(spark, sf_dir).drop("version_no"), ["workspace_id", "sha256"], ["document_id"])


@query(f"WITH {_H} SELECT workspace_id, document_id, sha256, CASE WHEN document_id % 3 = 0 THEN version_no + 2 ELSE version_no END AS version_no FROM h")
def s10_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document comes again twice, with higher versions."""
    rows = _hashed(spark, sf_dir)
    again = rows.filter("document_id % 3 = 0").withColumn("version_no", F.explode(F.array(F.col("version_no") + 1, F.col("version_no") + 2)))
    return lifecycle.upsert(rows, again, ["document_id"], "version_no")


@query("SELECT 'documents' AS table_name, count(*) AS deleted FROM documents WHERE source = 'src3' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def p1_purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    tables = {"documents": (docs, "doc_id"), "labels": (table(spark, sf_dir, "labels"), "doc_id"), "embeddings": (table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")}
    return lifecycle.purge(tables, docs.filter("source = 'src3'"), "doc_id")[1]


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def p2_purged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return lifecycle.purge({"labels": (table(spark, sf_dir, "labels"), "doc_id")}, docs.filter("source = 'src3'"), "doc_id")[0]["labels"]


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN doc_id % 10 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def p3_apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth label is corrected."""
    points = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("revision"), F.lit(0.5).alias("confidence"), "quality")
    return lifecycle.apply_corrections(points, points.filter("doc_id % 10 = 0").select("doc_id", (1 - F.col("quality")).alias("quality")), "doc_id")
