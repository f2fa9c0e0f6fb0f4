"""Text functions over documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import text as X
from sondage.sources.bindings import table

from .registry import query


@query(r"SELECT doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS key FROM documents")
def x1_normal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text; ``x1_whole_key`` gives its digest."""
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, md5(lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g'))) AS key_md5 FROM documents")
def x1_whole_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normal_key(F.col("text"))).alias("key_md5"))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9%一-鿿]', '', 'g')) AS cell_md5 FROM documents")
def x2_normal_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normal_cell(F.col("text"))).alias("cell_md5"))


@query(r"SELECT doc_id, TRY_CAST(nullif(replace(regexp_extract(replace(text, '−', '-'), '([-+]?\d[\d,]*(?:\.\d+)?)', 1), ',', ''), '') AS DOUBLE) AS number FROM documents")
def x3_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.parse_number(F.col("text")).alias("number"))


_TOKENS = "CAST(length(regexp_replace({0}, '[^㐀-䶿一-鿿豈-﫿]', '', 'g')) + ceil(length(regexp_replace({0}, '[㐀-䶿一-鿿豈-﫿]', '', 'g')) / 4.0) AS INTEGER)"


@query(f"SELECT conv_id, turn, {_TOKENS.format('text')} AS tokens FROM conversations")
def x10_estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH k AS (SELECT conv_id, turn, text, max(CASE WHEN substr(text, i, 1) NOT IN (' ', chr(9), chr(10), chr(13)) AND {_TOKENS.format("(left(text, CAST(i AS BIGINT)) || '…')")} <= 20 THEN i ELSE 0 END) AS best FROM conversations, unnest(range(1, 81)) AS u(i) WHERE i <= length(text) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN {_TOKENS.format('text')} <= 20 THEN text ELSE left(text, CAST(best AS BIGINT)) || '…' END AS short FROM k""")
def x11_truncate_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncate_to_tokens(F.col("text"), 20).alias("short"))


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def x19_content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))


@query("SELECT doc_id, CAST(k AS INTEGER) AS k, substr(text, k * 48 + 1, 48) AS delta FROM documents, unnest(range(0, CAST(ceil(length(text) / 48.0) AS BIGINT))) AS u(k) WHERE length(text) > 0")
def x21_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.deltas(F.col("text"))).alias("k", "delta"))


@query(r"""WITH u AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?i)\b(?:FY|CY)?20\d{2}\b'), regexp_extract_all(text, '(?i)\bQ[1-4]\b'), regexp_extract_all(text, '(?i)\bH[12]\b'),
regexp_extract_all(text, '20\d{2}年'), regexp_extract_all(text, '第[一二三四1-4]季度'), regexp_extract_all(text, '\b\d+(?:\.\d+)?%'))) AS c FROM documents) SELECT DISTINCT doc_id, c AS constraint_text FROM u""")
def x22_hard_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.hard_constraints(F.col("text"))).alias("constraint_text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM documents")
def x23_answer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.answer_language(F.col("text")).alias("language"))


@query(r"""WITH u AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[?？!！;；。]+'), lambda c: trim(c, ' ,，')), lambda c: c <> '') AS c FROM documents)
SELECT DISTINCT doc_id, md5(clause) AS clause_md5 FROM (SELECT doc_id, unnest(CASE WHEN len(c) > 0 THEN c ELSE [text] END) AS clause FROM u)""")
def x24_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.clauses(F.col("text"))).alias("clause")).select("doc_id", F.md5("clause").alias("clause_md5"))


@query("WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS t FROM documents) SELECT doc_id, count(DISTINCT t) AS n_terms, md5(string_agg(DISTINCT t, ' ' ORDER BY t)) AS terms_md5 FROM u GROUP BY doc_id")
def x9_semantic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(X.semantic_tokens(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))
