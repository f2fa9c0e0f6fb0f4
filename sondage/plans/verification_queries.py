"""Numbers of whole documents, and answers about parts held against what is recorded of these.

SQL of the twin engine has no look-around, so the numbers of documents are held against a scanner in the tests; the answers about parts are made so that SQL can tell which of their sentences are wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import verification
from sondage.sources.bindings import spread, table

from .registry import query


@query()
def x4_numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of all documents, with the units that their tables declare."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return verification.number_rows(texts).select(F.col("id").alias("doc_id"), "k", F.col("exact").alias("value"), "unit", "raw")


def _price() -> F.Column:
    return F.format_string("%.1f", "p_retailprice")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), "p_partkey")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a wrong size, a cause, a false citation or another series, by part key."""
    key = F.col("p_partkey")
    size = F.col("p_size") + F.when(key % 3 == 0, 1000).otherwise(0)
    text = F.concat(F.lit("## Price of "), "p_name", F.lit("\nThe price was "), _price(), F.lit(" [1]. Size "), size.cast("string"), F.lit(" was noted [2]. It fell due to weather [1].\n\n## Outlook\n"), F.when(key % 5 == 0, "See more [7].").otherwise("It stays open [2]."), F.when(key % 7 == 0, F.concat(F.lit("\nBeside it "), "p_type", F.lit(" matters [1]."))).otherwise(""))
    return _parts(spark, sf_dir).select(key.alias("answer_id"), text.alias("text"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.struct(F.lit(1).alias("ref_no"), F.concat(F.lit("price "), _price()).alias("text")), F.struct(F.lit(2).alias("ref_no"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("text")))
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("answer_id"), F.explode(known).alias("e")).select("answer_id", "e.*")


_FAMILY = "array<struct<family:string,names:array<string>,least:int>>"


def _scopes(spark: SparkSession, sf_dir: str, families: bool = False) -> DataFrame:
    bar = F.array(F.struct(F.lit("bar").alias("family"), F.array(F.col("p_name"), F.lit("Nowhere")).alias("names"), (1 + F.col("p_partkey") % 2).cast("int").alias("least")))
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("answer_id"), F.array("p_name").alias("selected"), F.array("p_type").alias("excluded"), (bar if families else F.array().cast(_FAMILY)).alias("families"), (F.col("p_partkey") % 4 == 0).alias("no_mapping"))


_MADE = """p AS (SELECT p_partkey AS answer_id, p_name, p_type, printf('%.1f', p_retailprice) AS price, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1000 ELSE 0 END AS n, p_partkey AS k FROM part),
w AS (SELECT *, k % 3 = 0 AND price <> n || '.0' AS wrong, k % 4 = 0 AS cause, k % 5 = 0 AS lost, k % 7 = 0 AS beside FROM p)"""


@query(f"WITH {_MADE} SELECT answer_id, n || '.000000000' AS value, CAST(NULL AS VARCHAR) AS unit, CAST(n AS VARCHAR) AS raw FROM w WHERE wrong")
def e8_unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verification.unsupported_numbers(_answers(spark, sf_dir), _evidence(spark, sf_dir).withColumnRenamed("ref_no", "nth"))
    return found.withColumn("value", F.col("value").cast("string"))


@query(f"WITH {_MADE} SELECT answer_id, CASE WHEN beside THEN p_type ELSE '' END AS outside, CASE WHEN k % 2 = 1 THEN 'bar' ELSE '' END AS lacking FROM w")
def e10_series_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer is about one part; it must name two of its series where the key is odd."""
    found = verification.series_scope(_answers(spark, sf_dir), _scopes(spark, sf_dir, families=True))
    return found.select("answer_id", F.array_join("outside", ",").alias("outside"), F.array_join("lacking", ",").alias("lacking"))


@query(f"WITH {_MADE} SELECT answer_id, CAST(1 AS BIGINT) AS n_claims FROM w WHERE cause")
def e11_unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _answers(spark, sf_dir).select("answer_id", F.posexplode(verification.segments(F.col("text"))).alias("nth", "segment"))
    found = verification.unsupported_claims(parts, _evidence(spark, sf_dir), _scopes(spark, sf_dir).filter("no_mapping"))
    return found.groupBy("answer_id").agg(F.count("*").alias("n_claims"))


@query(f"""WITH {_MADE}, r AS (SELECT *, '## Price of ' || p_name || chr(10) || 'The price was ' || price || ' [1].' || CASE WHEN wrong THEN '' ELSE ' Size ' || n || ' was noted [2].' END || CASE WHEN cause THEN '' ELSE ' It fell due to weather [1].' END
  || CASE WHEN lost THEN '' ELSE chr(10) || chr(10) || '## Outlook' || chr(10) || 'It stays open [2].' END AS kept FROM w)
SELECT answer_id, CASE WHEN NOT (wrong OR cause OR lost OR beside) THEN 'accepted' WHEN beside THEN 'fallback' ELSE 'repaired' END AS disposition, concat_ws(',', CASE WHEN lost THEN 'LLM_CITATION_VALIDATION_FAILED' END, CASE WHEN wrong THEN 'LLM_NUMERIC_VALIDATION_FAILED' END, CASE WHEN beside THEN 'LLM_CHART_SCOPE_VALIDATION_FAILED' END, CASE WHEN cause THEN 'LLM_CHART_INFERENCE_VALIDATION_FAILED' END) AS warnings,
  CAST(CASE WHEN wrong OR cause OR lost THEN wrong::INT + cause::INT + lost::INT ELSE 0 END AS BIGINT) AS n_removed, CASE WHEN (wrong OR cause OR lost) AND NOT beside THEN kept END AS repaired FROM r""")
def e12_repair_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verification.repair_answers(_answers(spark, sf_dir), _evidence(spark, sf_dir), _scopes(spark, sf_dir))
    return found.withColumn("warnings", F.array_join("warnings", ","))
