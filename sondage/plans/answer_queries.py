"""Checks of answers, fused variants and projections over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.operators import evidence, search, tables
from sondage.sources.bindings import CELLS_SQL, YEARLY_SQL, cells, table, yearly_points

from .registry import query
from .verification_queries import _MADE, _answers


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts by quantity, once for each third of the line numbers."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_linenumber") % 3).alias("variant_id"), F.col("l_partkey").alias("chunk_id")).agg(F.sum("l_quantity").alias("n"))
    order = Window.partitionBy("query_id", "variant_id").orderBy(F.desc("n"), "chunk_id")
    return rows.withColumns({"rank": F.row_number().over(order), "weight": F.lit(1.0) + F.col("variant_id") * 0.25}).filter("rank <= 24").drop("n")


_VARIANTS = """v0 AS (SELECT l_suppkey AS query_id, l_linenumber % 3 AS variant_id, l_partkey AS chunk_id, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant_id ORDER BY n DESC, chunk_id) AS rk FROM v0 QUALIFY rk <= 24),
fu AS (SELECT query_id, chunk_id, round(sum((1.0::DOUBLE + variant_id * 0.25::DOUBLE) / (rk + 1)), 8) AS score, string_agg(DISTINCT variant_id::VARCHAR, ',' ORDER BY variant_id::VARCHAR) AS variants FROM v GROUP BY ALL),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fu)"""


@query(f"WITH {_VARIANTS} SELECT * FROM fr")
def r10_fuse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse_variants(_variants(spark, sf_dir))


@query(f"""WITH {_VARIANTS}, s AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN chunk_id * 7919 % 1000 END AS rerank FROM fr)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank > 30, rank <= 30 AND rerank IS NULL, CASE WHEN rank <= 30 THEN -rerank END NULLS FIRST, rank) AS INTEGER) AS rank FROM s""")
def r12_apply_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third part has a score from elsewhere."""
    fused = search.fuse_variants(_variants(spark, sf_dir))
    scores = fused.filter("chunk_id % 3 = 0").select("query_id", "chunk_id", (F.col("chunk_id") * 7919 % 1000).alias("score"))
    return search.apply_rerank(fused.select("query_id", "chunk_id", "rank"), scores, 30)


@query("""WITH w AS (SELECT DISTINCT c_nationkey AS query_id, c_mktsegment AS d FROM customer), h AS (SELECT DISTINCT c_nationkey AS query_id, c_mktsegment AS d FROM customer WHERE c_acctbal > 9000)
SELECT w.query_id, count(h.d) AS covered, COALESCE(string_agg(w.d, ',' ORDER BY w.d) FILTER (h.d IS NULL), '') AS missing FROM w LEFT JOIN h ON w.query_id = h.query_id AND w.d = h.d GROUP BY 1""")
def e7_document_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each nation with a customer of more than 9000."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_mktsegment").alias("document_id"), "c_acctbal")
    found = evidence.document_coverage(rows.select("query_id", "document_id").distinct(), rows.filter("c_acctbal > 9000"))
    return found.withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {_MADE} SELECT answer_id, CASE WHEN lost THEN 3 ELSE 2 END AS n_cited, CASE WHEN lost THEN '7' ELSE '' END AS unknown, NOT lost AS ok FROM w")
def e9_verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir).select("answer_id", F.col("text").alias("answer"), F.lit(2).alias("n_evidence"))
    found = evidence.verify_citations(answers)
    return found.withColumn("unknown", F.array_join(F.transform("unknown", lambda n: n.cast("string")), ","))


def _marks(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, '{mark}', ''))) // {len(mark)} % 2 = 0"


@query(rf"""WITH e AS (SELECT doc_id, text, regexp_replace(text, '(?m)^[ \t]{{0,3}}(?:(?:\*[ \t]*){{3,}}|(?:_[ \t]*){{3,}})$', '', 'g') AS x FROM documents) SELECT doc_id, {_marks("x", "**")} AND {_marks("x", "__")} AND {_marks("text", "```")} AS balanced FROM e""")
def e13_markdown_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", evidence.markdown_balanced(F.col("text")).alias("balanced"))


@query("""SELECT doc_id, round((contains(lower(text), 'the') OR contains(lower(text), 'und'))::INT / 3.0 + (contains(lower(text), 'license') OR contains(lower(text), 'copyright'))::INT / 3.0 + contains(lower(text), lower(source))::INT / 3.0, 6) AS coverage FROM documents""")
def e14_group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of aliases, one of which differs by document."""
    groups = F.array(F.array(F.lit("The"), F.lit("UND")), F.array(F.lit("license"), F.lit("copyright")), F.array("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(evidence.group_coverage(F.col("text"), groups), 6).alias("coverage"))


def _replies() -> Column:
    key = F.col("p_partkey") % 5
    return F.when(key == 0, F.concat(F.lit("Insufficient evidence about "), "p_name")).when(key == 1, F.concat("p_name", F.lit(" 证据不足"))).when(key == 2, "There is not enough information").otherwise(F.concat("p_name", F.lit(" sells well [1]")))


@query("SELECT p_partkey AS answer_id, p_partkey % 5 < 3 OR p_partkey % 7 = 0 AS abstains, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN (p_partkey % 5 < 3 OR p_partkey % 7 = 0) AND p_partkey % 5 < 3 THEN 1.0 ELSE 0.0 END ELSE 0.75 END::DOUBLE AS groundedness FROM part")
def e17_abstains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by part key; every seventh run has the warning; even keys ought to abstain."""
    key = F.col("p_partkey")
    warned = F.when(key % 7 == 0, F.array(F.lit("INSUFFICIENT_EVIDENCE"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select(key.alias("answer_id"), evidence.abstains(_replies(), warned).alias("abstains"), F.size(evidence.citations(_replies())).alias("n"))
    return rows.select("answer_id", "abstains", evidence.groundedness(F.col("answer_id") % 2 == 0, F.col("abstains"), F.col("n"), F.lit(0.5), F.lit(1.0)).alias("groundedness"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size::VARCHAR AS old, (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR AS new, printf('%.1f', p_retailprice) AS price FROM part), c AS (SELECT id, old AS token, 1 AS o, 0 AS n FROM b UNION ALL SELECT id, price, 1, 0 FROM b UNION ALL SELECT id, new, 0, 1 FROM b UNION ALL SELECT id, price, 0, 1 FROM b)
SELECT id, token, CAST(sum(o) AS BIGINT) AS in_before, CAST(sum(n) AS BIGINT) AS in_after FROM c GROUP BY ALL HAVING sum(o) <> sum(n)""")
def d7_token_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which every third has another size."""
    parts, price = table(spark, sf_dir, "part"), F.format_string("%.1f", "p_retailprice")
    text = lambda size: parts.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Size "), size.cast("string"), F.lit(" for "), price).alias("text"))
    return evidence.token_multiset_changes(text(F.col("p_size")), text(F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int")))


@query(f"WITH {CELLS_SQL} SELECT table_id AS source, header AS metric, lower(regexp_replace(row_label, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS label, round(value, 4) AS value FROM cells WHERE row_label <> 'Total' QUALIFY count(*) OVER (PARTITION BY table_id, header) >= 3")
def xprj_table_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_projections(cells(spark, sf_dir)).withColumn("value", F.round("value", 4))


@query(f"WITH {YEARLY_SQL} SELECT scope_id AS source, series_name AS metric, lower(category) AS label, round(y_value, 4) AS value, false AS turned FROM points UNION ALL SELECT scope_id, category, lower(series_name), round(y_value, 4), true FROM points")
def xprj_chart_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years over segments, and segments over fiscal years."""
    return tables.chart_projections(yearly_points(spark, sf_dir)).withColumn("value", F.round("value", 4))
