"""Decks of the trade tables: customers are documents, orders versions and slides, lines elements, charts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import decks
from sondage.sources.bindings import table

from .registry import query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS chunk_id, concat(l_partkey, '/', l_suppkey) AS content, o_orderkey % 7 AS slide_no, o_orderpriority AS slide_title, c_custkey AS document_id, c_name AS document_title, CASE WHEN l_linenumber % 2 = 0 THEN CAST(p_retailprice AS DOUBLE) END AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10 AND o_orderkey % 3 = c_custkey % 3 AND c_custkey % 11 > 0""")
def s3_scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    element = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))
    chunks = lines.select(F.col("line_id").alias("chunk_id"), F.col("l_orderkey").alias("slide_id"), F.col("l_orderkey").alias("version_id"), element.alias("element_id"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("content"), (F.col("l_quantity") > 10).alias("active"))
    orders = table(spark, sf_dir, "orders")
    slides = orders.select(F.col("o_orderkey").alias("slide_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 3).alias("parser_run_id"), (F.col("o_orderkey") % 7).alias("slide_no"), F.col("o_orderpriority").alias("slide_title"))
    versions = orders.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"), (F.col("o_custkey") % 3).alias("active_parser_run_id"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("document_title"), (F.col("c_custkey") % 11 == 0).alias("deleted"))
    elements = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_retailprice").cast("double").alias("confidence"))
    return decks.scan_chunks(chunks, slides, versions, documents, elements)


@query("""WITH s AS (SELECT o_orderkey AS slide_id, o_custkey AS document_id FROM orders), e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS slide_id, l_partkey, l_suppkey, l_linenumber FROM lineitem),
c AS (SELECT id FROM e WHERE l_suppkey % 2 = 0), r AS (SELECT id * 3 + k AS series_id, id FROM c, range(0, 3) u(k) WHERE (id + k) % 4 > 0), p AS (SELECT series_id, series_id * 5 + j AS point_id FROM r, range(0, 5) u(j) WHERE (series_id + j) % 3 > 0)
SELECT c_custkey AS document_id, count(DISTINCT s.slide_id) AS slides, count(DISTINCT e.id) AS elements, count(DISTINCT CASE WHEN l_linenumber = 1 THEN e.id END) AS tables, count(DISTINCT c.id) AS charts, count(DISTINCT r.series_id) AS series, count(DISTINCT p.point_id) AS points
FROM customer LEFT JOIN s ON s.document_id = c_custkey LEFT JOIN e ON e.slide_id = s.slide_id LEFT JOIN c ON c.id = e.id LEFT JOIN r ON r.id = c.id LEFT JOIN p ON p.series_id = r.series_id GROUP BY 1""")
def a8_document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of orders are tables; lines of even suppliers hold a chart of up to three series of up to five points."""
    lines = _lines(spark, sf_dir)
    elements = lines.select(F.col("line_id").alias("element_id"), F.col("l_orderkey").alias("slide_id"), F.when(F.col("l_linenumber") == 1, "table").otherwise("text").alias("element_type"))
    charts = lines.filter("l_suppkey % 2 = 0").select(F.col("line_id").alias("chart_id"), F.col("line_id").alias("element_id"))
    series = charts.select("chart_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).filter("(chart_id + k) % 4 > 0").select((F.col("chart_id") * 3 + F.col("k")).alias("series_id"), "chart_id")
    points = series.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).filter("(series_id + j) % 3 > 0").select((F.col("series_id") * 5 + F.col("j")).alias("point_id"), "series_id")
    slides = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide_id"), F.col("o_custkey").alias("document_id"))
    return decks.document_profile(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id")), slides, elements, charts, series, points)


@query(r"""WITH f AS (SELECT source AS workspace_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 100 DESC, doc_id % 7, doc_id) AS nth, regexp_extract_all(coalesce(lang, '') || '=' || coalesce(text, ''), '[A-Za-z][A-Za-z0-9&/_-]{1,40}|[\x{4e00}-\x{9fff}]{2,16}') AS w FROM documents QUALIFY nth <= 80),
t AS (SELECT workspace_id, nth, unnest(w) AS term, generate_subscripts(w, 1) AS k FROM f), s AS (SELECT workspace_id, term, min({'a': nth, 'b': k}) AS seen FROM t GROUP BY ALL)
SELECT workspace_id, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY seen) AS INTEGER) AS place, term FROM s QUALIFY place <= 120""")
def s13_document_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are workspaces, whole texts the titles of slides; a hundred dates of change."""
    titles = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), (F.col("doc_id") % 100).alias("updated_at"), (F.col("doc_id") % 7).alias("slide_no"), F.col("doc_id").alias("slide_id"), F.col("lang").alias("document_title"), F.col("text").alias("slide_title"))
    return decks.document_vocabulary(titles)


@query("""WITH k AS (SELECT o_orderkey AS conv, o_orderkey % 4 AS ws, o_custkey FROM orders), n AS (SELECT ws, conv, unnest([o_custkey, o_custkey + 4]) AS d FROM k WHERE conv % 3 = 0), c AS (SELECT ws, conv, l_suppkey % 50 AS d FROM lineitem JOIN k ON l_orderkey = conv WHERE l_linenumber = 2)
SELECT DISTINCT d AS document_id, conv AS conversation_id FROM (SELECT * FROM n UNION ALL SELECT * FROM c) JOIN customer ON d = c_custkey WHERE d % 4 = ws""")
def j16_related_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are conversations: every third names its customer and another, second lines cite the versions of suppliers."""
    orders = table(spark, sf_dir, "orders")
    conversations = orders.select(F.col("o_orderkey").alias("conversation_id"), (F.col("o_orderkey") % 4).alias("workspace_id"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_custkey"), F.col("o_custkey") + 4)).alias("document_ids"))
    citations = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("conversation_id"), F.col("l_suppkey").alias("version_id"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 4).alias("workspace_id"))
    versions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("version_id"), (F.col("l_suppkey") % 50).alias("document_id")).distinct()
    return decks.related_conversations(conversations, citations, documents, versions)


@query("""WITH a AS (SELECT l_orderkey AS chart, l_linenumber AS no, 'a' || l_linenumber AS axis, CASE l_suppkey % 4 WHEN 0 THEN 'valAx' WHEN 1 THEN 'Value' WHEN 2 THEN 'catAx' END IN ('valAx', 'Value') AS is_value, CASE l_partkey % 5 WHEN 0 THEN 'r' WHEN 1 THEN 'left' WHEN 2 THEN 'T' WHEN 3 THEN '' END AS side FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)),
v AS (SELECT chart, count(*) FILTER (is_value) AS n, arg_max(axis, no) FILTER (is_value) AS last FROM a GROUP BY 1), s AS (SELECT o_orderkey AS chart, k AS series_id, 'a' || unnest([k, k + 2]) AS axis FROM orders, range(1, 4) u(k)),
b AS (SELECT s.chart, series_id, a.axis, lower(coalesce(side, '')) AS side, n, last FROM s JOIN a ON a.chart = s.chart AND a.axis = s.axis JOIN v ON v.chart = s.chart QUALIFY row_number() OVER (PARTITION BY s.chart, series_id ORDER BY coalesce(is_value, false) DESC, no DESC) = 1)
SELECT chart AS chart_id, CAST(series_id AS BIGINT) AS series_id, axis AS axis_id, CASE WHEN side IN ('r', 't') THEN 'secondary' WHEN side = 'left' THEN 'primary' WHEN n > 1 AND last = axis THEN 'secondary' ELSE 'primary' END AS role FROM b""")
def j17_axis_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are charts of three series, their lines the axes."""
    kind = F.element_at(F.array(F.lit("valAx"), F.lit("Value"), F.lit("catAx"), F.lit(None).cast("string")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    side = F.element_at(F.array(F.lit("r"), F.lit("left"), F.lit("T"), F.lit(""), F.lit(None).cast("string")), (F.col("l_partkey") % 5 + 1).cast("int"))
    name = lambda k: F.concat(F.lit("a"), k.cast("string"))
    lines = _lines(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))  # lines repeat
    axes = lines.select(F.col("l_orderkey").alias("chart_id"), F.col("l_linenumber").alias("axis_no"), name(F.col("l_linenumber")).alias("axis_id"), kind.alias("axis_type"), side.alias("position"))
    series = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chart_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("series_id")).withColumn("axis_ids", F.array(name(F.col("series_id")), name(F.col("series_id") + 2)))
    return decks.axis_resolution(series, axes)


@query("""WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS element_id, l_partkey % 5 > 0 AS has, CASE WHEN l_partkey % 7 > 0 THEN l_partkey END AS x, l_suppkey AS y, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_quantity AS BIGINT) END AS w, CAST(l_quantity AS BIGINT) * 2 AS h FROM lineitem)
SELECT element_id, round(CASE WHEN has THEN coalesce(x, 0) / 12192.0 ELSE 0.05 END, 6) AS x, round(CASE WHEN has THEN y / 6858.0 ELSE 0.15 END, 6) AS y, round(CASE WHEN has THEN coalesce(w, 12192) / 12192.0 ELSE 0.9 END, 6) AS w, round(CASE WHEN has THEN h / 6858.0 ELSE 0.7 END, 6) AS h FROM b""")
def x27_normal_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    box = F.when(F.col("l_partkey") % 5 > 0, F.struct(F.when(F.col("l_partkey") % 7 > 0, F.col("l_partkey")).alias("x"), F.col("l_suppkey").alias("y"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_quantity")).alias("w"), (F.col("l_quantity").cast("long") * 2).alias("h")))
    found = rows.select(F.col("line_id").alias("element_id"), decks.normal_box(box, F.lit(12192).cast("long"), F.lit(6858).cast("long")).alias("b"))
    return found.select("element_id", *(F.round(f"b.{n}", 6).alias(n) for n in "xywh"))
