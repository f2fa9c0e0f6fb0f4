"""Evaluation over the event log, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import coverage, evaluation
from sondage.sources.bindings import table

from .coverage_queries import _COVERED, _covered
from .metric_queries import _RUNS, _WARNED, _warned
from .registry import query


def _places(spark: SparkSession, sf_dir: str, condition: str, slides: int) -> DataFrame:
    return table(spark, sf_dir, "events").filter(condition).select(F.col("user_id").alias("case_id"), (F.col("event_id") % 3).alias("group_no"), F.col("event_type").alias("document_id"), (F.col("event_id") % slides).alias("slide_no"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh user's case is to abstain; policies go round."""
    policy = F.element_at(F.array(F.lit("required"), F.lit("optional"), F.lit("forbidden"), F.lit(None).cast("string")), (F.col("case_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id")).distinct().withColumns({"abstains": F.col("case_id") % 7 == 0, "policy": policy})


_E15 = """cases AS (SELECT DISTINCT user_id AS case_id FROM events), act AS (SELECT user_id AS case_id, event_type AS d, event_id % 11 AS s FROM events WHERE event_id % 2 = 0 AND user_id % 5 > 0),
grp AS (SELECT user_id AS case_id, event_id % 3 AS g, event_type AS d, event_id % 11 AS s FROM events WHERE event_id % 2 = 1 AND user_id % 6 > 0)"""


@query(f"WITH {_E15}, h AS (SELECT case_id, g, max(CASE WHEN EXISTS (SELECT 1 FROM act a WHERE a.case_id = grp.case_id AND a.d = grp.d AND a.s = grp.s) THEN 1 ELSE 0 END) AS hit FROM grp GROUP BY ALL), r AS (SELECT case_id, sum(hit) / count(*) AS recall FROM h GROUP BY 1) SELECT case_id, round(recall, 6) AS recall FROM cases LEFT JOIN r USING (case_id)")
def e15_evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are what a user's case found, odd ones its three groups of gold places."""
    found = evaluation.evidence_recall(_cases(spark, sf_dir), _places(spark, sf_dir, "event_id % 2 = 0 and user_id % 5 > 0", 11), _places(spark, sf_dir, "event_id % 2 = 1 and user_id % 6 > 0", 11))
    return found.withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_E15}, p AS (SELECT case_id, avg(CASE WHEN EXISTS (SELECT 1 FROM grp g WHERE g.case_id = act.case_id AND g.d = act.d AND g.s = act.s) THEN 1.0 ELSE 0.0 END) AS p FROM act GROUP BY 1)
SELECT case_id, CASE WHEN case_id % 7 = 0 OR case_id % 4 = 2 THEN CASE WHEN p IS NULL THEN 1.0 ELSE 0.0 END WHEN p IS NULL THEN CASE WHEN case_id % 4 = 1 THEN 1.0 ELSE 0.0 END ELSE round(p, 6) END AS precision FROM cases LEFT JOIN p USING (case_id)""")
def e15_citation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.citation_precision(_cases(spark, sf_dir), _places(spark, sf_dir, "event_id % 2 = 0 and user_id % 5 > 0", 11), _places(spark, sf_dir, "event_id % 2 = 1 and user_id % 6 > 0", 11))
    return found.withColumn("precision", F.round("precision", 6))


@query("""WITH v AS (SELECT user_id AS series_id, event_id % 20 AS point_ix, CASE event_id % 5 WHEN 0 THEN 'vision' WHEN 1 THEN 'table' WHEN 2 THEN 'chart_cache' WHEN 3 THEN 'embedded_workbook' ELSE 'other' END AS source, max(value) AS value FROM events WHERE event_id % 9 > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, point_ix ORDER BY CASE source WHEN 'embedded_workbook' THEN 1 WHEN 'chart_cache' THEN 2 WHEN 'table' THEN 3 WHEN 'vision' THEN 4 ELSE 5 END) AS k FROM v WHERE value IS NOT NULL)
SELECT a.series_id, a.point_ix, a.value, a.source, b.value AS value_cache, b.source AS source_cache FROM r a LEFT JOIN r b ON a.series_id = b.series_id AND a.point_ix = b.point_ix AND b.k = 2 WHERE a.k = 1""")
def e19_source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are series of twenty points; events give them values from five sources, every ninth has none."""
    names = F.array(*map(F.lit, ("vision", "table", "chart_cache", "embedded_workbook", "other")))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), (F.col("event_id") % 20).alias("point_ix"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("source"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("value"))
    return evaluation.source_precedence(rows, ["series_id", "point_ix"])


@query("""WITH r AS (SELECT lang AS category, CAST(quality AS DECIMAL(18,6)) AS q, CAST(1 - toxic AS DECIMAL(18,6)) AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT category, avg(q) AS m FROM r GROUP BY 1 HAVING m IS NOT NULL)
SELECT (SELECT category FROM c ORDER BY m DESC, category LIMIT 1) AS strongest_category, (SELECT category FROM c ORDER BY m, category LIMIT 1) AS weakest_category, CASE WHEN avg(q) <= avg(s) THEN 'quality' ELSE 'safe' END AS weakest_dimension, round(avg(s) - avg(q), 2) AS gap FROM r""")
def a17_score_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id").select("category", F.col("quality").alias("score"), "quality", (1 - F.col("toxic")).alias("safe"))
    return evaluation.score_diagnostics(rows, ["quality", "safe"], ("safe", "quality"))


@query(f"""WITH {_WARNED.replace("SELECT DISTINCT run_id, CASE WHEN trim(c) = '' THEN 'UNKNOWN_WARNING' ELSE c END AS code", "SELECT c AS code")}
SELECT 'source' AS kind, CASE WHEN kind = 'view' THEN 'none' ELSE kind END AS name, count(*) AS n FROM runs GROUP BY ALL UNION ALL SELECT 'warning', code, count(*) FROM warned GROUP BY ALL""")
def a19_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one kind stand for answers of one source; views have none."""
    return evaluation.run_report(_warned(spark, sf_dir).withColumn("source", F.when(F.col("kind") != "view", F.col("kind"))))


@query(f"""WITH {_RUNS}, l AS (SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 10)
SELECT run_id, conversation_id, kind AS warnings, (SELECT arg_max(text, turn) FROM conversations c WHERE c.conv_id = l.conversation_id AND c.role = 'user' AND c.turn <= l.run_id) AS question FROM l""")
def a5_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversation with the user's number are messages a second apart, from the epoch."""
    runs = _warned(spark, sf_dir).select("run_id", "conversation_id", F.col("created_at").cast("timestamp").alias("created_at"), F.array("kind").alias("warnings"))
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id"), F.timestamp_seconds("turn").alias("created_at"), "role", F.col("text").alias("content"))
    return evaluation.recent_runs(runs, messages).select("run_id", "conversation_id", F.array_join("warnings", ",").alias("warnings"), "question")


@query(f"WITH {_COVERED}, g AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY facet_no) AS variant_no FROM cov WHERE status <> 'supported') SELECT query_id, CAST(variant_no AS INTEGER) AS variant_no, label AS text, 'evidence_gap' AS kind, CAST(1.1 AS DOUBLE) AS weight FROM g WHERE variant_no <= 3")
def r15_gap_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gap_variants(coverage.coverage_summary(_covered(spark, sf_dir)))


@query("""WITH f AS (SELECT o_custkey AS query_id, count(DISTINCT o_orderstatus) AS documents, count(*) FILTER (o_orderkey % 2 = 0) AS supported, count(*) AS atoms FROM orders WHERE o_orderkey % 5 < 3 GROUP BY 1), s AS (SELECT o_custkey AS query_id, count(DISTINCT o_orderstatus) AS documents, count(*) FILTER (o_orderkey % 2 = 0) AS supported, count(*) AS atoms FROM orders WHERE o_orderkey % 5 >= 2 GROUP BY 1),
j AS (SELECT f.*, s.documents AS d, s.supported AS u, s.atoms AS a, coalesce((s.documents, s.supported, s.atoms) > (f.documents, f.supported, f.atoms) AND s.atoms IS NOT NULL, false) AS retried FROM f LEFT JOIN s USING (query_id))
SELECT query_id, CASE WHEN retried THEN d ELSE documents END AS documents, CASE WHEN retried THEN u ELSE supported END AS supported, CASE WHEN retried THEN a ELSE atoms END AS atoms, retried FROM j""")
def r15_keep_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are queries, their orders what two searches found: statuses the documents, even orders the supported facets."""

    def found(condition: str) -> DataFrame:
        rows = table(spark, sf_dir, "orders").filter(condition)
        return rows.groupBy(F.col("o_custkey").alias("query_id")).agg(F.countDistinct("o_orderstatus").alias("documents"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("supported"), F.count("*").alias("atoms"))

    return evaluation.keep_better(found("o_orderkey % 5 < 3"), found("o_orderkey % 5 >= 2"))
