"""Operations metrics over the event log, quality metrics over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import metrics
from sondage.sources.bindings import table
from sondage.streaming import streams

from .registry import query


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "view"), "completed").when(kind == "error", "failed").otherwise("pending")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at"), status.alias("status"), kind.alias("kind"), F.col("value").alias("latency_ms"))


_RUNS = """runs AS (SELECT event_id AS run_id, user_id AS conversation_id, ts AS created_at, CASE WHEN event_type IN ('purchase', 'view') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS status, event_type AS kind, value AS latency_ms FROM events)"""


@query(f"WITH {_RUNS} SELECT status, count(*) AS n FROM runs GROUP BY status")
def a1_count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_by_status(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(CAST(CAST(sum(CASE WHEN status IN ('completed','failed') THEN CAST(latency_ms AS DECIMAL(18,4)) END) AS DOUBLE) / count(*) FILTER (status IN ('completed','failed') AND latency_ms IS NOT NULL) AS DOUBLE), 3) AS mean_latency_ms FROM runs")
def a2_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(_runs(spark, sf_dir))


@query("SELECT count(*) AS n, round(avg(CASE WHEN toxic = 0 AND quality = 1 THEN 1.0 ELSE 0.0 END), 3) AS positive_rate FROM labels")
def a4_feedback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feedback_rate(table(spark, sf_dir, "labels").select(F.when((F.col("toxic") == 0) & (F.col("quality") == 1), 1).otherwise(-1).alias("rating")))


@query(f"WITH {_RUNS} SELECT run_id FROM runs WHERE kind = 'error' OR run_id % 11 = 0")
def a3_degraded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.degraded_runs(_warned(spark, sf_dir)).select("run_id")


def _warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are provider errors, every eleventh run fell back on its planner; the others have codes that degrade nothing."""
    codes = F.array(F.when(F.col("kind") == "error", "LLM_PROVIDER_ERROR").otherwise("SLOW"), F.when(F.col("run_id") % 11 == 0, "QUERY_PLANNER_PROVIDER_ERROR").otherwise("LOW_CHART_CONFIDENCE"), F.when(F.col("run_id") % 3 == 0, " ").otherwise("SLOW"))
    return _runs(spark, sf_dir).withColumn("warnings", codes)


_WARNED = f"""{_RUNS}, warned AS (SELECT DISTINCT run_id, CASE WHEN trim(c) = '' THEN 'UNKNOWN_WARNING' ELSE c END AS code FROM (SELECT run_id, unnest([CASE WHEN kind = 'error' THEN 'LLM_PROVIDER_ERROR' ELSE 'SLOW' END,
CASE WHEN run_id % 11 = 0 THEN 'QUERY_PLANNER_PROVIDER_ERROR' ELSE 'LOW_CHART_CONFIDENCE' END, CASE WHEN run_id % 3 = 0 THEN ' ' ELSE 'SLOW' END]) AS c FROM runs))"""


@query(f"WITH {_WARNED} SELECT run_id, code, CASE WHEN code IN ('LLM_PROVIDER_ERROR', 'QUERY_PLANNER_PROVIDER_ERROR') THEN 'degraded' ELSE 'warning' END AS severity FROM warned")
def j14_describe_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.describe_warnings(_warned(spark, sf_dir))


@query("""WITH c AS (SELECT user_id AS run_id, event_type AS component, event_id % 50 AS i, event_id % 9 AS o, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0 ELSE event_id % 70 END AS t FROM events),
u AS (SELECT run_id, component, i, o, coalesce(nullif(t, 0), i + o) AS t FROM c)
SELECT run_id, component, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(t) AS BIGINT) AS total_tokens FROM u GROUP BY run_id, component UNION ALL SELECT run_id, 'all', CAST(sum(i) AS BIGINT), CAST(sum(o) AS BIGINT), CAST(sum(t) AS BIGINT) FROM u GROUP BY run_id""")
def a9_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for runs, event types for components; tokens come from event ids."""
    total = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, 0).otherwise(F.col("event_id") % 70)
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("component"), (F.col("event_id") % 50).alias("input_tokens"), (F.col("event_id") % 9).alias("output_tokens"), total.alias("total_tokens"))
    return metrics.token_usage(calls)


@query("""WITH s AS (SELECT event_id AS run_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) SELECT run_id, greatest(0, epoch_us(nxt) - epoch_us(ts)) // 1000 AS latency FROM s WHERE nxt IS NOT NULL""")
def x28_latency_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the user's next event by id."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("run_id"))).filter("next is not null")
    return rows.select("run_id", metrics.latency_ms(F.col("ts"), F.col("next")).alias("latency"))


@query("SELECT source, count(*) AS n, round(avg(doc_id % 7), 3) AS mean_citations, round(avg(length(text)), 3) AS mean_length FROM documents GROUP BY source")
def a19_run_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for answers."""
    return metrics.run_quality(table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 7).alias("n_citations"), F.length("text").alias("length")))


@query(f"""WITH {_RUNS} SELECT run_id, status = 'completed' AS completed, run_id % 5 > 0 AS answered, run_id % 4 > 0 AS cited, kind <> 'error' AND run_id % 11 > 0 AS sound, status = 'completed' AND run_id % 5 > 0 AND run_id % 4 > 0 AND kind <> 'error' AND run_id % 11 > 0 AS ok FROM runs""")
def e18_basic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer, cited = F.when(F.col("run_id") % 5 > 0, "yes").otherwise(" "), F.when(F.col("run_id") % 4 > 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(None).cast("int")))
    return metrics.basic_checks(_warned(spark, sf_dir).withColumns({"answer": answer, "citations": cited}))


@query(f"WITH {_RUNS} SELECT conversation_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, run_id DESC) = 1")
def w18_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_per_key(_runs(spark, sf_dir), "conversation_id", ["created_at", "run_id"]).select("conversation_id", "run_id", "status")


@query(f"""WITH {_RUNS} SELECT l.run_id, l.conversation_id, (SELECT max(r.run_id) FROM runs r WHERE r.conversation_id = l.conversation_id AND r.kind = 'signup' AND r.run_id < l.run_id) AS signup_run FROM runs l WHERE l.kind = 'error'""")
def j7_last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup before each error of the same user."""
    runs = _runs(spark, sf_dir).withColumn("at", F.col("run_id"))
    left = runs.filter("kind = 'error'").select("conversation_id", "at", F.col("run_id").alias("left_id"))
    right = runs.filter("kind = 'signup'").select("conversation_id", "at", F.col("run_id").alias("signup_run"))
    return metrics.as_of(left, right, "conversation_id", "at", "signup_run").select(F.col("left_id").alias("run_id"), "conversation_id", "signup_run")


@query("""WITH r AS (SELECT lang AS category, quality, 1 - toxic AS safe FROM labels JOIN documents USING (doc_id)), u AS (SELECT category, 'quality' AS dimension, quality AS score FROM r UNION ALL SELECT category, 'safe', safe FROM r)
SELECT category, dimension, round(avg(score), 6) AS mean_score, count(*) AS n FROM u GROUP BY ALL""")
def a16_dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dimension_scores(_evaluated(spark, sf_dir), ["quality", "safe"])


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", F.col("lang").alias("category"), "quality", (1 - F.col("toxic")).alias("safe"))


@query("SELECT doc_id, round((quality * 0.7 + (1 - toxic) * 0.45) / 1.15 * 100, 4) AS score FROM labels JOIN documents USING (doc_id)")
def e16_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_score(_evaluated(spark, sf_dir), {"quality": 0.7, "safe": 0.45}).select("doc_id", "score")


@query("WITH s AS (SELECT round((quality * 0.7 + (1 - toxic) * 0.45) / 1.15 * 100, 4) AS score FROM labels JOIN documents USING (doc_id)) SELECT round(avg(score), 6) AS mean, quantile_cont(score, 0.5) AS median, avg(CASE WHEN score >= 80 THEN 1.0 ELSE 0.0 END) AS pass_rate, count(*) FILTER (score = 100) AS perfect FROM s")
def a17_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_summary(metrics.weighted_score(_evaluated(spark, sf_dir), {"quality": 0.7, "safe": 0.45}))


@query(f"WITH {_RUNS}, r AS (SELECT kind, latency_ms, row_number() OVER (PARTITION BY kind ORDER BY latency_ms) AS rank, count(*) OVER (PARTITION BY kind) AS n FROM runs WHERE latency_ms IS NOT NULL) SELECT kind, latency_ms AS p95 FROM r WHERE rank = greatest(1, floor(0.95 * n))")
def a18_p95_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.p95_lower(_runs(spark, sf_dir), "kind", "latency_ms")


@query("SELECT 'quality in range' AS rule, CAST(count(*) FILTER (NOT quality BETWEEN 0 AND 1) AS BIGINT) AS n FROM labels UNION ALL SELECT 'toxic in range', count(*) FILTER (NOT toxic BETWEEN 0 AND 1) FROM labels UNION ALL SELECT 'doc_id unique', (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1))")
def f11_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.constraint_violations(table(spark, sf_dir, "labels"), "doc_id", {"quality": (0, 1), "toxic": (0, 1)})


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "reset")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind")).filter("kind is not null")


@query("""WITH e AS (SELECT event_id, user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_type FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY sec, event_id) AS spell FROM e),
r AS (SELECT event_id, key, count(*) OVER (PARTITION BY key, spell ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY key, spell, sec ORDER BY event_id) - 1 AS recent FROM s WHERE event_type = 'error') SELECT *, recent >= 5 AS blocked FROM r""")
def z4_failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures, signups resets, within a day."""
    return streams.failed_attempts(_attempts(spark, sf_dir), 86_400, 5)


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def z2_tail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return streams.tail(events, events.agg(F.max("event_id")).first()[0] // 2).select("event_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def z3_first_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.first_submissions(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def z7_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.status_counts(table(spark, sf_dir, "events"))
