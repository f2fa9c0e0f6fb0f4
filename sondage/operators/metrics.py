"""Operations and quality metrics over runs, feedback and evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Warning codes and their severities.
SEVERITIES = {
    "SYNTHETIC_DATA_SIGNAL": "info",
    "INSUFFICIENT_EVIDENCE": "warning", "PARTIAL_EVIDENCE_COVERAGE": "warning", "NO_COMPARATIVE_STRENGTH_EVIDENCE": "warning", "LOW_CHART_CONFIDENCE": "warning",
    "QUERY_PLANNER_PROVIDER_ERROR": "degraded", "QUERY_PLANNER_OUTPUT_INVALID": "degraded", "LLM_PROVIDER_ERROR": "degraded", "ANSWER_POLISHING_PROVIDER_ERROR": "degraded",
    "ANSWER_POLISHING_OUTPUT_INVALID": "degraded", "ANSWER_POLISHING_FACT_CONTRACT_FAILED": "degraded", "LLM_EMPTY_OR_OVERSIZED_RESPONSE": "degraded", "LLM_OUTPUT_TRUNCATED": "degraded",
    "LLM_CITATION_VALIDATION_FAILED": "degraded", "LLM_NUMERIC_VALIDATION_FAILED": "degraded", "EVIDENCE_ROLE_VALIDATION_FAILED": "degraded", "LLM_QUERY_ADHERENCE_FAILED": "degraded",
}
DEGRADED = tuple(code for code, severity in SEVERITIES.items() if severity == "degraded")


def count_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals by outcome, and the mean latency of finished runs."""
    done = F.col("status").isin("completed", "failed")
    return runs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(done, F.col("latency_ms").cast("decimal(18,4)"))).cast("double"), 3).alias("mean_latency_ms"))


def feedback_rate(feedback: DataFrame) -> DataFrame:
    """Share of positive ratings to three decimals; null without any."""
    return feedback.agg(F.count("rating").alias("n"), F.round(F.avg(F.when(F.col("rating") > 0, 1.0).when(F.col("rating").isNotNull(), 0.0)), 3).alias("positive_rate"))


def degraded_runs(runs: DataFrame) -> DataFrame:
    """Runs (run_id, warnings) with a warning of the degraded kind."""
    return runs.filter(F.arrays_overlap("warnings", F.array(*map(F.lit, DEGRADED))))


def describe_warnings(runs: DataFrame) -> DataFrame:
    """run_id, code, severity of each distinct warning of the runs (run_id, warnings); blank codes are UNKNOWN_WARNING, codes that are not in the catalogue of severity warning."""
    catalogue = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    codes = F.transform("warnings", lambda c: F.when(F.trim(c) == "", "UNKNOWN_WARNING").otherwise(F.trim(c)))
    return runs.select("run_id", F.explode(F.array_distinct(codes)).alias("code")).withColumn("severity", F.coalesce(catalogue[F.col("code")], F.lit("warning")))


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is greatest by the columns ``order``, in one aggregate."""
    rest = [c for c in rows.columns if c != key and c not in order]
    found = rows.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return found.select(key, *(F.col(f"_row.{c}").alias(c) for c in rows.columns if c != key))


def token_usage(calls: DataFrame) -> DataFrame:
    """Per run (run_id, component, input_tokens, output_tokens, total_tokens): sums by component and in all; a missing or zero total is input and output together."""
    total = F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("input_tokens", "output_tokens")] + [F.sum("_total").cast("long").alias("total_tokens")]
    rows = calls.withColumn("_total", total)
    return rows.groupBy("run_id", "component").agg(*sums).unionByName(rows.groupBy("run_id").agg(F.lit("all").alias("component"), *sums))


def latency_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, 0 at least."""
    return F.call_function("div", F.greatest(F.lit(0).cast("long"), F.unix_micros(end) - F.unix_micros(start)), F.lit(1000).cast("long"))


def run_quality(runs: DataFrame) -> DataFrame:
    """Runs by source of the answer (source, n_citations, length): number, mean citations and mean length to three decimals."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,4)")).cast("double"), 3)
    return runs.groupBy("source").agg(F.count("*").alias("n"), mean("n_citations").alias("mean_citations"), mean("length").alias("mean_length"))


def basic_checks(runs: DataFrame) -> DataFrame:
    """Per run (run_id, status, answer, citations as array, warnings as array): has it completed, an answer, citations without nulls, no degraded warning, and all of these?"""
    flags = {"completed": F.col("status") == "completed", "answered": F.trim(F.coalesce("answer", F.lit(""))) != "", "cited": F.forall("citations", lambda c: c.isNotNull()) & (F.size("citations") > 0), "sound": ~F.arrays_overlap("warnings", F.array(*map(F.lit, DEGRADED)))}
    rows = runs.select("run_id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    return rows.withColumn("ok", F.col("completed") & F.col("answered") & F.col("cited") & F.col("sound"))


def as_of(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the last right row of its key that is strictly earlier: one shuffle, no pairs. Keys that hold very many rows are sorted in one task, as any as-of join by key does."""
    rows = left.select(by, on, F.col("left_id"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(0).alias("side")).unionByName(right.select(by, on, F.lit(None).cast("long").alias("left_id"), value, F.lit(1).alias("side")))
    w = Window.partitionBy(by).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("found", F.last(F.when(F.col("side") == 1, F.col(value)), ignorenulls=True).over(w)).filter("side = 0").select("left_id", by, on, F.col("found").alias(value))


def dimension_scores(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mean of each score dimension by category, nulls left out."""
    long = rows.select("category", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("score")) for d in dimensions))).alias("x")).select("category", "x.*")
    return long.filter("score is not null").groupBy("category", "dimension").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


def score_summary(rows: DataFrame) -> DataFrame:
    """Mean, median, share of at least 80, number of 100s, over (category, score)."""
    return rows.agg(F.round(F.avg("score"), 6).alias("mean"), F.percentile("score", 0.5).alias("median"), F.avg((F.col("score") >= 80).cast("double")).alias("pass_rate"), F.count_if(F.col("score") == 100).alias("perfect"))


def p95_lower(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: the element at place max(1, floor(0.95 n)) of the sorted values, not interpolated. Equal values are counted before they are sorted."""
    w = Window.partitionBy(key)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key), F.col(value).alias("p95")).agg(F.count("*").alias("times"))
    ranked = counts.withColumns({"upto": F.sum("times").over(w.orderBy("p95").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("times").over(w)})
    place = F.greatest(F.lit(1), F.floor(0.95 * F.col("n")))
    return ranked.filter((F.col("upto") >= place) & (F.col("upto") - F.col("times") < place)).select(key, "p95")


def weighted_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean in percent over the dimensions that are not null."""
    total = sum(F.when(F.col(d).isNotNull(), w).otherwise(0.0) for d, w in weights.items())
    part = sum(F.coalesce(F.col(d).cast("double"), F.lit(0.0)) * w for d, w in weights.items())
    return rows.withColumn("score", F.round(F.try_divide(part, total) * 100, 4))


def constraint_violations(rows: DataFrame, key: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows outside a column's range, and keys that occur more than once: rule, n."""
    outside = rows.select(F.explode(F.array(*(F.struct(F.lit(f"{c} in range").alias("rule"), F.coalesce(~F.col(c).between(lo, hi), F.lit(False)).cast("long").alias("bad")) for c, (lo, hi) in ranges.items()))).alias("x"))
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.lit(f"{key} unique").alias("rule"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n"))
    return outside.groupBy(F.col("x.rule").alias("rule")).agg(F.sum("x.bad").alias("n")).unionByName(repeated)
