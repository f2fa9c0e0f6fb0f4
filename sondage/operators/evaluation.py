"""Evaluation of answers by their citations, reports over scores and runs, and which of several sources of a value stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources of a chart's values, the most trusted first.
SOURCES = ("embedded_workbook", "chart_cache", "table", "vision")

_PLACE = ["document_id", "slide_no"]


def evidence_recall(cases: DataFrame, actual: DataFrame, groups: DataFrame) -> DataFrame:
    """case_id, recall: the share of a case's groups of which one place (document_id, slide_no) is among the actual ones; null for cases without groups. groups: case_id, group_no, document_id, slide_no; a place counts once, however often it comes."""
    found = groups.join(actual.select("case_id", *_PLACE).distinct().withColumn("hit", F.lit(1)), ["case_id", *_PLACE], "left")
    by_group = found.groupBy("case_id", "group_no").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    shares = by_group.groupBy("case_id").agg((F.sum("hit") / F.count("*")).alias("recall"))
    return cases.select("case_id").join(shares, "case_id", "left")


def citation_precision(cases: DataFrame, citations: DataFrame, allowed: DataFrame) -> DataFrame:
    """case_id, precision of cases (case_id, abstains, policy): the share of their citations that are at an allowed place, repeated ones counted each time.

    Without citations it is 1 where the case is to abstain or the policy is 'forbidden' or 'optional', else 0; with some it is 0 where the case is to abstain or the policy is 'forbidden'. A null policy is 'required', a null ``abstains`` false.
    """
    fits = citations.select("case_id", *_PLACE).join(allowed.select("case_id", *_PLACE).distinct().withColumn("fits", F.lit(1)), ["case_id", *_PLACE], "left")
    shares = fits.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("fits", F.lit(0))).alias("hits"))
    rows = cases.select("case_id", F.coalesce("abstains", F.lit(False)).alias("abstains"), F.coalesce("policy", F.lit("required")).alias("policy")).join(shares, "case_id", "left")
    none, silent = F.col("n").isNull(), F.col("abstains") | (F.col("policy") == "forbidden")
    return rows.select("case_id", F.when(silent, F.when(none, 1.0).otherwise(0.0)).when(none, F.when(F.col("policy") == "optional", 1.0).otherwise(0.0)).otherwise(F.col("hits") / F.col("n")).alias("precision"))


def score_diagnostics(rows: DataFrame, dimensions: list[str], gap: tuple[str, str]) -> DataFrame:
    """One row over (category, score, and a column for each dimension): strongest and weakest category by mean score, weakest dimension by mean, and how far the first dimension of ``gap`` is above the second, in two decimals. Of equal ones the first by name; nulls count nowhere, and without any value a result is null."""
    mean = lambda c: F.avg(F.col(c).cast("decimal(18,6)"))
    by = rows.groupBy("category").agg(mean("score").alias("m")).filter("m is not null")
    ends = by.agg(F.min_by("category", F.struct(-F.col("m"), F.col("category"))).alias("strongest_category"), F.min_by("category", F.struct("m", "category")).alias("weakest_category"))
    means = rows.agg(*(mean(d).alias(d) for d in dimensions))
    weakest = F.array_min(F.filter(F.array(*(F.struct(F.col(d).alias("m"), F.lit(d).alias("name")) for d in dimensions)), lambda x: x["m"].isNotNull()))["name"]
    # both sides are single rows
    return ends.join(F.broadcast(means.select(weakest.alias("weakest_dimension"), F.round(F.col(gap[0]) - F.col(gap[1]), 2).cast("double").alias("gap"))))


def run_report(runs: DataFrame) -> DataFrame:
    """kind, name, n: runs by 'source' of their answer and by 'warning' (each code as often as it is given), over (source, warnings). Runs without a source are counted under 'none'."""
    sources = runs.groupBy(F.coalesce("source", F.lit("none")).alias("name")).agg(F.count("*").alias("n"))
    codes = runs.select(F.explode("warnings").alias("name")).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    return sources.select(F.lit("source").alias("kind"), "name", "n").unionByName(codes.select(F.lit("warning").alias("kind"), "name", "n"))


def source_precedence(values: DataFrame, keys: list[str], order: tuple[str, ...] = SOURCES) -> DataFrame:
    """``keys``, value, source, value_cache, source_cache: of a value that several sources give, that of the source first in ``order`` that has one, and the next source's beside it (null without another). values: ``keys``, source, value. Other sources come last, by name; of equal sources the greatest value stands and no other is kept."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("source")), F.lit(0)), F.lit(len(order) + 1))
    best = values.filter("value is not null").groupBy(*keys, "source").agg(F.max("value").alias("value"))
    # at most one row a source
    ranked = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "source", "value"))).alias("told"))
    first, second = F.col("told")[0], F.get("told", F.lit(1))
    return ranked.select(*keys, first["value"].alias("value"), first["source"].alias("source"), second["value"].alias("value_cache"), second["source"].alias("source_cache"))


def recent_runs(runs: DataFrame, messages: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` latest runs (run_id, conversation_id, created_at, warnings) with the last message of a user in their conversation at or before them (null without one). Of equal times the greater run, and message, is later. messages: conversation_id, message_id, created_at, role, content."""
    latest = runs.select("run_id", "conversation_id", "created_at", "warnings").orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
    asked = messages.filter("role = 'user'").select("conversation_id", F.col("created_at").alias("asked_at"), "message_id", "content")
    # n rows by parameter
    found = asked.join(F.broadcast(latest.select("run_id", "conversation_id", "created_at")), "conversation_id").filter("asked_at <= created_at").groupBy("run_id").agg(F.max_by("content", F.struct("asked_at", "message_id")).alias("question"))
    return latest.join(found, "run_id", "left").select("run_id", "conversation_id", "created_at", "warnings", "question")


def keep_better(first: DataFrame, again: DataFrame) -> DataFrame:
    """query_id, documents, supported, atoms, retried: the outcome of a second search only where it covers more documents, or as many and supports more facets, or these too and has more atoms. Both: query_id, documents, supported, atoms; a query that has no second search keeps its first."""
    quality = ["documents", "supported", "atoms"]
    other = again.select("query_id", F.struct(*quality).alias("other"))
    rows = first.select("query_id", F.struct(*quality).alias("own")).join(other, "query_id", "left").withColumn("retried", F.coalesce(F.col("other") > F.col("own"), F.lit(False)))
    kept = F.when(F.col("retried"), F.col("other")).otherwise(F.col("own"))
    return rows.select("query_id", *(kept[c].alias(c) for c in quality), "retried")


def gap_variants(summary: DataFrame, most: int = 3) -> DataFrame:
    """query_id, variant_no, text, kind, weight: the first ``most`` uncovered labels of each query (query_id, gaps) as variants of it, for one more search."""
    gaps = summary.select("query_id", F.posexplode(F.slice("gaps", 1, most)).alias("at", "text"))
    return gaps.select("query_id", (F.col("at") + 1).alias("variant_no"), "text", F.lit("evidence_gap").alias("kind"), F.lit(1.1).alias("weight"))
