"""Checks of answers against their evidence, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citations(answer: Column) -> Column:
    """The numbers of ``[n]`` references, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))


def verify_citations(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer, n_evidence): references out of 1..n, and whether the answer may stand: none out of range, and some where there is evidence."""
    cited = citations(F.col("answer"))
    wrong = F.filter(cited, lambda n: (n < 1) | (n > F.col("n_evidence")))
    return answers.select("answer_id", F.size(cited).alias("n_cited"), wrong.alias("unknown"), ((F.size(wrong) == 0) & ((F.col("n_evidence") == 0) | (F.size(cited) > 0))).alias("ok"))


def markdown_balanced(text: Column) -> Column:
    """Even numbers of ``**``, ``__`` and code fences; lines that are thematic breaks are no emphasis."""
    emphasis = F.regexp_replace(text, r"(?m)^[ \t]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$", "")
    even = lambda where, mark: F.regexp_count(where, F.lit(mark)) % 2 == 0
    return even(emphasis, r"\*\*") & even(emphasis, "__") & even(text, "```")


def group_coverage(answer: Column, groups: Column) -> Column:
    """Share of groups of aliases (array<array<string>>) of which the answer has one, without regard to case; 1 without groups. The share of forbidden groups that are absent is one less this."""
    hit = F.filter(groups, lambda g: F.exists(g, lambda a: F.contains(F.lower(answer), F.lower(a))))
    return F.when(F.size(groups) == 0, 1.0).otherwise(F.size(hit) / F.size(groups))


#: Phrases of an answer that abstains.
ABSTENTION_TERMS = ("没有足够证据", "证据不足", "未提供", "无法回答", "不能回答", "不可回答")
#: Our additions for English answers.
ABSTENTION_TERMS_EN = ("insufficient evidence", "cannot be determined", "not enough information", "not enough evidence")


def abstains(answer: Column, warnings: Column | None = None) -> Column:
    """Has the answer one of the phrases, or its warnings (array) the code INSUFFICIENT_EVIDENCE?"""
    said = F.lower(answer).rlike("|".join((*ABSTENTION_TERMS, *ABSTENTION_TERMS_EN)))
    return said if warnings is None else said | F.coalesce(F.array_contains(warnings, "INSUFFICIENT_EVIDENCE"), F.lit(False))


def groundedness(expected: Column, abstained: Column, n_citations: Column, recall: Column, precision: Column) -> Column:
    """Where abstention is expected: 1 for an answer that abstains without citations, else 0. Elsewhere the mean of recall (null: 0) and precision of its citations."""
    return F.when(expected, F.when(abstained & (n_citations == 0), 1.0).otherwise(0.0)).otherwise((F.coalesce(recall, F.lit(0.0)) + precision) / 2)


def document_coverage(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per query of ``wanted`` (query_id, document_id): documents with and without evidence (query_id, document_id)."""
    have = evidence.select("query_id", "document_id").distinct().withColumn("have", F.lit(1))
    return wanted.join(have, ["query_id", "document_id"], "left").groupBy("query_id").agg(F.count("have").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.col("document_id")))).alias("missing"))


def token_multiset_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Texts (id, text) whose numbers or citations differ as multisets: id, token, in_before, in_after. No row: nothing changed."""
    tokens = lambda df, name: df.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\d+\]|\d[\d,]*(?:\.\d+)?%?"), F.lit(0))).alias("token")).groupBy("id", "token").agg(F.count("*").alias(name))
    both = tokens(before, "in_before").join(tokens(after, "in_after"), ["id", "token"], "full_outer")
    return both.select("id", "token", F.coalesce("in_before", F.lit(0)).alias("in_before"), F.coalesce("in_after", F.lit(0)).alias("in_after")).filter("in_before <> in_after")
