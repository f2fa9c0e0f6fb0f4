"""Column functions on text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the query tokeniser: our choice, common English function words.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "what", "which", "with")
_CJK = r"[\x{4e00}-\x{9fff}]"
#: The three blocks whose characters count as a token each.
_WIDE = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition: full-width forms, ligatures and the like become plain characters."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return composed(text)


def normal_key(text: Column) -> Column:
    """Lower case, without anything but letters, digits and '_'; full-width forms count as their plain ones. Other compatibility forms (ligatures, circled digits) take ``nfkc`` before."""
    plain = F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
    return F.lower(F.regexp_replace(plain, r"(?U)[^\w]+", ""))


def normal_cell(text: Column) -> Column:
    """Lower-case ASCII letters, digits, '%' and CJK characters only."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9%\x{4e00}-\x{9fff}]", "")


def parse_number(text: Column) -> Column:
    """The first signed number, with thousands separators and the minus sign U+2212; null without one."""
    found = F.regexp_extract(F.replace(text, F.lit("−"), F.lit("-")), r"([-+]?\d[\d,]*(?:\.\d+)?)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def estimate_tokens(text: Column) -> Column:
    """CJK characters, and a quarter of the others rounded up."""
    cjk = F.regexp_count(text, F.lit(_WIDE))
    return (cjk + F.ceil((F.length(text) - cjk) / 4)).cast("int")


def truncate_to_tokens(text: Column, budget: Column | int) -> Column:
    """Text within ``budget`` estimated tokens as it is; else its longest prefix that fits with '…' after it, without blanks at its end. Nothing for a budget of 0 or less."""
    most = F.lit(budget) if isinstance(budget, int) else budget
    zero = F.struct(F.lit(0).alias("wide"), F.lit(0).alias("other"), F.lit(0).alias("at"), F.lit(0).alias("best"))

    def add(acc: Column, c: Column) -> Column:
        wide = acc["wide"] + c.rlike(_WIDE).cast("int")
        other = acc["other"] + (~c.rlike(_WIDE)).cast("int")
        at = acc["at"] + 1
        fits = ~c.rlike(r"^(?U)\s$") & (wide + F.ceil((other + 1) / 4) <= most)
        return F.struct(wide.alias("wide"), other.alias("other"), at.alias("at"), F.when(fits, at).otherwise(acc["best"]).alias("best"))

    # no longer prefix than four characters a token can fit
    letters = F.split(F.substring(text, F.lit(1), F.greatest(most * 4, F.lit(0))), "")
    best = F.aggregate(letters, zero, add, lambda acc: acc["best"])
    return F.when(text.isNull(), text).when(most <= 0, "").when(estimate_tokens(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), best), F.lit("…")))


def semantic_tokens(text: Column, least: int = 2) -> Column:
    """Distinct ASCII words of ``least`` letters or digits, and pairs of neighbouring CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9_]{{{least},}}"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(_CJK + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def query_terms(text: Column, most: int = 16) -> Column:
    return F.slice(F.array_except(semantic_tokens(text), F.array(*map(F.lit, STOPWORDS))), 1, most)


#: Years, quarters, halves and percentages, in this order.
_CONSTRAINTS = (r"\b(?:FY|CY)?20\d{2}\b", r"\bQ[1-4]\b", r"\bH[12]\b", r"20\d{2}年", r"第[一二三四1-4]季度", r"\b\d+(?:\.\d+)?%")


def hard_constraints(text: Column) -> Column:
    """Years, quarters, halves and percentages that a text names, kind by kind, each spelling once."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(0)) for p in _CONSTRAINTS)))


def answer_language(text: Column) -> Column:
    return F.when(text.rlike(_CJK), "zh").otherwise("en")


def clauses(text: Column) -> Column:
    """Parts between sentence marks, without blanks and commas at their ends, each once; the text itself where it has none."""
    parts = F.filter(F.transform(F.split(text, r"[?？!！;；。]+"), lambda c: F.trim(c, F.lit(" ,，"))), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_distinct(parts)).otherwise(F.array(text))


def deltas(text: Column, size: int = 48) -> Column:
    """Pieces of ``size`` characters."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chart_family(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.contains("bar") | k.contains("column"), "bar").when(k.contains("line") | k.contains("scatter"), "line").when(k.contains("pie") | k.contains("doughnut"), "share").otherwise("other")
