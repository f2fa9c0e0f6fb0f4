"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Counts of each text are whole numbers per thousand, so that every cutoff is exact. On labelled holdouts, per stratum (language) and feature, a cutoff may be used if the exact binomial upper bound on its rate of false rejections stays below ``risk`` / features at level ``alpha`` / (strata * features): Bonferroni over strata and features, and a fixed sequence from the loosest cutoff inwards within each, which needs no correction. Of the cutoffs allowed, the one that rejects most low-quality holdouts is taken; of equal ones the loosest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: White space between words, as a class and as characters.
_BLANK, _BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Features that reject where they are large.
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "same_word_rate", "upper_rate")


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_upper, n_lines of each row. A null text has no words; a null stratum is ''."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.trim(F.col("text"), F.lit(_BLANKS))
    full_lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "")
    rows = rows.select(
        "id", "stratum", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK)).alias("words"), full_lines.alias("lines"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"), _removed(F.col("text"), _SYMBOLS).cast("long").alias("n_symbols"), _removed(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
    )
    # three words and their place, sorted: equal windows are neighbours
    windows = F.transform("words", lambda w, i: F.struct(F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i")))
    rows = rows.select("*", F.sort_array(F.slice(windows, 1, F.greatest(F.size("words") - 2, F.lit(0)))).alias("windows"))
    found = F.filter("windows", lambda x, k: ((k > 0) & (F.get("windows", k - 1)["w"] == x["w"])) | (F.coalesce(F.get("windows", k + 1)["w"] == x["w"], F.lit(False))))
    rows = rows.select("*", F.sort_array(F.transform(found, lambda x: x["i"])).alias("places")).drop("windows")
    # each window adds the words that the one before it doesn't cover
    covered = F.aggregate(F.transform("places", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("places", k - 1)))), F.lit(0), lambda a, x: a + x)
    return rows.select("id", "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), "n_upper", F.size("lines").cast("long").alias("n_lines"))


def _rates() -> dict[str, Column]:
    rate = lambda a, b: F.coalesce(F.floor(F.try_divide(F.lit(1000) * a, b)), F.lit(0)).cast("int")
    c = F.col
    return {"symbol_rate": rate(c("n_symbols"), c("word_chars")), "dup_line_rate": rate(c("n_dup_lines"), c("n_lines")), "repeat_rate": rate(c("n_repeat_words"), c("n_words")), "same_word_rate": rate(c("n_words") - c("n_distinct"), c("n_words")), "upper_rate": rate(c("n_upper"), c("word_chars"))}


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 7, where it is exact to 12 digits, carried back."""
    z = x + 7
    back = F.ln(x * (x + 1) * (x + 2)) + F.ln((x + 3) * (x + 4) * (x + 5) * (x + 6))
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - back


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed exactly term by term."""
    n = n.cast("double")
    odds = F.ln(F.lit(p)) - F.ln(F.lit(1 - p))
    term = lambda j: F.exp(_ln_gamma(n + 1) - _ln_gamma(j + 1.0) - _ln_gamma(n - j + 1) + j * odds + n * F.ln(F.lit(1 - p)))
    return F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda a, j: a + term(j.cast("double")))


def select_cutoffs(holdouts: DataFrame, *, risk: float = 0.02, alpha: float = 0.05, step: int = 10) -> DataFrame:
    """stratum, feature, cutoff: reject where the feature is above the cutoff.

    holdouts: stratum, good (boolean) and the columns of FEATURES. Strata without enough good holdouts get no cutoffs, nor does a feature that would reject no low-quality holdout.
    """
    long = holdouts.select("stratum", "good", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.least(F.col(f), F.lit(1000)).alias("value")) for f in FEATURES))).alias("x")).select("stratum", "good", "x.*")
    # a value v is rejected by the cutoffs below it: those up to step * ceil(v / step) - step
    bins = long.groupBy("stratum", "feature", (F.ceil(F.col("value") / step) * step - step).cast("int").alias("cutoff")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    above = Window.partitionBy("stratum", "feature").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum", "feature")
    sums = bins.select("stratum", "feature", "cutoff", F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("caught"), F.sum("good").over(whole).alias("n"))
    strata = holdouts.agg(F.countDistinct("stratum")).first()[0]
    part, level = risk / len(FEATURES), alpha / max(1, strata * len(FEATURES))
    allowed = sums.filter("cutoff >= 0 and caught > 0 and n > 0").filter(F.col("k") <= F.floor(F.col("n") * part)).filter(binomial_cdf(F.col("k"), F.col("n"), part) <= level)
    return allowed.groupBy("stratum", "feature").agg(F.max(F.struct("caught", "cutoff"))["cutoff"].alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", least_words: int = 50, most_repeated: int = 50, risk: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by (names of features, joined by commas).

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them in repeated windows. kept: neither base_failed nor above a cutoff of the row's stratum. Good holdouts are labelled documents with quality 1 that pass the base rules, low ones those with quality 0 that do; null labels are left out, and of several labels the lowest counts. Null and empty texts have no words and fail. Rows that repeat an id are judged each. An empty table gives no rows; without labels only the base rules hold.
    """
    counts = text_counts(docs, id_col, text_col, stratum_col)
    counts = counts.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))).withColumns(_rates())
    counts = materialize(counts, "text-counts")
    good = labels.filter("quality is not null").groupBy(F.col(id_col).alias("id")).agg((F.min("quality") > 0).alias("good"))
    holdouts = materialize(counts.filter("not base_failed").join(good, "id").select("stratum", "good", *FEATURES), "holdouts")
    cutoffs = select_cutoffs(holdouts, risk=risk, alpha=alpha).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("cutoffs"))
    judged = counts.join(materialize(cutoffs, "cutoffs"), "stratum", "left")
    by = F.filter(F.array(*(F.when(F.col(f) > F.col("cutoffs")[f], F.lit(f)) for f in FEATURES)), lambda x: x.isNotNull())
    judged = judged.withColumn("rejected_by", F.array_join(by, ","))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")
