import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondage.llm import queries
from sondage.llm.quality_rules import FEATURES, apply_rules, binomial_cdf, select_cutoffs

from .conftest import TEXTS


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    repeated = len(covered)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed


def base(rows):
    return sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_counts_against_brute_force(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    more = [(20, "a b c d a b c # a b c", None, "x"), (21, "\n \n\x0b\nq\nq\n q", "de", "x"), (22, "x x x x x x", "de", "x"), (23, "one two", "de", None)]
    rows = apply_rules(docs.unionByName(spark.createDataFrame(more, docs.schema)), labels).collect()
    assert base(rows) == sorted((i, *brute(t)) for i, t in TEXTS + [m[:2] for m in more])
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert apply_rules(no_docs, labels).count() == 0


def test_query_on_the_given_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    assert base(queries.op1_quality_rules(spark, d).collect()) == sorted((r.doc_id, *brute(r.text)) for r in texts)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 50, 0.02), (7, 4000, 0.004), (40, 10_000, 0.004)])
def test_binomial_cdf(spark, k, n, p):
    got = spark.createDataFrame([(k, n)], "k long, n long").select(binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_cutoffs_are_the_loosest_that_catch_most_under_the_bound(spark):
    # 3000 good holdouts at 0..9, three of them at 55; 40 low ones at 95 and two at 35; too few in the stratum "small"
    rows = [("big", True, k % 10) for k in range(2997)] + [("big", True, 55)] * 3 + [("big", False, 95)] * 40 + [("big", False, 35)] * 2 + [("small", True, 0)] * 20 + [("small", False, 99)] * 5
    df = spark.createDataFrame([(s, g, *[v] * len(FEATURES)) for s, g, v in rows], f"stratum string, good boolean, {', '.join(f + ' int' for f in FEATURES)}")
    got = {(r.stratum, r.feature): r.cutoff for r in select_cutoffs(df).collect()}
    part, level = 0.02 / len(FEATURES), 0.05 / (2 * len(FEATURES))
    cdf = lambda k: math.fsum(math.comb(3000, j) * part**j * (1 - part) ** (3000 - j) for j in range(k + 1))
    assert got == {("big", f): 30 if cdf(3) <= level else 90 for f in FEATURES}
