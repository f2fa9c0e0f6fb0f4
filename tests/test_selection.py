"""Evidence selection and coverage, with examples of our own."""

import pytest
from pyspark.sql import functions as F

from sondage.functions.text import normal_key
from sondage.operators import coverage, mentions, selection


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "kind", "role"),
    [("12", "text", "boilerplate"), (None, "text", "boilerplate"), ("Confidential | draft", "text", "boilerplate"), ("Source: annual report", "text", "provenance"), ("plain", "notes", "provenance"), ("See https://x.org, implemented with care", "text", "methodology"), ("a | b", "table", "table"), ("x", "chart_points", "chart"), ("Margins under PRESSURE", "text", "risk_signal"), ("We optimize stock", None, "management_insight"), ("风险下降", "text", "risk_signal"), ("Sales were 5", "text", "business_fact")],
)
def test_roles(spark, text, kind, role):
    assert one(spark, text, selection.content_role(F.col("t"), F.lit(kind).cast("string"))) == role
    assert one(spark, text, selection.content_role(F.col("t"), F.lit("text"), F.lit("chart"))) == "chart"


def test_units(spark):
    of = lambda t: one(spark, t, selection.split_units(F.col("t")))
    assert of("One. Two! 三。 四") == ["One.", "Two!", "三。", "四"]
    assert of(" a\n\n b ") == ["a", "b"] and of("") == []
    long = "x" * 500 + ", " + "y" * 500
    assert of(long) == ["x" * 500 + ",", "y" * 500] and of("z" * 900) == ["z" * 900]


def test_quotes(spark):
    terms = F.array(F.lit("profit"), F.lit("north"))
    of = lambda t, kind="text": one(spark, t, selection.extract_quote(F.col("t"), terms, F.lit(kind)))
    assert of("Intro. Profit in the north rose. Nothing. More words. End.") == "Intro.\nProfit in the north rose."
    assert of("A. B. C.") == "A.\nB." and of("  ") == ""
    table = "region | profit\nsouth | 1\nnorth | 2\nsouth | 1\nwest | x"
    assert of(table) == "region | profit\nsouth | 1\nnorth | 2"
    assert of("h\na\nb\nc\nd", "table") == "h\na\nb\nc"


@pytest.mark.parametrize(("text", "heading"), [("Section two of this long report about everything we know and more words here.", True), ("FY OVERVIEW", True), ("Short title", True), ("It rose.", False), ("Sales fell", False), ("one two three four five six seven", False)])
def test_headings(spark, text, heading):
    assert one(spark, text, selection.heading_like(F.col("t"))) is heading


SCORED = "query_id long, chunk_id long, document_id string, slide_id long, role string, facet string, quote string, score decimal(28,10), rejected string"


def test_choice_under_limits(spark):
    from decimal import Decimal

    row = lambda c, d, s, quote, score, q=1, rejected=None: (q, c, d, s, "table", "f", quote, Decimal(score), rejected)
    words = lambda *k: " ".join(f"word{i}" for i in k)
    rows = [row(1, "a", 1, words(1, 2), 9), row(2, "a", 1, words(1, 2).upper() + "  ", 8), row(3, "a", 1, words(3, 4), 7), row(4, "a", 1, words(5, 6), 6), row(5, "b", 1, words(7, 8), 5), row(6, "c", 1, words(9), 4, rejected="role"), row(7, "c", 2, words(*range(20, 30)), 3), row(8, "c", 3, words(*range(20, 30), 31), 2)]
    requests = spark.createDataFrame([(1, []), (2, ["c", "b", "z"])], "query_id long, document_ids array<string>")
    rows += [(2, *r[1:]) for r in rows]
    got = selection.select_evidence(spark.createDataFrame(rows, SCORED), requests)
    of = lambda df, q: [r.chunk_id for r in df.filter(F.col("query_id") == q).orderBy("place").collect()]
    assert of(got, 1) == [1, 3, 5, 7]  # equal words, a third of a slide, and nearly equal words are left out
    assert of(got, 2) == [7, 5, 1, 3]  # documents that are named go first, in their order
    tight = selection.select_evidence(spark.createDataFrame(rows, SCORED), requests, most_chars=30)
    assert of(tight, 1) == [1, 3] and tight.filter("query_id = 1").first().n_over_budget == 3  # the other document, and both long ones
    assert of(selection.select_evidence(spark.createDataFrame(rows, SCORED), requests, most=2), 2) == [7, 5]


def test_coverage(spark):
    requests = spark.createDataFrame([(1, "What is the churn value in 2031 Q2? Why did it change", False), (2, "Summarise everything", True), (3, "churn。流失率是多少", False)], "query_id long, question string, deep boolean")
    glossary = spark.createDataFrame([("Churn", "流失率"), ("Churn", "customer loss")], "term string, alias string")
    facets = coverage.evidence_contract(requests, glossary)
    got = {(r.query_id, r.facet_no): r for r in facets.collect()}
    assert got[1, 1].subject == "churn" and got[1, 1].validators == ["direct_support", "numeric"] and got[1, 1].constraints == ["2031", "Q2"] and got[1, 1].aliases == ["churn", "customer loss", "流失率"]
    assert got[1, 2].validators == ["direct_support", "attribution", "comparison"] and got[2, 1].minimum == 2
    assert got[3, 1].semantic_required and got[3, 2].subject == "churn"
    row = lambda q, n, text, conf=1.0, kind="native": (q, f"e{n}", n, text, "business_fact", None, kind, conf, "d", n)
    evidence = [row(1, 1, "Customer loss was 4% in 2031 Q2"), row(1, 2, "Growth was driven by price"), row(2, 1, "All well"), row(3, 1, "流失率 4", kind="visual_model"), row(3, 2, "churn is low", conf=0.4)]
    proof = spark.createDataFrame(evidence, "query_id long, evidence_id string, place int, text string, role string, extraction string, source_kind string, confidence double, document_id string, slide_id int")
    found = {(r.query_id, r.facet_no): (r.status, r.missing) for r in coverage.evaluate_coverage(facets, proof).collect()}
    assert found[1, 1] == ("supported", []) and found[1, 2] == ("supported", [])
    assert found[2, 1] == ("partial", ["evidence_breadth", "context_breadth"])
    assert found[3, 1][0] == "unreliable" and found[3, 2][0] == "unreliable"
    none = {r.query_id: (r.total, r.ratio, r.gaps) for r in coverage.coverage_summary(coverage.evaluate_coverage(facets, proof.filter("query_id = 1"))).collect()}
    assert none[1] == (2, 1.0, []) and none[2] == (1, 0.0, ["Summarise everything"])


def test_mentions_equal_a_loop(spark):
    import random
    import re

    rng = random.Random(7)
    texts = [(i, "".join(rng.choice(["ab", "b a", "a.b", "中", "文中", " ", "-", "c9"]) for _ in range(40))) for i in range(60)] + [(99, None), (98, "")]
    labels = sorted({"".join(rng.choice("ab c.9-中文") for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"", "AB", "zz", "文"})
    want = set()
    for label in labels:
        key = label.strip(" ").lower()
        for i, text in texts:
            if key and text:
                exact = re.search(rf"(?<![a-z0-9]){re.escape(key)}(?![a-z0-9])", text) if re.fullmatch(r"[a-z0-9][a-z0-9 .&/-]*", key) else re.search(re.escape(key), text)
                if exact:
                    want.add((label, i, exact.start()))
    got = mentions.mention_join(spark.createDataFrame([(x, x) for x in labels], "label_id string, label string"), spark.createDataFrame(texts, "text_id long, text string"))
    assert want and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_full_width_keys(spark):
    assert one(spark, "ＡＢ－１２ c", normal_key(F.col("t"))) == "ab12c"
